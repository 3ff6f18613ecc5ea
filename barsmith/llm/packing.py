"""Best-fit packing of tokenised documents by the sum of squares.

A document is its token ids and an end mark.  One that is longer than a sequence is cut into full pieces, the first of
which may be shorter.  A piece goes to the open bin, or to a new one, for which the sum of the squared counts of open
bins by residual gap becomes smallest (ties: the smallest gap).  Full bins leave.  That keeps the gaps varied, so that
almost every later length meets one it fills.

On a cluster pieces are dealt by a hash to bundles of about ``BUNDLE`` pieces, each packed by one task.  The bins that a
bundle leaves open are few; their pieces are dealt again to fewer bundles, round by round until one is left.  Each round
is written, so a lost executor cannot mix two packings.  Pieces of full length are sequences by themselves and are never
dealt.  A bundle is packed in an order fixed by its rows: pieces of over a
quarter of a sequence, longest first, then the others in the order of their checksums, which is as good as shuffled.
(Sorted throughout, the small ones come in runs of one length and leave one per cent unused; so, 0.05 %.)

Null texts count as empty (the end mark alone); rows with a null id are packed too; repeated rows are packed each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import small, utf8, written
from barsmith.llm.tokenizers import added, fast, ranks

LENGTH = 1024
END = 2
BUNDLE = 50_000


#: Bytes on whose class libraries may differ: control characters and the lead bytes of U+2000 and above.
_ODD = np.zeros(256, bool)
_ODD[[*range(0, 9), 11, 12, *range(14, 32), 127, *range(0xE2, 256)]] = True


def token_ids(texts: list[str], odd: np.ndarray, json_path: str, rank_path: str | None, pattern: str | None) -> list[np.ndarray]:
    """Ids of each text by the ``tokenizers`` file.

    ``rank_path`` names the same vocabulary as ranks.  Both split alike below U+2000 without control characters (tests
    walk through these code points), and ranks are encoded three times as fast; texts with other characters (``odd``) or
    with strings of added tokens, such as ``<|endoftext|>``, go to the ``tokenizers`` library.
    """
    if rank_path is None:
        return [np.array(x.ids, dtype="<u4") for x in fast(json_path).encode_batch(texts, add_special_tokens=False)]
    encode, names = ranks(rank_path, pattern).encode_ordinary, added(json_path)
    odd = [bool(o) or any(x in t for x in names) for t, o in zip(texts, odd)]
    rest = iter(fast(json_path).encode_batch([t for t, o in zip(texts, odd) if o], add_special_tokens=False))
    return [np.array(next(rest).ids if o else encode(t), dtype="<u4") for t, o in zip(texts, odd)]


def cut(size: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``size`` ids."""
    first = size % length or length
    return [(0, first), *((at, length) for at in range(first, size, length))] if size > length else [(0, size)]


def pieces(docs: DataFrame, json_path: str, rank_path: str | None = None, pattern: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, crc, and with ``with_ids`` the ids as binary)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for batch in small(batches):
            column = batch.column(1).fill_null("")
            texts = column.to_pylist()
            data, at = utf8(column)
            odd = np.diff(np.concatenate([[0], np.cumsum(_ODD[data])])[at]) > 0
            owner, rows, out = [], [], []
            for i, ids in enumerate(token_ids(texts, odd, json_path, rank_path, pattern)):
                whole = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                for no, (start, size) in enumerate(cut(len(whole) // 4, length)):
                    own = whole[4 * start : 4 * (start + size)]
                    owner.append(i)
                    rows.append((no, start, size, zlib.crc32(own)))
                    out.append(own if with_ids else None)
            no, start, size, crc = (pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), no, start, size, crc, pa.array(out, pa.binary())], ["id", "piece", "start", "length", "crc", "ids"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, piece int, start long, length long, crc long, ids binary")
    return made if with_ids else made.drop("ids")


def sum_of_squares(sizes: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, placed in the given order, and the gap of each bin."""
    counts = np.zeros(length + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    gaps: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        gap = length
        if size == length:
            best = None
        else:
            # The change of the sum if a bin of gap g gets the piece: 2 (n[g - size] - n[g]) + 2; a gap that closes
            # leaves the sum (1 - 2 n[g]); a new bin adds 2 n[length - size] + 1.
            here, after = counts[size:length], counts[: length - size]
            change = 2 * (after - here) + 2
            change[0] = 1 - 2 * counts[size]
            change = np.where(here > 0, change, np.iinfo(np.int64).max)
            at = int(change.argmin()) if len(change) else 0
            best = at + size if len(change) and change[at] <= 2 * counts[length - size] + 1 and here[at] > 0 else None
        if best is None:
            which = len(gaps)
            gaps.append(length)
        else:
            gap = best
            which = stacks[gap].pop()
            counts[gap] -= 1
        bins.append(which)
        offsets.append(length - gap)
        gaps[which] = gap - size
        if gap > size:
            stacks[gap - size].append(which)
            counts[gap - size] += 1
    return bins, offsets, gaps


def _pack(rows: DataFrame, round_no: int, bundles: int, length: int) -> DataFrame:
    """Rows with (sequence, offset, open) after one round over ``bundles`` bundles."""
    names = rows.columns
    dealt = rows.withColumn("bundle", F.pmod(F.xxhash64(*[F.col(c) for c in names], F.monotonically_increasing_id(), F.lit(round_no)), F.lit(bundles)))

    def each(keys, batches):
        table = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("crc", "ascending")])
        size, crc = np.array(table.column("length")), np.array(table.column("crc"))
        small = size <= length // 4
        table = table.take(pa.array(np.lexsort((np.where(small, crc, -size), small))))
        bins, offsets, gaps = sum_of_squares(table.column("length").to_pylist(), length)
        own = (int(keys[0].as_py()) << 24) + np.array(bins, np.int64) + (round_no << 52)
        gap = np.array(gaps, np.int64)[np.array(bins, np.int64)]
        return table.drop(["bundle"]).append_column("sequence", pa.array(own)).append_column("offset", pa.array(offsets, pa.int64())).append_column("open", pa.array(gap > 0))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.groupBy("bundle").applyInArrow(each, f"{kinds}, sequence long, offset long, open boolean")


def pack(rows: DataFrame, length: int = LENGTH, bundle: int = BUNDLE) -> DataFrame:
    """``rows`` of ``pieces`` with the sequence of each and its place there."""
    rows = written(rows, "pieces")
    names = rows.columns
    alone = rows.where(F.col("length") == length).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    left, out, round_no = rows.where(F.col("length") < length), [alone], 0
    n = left.count()
    while True:
        bundles = max(1, -(-n // bundle))
        packed = written(_pack(left, round_no, bundles, length), "packed")
        if bundles == 1:
            out.append(packed.drop("open"))
            break
        out.append(packed.where("NOT open").drop("open"))
        left = packed.where("open").select(*names)
        before, n = n, left.count()
        if n > before // 2:  # lengths that do not fit each other at all: another round would not change that
            out.append(packed.where("open").drop("open"))
            break
        round_no += 1
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done


def digests(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")
