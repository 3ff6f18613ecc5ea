"""Lempel-Ziv phrase fingerprints: compression-like similarity of whole texts.

The UTF-8 bytes of a text are parsed from left to right into dictionary phrases: each is the longest known phrase and one
more byte (an unfinished last phrase is a known one and adds nothing).  The set of phrases is hashed and kept as a
minimum-hash signature of ``BINS`` bins: a phrase falls in a bin by its hash, and each bin keeps the smallest 32 bits
(``ffffffff``: none), enough that minima of unrelated long texts don't agree by chance.  The likeness of two signatures is the share of equal bins among those that either uses, an estimate of
the Jaccard similarity of the phrase sets; two texts without phrases have likeness 1.

``edits`` also fingerprints each document's edited text, whose last half comes from the next document in ascending order
of ids.  Documents are dealt to ranges of ids and sorted there; each task goes through its range with one document in
hand, parses the half that text and edited text share once, and hands over only its first and last document, which
neighbouring ranges need.  These, two for each partition, meet in a join.

Null texts count as empty.  Null ids come first; rows with one id follow in the order of the hashes of their texts, so
that one id can be spread over several ranges.  A single document is its own next one.  Other columns are not read.  An empty table gives
an empty result.

Memory: a parse keeps its dictionary, some 100 to 140 bytes for each phrase of 5 to 12 bytes of prose, and a document
fingerprinted with its edit keeps two (of the shared half, and a copy of it that goes on), one text at a time.  A text of
100 MB so needs some 3 GB; none is cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import partitions_for, small, written
from barsmith.llm.rolling import Prefix, byte_codes

BINS = 128
_NONE = 0xFFFFFFFF


class Parse:
    """A parse that can be continued."""

    def __init__(self, known: dict[int, int] | None = None, rest: bytes = b"", node: int = 0):
        self.known, self.rest, self.node = known if known is not None else {}, rest, node

    def branch(self) -> Parse:
        return Parse(self.known.copy(), self.rest, self.node)

    def feed(self, data: bytes) -> np.ndarray:
        """The signature of the phrases that end in ``data``, which follows what was fed before."""
        known, node, ends, i = self.known, self.node, [], len(self.rest)
        get, add = known.get, ends.append
        # A phrase is a number; the phrase with one more byte is found under (number, byte).
        count = len(known) + 1
        for byte in data:
            i += 1
            key = node << 8 | byte
            node = get(key)
            if node is None:
                known[key] = count
                count += 1
                node = 0
                add(i)
        data = self.rest + data
        self.node, self.rest = node, data[ends[-1] if ends else 0 :]
        end = np.array(ends, np.int64)
        return signature(data, np.concatenate([[0], end[:-1]]) if ends else end, end)


def signature(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.full(BINS, _NONE, np.uint32)
    if len(end):
        hashes = Prefix(byte_codes(2)[np.frombuffer(data, np.uint8)], 2).slices(start, end)
        value = np.minimum(hashes >> np.uint64(32), np.uint64(_NONE - 1)).astype(np.uint32)
        np.minimum.at(out, (hashes % np.uint64(BINS)).astype(np.int64), value)
    return out


def fingerprint(text: str) -> np.ndarray:
    return Parse().feed(text.encode())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != _NONE) | (b != _NONE)
    return float((a == b)[used].mean()) if used.any() else 1.0


def as_hex(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


class _Open:
    """A document that waits for the next one."""

    def __init__(self, id_, text: str):
        self.id, self.text, self.n = id_, text, len(text)
        self.half = text[: self.n - self.n // 2]
        self.shared = Parse()
        first = self.shared.feed(self.half.encode())
        self.first = first
        self.print = np.minimum(first, self.shared.branch().feed(text[len(self.half) :].encode()))

    def close(self, text: str, print_: np.ndarray) -> tuple:
        """The row of this document, given the next one's text and fingerprint."""
        tail = text[: self.n // 2]
        edited = np.minimum(self.first, self.shared.feed(tail.encode()))
        return (self.id, self.n, hashlib.sha256((self.half + tail).encode()).hexdigest(), as_hex(self.print), as_hex(edited), likeness(self.print, edited), likeness(self.print, print_))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(rows, id_type, more=()):
        columns = list(zip(*rows)) if rows else [()] * (len(names) + len(more))
        arrays = [pa.array(c, t or id_type) for c, t in zip(columns, [*types, *(t for _, t in more)])]
        return pa.RecordBatch.from_arrays(arrays, [*names, *(n for n, _ in more)])

    edge = (("range", pa.int32()), ("place", pa.string()), ("text", pa.string()))

    def walk(batches):
        at, waiting, id_type = TaskContext.get().partitionId(), None, None
        for batch in small(batches):
            rows, id_type = [], batch.schema.field(0).type
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = _Open(id_, text)
                if waiting is None:
                    rows.append((id_, None, None, None, None, None, None, at, "first", text))
                else:
                    rows.append((*waiting.close(text, now.print), at, "row", None))
                waiting = now
            yield batch_of(rows, id_type, edge)
        if waiting is not None:
            yield batch_of([(waiting.id, None, None, None, None, None, None, at, "last", waiting.text)], id_type, edge)

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ranged = own.repartitionByRange(partitions_for(docs), "id", "hash").sortWithinPartitions("id", "hash").select("id", "text")
    walked = written(ranged.mapInArrow(walk, f"{kinds}, range int, place string, text string"), "ranges")

    # Every range that has documents is followed by the next such range, the last by the first: a few numbers each.
    firsts = walked.where("place = 'first'").select(F.col("range").alias("next"), F.col("text").alias("next_text"))
    order = firsts.select(F.col("next").alias("range")).withColumn("next", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy())))
    lasts = walked.where("place = 'last'").select("id", "text", "range").join(order, "range").join(firsts, "next").select("id", "text", "next_text")

    def meet(batches):
        for batch in small(batches):
            yield batch_of([_Open(i, a).close(b, fingerprint(b)) for i, a, b in zip(*(c.to_pylist() for c in batch.columns))], batch.schema.field(0).type)

    return walked.where("place = 'row'").select(*names).unionByName(lasts.mapInArrow(meet, kinds))


def digests(edited: DataFrame) -> DataFrame:
    return edited.withColumnRenamed("id", "doc_id")
