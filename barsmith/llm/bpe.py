"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

A text of at most ``chunk`` code points is one piece.  A longer one is dealt out as chunks that overlap by ``overlap``:

1. every chunk is split into pre-tokens on its own, from its first code point on, wherever that falls in a word;
2. the pre-token boundaries of neighbours are compared in their overlap.  Matching at a position depends on what
   follows only, so from the first boundary that both have (*resynchronisation*) both go on alike; each chunk keeps what
   lies between its own and the next resynchronisation;
3. these pieces are encoded apart and their ids are joined in order.

Boundaries near the end of a chunk are not trusted (more text could have lengthened the match), nor are boundaries
after white space (a piece that ends there would be split otherwise than the whole text).  A text without a common
boundary in some overlap, such as one unbroken run of letters, is encoded as one piece: exact, only less parallel.

Null texts count as empty; null ids are kept; repeated rows are encoded each for itself; other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import small
from barsmith.llm.tokenizers import pretokens, ranks

CHUNK, OVERLAP = 32768, 1024
#: Code points before a cut in which a match may depend on what follows the cut.
_MARGIN = 3


def boundaries(text: str, pattern: str, whole: bool) -> list[int]:
    """Ends of pre-tokens after which a text can be cut; without those near the end unless the text is ``whole``."""
    last = len(text) if whole else len(text) - _MARGIN
    return [m.end() for m in pretokens(pattern).finditer(text) if m.end() <= last and not text[m.end() - 1].isspace()]


def encode(text: str, path: str, pattern: str) -> np.ndarray:
    return np.array(ranks(path, pattern).encode_ordinary(text), dtype="<u4")


def decode(ids, path: str, pattern: str) -> bytes:
    """The bytes of the tokens, one after another; not always UTF-8, if ids were cut."""
    return ranks(path, pattern).decode_bytes(ids.tolist() if isinstance(ids, np.ndarray) else list(ids))


def stitch(text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The same in one process: a plain statement of the rule, for tests and for single texts."""
    starts = list(range(0, max(1, len(text)), chunk))
    found = [[s + x for x in boundaries(text[s : s + chunk + overlap], pattern, s + chunk + overlap >= len(text))] for s in starts]
    cuts = [0]
    for before, after, s in zip(found, found[1:], starts[1:]):
        both = set(before) & set(after)
        common = [x for x in both if s <= x <= s + overlap]
        if not common:
            return encode(text, path, pattern)
        cuts.append(min(common))
    return np.concatenate([encode(text[a:b], path, pattern) for a, b in zip(cuts, [*cuts[1:], len(text)])])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (id, ids: little-endian unsigned 32-bit integers as binary, decoded: binary), one for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("size", F.length("text"))

    def whole(batches):
        for batch in small(batches):
            ids = [encode(x, path, pattern) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decode(x, path, pattern) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    short = own.where(F.col("size") <= chunk).select("id", "text").mapInArrow(whole, f"id {kind}, ids binary, decoded binary")

    # The scan deals the same rows to the same partitions each time, so this number names a row for good.
    long = own.where(F.col("size") > chunk).withColumn("row", F.monotonically_increasing_id())

    def deal(batches):
        for batch in small(batches):
            for row, (size, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                numbers = range((size - 1) // chunk + 1)
                for a in range(0, len(numbers), 64):  # one pass over a text of any length
                    own = numbers[a : a + 64]
                    at = pa.array([row] * len(own), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(own, pa.int32()), pa.array([text[n * chunk : (n + 1) * chunk + overlap] for n in own], pa.string())], ["row", "id", "size", "no", "text"])

    pieces = long.select("row", "id", "size", "text").mapInArrow(deal, f"row long, id {kind}, size int, no int, text string").repartition("row", "no")

    def split(batches):
        for batch in small(batches):
            heads, tails = [], []
            for no, size, text in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                start = no * chunk
                found = boundaries(text, pattern, start + len(text) >= size)
                heads.append([start + x for x in found if x <= overlap])
                tails.append([start + x for x in found if x >= chunk])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["row", "id", "size", "no", "text", "head", "tail"])

    marked = pieces.mapInArrow(split, f"row long, id {kind}, size int, no int, text string, head array<int>, tail array<int>")
    at = F.expr("CASE WHEN no = 0 THEN 0 ELSE array_min(array_intersect(head, lag(tail) OVER (PARTITION BY row ORDER BY no))) END")
    marked = marked.withColumn("at", at).drop("head", "tail")
    marked = marked.withColumn("until", F.expr("CASE WHEN (no + 1) * %d >= size THEN size ELSE lead(at) OVER (PARTITION BY row ORDER BY no) END" % chunk))
    marked = marked.withColumn("broken", F.expr("max(at IS NULL) OVER (PARTITION BY row)"))

    def piecewise(batches):
        for batch in small(batches):
            out = []
            for no, text, at, until, broken in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6))):
                # Where neighbours don't resynchronise, the chunks go on as text and the whole is encoded at the end.
                out.append((b"", text[:chunk]) if broken else (encode(text[at - no * chunk : until - no * chunk], path, pattern).tobytes(), None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["row", "id", "no", "ids", "text"])

    parts = marked.select("row", "id", "no", "text", "at", "until", "broken").mapInArrow(piecewise, f"row long, id {kind}, no int, ids binary, text string")
    joined = parts.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("no", "ids", "text"))).alias("parts"))

    def join(batches):
        for batch in small(batches):
            ids = []
            for parts in batch.column(1).to_pylist():
                ids.append(encode("".join(p["text"] for p in parts), path, pattern).tobytes() if parts[0]["text"] is not None else b"".join(p["ids"] for p in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([decode(np.frombuffer(x, "<u4"), path, pattern) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    return short.unionByName(joined.select("id", "parts").mapInArrow(join, f"id {kind}, ids binary, decoded binary"))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of tokens and digests of ids and of decoded bytes."""
    return encoded.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


