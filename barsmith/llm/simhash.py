"""SimHash fingerprints and near-duplicate classes by pivot distance tables.

Texts have A-Z lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; shingles are runs of ``shingle`` words joined by one space,
repeats included (fewer words: the whole sequence).  A bit of the fingerprint is 1 if it is set in over half of the
shingles' XXH64 hashes (seed 42).  No words, or a null text: fingerprint zero, linked like any other.

Linking works on *distinct* fingerprints, so exact copies cost one row each:

1. the distances of each fingerprint to ``PIVOTS`` reference fingerprints are precomputed once (the pivot table), go with it
   wherever it is dealt, and are all that pairs are first compared by;
2. the 64 bits are cut into six blocks; two fingerprints that differ in up to three bits agree in three blocks, so each
   fingerprint is dealt to its 20 triples of blocks and meets its neighbours in one of them;
3. within a triple, a pair is discarded if its pivot distances differ by more than ``most`` anywhere (the triangle
   inequality makes this safe) and verified by its Hamming distance otherwise.  A triple's fingerprints yield a
   spanning forest, never all pairs.  A triple of over ``HOT`` fingerprints is cut into blocks, and each pair of blocks is
   one task's work: no task holds an unbounded group and no link is lost;
4. components come from alternating large-star and small-star steps over the forest, each written to the shared folder.

Repeated ids: every row gets the component of its own fingerprint.  The component's name is its smallest non-null id
(null if it has none); rows with a null id take part.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import small, utf8, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PIVOTS = 16
HOT = 8192
_CUTS = (0, 11, 22, 33, 43, 53, 64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    line = b" ".join(WORD.findall(text.lower()))
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    if len(starts) <= shingle:
        return digest(line, seed)
    ones, n = np.zeros(64, np.int64), len(starts) - shingle + 1
    for at in range(0, n, 1 << 16):  # a very long text needs no more memory than this many hashes
        upto = min(n, at + (1 << 16))
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:upto], ends[at + shingle - 1 :])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp: the fingerprint as a signed long)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for batch in small(batches):
            data, at = utf8(batch.column(1))
            prints = np.array([fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(at[:-1], at[1:])], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, fp long")


def pivots() -> np.ndarray:
    """Reference fingerprints, spread over the cube by a fixed rule."""
    from barsmith.llm.rolling import mix

    return mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int16)


def with_pivots(prints: DataFrame) -> DataFrame:
    """Rows (fp, table: the distances to the pivots, a byte each)."""

    def each(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in pivot_table(fps).astype(np.uint8)], pa.binary())], ["fp", "table"])

    return prints.select("fp").mapInArrow(each, "fp long, table binary")


def forest(prints: np.ndarray, table: np.ndarray, most: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of distinct fingerprints linked at ``most`` or fewer differing bits; ``table``: their distances
    to the pivots."""
    n = len(prints)
    table, parent = table.astype(np.int16), np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    # Neighbours differ by at most ``most`` in the first coordinate: sorted by it, a row looks ahead only so far.
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    ends = np.searchsorted(first, first + most, side="right")
    for a in range(0, n, block):
        rows = order[a : a + block]
        for c in range(a, int(ends[min(n, a + block) - 1]), 4096):
            cols = order[c : min(c + 4096, int(ends[min(n, a + block) - 1]))]
            near = np.ones((len(rows), len(cols)), bool)
            for k in range(PIVOTS):
                near &= np.abs(table[rows, k][:, None] - table[cols, k][None, :]) <= most
            i, j = np.nonzero(near)
            ok = (np.arange(a, a + len(rows))[i] < np.arange(c, c + len(cols))[j]) & (np.bitwise_count(prints[rows[i]] ^ prints[cols[j]]) <= most)
            for x, y in zip(rows[i[ok]].tolist(), cols[j[ok]].tolist()):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    left.append(x)
                    right.append(y)
    return prints[left], prints[right]


def _blocks() -> list[int]:
    return [((1 << (b - a)) - 1) << a for a, b in zip(_CUTS[:-1], _CUTS[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) that connect just what links at ``most`` (up to 3) differing bits; ``prints`` has distinct ``fp`` and their
    ``table`` (see ``with_pivots``)."""
    if not 0 <= most <= 3:
        raise ValueError("three equal blocks of six are sure for up to three differing bits")
    masks = [sum(x) for x in combinations(_blocks(), 3)]
    deals = F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    dealt = prints.select("fp", "table", F.explode(deals).alias("k")).select("fp", "table", "k.no", "k.bits")
    counts = dealt.groupBy("no", "bits").agg(F.count("*").alias("n")).where("n > 1")
    # A crowded triple is cut into blocks by a hash, and each pair of blocks is a cell of its own.
    met = dealt.join(counts, ["no", "bits"]).withColumn("cut", F.ceil(F.col("n") / HOT).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).where("cut = 1 OR own != other")
    cells = met.groupBy("no", "bits", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"))
    gathered = cells.agg(F.collect_list(F.struct("fp", "table")).alias("rows")).where("size(rows) > 1").select("rows")

    def within(batches):
        for batch in small(batches):
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for rows in batch.column(0):
                rows = rows.values
                fps, tables = rows.field("fp").to_numpy().astype(np.int64).view(np.uint64), np.frombuffer(b"".join(rows.field("table").to_pylist()), np.uint8).reshape(-1, PIVOTS)
                order = np.argsort(fps)
                x, y = forest(fps[order], tables[order], most)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return gathered.mapInArrow(within, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root): the smallest node of each component, for nodes with edges (columns a, b, of one long type).

    Large-star links a node's larger neighbours to its smallest; small-star links its smaller ones.  Every round is
    written; the rounds end when one changes nothing.  Groups hold neighbours of one node only, and hubs are met by
    aggregates with partial sums, not by lists.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))) if larger else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        met = both.join(least, "a")
        if larger:
            made = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            made = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return made.where("a != b").distinct()

    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    stamp = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = stamp(now)
    for _ in range(most_rounds):
        now = written(star(star(now, True), False), "stars")
        after = stamp(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, shingle: int = 3) -> DataFrame:
    """Rows (id, fp, component), one for each row of ``docs``."""
    prints = written(with_fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(written(with_pivots(distinct), "pivots"), most))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.select("fp", "root").join(names, "root").select("fp", "component")
    return prints.join(classes, "fp").select("id", "fp", "component")


def digests(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
