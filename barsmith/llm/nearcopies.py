"""Near copies by word shingles: SimHash fingerprints with pivot tables, partial fingerprints beyond, and an exact check.

Two texts are linked if the sets of their five-word shingles (ASCII lower case; fewer words: the whole sequence) have a
Jaccard similarity of ``least`` or more.  Exact copies are one text from the start.

Candidates come by the method of ``simhash`` first: each text's fingerprint, its distances to the pivots, triples of equal bit
blocks, pairs at 3 or fewer differing bits (``print_pairs``).  The exact similarity decides on each of these pairs.

Fingerprints of similar texts at 0.8 differ in about 10 of 64 bits, up to 20; no blocking of 64 bits finds such pairs without
most of all pairs.  So further candidates meet by *partial* fingerprints: each of ``TABLES`` tables hashes the two shingles with
the smallest values under the table's own two orders.  A pair at 0.8 misses one table with a chance of 0.36, all twelve with
5 in a million.  In a bucket, a pair is discarded only if its sets surely differ by too much: by their sizes, or by how
many shingles they have of each of ``KINDS`` kinds (the differences of these counts add up to no more than the shingles that
one set has and the other has not).  Every other pair is decided by the exact similarity of the sets.  A bucket yields a spanning forest, never all its pairs.  A bucket of
over ``HOT`` texts is cut into blocks, and each pair of blocks is a cell that one task compares, so that no task needs all of
it and no link is lost.

Texts without words are copies of each other.  Null texts count as empty; rows with a null id take no part; rows with one
id stay or go together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm import simhash
from barsmith.llm.common import groups, small, utf8, written
from barsmith.llm.rolling import Prefix, byte_codes, mix, words
from barsmith.llm.simhash import components

SHINGLE = 5
LEAST = 0.8
TABLES = 12
KINDS = 128
HOT = 1024
#: Rows and shingles of one matrix product, and the candidates up to which sets are met one by one.
BLOCK, COLUMNS, FEW = 256, 2048, 2000
#: Pairs whose counts are compared at a time.
PAIRS = 1 << 14
TEXT_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each text, one after another, and the n + 1 bounds of the texts; one at least each."""
    data = _LOWER[data]
    start, end, first = words(data, at)
    codes = Prefix(byte_codes(0)[data]).slices(start, end)
    n_words = np.diff(first)
    n = np.maximum(n_words - size + 1, 1)
    bound = np.concatenate([[0], np.cumsum(n)])
    no = np.arange(bound[-1]) - np.repeat(bound[:-1], n)
    a = np.repeat(first[:-1], n) + no
    b = np.minimum(a + size, np.repeat(first[1:], n))
    # The number of words is part of the hash, so a short text is no part of a longer one.
    return mix(Prefix(codes, 1).slices(a, b) + (b - a).astype(np.uint64)), bound


def sketch(hashes: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The 2 x TABLES smallest values of each text."""
    least = np.empty((len(bound) - 1, 2 * TABLES), np.uint64)
    for t in range(2 * TABLES):
        least[:, t] = np.minimum.reduceat(mix(hashes ^ np.uint64((0x9E3779B97F4A7C15 * (t + 1)) & (2**64 - 1))), bound[:-1])
    return least


def kind_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles of each kind each set has."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds = (np.concatenate(sets) % np.uint64(KINDS)).astype(np.int64)
    return np.bincount(rows * KINDS + kinds, minlength=len(sets) * KINDS).reshape(len(sets), KINDS)


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` has in common with each of ``b``: products of 0/1 matrices, some columns at a time."""
    names, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    in_a, in_b = place[: len(rows_a)], place[len(rows_a) :]
    both = np.intersect1d(in_a, in_b)
    new = np.full(len(names), -1)
    new[both] = np.arange(len(both))
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(both), COLUMNS):
        parts = []
        for rows, cols, n in ((rows_a, new[in_a], len(a)), (rows_b, new[in_b], len(b))):
            ok = (cols >= first) & (cols < first + COLUMNS)
            part = np.zeros((n, min(COLUMNS, len(both) - first)), np.float32)
            part[rows[ok], cols[ok] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def cell_forest(ids: np.ndarray, counts: np.ndarray, sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that connect what links in one cell: rows of side 0 with rows of side 1, or all rows if there is one side only.

    ``counts`` are the ``kind_counts`` of the sets; they discard only what can't link (zeros discard nothing).
    """
    one = (side == side[0]).all()
    left = np.arange(len(ids)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    table, sizes = counts.reshape(len(ids), -1).astype(np.int32), np.array([len(s) for s in sets])
    parent, out = list(range(len(ids))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for first in range(0, len(left), BLOCK):
        rows = left[first : first + BLOCK]
        near = np.minimum(sizes[rows][:, None], sizes[right][None, :]) >= least * np.maximum(sizes[rows][:, None], sizes[right][None, :])
        if one:
            near &= rows[:, None] < right[None, :]
        i, j = np.nonzero(near)
        # Sets of a and b shingles at ``least`` differ in (1 - least) / (1 + least) (a + b) at most; the rest is for rounding.
        most = ((1 - least) / (1 + least) + 1e-9) * (sizes[rows[i]] + sizes[right[j]])
        ok = np.ones(len(i), bool)
        for k in range(0, len(i), PAIRS):
            ok[k : k + PAIRS] = np.abs(table[rows[i[k : k + PAIRS]]] - table[right[j[k : k + PAIRS]]]).sum(axis=1) <= most[k : k + PAIRS]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if len(i) > FEW:
            (some, m), (others, n) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            both = shared([sets[x] for x in rows[some]], [sets[x] for x in right[others]])[m, n]
        else:
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(rows[i], right[j])])
        linked = both >= least * (sizes[rows[i]] + sizes[right[j]] - both)
        for x, y in zip(rows[i[linked]].tolist(), right[j[linked]].tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(ids[x]), int(ids[y])))
    return out


def print_pairs(firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (id, fp) that connect just what their fingerprints link at 3 or fewer bits, by pivot tables (see ``simhash``)."""
    prints = written(firsts.groupBy("fp").agg(F.min("id").alias("own")), "prints")
    forest = simhash.links(written(simhash.with_pivots(prints), "pivots"))
    a, b = (prints.select(F.col("fp").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    same = firsts.join(prints, "fp").where("id != own").select(F.col("own").alias("a"), F.col("id").alias("b"))
    return forest.join(a, "a").join(b, "b").select(F.col("own_a").alias("a"), F.col("own_b").alias("b")).union(same)


def links(docs: DataFrame, id_col: str, text_col: str, least: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Exact copies as (id, first), and edges (a, b) between firsts."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL").withColumn("digest", F.sha2("text", 256))

    def sketches(batches):
        for batch in small(batches):
            data, at = utf8(batch.column(2))
            tops = [np.zeros((0, 2 * TABLES), np.uint64)]
            prints = np.array([simhash.fingerprint(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])], np.uint64)
            for a, b in groups(at, TEXT_BYTES):
                tops.append(sketch(*shingle_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a], shingle)))
            m = np.concatenate(tops).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, m.size + 1, 2 * TABLES, dtype=np.int32), m.ravel()), pa.array(prints.view(np.int64))], ["id", "digest", "least", "fp"])

    known = written(own.select("id", "digest", "text").mapInArrow(sketches, "id long, digest string, least array<long>, fp long"), "sketches")
    firsts = known.groupBy("digest").agg(F.min(F.struct("id", "least", "fp")).alias("r")).select("digest", "r.*")
    firsts = written(firsts, "firsts")
    copies = known.join(firsts.select("digest", F.col("id").alias("first")), "digest").select("id", "first")

    keys = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.struct(t.alias("no"), F.xxhash64(F.element_at("least", 2 * t + 1), F.element_at("least", 2 * t + 2)).alias("key")))
    dealt = firsts.select("id", F.explode(keys).alias("k")).select("id", "k.no", "k.key")
    crowds = dealt.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt.join(crowds, ["no", "key"])
    # A crowded bucket is cut into blocks by ids, and every pair of blocks is a cell of its own.
    cut = F.ceil(F.col("n") / HOT).cast("int")
    met = met.withColumn("cut", cut).withColumn("own", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    met = met.select("no", "key", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id")
    # A pair of near fingerprints is a cell of two.
    pair = print_pairs(firsts.select("id", "fp")).select(F.lit(TABLES).alias("no"), F.xxhash64("a", "b").alias("key"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("side"), F.explode(F.array("a", "b")).alias("id"))
    met = written(met.unionByName(pair), "cells")

    def shingles(batches):
        for batch in small(batches):
            data, at = utf8(batch.column(1))
            out = []
            for a, b in groups(at, TEXT_BYTES):
                hashes, bound = shingle_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a], shingle)
                # 40 bits of each are enough inside a bucket and save a third of what is dealt.
                out += [np.unique(hashes[x:y] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for x, y in zip(bound[:-1], bound[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "shingles"])

    wanted = firsts.select("id", "digest").join(met.select("id").distinct(), "id")
    sets = own.join(wanted, ["id", "digest"]).select("id", "text").mapInArrow(shingles, "id long, shingles binary")
    gathered = met.join(sets, "id").groupBy("no", "key", "row", "col").agg(F.collect_list(F.struct("id", "side", "shingles")).alias("rows")).where("size(rows) > 1").select("rows")

    def decide(batches):
        for batch in small(batches):
            out = []
            for rows in batch.column(0):
                rows = rows.values
                ids = np.asarray(rows.field("id"))
                order = np.argsort(ids, kind="stable")
                binary = rows.field("shingles")
                unpacked = []
                for i in order.tolist():
                    raw = np.frombuffer(binary[i].as_buffer(), np.uint8).reshape(-1, 5)
                    wide = np.zeros((len(raw), 8), np.uint8)
                    wide[:, :5] = raw
                    unpacked.append(wide.view("<u8").ravel())
                out += cell_forest(ids[order], kind_counts(unpacked), unpacked, np.asarray(rows.field("side"))[order], least)
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return copies, gathered.mapInArrow(decide, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, component): the smallest id that links of near copies reach, for every id."""
    copies, edges = links(docs, id_col, text_col, least, shingle)
    roots = components(edges)
    return copies.join(roots, copies["first"] == roots.node, "left").select("id", F.coalesce("root", "first").alias("component")).distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without documents that are near copies of one with a smaller id."""
    gone = classes(docs, id_col, text_col, least, shingle).where("id != component").select(F.col("id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")
