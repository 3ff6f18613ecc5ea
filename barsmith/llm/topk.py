"""Exact top-k inner products by a uniform threshold in three phases.

Vectors are quantised to ``floor(scale * x)``.  Candidate rows are dealt evenly to blocks, query rows too; a *cell* is one
block of queries against one block of candidates, a matrix product in memory of bounded size.

1. *Gather*: every cell makes, for each query, the list of its best entries, and a task sends the best of the cells that
   it has one after another: of k entries, the share that its blocks are of all.  Together these
   are k entries or more, so the k-th best of them bounds the true k-th score from below.
2. *Cut off*: that bound is written beside the query blocks (it grows with the queries, so it isn't broadcast) and goes
   back to the cells.  Every cell sends the entries that reach it, of more than k for one query, as with ties, the k best by (score,
   smaller id), since no other entry of the cell can be among the k best of all.
3. *Resolve*: the scores of these entries, products in floating point up to here with a bound on their error taken off
   the cutoff, are computed exactly in integers, ranked by (score, smaller id), and cut at k.

No cell is dealt: each task reads some query blocks and some row blocks from the shared folder and makes their products, so
disk holds the vectors once as blocks, and not once for each block that they meet.  Ranks are limited where rows are, before they are dealt, so a query's entries are never gathered: a task sends k at most.

Vectors that are null, or hold null or non-finite components, take no part; nor do rows with a null id or of another
length than the query.  Repeated ids are candidates each; a query's own id is none, and of
queries with one id the one with the smallest vector asks.  A query with fewer than k
candidates returns all.  Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import partitions_for, small, utf8, written

QUERY_BLOCK, ROW_BLOCK = 2048, 8192
#: Blocks that a task keeps as matrices.
HELD = 24


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Rows (id, dim, vec: components as binary integers of 1, 2, 4 or 8 bytes, as they need) of the vectors that take part."""

    def each(batches):
        for batch in small(batches):
            ids, dims, out = [], [], []
            for i, vec in enumerate(batch.column(1)):
                if not vec.is_valid or vec.values.null_count:
                    continue
                x = np.floor(scale * np.asarray(vec.values, dtype=np.float64))
                if np.isfinite(x).all():
                    most = np.abs(x).max(initial=0)
                    if most >= 2.0**62:
                        raise OverflowError("a quantised component exceeds 64 bits")
                    ids.append(i)
                    dims.append(len(x))
                    out.append(x.astype(next(f"<i{w}" for w in (1, 2, 4, 8) if most < 2 ** (8 * w - 1))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "vec"])

    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    return own.mapInArrow(each, "id long, dim int, vec binary")


def _blocks(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (dim, name, ids, vecs) of at most about ``most`` rows each, and their number for each dim."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    numbered = rows.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(sizes), "dim")  # as many rows as lengths of vectors
    # Rows of a partition are numbered in turn, so blocks are even whatever the ids and values.
    numbered = numbered.withColumn(name, F.pmod(F.col("at") + F.shiftright("at", 33), F.col("blocks")).cast("int"))
    # A number of partitions that is named stays, however small the blocks are: tasks are cut by these files.
    dealt = numbered.repartition(partitions_for(rows), "dim", name) if name == "c" else numbered
    packed = dealt.groupBy("dim", name).agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
    return packed.select("dim", name, F.transform("rows", lambda r: r.id).alias(f"{name}_ids"), F.transform("rows", lambda r: r.vec).alias(f"{name}_vecs")), sizes


def _matrix(vecs: pa.BinaryArray, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(vecs), 0), np.int64)
    data, at = utf8(vecs)
    width = np.diff(at) // dim
    out = np.empty((len(vecs), dim), np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        out[own] = data[at[own][:, None] + np.arange(w * dim)].view(f"<i{w}")
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products in floating point and a bound on their error (0 if they're exact)."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T, 0.0
    return a.astype(np.float64) @ b.astype(np.float64).T, 0.0 if bound < 2**53 else bound * a.shape[1] * 2.0**-51


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**62:
        return (a * b).sum(axis=1)
    out = [sum(x * y for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())]
    if any(abs(x) >= 2**63 for x in out):
        raise OverflowError("a score exceeds 64 bits")
    return np.array(out, np.int64)


def _own(queries: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) where a query meets its own id."""
    order = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[order], queries, side=side) for side in ("left", "right"))
    n = last - first
    row = np.repeat(np.arange(len(queries)), n)
    return row, order[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]]


def best(a: np.ndarray, b: np.ndarray, queries: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Lower bounds of the ``n`` best scores of each query in a cell (all, if fewer; -inf: its own)."""
    scores, error = _scores(a, b)
    scores[_own(queries, ids)] = -np.inf
    n = min(n, scores.shape[1])
    top = scores.max(axis=1, keepdims=True) if n == 1 else np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n :]
    return top.astype(np.float64) - error


def enough(a: np.ndarray, b: np.ndarray, queries: np.ndarray, ids: np.ndarray, cuts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, exact score) of a cell's entries that reach their query's cutoff, the k best by (score, smaller id) of each query."""
    scores, error = _scores(a, b)
    scores[_own(queries, ids)] = np.nan
    low = (cuts - error).astype(scores.dtype)
    low = np.where(low > cuts - error, np.nextafter(low, scores.dtype.type(-np.inf)), low)  # never above the cutoff
    i, j = np.nonzero(scores >= low[:, None])
    exact = np.concatenate([np.zeros(0, np.int64), *(_exact(a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]]) for s in range(0, len(i), 1 << 16))])
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    few = place < k
    return queries[i[few]], ids[j[few]], exact[few]


class _Blocks:
    """Matrices of the blocks that a task meets again and again, the last ``HELD`` of them."""

    def __init__(self):
        self.held = {}

    def get(self, key: tuple, vecs: pa.BinaryArray, dim: int) -> np.ndarray:
        if key not in self.held:
            if len(self.held) >= HELD:
                self.held.pop(next(iter(self.held)))
            self.held[key] = _matrix(vecs, dim)
        return self.held[key]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Rows (query_id, rank, id, score): the ``k`` best of ``rows`` for each of ``queries``, both from ``quantised``."""
    rows = written(rows, "vectors")
    queries = written(queries.groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("q")).select("id", "q.dim", "q.vec"), "queries")
    candidates, sizes = _blocks(rows, row_block, "c")
    asked, _ = _blocks(queries, query_block, "q")
    # Row blocks in many files and query blocks in few: a task has a file or some of each.
    candidates, asked = written(candidates, "blocks"), written(asked.join(F.broadcast(sizes), "dim"), "asked")

    def cells(asked: DataFrame) -> DataFrame:
        """Each block of queries with each block of candidates of its dimension: a stated query set against all rows, in blocks."""
        return asked.join(candidates.hint("shuffle_replicate_nl"), "dim")

    def gather(batches):
        blocks, key, ids, best_, seen = _Blocks(), None, None, None, 0

        def sent():
            keep = np.isfinite(best_)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(axis=1)), pa.int64()), pa.array(best_[keep], pa.float64())], ["query", "score"])

        for batch in small(batches):
            for dim, q, q_ids, q_vecs, n, c, c_ids, c_vecs in zip(*batch.columns):
                if key != (dim.as_py(), q.as_py()):
                    if key is not None:
                        yield sent()
                    key, ids, seen = (dim.as_py(), q.as_py()), np.array(q_ids.values), 0
                    best_, own = np.zeros((len(ids), 0)), _matrix(q_vecs.values, key[0])
                seen += 1
                share = -(-k * seen // n.as_py())
                found = best(own, blocks.get((key[0], c.as_py()), c_vecs.values, key[0]), ids, np.asarray(c_ids.values), share)
                best_ = np.sort(np.concatenate([best_, found], axis=1), axis=1)[:, -share:]
        if key is not None:
            yield sent()

    columns = ["dim", "q", "q_ids", "q_vecs", "blocks", "c", "c_ids", "c_vecs"]
    first = cells(asked).select(columns).mapInArrow(gather, "query long, score double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    cutoff = first.withColumn("rank", nth).where(F.col("rank") <= k).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    cutoff = cutoff.select("query", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("cut"))
    at = asked.select("dim", "q", F.posexplode("q_ids").alias("pos", "query")).join(cutoff, "query", "left")
    cuts = at.groupBy("dim", "q").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("cut", F.lit(float("-inf"))).alias("cut")))), lambda x: x.cut).alias("cuts"))
    asked = written(asked.drop("blocks").join(cuts, ["dim", "q"]), "cutoffs")

    def collect(batches):
        blocks, key = _Blocks(), None
        for batch in small(batches):
            for dim, q, q_ids, q_vecs, cut, c, c_ids, c_vecs in zip(*batch.columns):
                if key != (dim.as_py(), q.as_py()):
                    key = dim.as_py(), q.as_py()
                    own = _matrix(q_vecs.values, key[0])
                found = enough(own, blocks.get((key[0], c.as_py()), c_vecs.values, key[0]), np.asarray(q_ids.values), np.asarray(c_ids.values), np.asarray(cut.values), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "id", "score"])

    sent = cells(asked).select([c.replace("blocks", "cuts") for c in columns]).mapInArrow(collect, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return sent.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
