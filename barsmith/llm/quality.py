"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

*Statistics.*  Shares of letter cases, digits, marks and white space, lengths and repetition of words and lines, byte
entropy: 20 numbers from the whole text and nothing else.  Null and empty texts get the statistics of an empty text.

*Fit.*  Up to ``sample`` labelled rows (a documented bound; those with the smallest hashes of their ids, so the choice
does not depend on order or partitions) are met with their texts by a broadcast of that bounded sample.  Every partition
sums its own share of the normal equations; the sums meet by cell in an aggregate with partial sums, and only the
(features + 1) x (features + 2) cells reach the driver.  Rows are dealt to two folds by another bit of the hash: each
fold is scored by the other's fit, and these scores, never seen by their fit, give the isotonic calibration.

*Score.*  One pass over all documents without any shuffle.

Rows whose label is null or whose id is null teach nothing; repeated labels count each.  Without any label, or with one
class only, every score is that class's share (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsmith.llm.common import groups, small, utf8, written
from barsmith.llm.rolling import Prefix, byte_codes, words

SAMPLE = 20000
FEATURES = 192
WIDTH = 4.0
RIDGE = 1e-3
N_STATS = 20

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _HIGH = (np.zeros(256) for _ in range(6))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = 1
_SPACE[[32, 9, 10, 11, 12, 13]] = 1
_STOP[[44, 46, 39, 45, 59, 58, 40, 41, 34]] = 1
_HIGH[128:] = 1
_MARK = 1 - _LOWER - _UPPER - _DIGIT - _SPACE - _STOP - _HIGH
_KINDS = np.stack([_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _HIGH, _MARK], axis=1)


def _segments(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the n + 1 bounds ``first``."""
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[first])


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner the number of distinct keys and the largest count of one key."""
    out, most = np.zeros(n), np.zeros(n)
    if len(keys):
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        np.add.at(out, o[at], 1)
        np.maximum.at(most, o[at], np.diff(np.append(at, len(k))))
    return out, most


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``N_STATS`` numbers for each text of ``data[at[i]:at[i + 1]]``."""
    n = len(at) - 1
    size = np.diff(at)
    counts = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(at[:-1], at[1:])]).astype(np.float64) if n else np.zeros((0, 256))
    share = counts / np.maximum(size, 1)[:, None]
    kinds = share @ _KINDS
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    start, end, first = words(data, at)
    n_words = np.diff(first).astype(np.float64)
    per = np.maximum(n_words, 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    length = (end - start).astype(np.float64)
    mean = _segments(length, first) / per
    spread = np.sqrt(np.maximum(0, _segments(length**2, first) / per - mean**2))
    hashes = Prefix(byte_codes(0)[data]).slices(start, end) if len(start) else np.zeros(0, np.uint64)
    unique, most = _distinct(hashes, owner, n)
    same = np.zeros(len(start))
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    marked = np.concatenate([[0.0], np.cumsum(_MARK[data])])
    marks = marked[end] - marked[start]
    capital = np.concatenate([[0.0], np.cumsum(_UPPER[data])])
    capitals = capital[end] - capital[start]
    # Lines, as runs between line feeds.
    feed = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([at, feed, feed + 1]))
    a, b = cuts[:-1], cuts[1:]
    line = (b - a > 1) | (data[np.minimum(a, max(len(data) - 1, 0))] != 10) if len(data) else np.zeros(0, bool)
    a, b = a[line], b[line]
    of = np.searchsorted(at, a, side="right") - 1
    lines = np.bincount(of, minlength=n).astype(np.float64) if len(a) else np.zeros(n)
    distinct_lines, most_lines = _distinct(Prefix(byte_codes(1)[data]).slices(a, b), of, n) if len(a) else (np.zeros(n), np.zeros(n))
    per_line = np.maximum(lines, 1)
    table = [
        np.log1p(size), np.log1p(n_words), *kinds.T, entropy, mean, spread, unique / np.maximum(per, 1) * np.log1p(per), most / per,
        _segments(same, first) / per, _segments(marks > 0, first) / per, _segments(marks == length, first) / per, _segments((capitals == length) & (length > 1), first) / per, distinct_lines / per_line, most_lines / per_line,
    ]
    return np.stack(table, axis=1)[:, :N_STATS]


def stats_of(column: pa.Array) -> np.ndarray:
    """Statistics of a string column, a few MB of text at a time."""
    data, at = utf8(column)
    parts = [statistics(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in groups(at, 1 << 21)]
    return np.concatenate(parts) if parts else np.zeros((0, N_STATS))


@dataclass
class Model:
    """What the scoring pass needs: a few thousand numbers, whatever the corpus."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    constant: float | None = None

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.clip(np.interp(fourier(stats, self.centre, self.scale) @ self.weights, self.knots, self.levels), 0, 1)


def fourier(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of width ``WIDTH`` over standardised statistics, and a constant."""
    draw = np.random.default_rng(10)
    w, b = draw.normal(size=(N_STATS, FEATURES)) / WIDTH, draw.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - centre) / scale, -6, 6)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))], axis=1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: ascending knots and their non-decreasing levels."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, sum of scores, rows
    for s, y in zip(score[order].tolist(), label[order].tolist()):
        blocks.append([y, s, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            y, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + s, blocks[-1][2] + n]
    return np.array([s / n for _, s, n in blocks]), np.array([y / n for y, _, n in blocks])


def _summed(rows: DataFrame, f, size: int) -> np.ndarray:
    """``f(fold, y, stats)`` of each batch, summed over a partition in Python and over partitions by cell in Spark."""

    def partial(batches):
        total = np.zeros(size)
        for batch in small(batches):
            stats = np.array(batch.column(2).flatten()).reshape(-1, N_STATS)
            total += f(np.array(batch.column(0)), np.array(batch.column(1), dtype=np.float64), stats)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["cells"])

    sums = rows.mapInArrow(partial, "cells array<double>").select(F.posexplode("cells").alias("cell", "x")).groupBy("cell").agg(F.sum("x").alias("x"))
    out = np.zeros(size)
    for cell, x in sums.collect():  # one row for each cell, whatever the corpus
        out[cell] = x
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``labels`` (all of which may teach), at most ``sample`` of them."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(sample).withColumn("fold", F.xxhash64(F.col("id"), F.lit(1)).bitwiseAND(F.lit(1)).cast("int"))

    def measure(batches):
        for batch in small(batches):
            stats = stats_of(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32), stats.ravel())], ["fold", "y", "stats"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("fold", "y", "text")
    rows = written(rows.mapInArrow(measure, "fold int, y int, stats array<double>"), "labelled")

    moments = _summed(rows, lambda fold, y, s: np.concatenate([[len(y), y.sum()], s.sum(axis=0), (s**2).sum(axis=0)]), 2 + 2 * N_STATS)
    n, ones = moments[:2]
    if n == 0 or ones in (0, n):
        nothing = np.zeros(0)
        return Model(nothing, nothing, nothing, nothing, nothing, float(ones / n) if n else 0.5)
    centre = moments[2 : 2 + N_STATS] / n
    scale = np.sqrt(np.maximum(moments[2 + N_STATS :] / n - centre**2, 0))
    scale[scale < 1e-9] = 1.0
    width = FEATURES + 1

    def equations(fold, y, s):
        z = fourier(s, centre, scale)
        both = []
        for k in (0, 1):
            of = z[fold == k]
            both += [(of.T @ of).ravel(), of.T @ y[fold == k]]
        return np.concatenate(both)

    cells = _summed(rows, equations, 2 * width * (width + 1)).reshape(2, width * (width + 1))
    solve = lambda c: np.linalg.solve(c[: width * width].reshape(width, width) + RIDGE * n * np.eye(width) / FEATURES, c[width * width :])
    apart = [solve(cells[1]), solve(cells[0])]  # the fit for a fold has not seen it

    def score(batches):
        for batch in small(batches):
            fold = np.array(batch.column(0))
            z = fourier(np.array(batch.column(2).flatten()).reshape(-1, N_STATS), centre, scale)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(fold == 0, z @ apart[0], z @ apart[1])), batch.column(1)], ["s", "y"])

    seen = rows.mapInArrow(score, "s double, y int").toArrow()  # bounded by ``sample``
    knots, levels = isotonic(np.array(seen.column("s")), np.array(seen.column("y"), dtype=np.float64))
    return Model(centre, scale, solve(cells[0] + cells[1]), knots, levels)


def scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each text; other columns pass unread, one named like the score gives way."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()])
    names = docs.columns
    where = names.index(text_col)
    kinds = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def each(batches):
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(stats_of(batch.column(where))))], [*names, out])

    return docs.mapInArrow(each, kinds)


def held_out(column="doc_id"):
    """Whether a document's label is kept from every fit."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))
