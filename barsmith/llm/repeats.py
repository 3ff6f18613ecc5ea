"""Where long substrings repeat: what substring and suffix-array deduplication share.

Both operators look for windows of k symbols that also start earlier.  Windows are far too many to deal out one by one
(each symbol starts one), so super-k-mers are dealt instead (see ``rolling``): runs of windows with one minimiser.  Equal
windows have equal minimisers, so all occurrences of a window meet under one minimiser.  Sequences that meet no other and
hold no window twice (*alone*) are dropped here; of every other sequence the earliest occurrence, with its source coordinates, goes on to the operator's own
method, which says

* which windows of a sequence repeat where it occurs first (``later`` false), and
* that, and as what, it repeats where it occurs later (``later`` true), with a digest of the symbols at the first place.

``spans`` carries that back to all occurrences.  At each later place the digest of the symbols that stand there is compared with that of the first place
before anything is taken out (``covered``), so equality of the routing hashes alone removes nothing.

Hot keys: before anything is dealt, each task finds repetitions among some ``HELD`` super-k-mers by itself, and all but the
first occurrence of a sequence (``done``) are dealt by their place, not by their minimiser: a passage found in a third of
all documents costs its minimiser a row for each such block.  A minimiser may also be hot because one short line stands in ever other
surroundings.  A first pass finds such *crowds*, by their different sequences in each block; their windows are dealt by
two further minimisers taken beside the first (``rolling.side_keys``).  Where the line is so long that these lie in it as well,
a second pass finds a crowd again, and its windows are dealt one by one, by the hash of the whole window.  That is a
matter of routing only: equal windows go the same way whatever the passes found.  So a group under one key has some
``CROWD`` sequences a block at most, 1 in 4,096 of the rows.

Ids are integers; rows with a null id take no part; rows with one id count as one document; rows are told apart by their id
and the hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import groups, small, utf8, written

HELD = 1 << 18
TEXT_BYTES = 1 << 19
#: Sequences under one minimiser that make it a crowd in a block.  Over all blocks a quarter of that on average is asked, so
#: there are at most 4 * HELD / CROWD crowds of each level, whatever the corpus: that is what the next pass is sent.
CROWD = 64
ROWS = "mini long, sk long, id long, hash long, start int, n int, loop boolean, done boolean, twin boolean"
#: What a method says of a sequence: windows (at, n) that repeat, as part of what (a path, a group), and for later
#: occurrences the digest of their symbols.
RUNS = "array<struct<later: boolean, at: int, n: int, of: bigint, digest: bigint>>"
NONE = np.zeros(0, np.uint64)


def digest(symbols: bytes) -> int:
    """64 bits of BLAKE2b, signed."""
    return int.from_bytes(hashlib.blake2b(symbols, digest_size=8).digest(), "little", signed=True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, hash, text) of documents that have an id; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).where("id IS NOT NULL")


def _blocks(batches, cut: Callable, crowd: tuple[np.ndarray, np.ndarray]):
    """Columns (minimiser, content, id, hash, start, n, loop, level) of blocks of about ``HELD`` super-k-mers."""
    held, size = [], 0
    for batch in small(batches):
        ids, hashes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        data, at = utf8(batch.column(2))
        for a, b in groups(at, TEXT_BYTES):
            owner, *rest = cut(data[at[a] : at[b]], at[a : b + 1] - at[a], crowd)
            if len(owner):
                held.append((rest[0], rest[1], ids[a:b][owner], hashes[a:b][owner], *rest[2:]))
                size += len(owner)
            if size >= HELD:
                yield [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def crowds(docs: DataFrame, cut: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers with many different sequences throughout the corpus, and those of their runs under side keys that still
    have; ascending, a bounded number."""
    first = _crowds(docs, cut, (NONE, NONE), 0)
    return first, _crowds(docs, cut, (first, NONE), 1) if len(first) else NONE


def _crowds(docs: DataFrame, cut: Callable, crowd: tuple[np.ndarray, np.ndarray], level: int) -> np.ndarray:
    def each(batches):
        minis, sizes, blocks = [NONE], [np.zeros(0, np.int64)], 0
        for mini, sk, *_, of in _blocks(batches, cut, crowd):
            mini, sk = mini[of == level], sk[of == level]
            order = np.lexsort((sk, mini))
            m, s = mini[order], sk[order]
            first = np.ones(len(m), bool)
            first[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
            names, n = np.unique(m[first], return_counts=True)
            minis.append(names[n > CROWD])
            sizes.append(n[n > CROWD])
            blocks += 1
        names = pa.array([None, *np.concatenate(minis).view(np.int64).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([names, pa.array([blocks, *np.concatenate(sizes).tolist()], pa.int64())], ["mini", "n"])

    found = written(docs.mapInArrow(each, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")), "crowds")
    row = found.where("mini IS NULL").first()
    blocks = row[1] if row else 0
    rows = found.where((F.col("n") * 4 >= CROWD * blocks) & F.col("mini").isNotNull()).select("mini").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def super_rows(docs: DataFrame, cut: Callable, by_start: bool) -> DataFrame:
    """Super-k-mers of ``keyed`` documents.

    ``cut(data, at, crowds)`` gives, for the texts ``data[at[i]:at[i + 1]]``, arrays (owner, minimiser, content, start, n, loop, level).
    ``by_start``: an occurrence is earlier by id and then start, not by id alone.
    """
    crowd, names = crowds(docs, cut), [c.split()[0] for c in ROWS.split(", ")]

    def flush(mini, sk, id_, hash_, start, n, loop, _):
        order = np.lexsort((start, id_, sk, mini)) if by_start else np.lexsort((id_, sk, mini))
        m, s, i, st = mini[order], sk[order], id_[order], start[order]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
        later = i > i[first]
        if by_start:
            later |= (i == i[first]) & (st > st[first])
        done, twin = np.zeros(len(m), bool), np.zeros(len(m), bool)
        done[order] = later
        group = np.cumsum(new) - 1  # a sequence that has such copies goes on whatever it meets
        twin[order] = ~later & (np.bincount(group, later, minlength=len(m))[group] > 0)
        for a in range(0, len(mini), 1 << 16):
            b = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(mini[a:b].view(np.int64)), pa.array(sk[a:b].view(np.int64)), pa.array(id_[a:b]), pa.array(hash_[a:b]), pa.array(start[a:b].astype(np.int32)), pa.array(n[a:b].astype(np.int32)), pa.array(loop[a:b]), pa.array(done[a:b]), pa.array(twin[a:b])], names)

    def each(batches):
        for block in _blocks(batches, cut, crowd):
            yield from flush(*block)

    return docs.mapInArrow(each, ROWS)


def repeated(rows: DataFrame, by_start: bool) -> DataFrame:
    """The super-k-mers that may repeat, with ``branch``: other sequences have their minimiser too; written."""
    spread = F.when(F.col("done"), F.hash("id", "hash", "start")).otherwise(0)
    w = Window.partitionBy("mini", spread)
    twice = F.count("*").over(w) > 1 if by_start else F.min("id").over(w) < F.max("id").over(w)
    met = rows.withColumn("twice", twice).where("done OR twin OR loop OR twice").drop("twice", "twin")
    branch = ~F.col("done") & (F.min("sk").over(w) != F.max("sk").over(w))
    return written(met.withColumn("branch", branch).drop("done"), "repeats")


def representatives(met: DataFrame, by_start: bool) -> DataFrame:
    """The earliest occurrence (id, start, hash, n) of each sequence (mini, sk), with ``branch``, ``loop`` and ``many``: it also
    occurs later."""
    many = F.count("*") > 1 if by_start else F.min("id") < F.max("id")
    reps = met.groupBy("mini", "sk").agg(F.min(F.struct("id", "start", "hash", "n")).alias("r"), F.max("branch").alias("branch"), F.max("loop").alias("loop"), many.alias("many"))
    return reps.where("branch OR loop OR many").select("mini", "sk", "r.*", "branch", "loop", "many")


def spans(met: DataFrame, found: DataFrame, by_start: bool) -> DataFrame:
    """Runs of repeated windows (id, hash, start, n, of, digest) of all occurrences.

    ``found``: (mini, sk, first_id, first_start, runs), what the method says of each sequence.
    """
    rows = met.select("mini", "sk", "id", "hash", "start").join(found, ["mini", "sk"])
    later = F.col("id") > F.col("first_id")
    if by_start:
        later = later | ((F.col("id") == F.col("first_id")) & (F.col("start") > F.col("first_start")))
    rows = rows.select("id", "hash", "start", F.explode(F.filter("runs", lambda r: r.later == later)).alias("x"))
    return rows.select("id", "hash", (F.col("start") + F.col("x.at")).alias("start"), "x.n", "x.of", "x.digest")


def by_document(runs: DataFrame) -> DataFrame:
    """All runs of a document: at most as many as it has windows."""
    return runs.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "n", "of", "digest")).alias("runs"))


def verified(runs, symbols: Callable[[int, int], bytes], more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and name (0: none) of the runs whose symbols ``symbols(start, end)`` have the digest of their first place; ascending."""
    start = np.asarray(runs.field("start"), dtype=np.int64)
    end = start + np.asarray(runs.field("n"), dtype=np.int64) + more
    want = runs.field("digest").to_pylist()
    ok = np.array([w is None or digest(symbols(a, b)) == w for a, b, w in zip(start.tolist(), end.tolist(), want)], bool)
    order = np.argsort(start[ok], kind="stable")
    return start[ok][order], end[ok][order], np.asarray(runs.field("of").fill_null(0))[ok][order]


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` symbols lie in a run."""
    mask = np.zeros(size + 1, np.int32)
    np.add.at(mask, start, 1)
    np.add.at(mask, np.minimum(end, size), -1)
    return np.cumsum(mask[:-1]) > 0
