"""Substring deduplication over words by De Bruijn compaction.

Words are ``[^\\x20\\x09-\\x0D]+``.  A window of k consecutive words is an *edge* of the De Bruijn graph of the corpus, between
two *nodes* of k - 1 words.  As in the published compaction by minimisers, edges are dealt by their minimiser and come as
paths already: a super-k-mer (see ``repeats``) is a run of consecutive edges under one minimiser.

1. *Edges.*  Where a minimiser has one sequence only, in however many documents, its path has no branch and its edges repeat
   together.  Where it has several, each is opened into edges from its earliest occurrence; edges meet in a join, by the
   digest of their words, and those that an earlier document has are repeated.
2. *Nodes.*  Aggregates count, for each node at an end of a repeated path, the paths that enter and that leave it.
3. *Compaction.*  A join brings these degrees to the paths: two that are neighbours at their source and meet in a node that
   one path enters and one leaves become parts of one longer path.  It is named by its source coordinates (document, first word).
4. *Verification.*  At the source coordinates of each path the words are read and digested.  Every later occurrence (id, first
   word, length) is read too, and counts only if its words have the same digest.  In each document neighbouring
   verified parts of one path are one long span (``repeated_spans``); all that spans cover is taken out.

Null texts have no words; rows with a null id are kept whole; documents of fewer than k words too; rows with one id are
no sources for each other; repeated rows are cut alike; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm import repeats
from barsmith.llm.common import scratch, small, utf8, written
from barsmith.llm.rolling import Prefix, byte_codes, sliding_min, split_crowded, super_kmers, words

WORDS = 13
GRAM = 4
_LONGEST = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cutter(k: int):
    gram = min(GRAM, k)

    def cut(data, at, crowd):
        start, end, first = words(data, at)
        codes = Prefix(byte_codes(0)[data]).slices(start, end)
        n = len(codes) - k + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 7
        owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
        grams = Prefix(codes, 1).grams(gram)
        least = sliding_min(grams, k - gram + 1)
        run, size = super_kmers(least, np.flatnonzero(owner[:n] == owner[k - 1 :]), _LONGEST)
        run, size, mini, level = split_crowded(grams, run, size, least[run], crowd, k - gram + 1, gram, lambda at: Prefix(codes, 3).slices(at, at + k))
        content = Prefix(codes, 2).slices(run, run + size + k - 1)
        of = owner[run]
        return of, mini, content, run - first[of], size, np.zeros(len(run), bool), level

    return cut


def lines(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins (and where one more would)."""
    own = _WORD.findall(text)
    return b" ".join(own), np.cumsum([0, *(len(w) + 1 for w in own)])


_OPENED = "mini long, sk long, id long, hash long, start int, n int, many boolean, head long, tail long, digest long, edge long, at int"


def _open(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Every path at its source: a row with its end nodes and the digest of its words (``edge`` null), and for branching ones
    a row for each edge (``edge``, ``at``); written."""
    wanted = reps.groupBy("id", "hash").agg(F.collect_list(F.struct("mini", "sk", "start", "n", "branch", "many")).alias("wanted"))

    def each(batches):
        for batch in small(batches):
            ids, hashes, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            per = np.diff(np.asarray(lists.offsets))
            mini, sk, start, n, branch, many = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("mini", "sk", "start", "n", "branch", "many"))
            owner, ends = np.repeat(np.arange(len(per)), per), np.empty((len(mini), 3), np.int64)
            of, edge, at, until = [], [], [], np.cumsum([0, *per])
            for row, text in enumerate(batch.column(2).to_pylist()):
                line, where = lines(text.encode())
                words = lambda a, b: repeats.digest(line[where[a] : where[b] - 1])  # noqa: B023, E731
                for item in range(until[row], until[row + 1]):
                    a, z = int(start[item]), int(start[item] + n[item])
                    ends[item] = words(a, a + k - 1), words(z, z + k - 1), words(a, z + k - 1)
                    if branch[item]:
                        of += [item] * (z - a)
                        edge += [words(x, x + k) for x in range(a, z)]
                        at += range(z - a)
            base = [mini, sk, ids[owner], hashes[owner], start, n, many]
            blank = lambda size, kind: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in base], *[pa.array(x) for x in ends.T], blank(len(mini), pa.int64()), blank(len(mini), pa.int32())], names)
            o = np.array(of, np.int64)
            for x in range(0, len(o), 1 << 16):
                y = slice(x, x + (1 << 16))
                yield pa.RecordBatch.from_arrays([*[pa.array(c[o[y]]) for c in base], *[blank(len(o[y]), pa.int64())] * 3, pa.array(edge[y], pa.int64()), pa.array(at[y], pa.int32())], names)

    names = [f.split()[0] for f in _OPENED.split(", ")]
    opened = docs.join(wanted, ["id", "hash"]).select("id", "hash", "text", "wanted")
    return written(opened.mapInArrow(each, _OPENED), "paths")


def _compact(paths: DataFrame) -> DataFrame:
    """``paths`` that repeat, with ``of``: the name of the compacted path that each is a part of."""
    ends = F.explode(F.array(F.struct(F.col("head").alias("node"), F.lit(1).alias("leaves"), F.lit(0).alias("enters")), F.struct(F.col("tail").alias("node"), F.lit(0).alias("leaves"), F.lit(1).alias("enters"))))
    degrees = paths.select(ends.alias("x")).groupBy("x.node").agg(F.sum("x.leaves").alias("leaves"), F.sum("x.enters").alias("enters"))
    simple = degrees.where("leaves = 1 AND enters = 1").select(F.col("node").alias("head"), F.lit(True).alias("simple"))
    w = Window.partitionBy("id", "hash").orderBy("start")  # the paths of one source document
    met = paths.join(simple, "head", "left").withColumn("joins", F.coalesce(F.col("simple") & (F.lag(F.col("start") + F.col("n")).over(w) == F.col("start")), F.lit(False)))
    begins = F.last(F.when(~F.col("joins"), F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("of", F.xxhash64("id", "hash", begins))


def _found(opened: DataFrame) -> DataFrame:
    """What is known of each sequence: (mini, sk, first_id, first_start, runs)."""
    run = lambda later, at, n, of, digest: F.struct(later.alias("later"), at.cast("int").alias("at"), n.cast("int").alias("n"), of.cast("long").alias("of"), digest.cast("long").alias("digest"))
    whole = _compact(opened.where("edge IS NULL AND many")).select("mini", "sk", "id", "start", run(F.lit(True), F.lit(0), F.col("n"), F.col("of"), F.col("digest")).alias("run"))
    edges = opened.where("edge IS NOT NULL").select("mini", "sk", "edge", "id", "start", "at")
    # The earliest document of an edge comes from sums of each task, so an edge that very many paths share costs a few rows.
    first = edges.groupBy("mini", "edge").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    ats = edges.join(first, ["mini", "edge"]).where("id > first").groupBy("mini", "sk").agg(F.min("id").alias("id"), F.min("start").alias("start"), F.sort_array(F.collect_set("at")).alias("ats"))
    # Neighbouring edges become one run.
    heads = F.filter("ats", lambda x: ~F.array_contains("ats", x - 1))
    ends = F.filter("ats", lambda x: ~F.array_contains("ats", x + 1))
    none = F.lit(None)
    parts = ats.select("mini", "sk", "id", "start", F.explode(F.zip_with(heads, ends, lambda a, z: F.struct(a.alias("a"), (z - a + 1).alias("n")))).alias("x")).select("mini", "sk", "id", "start", run(F.lit(False), F.col("x.a"), F.col("x.n"), none, none).alias("run"))
    return whole.unionByName(parts).groupBy("mini", "sk").agg(F.min("id").alias("first_id"), F.min("start").alias("first_start"), F.collect_list("run").alias("runs"))


def removals(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, hash, runs: array of (start, n, of, digest)): the windows of each document that start in an earlier one."""
    own = repeats.keyed(docs, id_col, text_col)
    met = repeats.repeated(repeats.super_rows(own, _cutter(k), False), False)
    # Written, so that the next join can part a sequence that very many documents have, and disk that is not needed any more is free.
    with scratch(docs.sparkSession) as keep:
        found = keep(_found(_open(own, repeats.representatives(met, False), k)), "found")
    return repeats.by_document(repeats.spans(met, found, False))


def _cut(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, runs), one for each row of ``docs``."""
    found = removals(docs, k, id_col, text_col)
    joined = repeats.keyed(docs, id_col, text_col).join(found, ["id", "hash"], "left").select("id", "text", "runs")
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<start: int, n: int, of: bigint, digest: bigint>>").alias("runs"))
    return joined.unionByName(nameless)


def repeated_spans(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, n, path): the verified spans of n words, from word ``start`` on, that are parts of one compacted path (null:
    edges of a branching part)."""

    def each(batches):
        for batch in small(batches):
            out = []
            for id_, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                line, where = lines((text or "").encode())
                if runs.is_valid:
                    start, end, of = repeats.verified(runs.values, lambda a, b: line[where[a] : where[b] - 1], k - 1)  # noqa: B023
                    new = np.ones(len(start), bool)
                    new[1:] = (start[1:] + k - 1 != end[:-1]) | (of[1:] != of[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(start)) - 1
                    out += [(id_, int(start[a]), int(end[z] - start[a]), int(of[a]) or None) for a, z in zip(first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, ["id", "start", "n", "path"])

    return _cut(docs, k, id_col, text_col).where("runs IS NOT NULL").mapInArrow(each, "id long, start long, n long, path long")


def without_repeats(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_removed, kept: the words that stay, joined by one space, as binary), one for each row."""

    def each(batches):
        for batch in small(batches):
            n, gone, kept = [], [], []
            data, at = utf8(batch.column(1))
            for a, b, runs in zip(at[:-1], at[1:], batch.column(2)):
                own = _WORD.findall(data[a:b].tobytes())
                n.append(len(own))
                if runs.is_valid:
                    line, where = b" ".join(own), np.cumsum([0, *(len(w) + 1 for w in own)])
                    start, end, _ = repeats.verified(runs.values, lambda a, b: line[where[a] : where[b] - 1], k - 1)  # noqa: B023
                    own = [w for w, m in zip(own, repeats.covered(len(own), start, end).tolist()) if not m]
                gone.append(n[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return _cut(docs, k, id_col, text_col).mapInArrow(each, "id long, n_words long, n_removed long, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

