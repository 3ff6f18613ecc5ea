import json
import re

import corpus
import pytest

import corpus_pipeline
from barsmith.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = [r for r in corpus.texts() if r[0] is None or r[0] < 80 or r[0] in (80, 81)]
    docs = corpus.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{at}/documents.parquet")
    junk = [(1000 + i, "%%% ### $$$ " * (5 + i)) for i in range(40)]
    corpus.table(spark, junk).select("doc_id", "text", "lang", "source", "n_chars").write.mode("append").parquet(f"{at}/documents.parquet")
    labels = [(i, 1) for i, t in rows if i is not None and t and i < 74] + [(i, 0) for i, _ in junk]
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0], 0) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), None if name == "packing" else docs.schema)
        kept.append(docs)
        assert name == "packing" or docs.columns == names
    good, one, cut, clean, packed = kept
    ids = {r.doc_id for r in good.collect()}
    assert not any(i is not None and i >= 1000 for i in ids) and {10, 31, 60} <= ids
    ids = {r.doc_id for r in one.collect()}
    assert 60 in ids and not ids & {61, 69, 70, 71}
    want = []
    for i, b, gone in corpus.byte_masks([(r.doc_id, r.text) for r in one.collect()], 100):
        at, text = 0, []
        for c in b.decode():  # whole characters go
            n = len(c.encode())
            text += [] if all(gone[at : at + n]) else [c]
            at += n
        want.append((i, "".join(text)))
    assert sorted(((r.doc_id, r.text or "") for r in cut.collect()), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())
    assert not any(re.search("04dbebab|AKIA|hunter22", r.text or "") for r in clean.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()} == ids


def test_stages_on_empty_and_clashing_tables(spark, folder):
    rows = [(i, t) for i, t in corpus.texts() if i is None or i < 40]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus.table(spark, rows)  # has columns id, hash, runs, score, found
        got, none = stage(spark, docs, folder), stage(spark, corpus.table(spark, []), folder)
        assert none.count() == 0, name
        assert got.columns == (["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] if name == "packing" else docs.columns), name
        if name in ("repeats", "secrets"):
            key = lambda df: sorted(((r.doc_id, r.id, r.runs, r.Text_) for r in df.collect()), key=repr)
            assert key(got) == key(docs), name


def test_run_and_queries(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert len([q for q in queries.QUERIES if re.match(r"op\d+_", q)]) == 10
    for name, query in queries.QUERIES.items():
        got = query(spark, folder)
        assert got.count() > 0, name


def test_session_and_folder_stay_as_they_were(spark, folder):
    from pathlib import Path

    from barsmith.llm import common

    settings = lambda: {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.session.timeZone")}
    before = settings()
    queries.QUERIES["op5_simhash"](spark, folder)
    with common.scratch(spark) as keep:
        common.written(spark.range(3), "gone")
        kept = keep(spark.range(4), "kept")
    at = Path(common.shared_dir(spark).replace("file://", ""))
    assert settings() == before and kept.count() == 4 and not list(at.glob("scratch-*"))


def test_written_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from barsmith.llm import common

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there = lambda: {x for x in disk.getAllFiles().mkString(",").split(",") if "/shuffle_" in x}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = there(), spark.conf.get(name)
    got = common.written(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(3, "count"), "counts")
    until = time.time() + 10
    while there() - before and time.time() < until:
        time.sleep(0.2)
    assert not there() - before and got.count() == 1000 and spark.conf.get(name) == setting


def test_entry(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries()) and json.dumps(entry.oracle_sql())


def test_nothing_else_imports_this():
    from pathlib import Path

    import barsmith

    for f in Path(barsmith.__file__).parent.rglob("*.py"):
        assert f.parent.name == "llm" or "llm" not in f.read_text(), f
