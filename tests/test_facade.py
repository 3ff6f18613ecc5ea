import pytest
from tapes import TAPE, random_tape

from barsmith.engine import Engine
from barsmith.operators import audit
from barsmith.operators.bars import bars
from barsmith.operators.specs import CandleSpec, EngineConfig
from barsmith.sources import sinks
from pyspark.sql import functions as F

SPECS = (CandleSpec("t", "tick_count", 3), CandleSpec("m", "time_fixed", 60000), CandleSpec("v", "volume", 20))


def test_life(spark, tmp_path):
    got, raw = [], []
    config = EngineConfig(SPECS, batch_pow2=2, cached_pow2=0, max_symbols=4, symbols=("a", "b", "c"), candle_flush=(lambda df: got.extend(df.collect()), lambda h: True), trade_flush=(lambda df: raw.append(df.count()), lambda h: True))
    engine = Engine(spark, config, str(tmp_path / "e"))
    assert [engine.symbol_id(s) for s in "abc"] == [0, 1, 2] and engine.symbol_name(1) == "b" and engine.register("a") == 0
    tape = random_tape(11, 120)
    rows = lambda a, b: spark.createDataFrame(tape[a:b], TAPE)
    engine.refresh()
    engine.feed_trades(rows(0, 70))
    engine.refresh()
    full = {(r.candle_type, r.symbol, r.seq) for r in got}
    assert full and len(full) == len(got)
    engine.feed_trades(rows(70, 120))
    with pytest.raises(LookupError):
        engine.feed_trades(spark.createDataFrame([("z", 1, 1, 1, 1.0, 1.0)], TAPE))
    engine.close()
    key = lambda df: sorted(map(tuple, df.withColumn("amount", F.round("amount", 6)).collect()))
    for spec in SPECS:
        want = bars(rows(0, 120), spec)
        assert key(engine.bars(spec.name)) == key(want)
        mine = [r for r in got if r.candle_type == spec.name]
        assert {(r.symbol, r.seq) for r in mine} == {(r.symbol, r.seq) for r in want.collect()}
    assert raw == [120] and len({(r.candle_type, r.symbol, r.chunk_no, r.seq) for r in got}) == len(got)
    newest = engine.by_offset("b", "t", 0, 2).collect()
    assert [r.seq for r in engine.by_offset(1, "t", 0, 2).collect()] == [r.seq for r in newest]
    assert engine.by_key("b", "t", newest[-1].key, 1).first().seq == newest[-1].seq
    assert engine.count_range("b", "t", 0, 10**9) == engine.by_key_range("b", "t", 0, 10**9).count() > 2
    assert engine.cached_bars("t").count() < engine.bars("t").count()
    for f in (lambda: engine.bars("no"), lambda: engine.by_offset("z", "t", 0, 1)):
        with pytest.raises(LookupError):
            f()
    with pytest.raises(ValueError):
        engine.feed_trades(rows(0, 1))
    assert engine.register("d") == 3
    with pytest.raises(LookupError):
        engine.register("e")


def test_book(spark, tmp_path):
    with pytest.raises(ValueError):
        Engine(spark, EngineConfig(SPECS[:1]), str(tmp_path / "none")).feed_book(spark.createDataFrame([("a", 5, 1)], "symbol string, ts long, arrival long"))
    config = EngineConfig(SPECS[:1], symbols=("a",), book_state=(lambda e: (e["p"], 1), lambda s, e: (max(s[0], e["p"]), s[1] + 1), "top double, n long"))
    engine = Engine(spark, config, str(tmp_path / "e"))
    engine.feed_book(spark.createDataFrame([("a", 5, 1, 1.5), ("a", 9, 2, 2.5)], "symbol string, ts long, arrival long, p double"))
    engine.feed_trades(spark.createDataFrame([("a", 1, 1, 7, 1.0, 1.0)], TAPE))
    assert engine.with_book(["p"]).first().book_p == 1.5 and engine.book_state(["p"]).first().p == 2.5
    assert tuple(engine.book_now().first()) == ("a", 2.5, 2)
    engine.feed_book(spark.createDataFrame([("a", 12, 3, 0.5)], "symbol string, ts long, arrival long, p double"))
    assert tuple(engine.book_now().first()) == ("a", 2.5, 3)


def test_retention_and_archive(spark, tmp_path):
    """Chunks leave the engine when a sink has had them; archive and engine together still have every bar."""
    store = str(tmp_path / "sink")
    config = EngineConfig(SPECS[:1], batch_pow2=2, cached_pow2=0, symbols=("a", "b", "c"), candle_flush=(lambda df: df.write.mode("append").parquet(store), lambda h: True), retain=True, files_per_trigger=1, feed_rows=20)
    engine, tape = Engine(spark, config, str(tmp_path / "e")), random_tape(11, 150)
    for at in range(0, 150, 50):
        engine.feed_trades(spark.createDataFrame(tape[at : at + 50], TAPE).coalesce(1))
        engine.refresh()
    want = bars(spark.createDataFrame(tape, TAPE), SPECS[0])
    key = lambda df: sorted(map(tuple, df.withColumn("amount", F.round("amount", 6)).select(*want.columns).collect()))
    assert engine.bars("t").count() < want.count() and key(engine.bars("t", spark.read.parquet(store))) == key(want)
    assert not [p for p in (tmp_path / "e" / "trades").iterdir() if p.suffix == ".parquet"] and engine.cached_bars("t").count() <= engine.bars("t").count()


def test_files(spark, tmp_path):
    hist = audit.histogram(spark.range(1000).select((F.col("id") * 7).alias("v")), [], "v")
    sinks.write_histogram(hist, str(tmp_path / "h"))
    back = spark.read.option("header", True).csv(str(tmp_path / "h"))
    assert back.columns == ["bucket_start_ns", "count"] and back.count() == hist.count()
    sinks.write_by_symbol(spark.createDataFrame(random_tape(1, 30), TAPE), str(tmp_path / "s"), files=2)
    assert sorted(p.name for p in (tmp_path / "s").glob("symbol=*")) == ["symbol=a", "symbol=b", "symbol=c"]
    rows = spark.createDataFrame([(0, False, False, 100, 7, 0)], "at long, gap boolean, tick_error boolean, feed_latency long, internal_latency long, audit_latency long")
    sinks.write_report(audit.interval_report(rows, "at"), str(tmp_path / "r"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "r")).columns) == 28
