import json

import pytest
from tapes import TAPE, golden, random_tape

from barsmith.functions import scalar
from barsmith.operators import audit, book, store, symbols
from barsmith.operators.bars import bars
from barsmith.operators.query import CandleReader
from barsmith.operators.specs import CandleSpec, EngineConfig, least_memory
from barsmith.sources import config, trades
from pyspark.sql import functions as F

MINUTE = CandleSpec("m", "time_fixed", 60000)


@pytest.fixture(scope="module")
def reader(spark):
    tape = spark.createDataFrame(golden(), TAPE)
    return CandleReader(bars(tape, MINUTE).cache(), symbols.dictionary(tape))


def seqs(df):
    return [r.seq for r in df.collect()]


def test_reads(reader):
    assert seqs(reader.by_offset("x", "m", 0, 2)) == [2, 3]
    assert seqs(reader.by_offset("x", "m", 1, 99)) == [0, 1, 2]
    assert seqs(reader.by_key("x", "m", 120000, 2)) == [1, 2]
    assert seqs(reader.by_key_range("x", "m", 60000, 200000)) == [1, 2]
    assert seqs(reader.by_key_range("x", "m", 9, 3)) == [] == seqs(reader.by_key_range("x", "m", 400000, 500000))
    assert reader.count_range("x", "m", 60000, 200000) == 2 and reader.seq_range("x", "m", 60000, 200000) == (1, 2) and reader.seq_range("x", "m", 1, 2) is None
    assert reader.by_offset(0, "m", 0, 1, [1, "close"]).columns == ["candle_type", "symbol", "seq", "key", "is_closed", "high", "close"]


def test_reads_in_one_plan(reader):
    lazy = CandleReader(reader.candles, reader.symbols, strict=False)
    for symbol in ("x", 0):
        assert seqs(lazy.by_offset(symbol, "m", 1, 99)) == [0, 1, 2] and seqs(lazy.by_key(symbol, "m", 120000, 2)) == [1, 2] and seqs(lazy.by_key_range(symbol, "m", 60000, 200000)) == [1, 2]
        assert lazy.counted(symbol, "m", 60000, 200000).first().n == 2 and seqs(lazy.by_offset(symbol, "m", 9, 1)) == [] == seqs(lazy.by_key(symbol, "m", 5, 1))
    assert seqs(lazy.by_offset("no", "m", 0, 1)) == [] == seqs(lazy.by_offset(9, "m", 0, 1))


def test_read_errors(reader):
    for f in (lambda: reader.by_offset("x", "m", 4, 1), lambda: reader.by_key("x", "m", 180000, 1), lambda: reader.by_offset("no", "m", 0, 1), lambda: reader.by_offset(7, "m", 0, 1)):
        with pytest.raises(LookupError):
            f()
    for f in (lambda: reader.by_offset("x", "m", 0, 0), lambda: reader.by_offset("x", "m", -1, 1), lambda: reader.by_offset("x", "m", 0, 1, ["odd"]), lambda: reader.by_offset("x", "m", 0, 1, [99])):
        with pytest.raises(ValueError):
            f()


def test_archive_prunes(spark, tmp_path):
    made = bars(spark.createDataFrame(random_tape(5, 300), TAPE), MINUTE)
    store.write_archive(made, str(tmp_path / "a"), 8)
    back = store.read_archive(spark, str(tmp_path / "a"))
    assert back.count() == made.count()
    plan = CandleReader(back).by_key_range("a", "m", 0, 100000, ["close"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(candle_type" in plan and "GreaterThanOrEqual(key,0)" in plan and "volume" not in plan


@pytest.mark.parametrize("batch,cached", [(1, 1), (4, 2), (8, 1)])
def test_retention(spark, batch, cached):
    made = bars(spark.createDataFrame(random_tape(6, 200, ("a",)), TAPE), CandleSpec("t", "tick_count", 2))
    n, full, first = made.count(), 0, 0
    for k in range(1, n + 1):  # bar k opens: the chunk behind it is full every ``batch`` bars
        full = (k - 1) // batch
        while full - first > cached:
            first += 1
    assert sorted(seqs(store.hot(made, batch, cached))) == list(range(first * batch, n))
    assert sorted(set(r.chunk_no for r in store.full_chunks(made, batch).collect())) == list(range((n - 1) // batch))


def test_symbols_and_blocks(spark):
    tape = spark.createDataFrame([("b", 1, 1, 1, 1.0, 1.0), ("a", 2, 2, 2, 1.0, 1.0), ("b", 3, 3, 3, 1.0, 1.0), (None, 4, 4, 4, 1.0, 1.0)], TAPE)
    d = symbols.dictionary(tape)
    assert sorted(map(tuple, d.collect())) == [(0, "b"), (1, "a")] and symbols.id_of(d, "a") == 1 and symbols.name_of(d, 0) == "b"
    assert symbols.dictionary(tape, 1).count() == 1 and symbols.with_ids(tape, d).count() == 3
    with pytest.raises(LookupError):
        symbols.id_of(d, "z")
    assert sorted((r.symbol, r.block_no) for r in store.trade_blocks(tape.dropna(), 32768).collect()) == [("a", 0), ("b", 0), ("b", 0)]
    assert trades.choose_symbols(["A"], ["b"]) == ["a"] and trades.choose_symbols(None, ["b"]) == ["b"] and len(trades.choose_symbols([], [])) == 2


def test_as_of(spark):
    t = spark.createDataFrame([("x", 1, 5), ("x", 2, 10), ("y", 3, 10), ("x", 4, 95)], "symbol string, arrival long, ts long")
    e = spark.createDataFrame([("x", 1, 10, 1.0), ("x", 2, 10, 2.0), ("x", 3, 20, 3.0)], "symbol string, arrival long, ts long, p double")
    for width in (1000, 7):
        assert sorted((r.arrival, r.book_p) for r in book.as_of(t, e, ["p"], width=width).collect()) == [(1, None), (2, 2.0), (3, None), (4, 3.0)]
    assert [(r.p, r.updates) for r in book.final_state(e, ["p"]).collect()] == [(3.0, 3)]


def test_audit(spark):
    made = bars(spark.createDataFrame(golden(), TAPE), CandleSpec("b", "tick_modulo", 5))
    got = audit.audited(made, 5).collect()
    assert [(r.seq, r.gap, r.tick_error) for r in got] == [(1, False, True)]
    values = spark.createDataFrame([(v,) for v in (5, -3, 99, 100, 1_000_050, 2_000_000_000, None)], "v long")
    hist = audit.histogram(values, [], "v")
    assert sorted(map(tuple, hist.collect())) == [(0, 2), (100, 1), (1_000_000, 1), (1_000_000_000, 1)]
    assert audit.histogram_percentiles(hist, [], {"p": 0.5}).first().p == 100
    got = audit.sample_percentiles(spark.range(1000).select(F.lit("k").alias("k"), "id"), ["k"], "id", {"p50": 0.5, "p999": 0.999}).first()
    assert (got.p50, got.p999, got.max, got.n) == (500, 999, 999, 1000)
    assert [r[0] for r in spark.createDataFrame([(2047,), (2048,), (4097,)], "v long").select(audit.hdr_bin(F.col("v"))).collect()] == [2047, 2048, 4096]
    near = [2**k + d for k in range(12, 62) for d in (-1, 0, 1)]
    got = spark.createDataFrame([(v,) for v in near], "v long").select("v", audit.hdr_bin(F.col("v")).alias("b")).collect()
    assert all(r.b == r.v >> (r.v.bit_length() - 11) << (r.v.bit_length() - 11) for r in got)
    many = spark.createDataFrame([("k", (i * 7919) % 100_003 - 500) for i in range(20_000)], "k string, v long")
    own, got = sorted((i * 7919) % 100_003 - 500 for i in range(20_000)), audit.sample_percentiles(many, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.999, "d": 1.0}).first()
    assert (got.a, got.b, got.c, got.d, got.max, got.n) == (own[0], own[10_000], own[19_980], own[-1], own[-1], 20_000)
    assert audit.newer(made, spark.createDataFrame([("b", "x", 0)], "candle_type string, symbol string, last_key long")).count() == 1


def test_interval_report(spark):
    rows = spark.createDataFrame([(0, False, False, 100, 7, 0), (700_000, True, False, 300, 9, 0)], "at long, gap boolean, tick_error boolean, feed_latency long, internal_latency long, audit_latency long")
    got = audit.interval_report(rows, "at").orderBy("period").collect()
    assert [(r.total_candles, r.gaps, r.win_feed_p50, r.glb_feed_max) for r in got] == [(1, 0, 100, 100), (2, 1, 300, 300)] and len(got[0]) == 28


def test_codec(spark):
    cases = [(100, 50), (0, 5_000_000_000), (1700000000000000000, 1700000003000000000), (10, 20)]
    df = spark.createDataFrame(cases, "exch long, feed long").withColumn("p", scalar.pack_latency("exch", "feed"))
    got = df.select(scalar.unpack_latency("p").alias("lat"), scalar.unpack_feed("p", F.col("feed") + 7).alias("feed_back"), "feed").collect()
    assert [r.lat for r in got] == [0, 2**32 - 1, 3_000_000_000, 10] and all(r.feed == r.feed_back for r in got)


def test_ema_and_rates(spark):
    many = spark.createDataFrame([("k", i * 10**9, i * i * 10) for i in range(50)], "k string, at long, n long")
    rates, want = [10 * (2 * i - 1) for i in range(1, 50)], []
    for v in rates:
        want.append(v if not want else (v + 3 * want[-1]) >> 2)
    assert [r.smoothed for r in scalar.rates(many, ["k"], "at", "n").orderBy("at").collect()] == want
    assert spark.createDataFrame([([8, 16, 4],)], "v array<long>").select(scalar.integer_ema("v")).first()[0] == (4 + 3 * 10) >> 2
    got = scalar.rates(spark.createDataFrame([("k", 0, 0), ("k", 10**9, 8), ("k", 2 * 10**9, 24)], "k string, at long, n long"), ["k"], "at", "n").orderBy("at").collect()
    assert [(r.rate, r.smoothed) for r in got] == [(8, 8), (16, 10)]


def test_rates_of_large_counts(spark):
    """Counts whose product with the nanoseconds of a second leaves 64 bits."""
    day, n = 86400 * 10**9, 40_020 * 10**6
    rows = [("k", day * i, n * i * (i + 1) // 2) for i in range(1, 4)]
    got = scalar.rates(spark.createDataFrame(rows, "k string, at long, n long"), ["k"], "at", "n").orderBy("at").collect()
    first, second = (n * i * 10**9 // day for i in (2, 3))
    assert [(r.rate, r.smoothed) for r in got] == [(first, first), (second, (second + 3 * first) >> 2)]


def test_json(spark):
    good = '{"stream":"s","data":{"s":"BTCUSDT","T":5,"a":42,"p":"35000.10","q":"0.005"}}'
    lines = [good, "no json", "{}", good.replace('"a":42,', ""), good.replace("BTC", "ETH"), good.replace("35000.10", "x"), None]
    got = trades.json_trades(spark.createDataFrame([(x,) for x in lines], "value string"), spark.createDataFrame([("btcusdt",)], "symbol string")).collect()
    assert [(r.symbol, r.ts_ns, r.trade_id, r.price, r.volume) for r in got] == [("btcusdt", 5_000_000, 42, 35000.10, 0.005)]
    ticker = json.dumps([{"symbol": "AUSDT", "quoteVolume": "5"}, {"symbol": "BUSDT", "quoteVolume": "50"}, {"symbol": "CEUR", "quoteVolume": "99"}, {"symbol": "DUSDT", "quoteVolume": "?"}])
    assert [r.symbol for r in trades.top_symbols(spark.createDataFrame([(ticker,)], "value string"), 5).collect()] == ["busdt", "ausdt"]


def test_config_and_generators(spark, tmp_path):
    made = config.load('{"candles": [{"name": "m", "type": "TIME_FIXED", "threshold": 1000}, {}]}')
    assert made.top_n == 5 and made.candles[1].threshold == 60000
    with pytest.raises(ValueError):
        config.load('{"candles": [{"type": "ODD"}]}')
    zipf = trades.zipf_tape(spark, 2000, 10).groupBy("symbol").count().orderBy("symbol").collect()
    assert sum(r["count"] for r in zipf) == 2000 and zipf[0]["count"] > 3 * zipf[-1]["count"]
    assert trades.zipf_tape(spark, 100, 5).collect() == trades.zipf_tape(spark, 100, 5).collect()
    assert trades.steady_tape(spark, 25).agg(F.max("ts")).first()[0] == 1609459202000
    (tmp_path / "h.csv").write_text("bucket_start_ns,count\n0,3\n100,0\n")
    assert [tuple(r) for r in trades.read_histogram(spark, str(tmp_path / "h.csv")).collect()] == [(0, 3)]


def test_engine_config():
    ok = EngineConfig((MINUTE,))
    assert ok.batch == 1024 and ok.cached == 16 and least_memory(1, 2, 10, 10, 5, 4, 1) == 160
    f = lambda *a: None
    for bad in (dict(specs=()), dict(specs=(MINUTE,) * 2), dict(specs=(MINUTE,), max_symbols=0), dict(specs=(MINUTE,), trade_flush=(f, None)), dict(specs=(MINUTE,), book_state=(f, f, None)), dict(specs=tuple(CandleSpec(str(i), "time_fixed", 1) for i in range(33)))):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_mixed_workload(spark, tmp_path):
    from barsmith.engine import Engine
    from barsmith.plans import workloads

    engine = Engine(spark, EngineConfig((CandleSpec("t", "tick_count", 3),)), str(tmp_path / "e"))
    got = workloads.mixed(spark, engine, "t", 600, rounds=1, symbols=4, count=5, offsets=3).collect()
    assert [(r.PhaseName, r.ActiveReaders) for r in got] == [("feed", 0), ("mixed", 1)] and all(r.FeedCountPerSec > 0 for r in got)
    assert got[0].QueryLatency_P50_ns is None and got[1].QueryCountPerSec > 0 and got[1].FailedQueriesPerSec == 0
    assert sum(r.tick_count for r in engine.bars("t").collect()) == 1200


def test_workloads(spark):
    from barsmith.plans import workloads

    assert [r.FeedCountPerSec > 0 for r in workloads.feed(spark, 2000, 8).collect()] == [True, True]
    made = bars(spark.createDataFrame(random_tape(5, 300, ("a",)), TAPE), CandleSpec("t", "tick_count", 2)).cache()
    got = workloads.reads(spark, CandleReader(made), "a", "t", sizes=(3, 1000), fields=(None, ("close",)), queries=2, offsets=100).collect()
    assert len(got) == 8 and all(r.FailedQueries == (2 if r.QuerySize == 1000 else 0) for r in got) and {r.NumFields for r in got} == {10, 1}
    with pytest.raises(LookupError):
        workloads.reads(spark, CandleReader(made), "z", "t")
