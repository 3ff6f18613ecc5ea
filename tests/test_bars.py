import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tapes import TAPE, golden, late_ids, random_tape, replay

from barsmith.operators.bars import all_bars, bars, fold_bars, latest, volume_bars
from barsmith.operators.specs import CandleSpec

COLUMNS = ["symbol", "seq", "key", "is_closed", "open", "high", "low", "close", "volume", "tick_count", "start_id", "end_id"]
SPECS = [CandleSpec("t", "tick_count", 3), CandleSpec("m", "time_fixed", 60000), CandleSpec("b", "tick_modulo", 5)]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_golden(spark):
    tape = spark.createDataFrame(golden(), TAPE)
    minute = [r[1:] for r in rows(bars(tape, SPECS[1]))]
    assert minute == [
        (0, 0, True, 10.0, 12.0, 10.0, 12.0, 3.0, 2, 1, 2), (1, 60000, True, 11.0, 11.0, 9.0, 9.0, 6.0, 2, 3, 4),
        (2, 120000, True, 13.0, 13.0, 8.0, 8.0, 3.0, 2, 5, 7), (3, 300000, False, 10.0, 10.5, 10.0, 10.2, 5.0, 3, 8, 10),
    ]
    assert [r[1:4] + r[4:8] for r in rows(bars(tape, SPECS[0]))] == [(0, 1, True, 10.0, 12.0, 10.0, 11.0), (1, 4, True, 9.0, 13.0, 8.0, 8.0), (2, 8, True, 10.0, 10.5, 10.0, 10.2)]
    assert [r[1:4] + r[9:] for r in rows(bars(tape, SPECS[2]))] == [(0, 0, True, 4, 1, 4), (1, 5, True, 4, 5, 9), (2, 10, False, 1, 10, 10)]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.kind)
@pytest.mark.parametrize("width", [1 << 20, 16])
def test_like_replay(spark, spec, width):
    for seed in (1, 2):
        tape = random_tape(seed, 300)
        assert rows(bars(spark.createDataFrame(tape, TAPE).repartition(5), spec, width)) == sorted(replay(tape, spec))


@pytest.mark.parametrize("ids", [[0, 1, 10, 11, 2, 12, 20, 21], [8, 9, 5, 10], [9, 4, 19, 3, 19, 29, 9, 9, 12], [19, 9, 9, 9, 9]])
@pytest.mark.parametrize("width", [1 << 20, 3])
def test_late_ids(spark, ids, width):
    tape = [("x", i, d, i, 1.0 + i, 1.0) for i, d in enumerate(ids)]
    spec = CandleSpec("b", "tick_modulo", 10)
    assert rows(bars(spark.createDataFrame(tape, TAPE), spec, width)) == sorted(replay(tape, spec))


def test_late_ids_are_those_of_the_rule(spark):
    """0 1 | 10 11 2 12 | 20 21: the late 2 joins the open bar; 8 9 | 5 | 10: it starts one behind a bar that closed."""
    counts = lambda ids: [r.tick_count for r in bars(spark.createDataFrame([("x", i, d, i, 1.0, 1.0) for i, d in enumerate(ids)], TAPE), CandleSpec("b", "tick_modulo", 10)).orderBy("seq").collect()]
    assert counts([0, 1, 10, 11, 2, 12, 20, 21]) == [2, 4, 2] and counts([8, 9, 5, 10]) == [2, 1, 1]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.sampled_from([2, 3, 10]), st.sampled_from([1 << 20, 40, 5]))
def test_any_ids(spark, seed, step, width):
    tape = late_ids(seed, 150)
    spec = CandleSpec("b", "tick_modulo", step)
    assert rows(bars(spark.createDataFrame(tape, TAPE).repartition(3), spec, width)) == sorted(replay(tape, spec))


def test_invariants(spark):
    tape = spark.createDataFrame(random_tape(3, 400), TAPE)
    made = all_bars(tape, SPECS).toPandas()
    for _, g in made.groupby(["candle_type", "symbol"]):
        g = g.sort_values("seq")
        assert list(g.seq) == list(range(len(g))) and g.key.is_monotonic_increasing and g.is_closed.iloc[:-1].all()
    assert (made.low <= made[["open", "close"]].min(axis=1)).all() and (made.high >= made[["open", "close"]].max(axis=1)).all()
    assert made.groupby("candle_type").tick_count.sum().eq(400).all()


def test_fold_equals_windows(spark):
    tape = random_tape(4, 200)

    def init(t):
        return {"key": t["trade_id"], "is_closed": False, "n": 1}

    def update(bar, t):
        bar["n"] += 1
        bar["is_closed"] = bar["n"] >= 3
        return True

    got = fold_bars(spark.createDataFrame(tape, TAPE), CandleSpec("t", "fold", init=init, update=update), "n long")
    want = bars(spark.createDataFrame(tape, TAPE), SPECS[0])
    assert sorted(map(tuple, got.select("symbol", "seq", "key", "n").collect())) == sorted(map(tuple, want.select("symbol", "seq", "key", "tick_count").collect()))


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_batches_that_close_no_bar(spark, size):
    tape = random_tape(4, 200)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = bars(spark.createDataFrame(tape, TAPE), CandleSpec("v", "volume", 60)).select("symbol", "seq", "volume", "tick_count").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for s in "abc":
        total, seq, n = 0, 0, 0
        for r in (r for r in tape if r[0] == s):
            if total >= 60:
                want.append((s, seq, total, n))
                total, seq, n = 0, seq + 1, 0
            total, n = total + r[5], n + 1
        want.append((s, seq, total, n))
    assert sorted(map(tuple, got)) == want


def test_fold_sees_the_book(spark):
    tape = spark.createDataFrame([("x", i, i, 10 * i, 1.0, 1.0) for i in range(6)], TAPE)
    events = spark.createDataFrame([("x", 15, 0, 7.0), ("x", 40, 1, 9.0)], "symbol string, ts long, arrival long, best double")

    def init(t, book):
        return {"key": t["trade_id"], "is_closed": False, "best": None if book is None else book["best"]}

    def update(bar, t, book):
        return (None if book is None else book["best"]) == bar["best"]

    spec = CandleSpec("b", "fold", init=init, update=update, schema="best double")
    got = fold_bars(tape, spec, events=events, state=["best"]).orderBy("seq").collect()
    assert [(r.key, r.best) for r in got] == [(0, None), (2, 7.0), (4, 9.0)]


def test_volume_resets(spark):
    got = volume_bars(spark.createDataFrame([("x", i, i, i, 1.0, v) for i, v in enumerate([3.0, 4.0, 9.0, 1.0, 1.0])], TAPE), CandleSpec("v", "volume", 7)).collect()
    assert [(r.volume, r.tick_count, r.is_closed) for r in got] == [(7.0, 2, True), (9.0, 1, True), (2.0, 2, False)]


def test_nulls_nan_empty(spark):
    bad = [("x", 0, 0, 0, float("nan"), 1.0), ("x", 1, 1, 1, None, 1.0), ("x", 2, 2, 2, 5.0, 1.0)]
    got = bars(spark.createDataFrame(bad, TAPE), SPECS[1]).collect()
    assert len(got) == 1 and got[0].open == got[0].high == 5.0
    assert bars(spark.createDataFrame([], TAPE), SPECS[0]).count() == 0


def test_calendar_and_latest(spark):
    month = bars(spark.createDataFrame([("x", 0, 0, 1704067200000, 1.0, 1.0), ("x", 1, 1, 1706745600000, 2.0, 1.0)], TAPE), CandleSpec("c", "calendar", unit="month"))
    assert [r.key for r in month.orderBy("seq").collect()] == [1704067200000, 1706745600000]
    assert latest(month).first().close == 2.0


@pytest.mark.parametrize("args", [("", "tick_count", 5), ("a", "odd", 5), ("a", "tick_count", 1), ("a", "time_fixed", 0), ("a", "time_fixed", 1.5), ("a", "calendar"), ("a", "fold")])
def test_specs_are_checked(args):
    with pytest.raises(ValueError):
        CandleSpec(*args)


def test_one_shuffle_by_symbol_for_aggregation(spark):
    plan = bars(spark.createDataFrame(golden(), TAPE), SPECS[2])._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan  # bars are aggregated before they are dealt
