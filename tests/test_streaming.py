import pytest
from tapes import TAPE, random_tape

from barsmith.operators.bars import bars
from barsmith.operators.specs import CandleSpec
from barsmith.streaming.bars import FIELDS, ChunkSink, bar_schema, bar_stream, book_stream, fold, write_bars, write_raw

COLUMNS = ["symbol", "seq", "key", "is_closed", "open", "high", "low", "close", "volume", "tick_count", "start_id", "end_id"]


@pytest.fixture()
def files(spark, tmp_path):
    tape = random_tape(9, 240)
    for k in range(4):
        spark.createDataFrame(tape[60 * k : 60 * k + 60], TAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tape, tmp_path


def coded(schema="close double, tick_count long"):
    def init(t):
        return {"key": t["trade_id"], "is_closed": False, "close": t["price"], "tick_count": 1}

    def update(bar, t):
        bar["close"], bar["tick_count"] = t["price"], bar["tick_count"] + 1
        bar["is_closed"] = bar["tick_count"] >= 4
        return True

    return CandleSpec("f", "fold", init=init, update=update, schema=schema)


KINDS = [CandleSpec("t", "tick_count", 7), CandleSpec("m", "time_fixed", 60000), CandleSpec("b", "tick_modulo", 5), CandleSpec("c", "calendar", unit="day"), CandleSpec("v", "volume", 30), coded()]


@pytest.mark.parametrize("spec", KINDS, ids=lambda s: s.kind)
def test_stream_equals_batch(spark, files, spec):
    tape, folder = files
    read = spark.readStream.schema(TAPE).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    fields = spec.schema or FIELDS
    query = write_bars(bar_stream(read, spec), str(folder / "out"), str(folder / "check"), 8, fields)
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive
    sink = ChunkSink(str(folder / "out"), 8, fields)
    want = bars(spark.createDataFrame(tape, TAPE), spec)
    names = [c for c in want.columns if c != "amount"]
    rows = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert rows(sink.read(spark)) == rows(want)
    if spec.kind != "tick_count":
        return
    sink.compact(spark)
    assert rows(sink.read(spark)) == rows(want) and len(list((folder / "out" / "done").iterdir())) <= 1
    sink.compact(spark, cached=0)
    newest = {s: max(r.seq for r in want.collect() if r.symbol == s) for s in "abc"}
    assert {(r.symbol, r.seq) for r in sink.read(spark).collect()} == {(r.symbol, r.seq) for r in want.collect() if r.seq // 8 >= newest[r.symbol] // 8}


def streamed(spark, upto):
    """Done and last bars of the first ``upto`` trades, in batches of 10, as the sink gets them."""
    spec, tape, out, state = KINDS[0], random_tape(2, upto, ("a",)), [], None
    for at in range(0, upto, 10):
        done, state = fold(spec, state, [dict(zip(TAPE.replace(",", "").split()[::2], r)) for r in tape[at : at + 10]])
        rows = [b | {"final": True} for b in done] + [dict(state) | {"final": False}]
        out.append(spark.createDataFrame([dict(r, candle_type="t", symbol="a") for r in rows], bar_schema()))
    return out


@pytest.mark.parametrize("where", ["done", "open"])
def test_a_batch_that_died_comes_again(spark, tmp_path, monkeypatch, where):
    from pyspark.sql.readwriter import DataFrameWriter

    sink, batches = ChunkSink(str(tmp_path / "a"), 4), streamed(spark, 40)
    rows = lambda: sorted(map(tuple, sink.read(spark).select(*COLUMNS).collect()))
    sink(batches[0], 0)
    sink(batches[1], 1)
    before = rows()
    write = DataFrameWriter.parquet

    def failing(self, path, *a, **k):
        write(self, path, *a, **k)
        if f"/{where}/" in path:
            (tmp_path / "a" / where / "batch=2" / "_SUCCESS").unlink()
            raise OSError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError):
        sink(batches[2], 2)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert rows() == before
    sink(batches[2], 2)
    sink(batches[2], 2)
    sink(batches[3], 3)
    assert rows() == sorted(map(tuple, bars(spark.createDataFrame(random_tape(2, 40, ("a",)), TAPE), KINDS[0]).select(*COLUMNS).collect()))


def test_raw_and_book(spark, files):
    tape, folder = files
    read = lambda: spark.readStream.schema(TAPE).option("maxFilesPerTrigger", 2).parquet(str(folder / "in"))
    write_raw(read(), str(folder / "raw"), str(folder / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(folder / "raw")).count() == 240
    states = book_stream(read(), lambda e: (e["price"], 1), lambda s, e: (e["price"], s[1] + 1), "last double, n long")
    query = states.writeStream.outputMode("update").format("memory").queryName("books").option("checkpointLocation", str(folder / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r.symbol: r.n for r in spark.sql("SELECT symbol, max(n) AS n FROM books GROUP BY symbol").collect()}
    assert got == {s: sum(r[0] == s for r in tape) for s in "abc"}
