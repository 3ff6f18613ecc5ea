"""Bars from trades: every trade, in arrival order, lands in exactly one bar of each type.

A tape has columns symbol, arrival (a unique integer that orders the symbol's trades), trade_id, ts (epoch milliseconds),
price and volume.  There is no watermark: a trade that is older than the open bar is merged into it, and spans without
trades have no bars.  So a time bar's key is the *running maximum* of the aligned time by arrival, not the aligned time.

The built-in kinds are windows and aggregates with partial sums; ``fold_bars`` runs user code in arrival order.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barsmith.operators.book import as_of
from barsmith.operators.sliced import WIDTH, counted, numbered, running_max, sliced
from barsmith.operators.specs import BASE, CandleSpec


def clean(trades: DataFrame) -> DataFrame:
    """Without trades whose price is null or NaN: those have no place in an order of prices."""
    return trades.where(F.col("price").isNotNull() & ~F.isnan("price"))


def _bucketed(trades: DataFrame, spec: CandleSpec, width: int) -> DataFrame:
    step = int(spec.threshold)
    if spec.kind == "tick_count":
        return numbered(trades, ["symbol"], "arrival", "__n", width).withColumn("bucket", F.expr(f"__n div {step}")).drop("__n")
    if spec.kind == "time_fixed":
        aligned = F.col("ts") - F.pmod("ts", F.lit(step))
    else:
        # Wall-clock time without a zone, so that the session's plays no part.
        zone = F.lit(spec.zone) if spec.zone else F.current_timezone()
        local = F.convert_timezone(F.lit("UTC"), zone, F.expr("timestampadd(MILLISECOND, ts, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))
        start = F.convert_timezone(zone, F.lit("UTC"), F.date_trunc(spec.unit, local).cast("timestamp_ntz"))
        aligned = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), start)
    return running_max(trades, ["symbol"], "arrival", aligned, "bucket", width)


def _summed() -> list:
    """What a bar says of its trades; every part can be merged."""
    return [
        F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"), F.min_by("price", "arrival").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "arrival").alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount"), F.count("*").alias("tick_count"), F.min_by("trade_id", "arrival").alias("start_id"), F.max_by("trade_id", "arrival").alias("end_id"), F.max_by("ts", "arrival").alias("last_ts"),
    ]


def bars(trades: DataFrame, spec: CandleSpec, width: int = WIDTH) -> DataFrame:
    """Bars of one type: base columns and the spec's fields.  The last bar of a symbol may be open.

    ``calendar`` units follow the spec's time zone, or the session's.
    """
    if spec.kind == "volume":
        return volume_bars(trades, spec)
    if spec.kind == "fold":
        return fold_bars(trades, spec)
    if spec.kind == "tick_modulo":
        done = _modulo(clean(trades), spec, width)
    else:
        grouped = _bucketed(clean(trades), spec, width).groupBy("symbol", "bucket").agg(*_summed(), *[F.max_by(c, "arrival").alias(c) for c in spec.last])
        if spec.kind == "tick_count":  # the number of a tick bar is its bucket
            done = grouped.withColumn("seq", F.col("bucket")).withColumn("key", F.col("start_id")).withColumn("is_closed", F.col("tick_count") >= int(spec.threshold))
        else:
            done = numbered(grouped, ["symbol"], "first_arrival", "seq", width, "__bars", once=True).withColumn("key", F.col("bucket"))
            done = done.withColumn("is_closed", F.col("seq") < F.col("__bars") - 1)
    return done.withColumn("candle_type", F.lit(spec.name)).select(*BASE, *spec.fields, *spec.last)


def _modulo(trades: DataFrame, spec: CandleSpec, width: int) -> DataFrame:
    """Bars of aligned ids, of whatever order.

    A bar's key is its first trade's aligned id.  A trade whose aligned id is larger starts the next bar; any other joins,
    late ones too, and if it is the last id of a block (a *closing* id) it closes the bar, so that the trade behind it starts
    a bar, late or not.  A bar's first trade never closes it.

    Behind a closing id a bar is closed, or open with that id as its first trade, so what a tape does from one closing id to
    the next is a map of one bit: always closed, always open, or the other one.  Within a slice these maps compose in a
    window.  Over slices one row each is folded in order: the key of the open bar that a slice starts with, if any.
    """
    step = int(spec.threshold)
    w, past = Window.partitionBy("symbol", "__slice").orderBy("arrival"), (Window.unboundedPreceding, -1)
    rows = sliced(trades, "arrival", width)
    rows = rows.withColumn("__a", F.col("trade_id") - F.pmod("trade_id", F.lit(step))).withColumn("__c", F.pmod(F.col("trade_id") + 1, F.lit(step)) == 0)
    closing = F.when(F.col("__c"), F.col("__a"))
    rows = rows.withColumn("__g", F.coalesce(F.sum(F.col("__c").cast("int")).over(w.rowsBetween(*past)), F.lit(0))).withColumn("__k", F.last(closing, ignorenulls=True).over(w.rowsBetween(*past)))
    rows = rows.withColumn("__m", F.max("__a").over(Window.partitionBy("symbol", "__slice", "__g").orderBy("arrival").rowsBetween(*past)))
    # Of a closing id behind another: 1 if it always closes, 0 if it never does, 2 if it does just when the bar before is open.
    always, ever = F.coalesce(F.col("__a") <= F.col("__m"), F.lit(False)), F.col("__a") <= F.greatest("__k", "__m")
    rows = rows.withColumn("__v", F.when(F.col("__c") & (F.col("__g") > 0), F.when(always, 1).when(ever, 2).otherwise(0)))
    turns = F.when(F.col("__v") == 2, 1).otherwise(0)
    rows = rows.withColumn("__n", F.sum(turns).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.when(F.col("__v") < 2, F.struct(F.col("__v").alias("v"), F.col("__n").alias("n")))
    rows = rows.withColumn("__known", F.last(known, ignorenulls=True).over(w.rowsBetween(*past))).withColumn("__turns", F.col("__n") - turns)

    end = F.struct(F.when(F.col("__v") < 2, F.struct(F.col("__v").alias("v"), F.col("__n").alias("n"))).otherwise(F.col("__known")).alias("known"), F.col("__n").alias("n"), F.col("__a").alias("a"), (F.col("__g") + 1).alias("g"))
    first = F.when(F.col("__c") & (F.col("__g") == 0), F.struct(F.col("__a").alias("a"), F.col("__m").alias("m")))
    per = rows.groupBy("symbol", "__slice").agg(F.max(first).alias("first"), F.max_by(end, F.when(F.col("__c"), F.col("arrival"))).alias("end"), F.max(F.struct(F.col("__g").alias("g"), F.col("__a").alias("a"))).alias("tail"))
    tail = F.when(F.col("tail.g") >= F.coalesce("end.g", F.lit(0)), F.col("tail.a"))
    per = per.select("symbol", "__slice", "first.a", "first.m", F.col("end.known.v").alias("v"), (F.col("end.n") - F.coalesce("end.known.n", F.lit(0))).alias("n"), F.col("end.a").alias("last"), tail.alias("tail"))

    def enter(table: pa.Table) -> pa.Table:
        """Key of the open bar before each slice, and whether its first closing id closes a bar."""
        most = lambda *x: max((y for y in x if y is not None), default=None)
        table, key, keys, shuts = table.sort_by("__slice"), None, [], []
        for row in table.select(["a", "m", "v", "n", "last", "tail"]).to_pylist():
            before, shut = most(key, row["m"]), False
            keys.append(key)
            if row["a"] is None:
                key = most(key, row["tail"])
            else:
                shut = before is not None and row["a"] <= before
                closed = (shut if row["v"] is None else row["v"] == 1) ^ (row["n"] % 2 == 1)
                key = row["tail"] if closed else most(row["last"], row["tail"])
            shuts.append(int(shut))
        return pa.table([table["symbol"], table["__slice"], pa.array(keys, pa.int64()), pa.array(shuts, pa.int32())], ["symbol", "__slice", "__enter", "__shut"])

    entered = per.groupBy("symbol").applyInArrow(enter, "symbol string, __slice long, __enter long, __shut int")  # one row for each ``width`` trades
    rows = rows.join(entered, ["symbol", "__slice"])
    shut = (F.coalesce("__known.v", "__shut") + F.col("__turns") - F.coalesce("__known.n", F.lit(0))) % 2 == 1
    before = F.greatest(F.when(F.col("__g") == 0, F.col("__enter")).when(~shut, F.col("__k")), F.col("__m"))
    rows = rows.withColumn("__start", F.coalesce(F.col("__a") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("__bar", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Slices have parts of bars; a part that no trade starts goes on with the bar before it.
    parts = rows.groupBy("symbol", "__slice", "__bar").agg(*_summed(), F.max("__start").alias("__start"), F.max_by("__a", -F.col("arrival")).alias("key"), *[F.max_by(c, "arrival").alias(c) for c in spec.last])
    parts = counted(parts.drop("__slice", "__bar"), ["symbol"], "first_arrival", "__start", "seq", width, "__bars")
    late, early = F.col("last_arrival"), F.col("first_arrival")
    whole = parts.groupBy("symbol", "seq").agg(
        F.min_by("key", early).alias("key"), F.min_by("open", early).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", late).alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
        F.sum("tick_count").alias("tick_count"), F.min_by("start_id", early).alias("start_id"), F.max_by("end_id", late).alias("end_id"), F.max_by("last_ts", late).alias("last_ts"), F.max("__bars").alias("__bars"), *[F.max_by(c, late).alias(c) for c in spec.last],
    )
    closes = (F.col("tick_count") >= 2) & (F.pmod(F.col("end_id") + 1, F.lit(step)) == 0)
    return whole.withColumn("is_closed", (F.col("seq") < F.col("__bars") - 1) | closes)


def all_bars(trades: DataFrame, specs: list[CandleSpec], width: int = WIDTH) -> DataFrame:
    """Bars of several types from one tape."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [bars(trades, s, width) for s in specs])


def fold_bars(trades: DataFrame, spec: CandleSpec, schema: str | None = None, events: DataFrame | None = None, state: list[str] | None = None) -> DataFrame:
    """Bars by user code, a left fold over each symbol's trades.

    ``spec.init(trade) -> dict`` starts a bar (with ``key`` and ``is_closed``); ``spec.update(bar, trade) -> bool`` takes a trade in, may
    set ``is_closed``, and returns False to leave the trade to the next bar.  ``schema`` (or the spec's) names the fields
    besides key and is_closed.  With book ``events``, both get a further argument: the ``state`` columns of the symbol's book as
    of the trade, a dict, None before the first event.

    Trades come to the code sorted, a batch at a time: what is held is one open bar and one batch, whatever the tape.  A
    symbol is one task's work, because the code may depend on all that was before.
    """
    fields = StructType.fromDDL(f"candle_type string, symbol string, seq long, key long, is_closed boolean, {schema or spec.schema}")
    arrow = to_arrow_schema(fields)
    init, update, label, names, books, booked = spec.init, spec.update, spec.name, fields.names[3:], state or [], events is not None
    tape = clean(trades)
    if booked:
        seen = as_of(tape, events.withColumn("__any", F.lit(True)), [*books, "__any"])
        tape = seen.withColumnRenamed("book___any", "__any")

    def fold(batches):
        bar, symbol, seq = None, None, 0
        for batch in batches:
            out = []
            for trade in batch.to_pylist():
                more = ()
                if booked:
                    book = {c: trade.pop(f"book_{c}") for c in books}
                    more = (book if trade.pop("__any") else None,)
                if trade["symbol"] != symbol:
                    if bar is not None:
                        out.append((symbol, seq, bar))
                    bar, symbol, seq = None, trade["symbol"], 0
                if bar is None:
                    bar = init(trade, *more)
                elif bar["is_closed"] or not update(bar, trade, *more):
                    out.append((symbol, seq, bar))
                    bar, seq = init(trade, *more), seq + 1
            if out:
                yield made(out)
        if bar is not None:
            yield made([(symbol, seq, bar)])

    def made(rows: list) -> pa.RecordBatch:
        columns = [[label] * len(rows), [r[0] for r in rows], [r[1] for r in rows], *[[r[2][n] for r in rows] for n in names]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return tape.repartition("symbol").sortWithinPartitions("symbol", "arrival").mapInArrow(fold, fields)


def volume_bars(trades: DataFrame, spec: CandleSpec) -> DataFrame:
    """Bars that close with the trade that brings their volume to the threshold; the sum starts anew with each bar."""
    limit = spec.threshold

    def init(t):
        return {"key": t["trade_id"], "open": t["price"], "high": t["price"], "low": t["price"], "close": t["price"], "volume": t["volume"], "amount": t["price"] * t["volume"], "tick_count": 1, "start_id": t["trade_id"], "end_id": t["trade_id"], "last_ts": t["ts"], "is_closed": t["volume"] >= limit}

    def update(bar, t):
        bar["high"], bar["low"], bar["close"] = max(bar["high"], t["price"]), min(bar["low"], t["price"]), t["price"]
        bar["volume"] += t["volume"]
        bar["amount"] += t["price"] * t["volume"]
        bar["tick_count"] += 1
        bar["end_id"], bar["last_ts"] = t["trade_id"], t["ts"]
        bar["is_closed"] = bar["volume"] >= limit
        return True

    fold = CandleSpec(spec.name, "fold", init=init, update=update, schema="open double, high double, low double, close double, volume double, amount double, tick_count long, start_id long, end_id long, last_ts long")
    return fold_bars(trades, fold).select(*BASE, *spec.fields)


def latest(candles: DataFrame) -> DataFrame:
    """The newest bar, open or not, of each symbol and type."""
    others = [c for c in candles.columns if c not in ("candle_type", "symbol")]
    return candles.groupBy("candle_type", "symbol").agg(F.max_by(F.struct(*others), "seq").alias("bar")).select("candle_type", "symbol", "bar.*")


def previous(column: str):
    """``column`` of the bar before."""
    return F.lag(column).over(Window.partitionBy("candle_type", "symbol").orderBy("seq"))
