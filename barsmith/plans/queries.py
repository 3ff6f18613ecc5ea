"""The registered queries, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions import scalar
from barsmith.operators import audit, bars, book, query as reading, store, symbols
from barsmith.operators.specs import CandleSpec
from barsmith.plans.registry import query
from barsmith.sources.sinks import REPORT
from barsmith.sources import trades as tapes

HOUR, DAY = 3_600_000, 86_400_000
TICK5 = CandleSpec("tick5", "tick_count", 5)
HOURS = CandleSpec("time_1h", "time_fixed", HOUR)
DAYS = CandleSpec("time_1d", "time_fixed", DAY)
MODULO = CandleSpec("modulo10", "tick_modulo", 10)
MONTHS = CandleSpec("month", "calendar", unit="month", zone="UTC")
WEEKS = CandleSpec("week", "calendar", unit="week", zone="UTC")

_TAPE = "SELECT event_type AS symbol, event_id AS arrival, event_id AS trade_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts, value AS price, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS DOUBLE) AS volume FROM events"
_LATE = f"SELECT symbol, arrival, trade_id, CASE WHEN arrival % 10 = 3 THEN ts - 7200000 ELSE ts END AS ts, price, volume FROM ({_TAPE})"
_FIELDS = "open, high, low, close, volume, round(amount, 4) AS amount, tick_count, start_id, end_id, last_ts"


def _sql(name: str, kind: str, step: int = 0, tape: str = _TAPE) -> str:
    """Bars in SQL, as a subquery."""
    bucket = {
        "tick_count": f"CAST(floor((row_number() OVER (PARTITION BY symbol ORDER BY arrival) - 1) / {step or 1}) AS BIGINT)",
        "tick_modulo": f"trade_id - trade_id % {step or 1}",
        "time_fixed": f"max(ts - ts % {step or 1}) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "month": "max(epoch_ms(date_trunc('month', make_timestamp(ts * 1000)))) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "week": "max(epoch_ms(date_trunc('week', make_timestamp(ts * 1000)))) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    }[kind]
    closed = {"tick_count": f"tick_count >= {step}", "tick_modulo": f"nxt IS NOT NULL OR (tick_count >= 2 AND (end_id + 1) % {step or 1} = 0)"}.get(kind, "nxt IS NOT NULL")
    key = "start_id" if kind == "tick_count" else "bucket"
    return f"""(SELECT '{name}' AS candle_type, symbol, seq, {key} AS key, {closed} AS is_closed, open, high, low, close, volume, amount, tick_count, start_id, end_id, last_ts FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY first_arrival) - 1 AS seq, lead(bucket) OVER (PARTITION BY symbol ORDER BY first_arrival) AS nxt FROM (
            SELECT symbol, bucket, min(arrival) AS first_arrival, arg_min(price, arrival) AS open, max(price) AS high, min(price) AS low, arg_max(price, arrival) AS close, sum(volume) AS volume,
                sum(price * volume) AS amount, count(*) AS tick_count, arg_min(trade_id, arrival) AS start_id, arg_max(trade_id, arrival) AS end_id, arg_max(ts, arrival) AS last_ts
            FROM (SELECT *, {bucket} AS bucket FROM ({tape})) GROUP BY symbol, bucket)))"""


_TICK5, _HOURS, _DAYS, _MODULO = _sql("tick5", "tick_count", 5), _sql("time_1h", "time_fixed", HOUR), _sql("time_1d", "time_fixed", DAY), _sql("modulo10", "tick_modulo", 10)


def _select(source: str, more: str = "", where: str = "") -> str:
    return f"SELECT candle_type, symbol, seq, key, is_closed, {_FIELDS}{more} FROM {source} {where}"


def _out(candles: DataFrame) -> DataFrame:
    return candles.withColumn("amount", F.round("amount", 4))


def _tick5(spark, d):
    return bars.bars(tapes.events(spark, d), TICK5)


def _hours(spark, d):
    return bars.bars(tapes.events(spark, d), HOURS)


@query("bars_tick5", _select(_TICK5))
def bars_tick5(spark, d):
    return _out(_tick5(spark, d))


@query("bars_time_1h", _select(_HOURS))
def bars_time_1h(spark, d):
    return _out(_hours(spark, d))


@query("bars_time_1d", _select(_DAYS))
def bars_time_1d(spark, d):
    return _out(bars.bars(tapes.events(spark, d), DAYS))


@query("bars_time_late", _select(_sql("time_1h", "time_fixed", HOUR, _LATE)))
def bars_time_late(spark, d):
    return _out(bars.bars(tapes.late_events(spark, d), HOURS))


@query("bars_tick_modulo", _select(_MODULO))
def bars_tick_modulo(spark, d):
    return _out(bars.bars(tapes.events(spark, d), MODULO))


_LATE_IDS = f"SELECT symbol, arrival, CASE WHEN arrival % 7 = 3 THEN arrival - least(arrival, 25) WHEN arrival % 11 = 5 THEN arrival + 13 ELSE arrival END AS trade_id, ts, price, volume FROM ({_TAPE})"


# The rule of the bars, trade by trade: key of the open bar, its number, whether it's closed.
@query("bars_tick_modulo_late", f"""WITH RECURSIVE t AS (SELECT *, trade_id - trade_id % 10 AS a, (trade_id + 1) % 10 = 0 AS c, row_number() OVER (PARTITION BY symbol ORDER BY arrival) AS rn FROM ({_LATE_IDS})),
    f AS (SELECT symbol, rn, a AS key, CAST(0 AS BIGINT) AS seq, false AS closed FROM t WHERE rn = 1
        UNION ALL SELECT t.symbol, t.rn, CASE WHEN f.closed OR t.a > f.key THEN t.a ELSE f.key END, CASE WHEN f.closed OR t.a > f.key THEN f.seq + 1 ELSE f.seq END, NOT f.closed AND t.a <= f.key AND t.c FROM f JOIN t ON t.symbol = f.symbol AND t.rn = f.rn + 1),
    b AS (SELECT f.symbol, f.seq, min(f.key) AS key, bool_or(f.closed) AS closed, arg_min(price, arrival) AS open, max(price) AS high, min(price) AS low, arg_max(price, arrival) AS close, sum(volume) AS volume, round(sum(price * volume), 4) AS amount, count(*) AS tick_count,
        arg_min(trade_id, arrival) AS start_id, arg_max(trade_id, arrival) AS end_id, arg_max(ts, arrival) AS last_ts FROM f JOIN t USING (symbol, rn) GROUP BY f.symbol, f.seq)
    SELECT 'modulo10' AS candle_type, symbol, seq, key, closed OR seq < max(seq) OVER (PARTITION BY symbol) AS is_closed, open, high, low, close, volume, amount, tick_count, start_id, end_id, last_ts FROM b""")
def bars_tick_modulo_late(spark, d):
    """Aligned-id bars of a tape whose ids come late and early."""
    return _out(bars.bars(tapes.late_id_events(spark, d), MODULO))


@query("bars_month", _select(_sql("month", "month")))
def bars_month(spark, d):
    return _out(bars.bars(tapes.events(spark, d), MONTHS))


@query("bars_week", _select(_sql("week", "week")))
def bars_week(spark, d):
    return _out(bars.bars(tapes.events(spark, d), WEEKS))


@query("bars_amount", f"SELECT symbol, seq, round(amount, 4) AS amount, round(amount / volume, 6) AS vwap FROM {_DAYS} WHERE volume > 0")
def bars_amount(spark, d):
    made = bars.bars(tapes.events(spark, d), DAYS).where("volume > 0")
    return made.select("symbol", "seq", F.round("amount", 4).alias("amount"), F.round(F.col("amount") / F.col("volume"), 6).alias("vwap"))


@query("bars_last_times", f"SELECT b.symbol, b.seq, b.close, 1700000000000000000 + b.end_id * 1234567891 AS feed_ts, 1700000000000000000 + b.end_id * 1234567891 + 700 AS local_ts FROM {_MODULO} b")
def bars_last_times(spark, d):
    """Bars with the feed and local time of their last trade."""
    feed = F.lit(1700000000000000000) + F.col("trade_id") * 1234567891
    tape = tapes.events(spark, d).withColumn("feed_ts", feed).withColumn("local_ts", feed + 700)
    spec = CandleSpec("modulo10", "tick_modulo", 10, fields=("close",), last=("feed_ts", "local_ts"))
    return bars.bars(tape, spec).select("symbol", "seq", "close", "feed_ts", "local_ts")


@query("bars_open_only", _select(_HOURS, where="WHERE NOT is_closed"))
def bars_open_only(spark, d):
    return _out(_hours(spark, d).where("NOT is_closed"))


@query("bars_seq", f"SELECT symbol, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, count(DISTINCT seq) AS n_seq FROM {_TICK5} GROUP BY symbol")
def bars_seq(spark, d):
    return _tick5(spark, d).groupBy("symbol").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), F.countDistinct("seq").alias("n_seq"))


@query("bars_multi", " UNION ALL ".join(_select(s) for s in (_TICK5, _HOURS, _MODULO)))
def bars_multi(spark, d):
    return _out(bars.all_bars(tapes.events(spark, d), [TICK5, HOURS, MODULO]))


@query("bars_users", _select(_sql("time_1d", "time_fixed", DAY, _TAPE.replace("event_type AS symbol", "CAST(user_id AS VARCHAR) AS symbol"))))
def bars_users(spark, d):
    """Daily bars with many symbols: one a user."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("user"))
    tape = tapes.events(spark, d).join(rows, F.col("arrival") == rows.event_id).drop("symbol", "event_id").withColumnRenamed("user", "symbol")
    return _out(bars.bars(tape, DAYS))


@query("bars_fold", f"SELECT symbol, seq, key, is_closed, close, tick_count FROM {_MODULO}")
def bars_fold(spark, d):
    """The aligned-id bars again, by user code in arrival order."""

    def init(t):
        return {"key": t["trade_id"] - t["trade_id"] % 10, "close": t["price"], "tick_count": 1, "is_closed": False}

    def update(bar, t):
        if t["trade_id"] >= bar["key"] + 10:
            bar["is_closed"] = True
            return False
        bar["close"] = t["price"]
        bar["tick_count"] += 1
        bar["is_closed"] = (t["trade_id"] + 1) % 10 == 0
        return True

    spec = CandleSpec("modulo10", "fold", init=init, update=update)
    return bars.fold_bars(tapes.events(spark, d), spec, "close double, tick_count long").drop("candle_type")


@query("bars_volume", f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival) AS rn FROM ({_TAPE})),
    f AS (SELECT symbol, rn, volume, volume AS total, CAST(0 AS BIGINT) AS seq FROM t WHERE rn = 1
        UNION ALL SELECT t.symbol, t.rn, t.volume, CASE WHEN f.total >= 5000 THEN t.volume ELSE f.total + t.volume END, CASE WHEN f.total >= 5000 THEN f.seq + 1 ELSE f.seq END FROM f JOIN t ON t.symbol = f.symbol AND t.rn = f.rn + 1)
    SELECT symbol, seq, sum(volume) AS volume, count(*) AS tick_count, sum(volume) >= 5000 AS is_closed FROM f GROUP BY symbol, seq""")
def bars_volume(spark, d):
    """Bars of a volume of 5,000; each starts its sum anew."""
    return bars.volume_bars(tapes.events(spark, d), CandleSpec("volume5000", "volume", 5000)).select("symbol", "seq", "volume", "tick_count", "is_closed")


_SYMBOLS = f"(SELECT CAST(row_number() OVER (ORDER BY min(arrival)) - 1 AS INTEGER) AS symbol_id, symbol FROM ({_TAPE}) GROUP BY symbol)"


@query("symbol_dictionary", f"SELECT symbol_id, symbol FROM {_SYMBOLS}")
def symbol_dictionary(spark, d):
    return symbols.dictionary(tapes.events(spark, d))


@query("symbol_lookup", f"SELECT s.symbol_id, t.arrival, t.price FROM ({_TAPE}) t JOIN {_SYMBOLS} s USING (symbol)")
def symbol_lookup(spark, d):
    tape = tapes.events(spark, d)
    return symbols.with_ids(tape, symbols.dictionary(tape)).select("symbol_id", "arrival", "price")


@query("symbol_names", f"SELECT x.symbol_id, s.symbol FROM (SELECT CAST(unnest([0, 2, 99]) AS INTEGER) AS symbol_id) x LEFT JOIN {_SYMBOLS} s USING (symbol_id)")
def symbol_names(spark, d):
    ids = spark.createDataFrame([(0,), (2,), (99,)], "symbol_id int")
    return symbols.with_names(ids, symbols.dictionary(tapes.events(spark, d))).select("symbol_id", "symbol")


_USERS = "(SELECT CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS symbol_id, CAST(user_id AS VARCHAR) AS symbol FROM events GROUP BY user_id)"


def _user_symbols(spark, d):
    return symbols.dictionary(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("symbol"), F.col("event_id").alias("arrival")))


@query("symbol_shards", f"SELECT CAST(floor(symbol_id / 40) AS INTEGER) AS shard, count(*) AS n, min(symbol_id) AS first_id FROM {_USERS} GROUP BY 1")
def symbol_shards(spark, d):
    return symbols.shards(_user_symbols(spark, d), 40).groupBy("shard").agg(F.count("*").alias("n"), F.min("symbol_id").alias("first_id"))


@query("feeder_shards", f"SELECT CAST(least(floor(symbol_id / greatest(floor(n / 4), 1)), 3) AS INTEGER) AS shard, count(*) AS n_symbols FROM (SELECT symbol_id, count(*) OVER () AS n FROM {_USERS}) GROUP BY 1")
def feeder_shards(spark, d):
    return symbols.feeder_shards(_user_symbols(spark, d), 4).groupBy("shard").agg(F.count("*").alias("n_symbols"))


def _reader(spark, d):
    tape = tapes.events(spark, d)
    return reading.CandleReader(_out(bars.bars(tape, TICK5)), symbols.dictionary(tape), strict=False)


def _hour_reader(spark, d):
    tape = tapes.events(spark, d)
    return reading.CandleReader(_out(bars.bars(tape, HOURS)), symbols.dictionary(tape), strict=False)


_OWN = f"{_TICK5} WHERE symbol = 'purchase'"
_NEWEST = f"(SELECT max(seq) FROM {_OWN})"


@query("q_offset_latest", _select(_OWN, where=f"AND seq > {_NEWEST} - 20"))
def q_offset_latest(spark, d):
    return _reader(spark, d).by_offset("purchase", "tick5", 0, 20)


@query("q_offset_shifted", _select(_OWN, where=f"AND seq BETWEEN {_NEWEST} - 24 AND {_NEWEST} - 10"))
def q_offset_shifted(spark, d):
    return _reader(spark, d).by_offset("purchase", "tick5", 10, 15)


@query("q_offset_id", _select(f"{_TICK5} b WHERE symbol = (SELECT symbol FROM {_SYMBOLS} WHERE symbol_id = 1)", where=f"AND seq > (SELECT max(seq) FROM {_TICK5} c WHERE c.symbol = b.symbol) - 7"))
def q_offset_id(spark, d):
    return _reader(spark, d).by_offset(1, "tick5", 0, 7)


_KEY = f"(SELECT key FROM {_OWN} AND seq = 12)"


@query("q_key_last_n", _select(_OWN, where="AND seq BETWEEN 5 AND 12"))
def q_key_last_n(spark, d):
    """The bars up to the one whose key is the trade id of the 61st purchase."""
    return _reader(spark, d).by_key("purchase", "tick5", _sixty_first(spark, d), 8)


def _sixty_first(spark, d) -> int:
    """First trade of the bar with seq 12."""
    return tapes.events(spark, d).where("symbol = 'purchase'").select("arrival").orderBy("arrival").offset(60).limit(1).first()[0]


@query("q_key_id", _select(_OWN, where="AND seq BETWEEN 5 AND 12"))
def q_key_id(spark, d):
    """The same by the symbol's id."""
    reader = _reader(spark, d)
    return reader.by_key(symbols.id_of(reader.symbols, "purchase"), "tick5", _sixty_first(spark, d), 8)


@query("q_key_range", _select(f"{_HOURS} WHERE symbol = 'click'", where="AND key BETWEEN 1704153600000 AND 1704412800000"))
def q_key_range(spark, d):
    return _hour_reader(spark, d).by_key_range("click", "time_1h", 1704153600000, 1704412800000)


@query("q_count_range", f"SELECT count(*) AS n FROM {_HOURS} WHERE symbol = 'click' AND key BETWEEN 1704153600000 AND 1704412800000")
def q_count_range(spark, d):
    return _hour_reader(spark, d).counted("click", "time_1h", 1704153600000, 1704412800000)


_SECOND = f"{_HOURS} WHERE symbol = (SELECT symbol FROM {_SYMBOLS} WHERE symbol_id = 1)"


@query("q_key_range_id", _select(_SECOND, where="AND key BETWEEN 1704153600000 AND 1704412800000"))
def q_key_range_id(spark, d):
    return _hour_reader(spark, d).by_key_range(1, "time_1h", 1704153600000, 1704412800000)


@query("q_count_range_id", f"SELECT count(*) AS n FROM {_SECOND} AND key BETWEEN 1704153600000 AND 1704412800000")
def q_count_range_id(spark, d):
    return _hour_reader(spark, d).counted(1, "time_1h", 1704153600000, 1704412800000)


@query("q_archive_and_open", _select(_TICK5, where="WHERE symbol IN ('click', 'purchase')"))
def q_archive_and_open(spark, d):
    """Bars of an archive and newer ones at hand, some of which the archive has with fewer trades."""
    tape = tapes.events(spark, d).where("symbol IN ('click', 'purchase')")
    early = bars.bars(tape.where("arrival % 1000 < 900 AND arrival < 1000 OR arrival < 500"), TICK5)
    whole = bars.bars(tape, TICK5)
    closed = early.where("is_closed")
    newest = closed.groupBy("symbol").agg(F.max("seq").alias("had"))
    at_hand = whole.join(newest, "symbol").where("seq >= had").drop("had")
    return _out(store.with_open(closed, at_hand))


@query("q_seq_range", f"SELECT min(seq) AS first_seq, max(seq) AS last_seq FROM {_HOURS} WHERE symbol = 'click' AND key BETWEEN 1704153600000 AND 1704412800000")
def q_seq_range(spark, d):
    return spark.createDataFrame([reading.CandleReader(_hours(spark, d)).seq_range("click", "time_1h", 1704153600000, 1704412800000)], "first_seq long, last_seq long")


@query("q_projection", f"SELECT candle_type, symbol, seq, key, is_closed, high, low, close FROM {_OWN} AND seq > {_NEWEST} - 50")
def q_projection(spark, d):
    return _reader(spark, d).by_offset("purchase", "tick5", 0, 50, ["high", 2, "close"])


@query("q_all_symbols", _select(f"(SELECT *, max(seq) OVER (PARTITION BY symbol) AS newest FROM {_TICK5})", where="WHERE seq BETWEEN newest - 4 AND newest - 2"))
def q_all_symbols(spark, d):
    return _out(reading.last_of_each(_tick5(spark, d), 3, 2))


@query("chunks", f"SELECT symbol, CAST(floor(seq / 64) AS BIGINT) AS chunk_no, min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM {_TICK5} GROUP BY 1, 2")
def chunks(spark, d):
    return store.with_chunks(_tick5(spark, d), 64).groupBy("symbol", "chunk_no").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


@query("hot_window", f"SELECT symbol, seq, key, close FROM (SELECT *, max(seq) OVER (PARTITION BY symbol) AS newest FROM {_TICK5}) WHERE seq >= greatest(0, floor(newest / 64) - 2) * 64")
def hot_window(spark, d):
    return store.hot(_tick5(spark, d), 64, 2).select("symbol", "seq", "key", "close")


@query("flushed_chunks", f"SELECT symbol, chunk_no, count(*) AS n, sum(tick_count)::BIGINT AS trades FROM (SELECT *, CAST(floor(seq / 64) AS BIGINT) AS chunk_no, max(seq) OVER (PARTITION BY symbol) AS newest FROM {_TICK5}) WHERE chunk_no < floor(newest / 64) GROUP BY 1, 2")
def flushed_chunks(spark, d):
    return store.full_chunks(_tick5(spark, d), 64).groupBy("symbol", "chunk_no").agg(F.count("*").alias("n"), F.sum("tick_count").alias("trades"))


@query("trade_blocks", f"SELECT symbol, CAST(floor(record_no / 2048) AS BIGINT) AS block_no, count(*) AS n, min(trade_id) AS first_id, max(trade_id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival) - 1 AS record_no FROM ({_TAPE})) GROUP BY 1, 2")
def trade_blocks(spark, d):
    return store.trade_blocks(tapes.events(spark, d), 32).groupBy("symbol", "block_no").agg(F.count("*").alias("n"), F.min("trade_id").alias("first_id"), F.max("trade_id").alias("last_id"))


@query("asof_book", """SELECT t.symbol, t.arrival, t.ts, t.price, b.price AS book_price, b.arrival AS book_arrival
    FROM (SELECT CAST(user_id AS VARCHAR) AS symbol, event_id AS arrival, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts, value AS price FROM events WHERE event_type = 'purchase') t
    ASOF LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts, max(event_id) AS arrival, arg_max(value, event_id) AS price FROM events WHERE event_type = 'view' GROUP BY 1, 2) b
    ON t.symbol = b.symbol AND t.ts >= b.ts""")
def asof_book(spark, d):
    return book.as_of(tapes.user_trades(spark, d), tapes.book_events(spark, d), ["price", "arrival"], width=DAY)


@query("book_state", "SELECT CAST(user_id AS VARCHAR) AS symbol, arg_max(value, event_id) AS price, count(*) AS updates FROM events WHERE event_type = 'view' GROUP BY 1")
def book_state(spark, d):
    return book.final_state(tapes.book_events(spark, d), ["price"])


_NS = "1700000000000000000 + event_id * 1234567891 AS feed, 1700000000000000000 + event_id * 1234567891 - CAST(floor(value * 1000003) AS BIGINT) + 2000000 AS exch"


def _stamped(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    feed = F.lit(1700000000000000000) + F.col("event_id") * 1234567891
    return rows.withColumn("feed", feed).withColumn("exch", feed - F.floor(F.col("value") * 1000003).cast("long") + 2000000)


@query("latency_codec", f"""SELECT event_id, lat * 4294967296 + (feed % 4294967296) AS packed, lat AS latency, CASE WHEN feed <= feed + 5000 THEN feed END AS feed_ns
    FROM (SELECT event_id, feed, least(greatest(feed - exch, 0), 4294967295) AS lat FROM (SELECT event_id, {_NS} FROM events))""")
def latency_codec(spark, d):
    rows = _stamped(spark, d).withColumn("packed", scalar.pack_latency("exch", "feed"))
    return rows.select("event_id", "packed", scalar.unpack_latency("packed").alias("latency"), scalar.unpack_feed("packed", F.col("feed") + 5000).alias("feed_ns"))


@query("bars_packed_times", _select(_sql("time_1m", "time_fixed", 60000, f"SELECT * REPLACE (1700000000000 + (arrival * 1234567891 - (CAST(floor(price * 1000003) AS BIGINT) - 2000000 > 0)::BIGINT * (CAST(floor(price * 1000003) AS BIGINT) - 2000000)) // 1000000 AS ts) FROM ({_TAPE})")))
def bars_packed_times(spark, d):
    """Bars of exchange times that come packed with their latency: unpacked against the local clock, then taken as the trades' times."""
    stamped = _stamped(spark, d).select("event_id", scalar.pack_latency("exch", "feed").alias("packed"), (F.col("feed") + 5000).alias("local"))
    feed = scalar.unpack_feed("packed", F.col("local"))
    times = stamped.select("event_id", scalar.ns_to_ms(feed - scalar.unpack_latency("packed")).alias("exchange_ms"))
    tape = tapes.events(spark, d).join(times, F.col("arrival") == F.col("event_id")).withColumn("ts", F.col("exchange_ms")).drop("event_id", "exchange_ms")
    return _out(bars.bars(tape, CandleSpec("time_1m", "time_fixed", 60000)))


@query("align", f"SELECT arrival, ts - ts % 60000 AS minute, trade_id - trade_id % 7 AS block, ts * 1000000 AS ns, lower(upper(symbol)) AS name FROM ({_TAPE})")
def align(spark, d):
    t = tapes.events(spark, d)
    return t.select("arrival", scalar.align_down("ts", 60000).alias("minute"), scalar.align_down("trade_id", 7).alias("block"), scalar.ms_to_ns("ts").alias("ns"), F.lower(F.upper("symbol")).alias("name"))


_DAILY = "SELECT CAST(floor(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) / 86400000) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("ema_rate", f"""WITH RECURSIVE c AS (SELECT event_type, (day + 1) * 86400 * 1000000000 AS at_ns, sum(n) OVER (PARTITION BY event_type ORDER BY day) AS total, row_number() OVER (PARTITION BY event_type ORDER BY day) AS rn FROM ({_DAILY})),
    r AS (SELECT a.event_type, a.at_ns, a.rn - 1 AS rn, CAST(floor((a.total - b.total) * 1000000000000 * 1000 / (a.at_ns - b.at_ns)) AS BIGINT) AS rate FROM c a JOIN c b ON a.event_type = b.event_type AND a.rn = b.rn + 1),
    e AS (SELECT event_type, at_ns, rn, rate, rate AS smoothed FROM r WHERE rn = 1 UNION ALL SELECT r.event_type, r.at_ns, r.rn, r.rate, (r.rate + 3 * e.smoothed) >> 2 FROM e JOIN r ON r.event_type = e.event_type AND r.rn = e.rn + 1)
    SELECT event_type, at_ns, rate, smoothed FROM e""")
def ema_rate(spark, d):
    """Events in a million seconds from one day to the next, smoothed."""
    daily = tapes.events(spark, d).groupBy(F.floor(F.col("ts") / DAY).alias("day"), F.col("symbol").alias("event_type")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("event_type").orderBy("day")) * 1_000_000
    samples = daily.select("event_type", ((F.col("day") + 1) * 86400 * 1_000_000_000).alias("at_ns"), total.alias("total"))
    return scalar.rates(samples, ["event_type"], "at_ns", "total")


@query("latest_per_symbol", _select(f"(SELECT *, max(seq) OVER (PARTITION BY symbol) AS newest FROM {_TICK5})", where="WHERE seq = newest"))
def latest_per_symbol(spark, d):
    return _out(bars.latest(_tick5(spark, d)))


_AUDITED = f"(SELECT *, start_id <> before + 1 AS gap, tick_count <> 10 AS tick_error FROM (SELECT *, lag(end_id) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM {_MODULO} WHERE is_closed) WHERE before IS NOT NULL)"


def _audited(spark, d):
    return audit.audited(bars.bars(tapes.events(spark, d), MODULO), 10)


@query("audit_gaps", f"SELECT symbol, seq, start_id, end_id FROM {_AUDITED} WHERE gap")
def audit_gaps(spark, d):
    return _audited(spark, d).where("gap").select("symbol", "seq", "start_id", "end_id")


@query("audit_tick_errors", f"SELECT symbol, seq, tick_count FROM {_AUDITED} WHERE tick_error")
def audit_tick_errors(spark, d):
    return _audited(spark, d).where("tick_error").select("symbol", "seq", "tick_count")


@query("audit_counters", f"SELECT candle_type, count(*) AS candles, sum(gap::BIGINT)::BIGINT AS gaps, sum(tick_error::BIGINT)::BIGINT AS tick_errors FROM {_AUDITED} GROUP BY candle_type")
def audit_counters(spark, d):
    return audit.counters(_audited(spark, d))


@query("audit_incremental", f"SELECT symbol, seq, key FROM {_HOURS} WHERE is_closed AND key > 1704412800000")
def audit_incremental(spark, d):
    made = _hours(spark, d)
    cursors = made.select("candle_type", "symbol").distinct().withColumn("last_key", F.lit(1704412800000))
    return audit.newer(made, cursors).select("symbol", "seq", "key")


_LAT = "SELECT event_type, CAST(floor(value * 1000003) AS BIGINT) - 2000000 AS raw, greatest(CAST(floor(value * 1000003) AS BIGINT) - 2000000, 0) AS lat FROM events"


def _latencies(spark, d):
    return _stamped(spark, d).withColumn("raw", F.col("feed") - F.col("exch")).withColumn("lat", F.greatest("raw", F.lit(0)))


@query("audit_latencies", f"SELECT event_id, greatest(feed - exch, 0) AS feed_latency, greatest(event_id % 977 - 100, 0) AS internal_latency, greatest(event_id * 7 % 1301 - event_id % 977 + 100, 0) AS audit_latency FROM (SELECT event_id, {_NS} FROM events)")
def audit_latencies(spark, d):
    local = F.col("feed") + F.col("event_id") % 977 - 100
    rows = _stamped(spark, d).withColumns({"exchange_ts": F.col("exch"), "feed_ts": F.col("feed"), "local_ts": local, "read_ts": F.col("feed") + F.col("event_id") * 7 % 1301})
    return audit.latencies(rows).select("event_id", "feed_latency", "internal_latency", "audit_latency")


def _place(p: float) -> str:
    return f"max(CASE WHEN rn = CAST(floor(n * {p}) AS BIGINT) + 1 THEN lat END)"


@query("latency_percentiles", f"SELECT event_type, {_place(0.5)} AS p50, {_place(0.99)} AS p99, {_place(0.999)} AS p999, max(lat) AS max, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY lat) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM ({_LAT})) GROUP BY event_type")
def latency_percentiles(spark, d):
    return audit.sample_percentiles(_latencies(spark, d), ["event_type"], "lat", audit.POINTS)


_BIN = "CASE WHEN raw < 1000000 THEN raw - raw % 100 WHEN raw < 10000000 THEN raw - raw % 1000 WHEN raw < 100000000 THEN raw - raw % 10000 WHEN raw < 1000000000 THEN raw - raw % 100000 ELSE 1000000000 END"
_HIST = f"(SELECT event_type, {_BIN} AS bucket_start_ns, count(*) AS count FROM ({_LAT}) WHERE raw >= 0 GROUP BY 1, 2)"


@query("latency_histogram", f"SELECT event_type, bucket_start_ns, count FROM {_HIST}")
def latency_histogram(spark, d):
    return audit.histogram(_latencies(spark, d), ["event_type"], "raw")


@query("hist_merge", f"SELECT bucket_start_ns, sum(count)::BIGINT AS count FROM {_HIST} GROUP BY bucket_start_ns")
def hist_merge(spark, d):
    return audit.merged(audit.histogram(_latencies(spark, d), ["event_type"], "raw"), [])


def _reach(p: float) -> str:
    return f"min(CASE WHEN upto >= greatest(ceil(n * {p}), 1) THEN bucket_start_ns END)"


@query("hist_percentile", f"SELECT event_type, {_reach(0.5)} AS p50, {_reach(0.99)} AS p99, {_reach(0.999)} AS p999, max(n)::BIGINT AS n FROM (SELECT *, sum(count) OVER (PARTITION BY event_type ORDER BY bucket_start_ns) AS upto, sum(count) OVER (PARTITION BY event_type) AS n FROM {_HIST}) GROUP BY event_type")
def hist_percentile(spark, d):
    return audit.histogram_percentiles(audit.histogram(_latencies(spark, d), ["event_type"], "raw"), ["event_type"], audit.POINTS)


_HDR = "CAST(floor(raw / (1 << CAST(greatest(length(bin(greatest(raw, 1))) - 11, 0) AS INTEGER))) * (1 << CAST(greatest(length(bin(greatest(raw, 1))) - 11, 0) AS INTEGER)) AS BIGINT)"


def _hdr_at(p: float) -> str:
    return f"min(CASE WHEN upto >= greatest(floor(total * {p} + 0.5), 1) THEN b END)"


@query("hdr_histogram", f"SELECT event_type, {_hdr_at(0.5)} AS p50, {_hdr_at(0.99)} AS p99, round(sum(b * n)::DOUBLE / max(total), 3) AS mean, max(b) AS max, max(total)::BIGINT AS n FROM (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM (SELECT event_type, {_HDR} AS b, count(*) AS n FROM ({_LAT}) WHERE raw >= 0 GROUP BY 1, 2)) GROUP BY event_type")
def hdr_histogram(spark, d):
    return audit.hdr_summary(_latencies(spark, d), ["event_type"], "raw", {"p50": 0.5, "p99": 0.99}).withColumn("mean", F.round("mean", 3))


_WIDE = "CASE WHEN event_id % 3 = 0 THEN (CAST(1 AS BIGINT) << CAST(event_id % 62 AS INTEGER)) - 1 WHEN event_id % 3 = 1 THEN CAST(1 AS BIGINT) << CAST(event_id % 62 AS INTEGER) ELSE (CAST(1 AS BIGINT) << CAST(event_id % 62 AS INTEGER)) + event_id END"


@query("hdr_bins", f"SELECT v, v - v % (CAST(1 AS BIGINT) << CAST(greatest(length(bin(greatest(v, 1))) - 11, 0) AS INTEGER)) AS b FROM (SELECT DISTINCT {_WIDE} AS v FROM events)")
def hdr_bins(spark, d):
    """Bins of values beside powers of two up to 2^62."""
    power = F.expr("shiftleft(cast(1 AS bigint), cast(event_id % 62 AS int))")
    v = F.when(F.col("event_id") % 3 == 0, power - 1).when(F.col("event_id") % 3 == 1, power).otherwise(power + F.col("event_id"))
    return spark.read.parquet(f"{d}/events.parquet").select(v.alias("v")).distinct().withColumn("b", audit.hdr_bin(F.col("v")))


@query("phase_summary", "SELECT event_type AS phase, round(avg(value), 6) AS value, round(avg(user_id), 6) AS user_id, count(*) AS samples FROM events GROUP BY 1")
def phase_summary(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "phase")
    return audit.phase_summary(rows, ["value", "user_id"]).withColumns({"value": F.round("value", 6), "user_id": F.round("user_id", 6)})


def _json_lines(spark, d):
    """Messages of the tape, some of them cut off or without a price."""
    t = tapes.events(spark, d)
    price = F.when(F.col("arrival") % 17 == 0, F.lit("")).otherwise(F.concat(F.lit(',"p":"'), F.col("price").cast("string"), F.lit('"')))
    line = F.concat(F.lit('{"stream":"x","data":{"s":"'), F.upper("symbol"), F.lit('","T":'), F.col("ts").cast("string"), F.lit(',"a":'), F.col("arrival").cast("string"), price, F.lit(',"q":"'), F.when(F.col("arrival") % 29 == 0, F.lit("many")).otherwise(F.col("volume").cast("string")), F.lit('"'), F.when(F.col("arrival") % 23 == 0, F.lit("")).otherwise(F.lit("}}")))
    return t.select(line.alias("value")), t.where("symbol != 'error'").select("symbol").distinct()


@query("json_trades", f"SELECT symbol, trade_id, ts, price, volume, ts * 1000000 AS ts_ns FROM ({_TAPE}) WHERE symbol <> 'error' AND arrival % 17 <> 0 AND arrival % 23 <> 0 AND arrival % 29 <> 0")
def json_trades(spark, d):
    lines, known = _json_lines(spark, d)
    return tapes.json_trades(lines, known).select("symbol", "trade_id", "ts", "price", "volume", "ts_ns")


@query("top_symbols", "SELECT 'user' || user_id || 'usdt' AS symbol, v AS quote_volume FROM (SELECT user_id, sum(CAST(floor(value * 100) AS BIGINT))::DOUBLE AS v FROM events WHERE user_id % 3 <> 0 GROUP BY user_id) ORDER BY v DESC, symbol LIMIT 10")
def top_symbols(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 100)).cast("double").alias("v"))
    name = F.concat(F.lit("USER"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, F.lit("EUR")).otherwise(F.lit("USDT")))
    array = F.concat(F.lit('[{"symbol":"'), name, F.lit('","quoteVolume":"'), F.col("v").cast("string"), F.lit('"},{"symbol":"BADUSDT","quoteVolume":"none"}]'))
    return tapes.top_symbols(rows.select(array.alias("value")), 10)


def _report_sql() -> str:
    """The interval report by day: every bin counts in its own period (win) and in all later ones (glb)."""
    base = f"(SELECT event_id, day * 86400000 AS period, event_id % 11 = 0 AS gap, event_id % 13 = 0 AS tick_error, lat AS feed, lat % 1000 AS internal, CAST(event_id AS BIGINT) AS audit FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, greatest(CAST(floor(value * 1000003) AS BIGINT) - 2000000, 0) AS lat FROM events))"
    joins, columns = "", []
    for name in ("feed", "internal", "audit"):
        hist = f"(SELECT period, {_BIN.replace('raw', name)} AS bucket_start_ns, count(*) AS count, max({name}) AS top FROM {base} GROUP BY 1, 2)"
        for scope, source in (("win", hist), ("glb", f"(SELECT p.period, bucket_start_ns, sum(count) AS count, max(top) AS top FROM {hist} h JOIN (SELECT DISTINCT period FROM {base}) p ON h.period <= p.period GROUP BY 1, 2)")):
            label = f"{scope}_{name}"
            joins += f" JOIN (SELECT period, {_reach(0.5)} AS p50, {_reach(0.99)} AS p99, {_reach(0.999)} AS p999, max(top) AS max FROM (SELECT *, sum(count) OVER (PARTITION BY period ORDER BY bucket_start_ns) AS upto, sum(count) OVER (PARTITION BY period) AS n FROM {source}) GROUP BY period) {label} USING (period)"
            columns += [f"{label}.{p} AS {label}_{p}" for p in ("p50", "p99", "p999", "max")]
    sums = f"(SELECT period, sum(c) OVER (ORDER BY period)::BIGINT AS total_candles, sum(g) OVER (ORDER BY period)::BIGINT AS gaps, sum(t) OVER (ORDER BY period)::BIGINT AS tick_errors FROM (SELECT period, count(*) AS c, sum(gap::BIGINT) AS g, sum(tick_error::BIGINT) AS t FROM {base} GROUP BY period))"
    return f"SELECT period, total_candles, gaps, tick_errors, {', '.join(columns)} FROM {sums} {joins}"


@query("interval_report", _report_sql())
def interval_report(spark, d):
    rows = _latencies(spark, d).withColumns({
        "at": scalar.epoch_ms("ts"), "gap": F.col("event_id") % 11 == 0, "tick_error": F.col("event_id") % 13 == 0, "feed_latency": F.col("lat"), "internal_latency": F.col("lat") % 1000, "audit_latency": F.col("event_id"),
    })
    return audit.interval_report(rows.select("at", "gap", "tick_error", "feed_latency", "internal_latency", "audit_latency"), "at", DAY).select(*REPORT)
