"""Trade tapes and book events from tables, JSON lines and generators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.scalar import epoch_ms

TAPE = "symbol string, arrival long, trade_id long, ts long, price double, volume double"
#: The message of a combined trade stream: symbol, time in ms, id, price and quantity as text.
MESSAGE = "stream string, data struct<s: string, T: long, a: long, p: string, q: string>"
TICKER = "array<struct<symbol: string, quoteVolume: string>>"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a tape: one symbol a type, the event's number as order and id, k of its properties as volume."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    volume = F.get_json_object("props", "$.k").cast("long").cast("double")
    return rows.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("arrival"), F.col("event_id").alias("trade_id"), epoch_ms("ts").alias("ts"), F.col("value").alias("price"), volume.alias("volume"))


def late_events(spark: SparkSession, sf_dir: str, every: int = 10, late_ms: int = 7_200_000) -> DataFrame:
    """The same tape with every tenth trade stamped two hours early, so that it arrives late."""
    return events(spark, sf_dir).withColumn("ts", F.when(F.col("arrival") % every == 3, F.col("ts") - late_ms).otherwise(F.col("ts")))


def late_id_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tape with ids out of order: every seventh trade has one from 25 before, every eleventh one from 13 ahead."""
    at = F.col("arrival")
    return events(spark, sf_dir).withColumn("trade_id", F.when(at % 7 == 3, at - F.least(at, F.lit(25))).when(at % 11 == 5, at + 13).otherwise(at))


def book_events(spark: SparkSession, sf_dir: str, kind: str = "view") -> DataFrame:
    """Events of one type as updates of a user's book: symbol = user."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    return rows.select(F.col("user_id").cast("string").alias("symbol"), epoch_ms("ts").alias("ts"), F.col("event_id").alias("arrival"), F.col("value").alias("price"))


def user_trades(spark: SparkSession, sf_dir: str, kind: str = "purchase") -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    return rows.select(F.col("user_id").cast("string").alias("symbol"), F.col("event_id").alias("arrival"), epoch_ms("ts").alias("ts"), F.col("value").alias("price"))


def json_trades(lines: DataFrame, symbols: DataFrame | None = None, column: str = "value") -> DataFrame:
    """Trades from JSON lines, static or streaming.

    A line is dropped if it isn't JSON, lacks one of the five fields, has a price or quantity that is no number, or, with
    ``symbols`` (a column symbol), a symbol that is not registered.  Symbols are lower-cased.  Times become nanoseconds too.
    """
    data = lines.select(F.from_json(column, MESSAGE, {"mode": "PERMISSIVE"}).alias("m")).select("m.data.*")
    rows = data.select(F.lower("s").alias("symbol"), F.col("a").alias("arrival"), F.col("a").alias("trade_id"), F.col("T").alias("ts"), F.expr("try_cast(p AS double)").alias("price"), F.expr("try_cast(q AS double)").alias("volume"), (F.col("T") * 1_000_000).alias("ts_ns"))
    rows = rows.dropna(how="any")
    return rows if symbols is None else rows.join(symbols.select("symbol"), "symbol")


def top_symbols(documents: DataFrame, n: int, contains: str = "usdt", column: str = "value") -> DataFrame:
    """The ``n`` symbols of largest quote volume from ticker arrays: lower-cased, with ``contains`` in their name."""
    if n <= 0:
        raise ValueError("n must be positive")
    rows = documents.select(F.explode(F.from_json(column, TICKER)).alias("t"))
    rows = rows.select(F.lower("t.symbol").alias("symbol"), F.expr("try_cast(t.quoteVolume AS double)").alias("quote_volume"))
    return rows.where(F.col("quote_volume").isNotNull() & F.col("symbol").contains(contains)).orderBy(F.desc("quote_volume"), "symbol").limit(n)


def choose_symbols(manual: list[str] | None, found: list[str] | None, default: tuple[str, ...] = ("btcusdt", "ethusdt")) -> list[str]:
    """A manual list goes before found symbols, these before the default pair."""
    return [s.lower() for s in manual] if manual else list(found) if found else list(default)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(bucket_start_ns, count) from CSV, without empty buckets."""
    return spark.read.schema("bucket_start_ns long, count long").option("header", True).csv(path).where("count > 0")


def steady_tape(spark: SparkSession, n: int, symbol: str = "SYM0000", seed: int = 1) -> DataFrame:
    """Ids from 0, ten trades a second from 2021-01-01, prices 100 to 110, volumes 1 to 101."""
    return spark.range(n).select(F.lit(symbol).alias("symbol"), F.col("id").alias("arrival"), F.col("id").alias("trade_id"), (F.lit(1609459200000) + F.expr("id div 10") * 1000).alias("ts"), (100 + 10 * F.rand(seed)).alias("price"), (1 + 100 * F.rand(seed + 1)).alias("volume"))


def zipf_tape(spark: SparkSession, n: int, symbols: int, s: float = 0.99, seed: int = 1, partitions: int = 8) -> DataFrame:
    """Trades over ``symbols`` symbols whose shares fall with rank ** -s (0: even); the same tape for the same arguments."""
    if symbols <= 0 or s < 0:
        raise ValueError("symbols must be positive and s not negative")

    def draw(batches):
        share = np.arange(1, symbols + 1, dtype=np.float64) ** -s
        upto = np.cumsum(share) / share.sum()
        for pdf in batches:
            if len(pdf):
                u = np.random.default_rng([seed, int(pdf["id"].iloc[0])]).random((len(pdf), 3))
                rank = np.minimum(np.searchsorted(upto, u[:, 0]), symbols - 1)
                yield pd.DataFrame({"symbol": [f"SYM{r:04d}" for r in rank], "arrival": pdf["id"], "trade_id": pdf["id"], "ts": 1609459200000 + pdf["id"] // 10 * 1000, "price": 100 + u[:, 1], "volume": 1 + 100 * u[:, 2]})

    return spark.range(0, n, 1, partitions).mapInPandas(draw, TAPE)
