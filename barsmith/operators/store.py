"""Chunks, retention and the archive of bars, and raw blocks of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.operators.sliced import WIDTH, numbered


def with_chunks(candles: DataFrame, batch: int) -> DataFrame:
    """``chunk_no``: the storage unit of ``batch`` bars that a bar belongs to."""
    if batch <= 0:
        raise ValueError("a chunk holds one bar at least")
    return candles.withColumn("chunk_no", F.expr(f"seq div {int(batch)}"))


def hot(candles: DataFrame, batch: int, cached: int) -> DataFrame:
    """Bars that an in-memory window keeps: full chunks leave, oldest first, once more than ``cached`` of them wait.

    A chunk is full when a bar behind it has begun.
    """
    n = candles.groupBy("candle_type", "symbol").agg(F.max("seq").alias("__newest"))
    first = F.greatest(F.lit(0), F.floor(F.col("__newest") / batch) - cached) * batch
    return candles.join(n, ["candle_type", "symbol"]).where(F.col("seq") >= first).drop("__newest")


def full_chunks(candles: DataFrame, batch: int) -> DataFrame:
    """Bars of chunks that are ready for a sink: each chunk exactly once, when a bar behind it has begun."""
    n = candles.groupBy("candle_type", "symbol").agg(F.max("seq").alias("__newest"))
    return with_chunks(candles, batch).join(n, ["candle_type", "symbol"]).where(F.col("chunk_no") < F.floor(F.col("__newest") / batch)).drop("__newest")


def write_archive(candles: DataFrame, path: str, batch: int = 1024, mode: str = "overwrite") -> None:
    """Bars as Parquet by type, hashed to files by symbol and chunk and sorted, so that filters on key and seq skip row groups.

    The partition column is the type only: symbols are too many for folders and too uneven for tasks, chunks are even.
    """
    made = with_chunks(candles, batch).repartition("candle_type", "symbol", F.expr("chunk_no div 64")).sortWithinPartitions("candle_type", "symbol", "seq")
    made.write.mode(mode).partitionBy("candle_type").parquet(path)


def read_archive(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_open(archive: DataFrame, open_bars: DataFrame) -> DataFrame:
    """Archived bars and those still at hand as one table: of bars in both, the one at hand (it has all trades).

    The bars at hand are few and the archive is not dealt: Spark broadcasts them while they are small.
    """
    keys = ["candle_type", "symbol", "seq"]
    names = [c for c in open_bars.columns if c in archive.columns]
    return archive.join(open_bars.select(*keys), keys, "left_anti").select(*names).unionByName(open_bars.select(*names))


def trade_blocks(trades: DataFrame, record_bytes: int, block_bytes: int = 65536, width: int = WIDTH) -> DataFrame:
    """Trades with the raw block each belongs to: ``max(1, block_bytes div record_bytes)`` records of a symbol."""
    if record_bytes <= 0:
        raise ValueError("a record has a size")
    size = max(1, block_bytes // record_bytes)
    return numbered(trades, ["symbol"], "arrival", "record_no", width).withColumn("block_no", F.expr(f"record_no div {size}"))


def write_trades(trades: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Raw trades, with their types, sorted within files."""
    trades.repartition("symbol", F.floor(F.col("arrival") / WIDTH)).sortWithinPartitions("symbol", "arrival").write.mode(mode).parquet(path)
