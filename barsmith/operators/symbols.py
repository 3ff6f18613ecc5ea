"""Dense ids of symbols, by first registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dictionary(trades: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """(symbol_id, symbol): ids from 0 in the order of each symbol's first arrival.

    The window runs over one row a symbol.  With ``max_symbols`` later symbols are not registered.
    """
    first = trades.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min("arrival").alias("first"))
    ids = first.withColumn("symbol_id", (F.row_number().over(Window.orderBy("first", "symbol")) - 1).cast("int"))
    ids = ids.where(F.col("symbol_id") < max_symbols) if max_symbols is not None else ids
    return ids.select("symbol_id", "symbol")


def id_of(symbols: DataFrame, symbol: str) -> int:
    """The id of a symbol; ``LookupError`` if it isn't registered."""
    row = symbols.where(F.col("symbol") == symbol).select("symbol_id").first()
    if row is None:
        raise LookupError(f"symbol {symbol!r} is not registered")
    return row[0]


def name_of(symbols: DataFrame, symbol_id: int) -> str:
    row = symbols.where(F.col("symbol_id") == symbol_id).select("symbol").first()
    if row is None:
        raise LookupError(f"there is no symbol {symbol_id}")
    return row[0]


def with_ids(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of registered symbols with their ids; Spark broadcasts the dictionary while it is small."""
    return rows.join(symbols, "symbol")


def with_names(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows with the names of their ids, null where an id is unknown."""
    return rows.join(symbols, "symbol_id", "left")


def shards(symbols: DataFrame, size: int = 200) -> DataFrame:
    """Contiguous shards of at most ``size`` symbols."""
    if size <= 0:
        raise ValueError("a shard holds one symbol at least")
    return symbols.withColumn("shard", F.floor(F.col("symbol_id") / size).cast("int"))


def feeder_shards(symbols: DataFrame, feeders: int) -> DataFrame:
    """``feeders`` contiguous shards of equal size; the last takes the remainder."""
    if feeders <= 0:
        raise ValueError("one feeder at least")
    n = symbols.agg(F.count("*").alias("__n"))
    share = F.greatest(F.floor(F.col("__n") / feeders), F.lit(1))
    return symbols.crossJoin(F.broadcast(n)).withColumn("shard", F.least(F.floor(F.col("symbol_id") / share), F.lit(feeders - 1)).cast("int")).drop("__n")
