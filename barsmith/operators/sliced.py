"""Windows over long ordered groups, in slices.

A window over one symbol's whole tape sorts the tape in one task, and a hot symbol may hold a third of all trades.  The
order column is cut into slices of ``width``; each (symbol, slice) is a window of its own, and what came before it is one
number, the prefix over the slices' aggregates (one row each), which is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


def sliced(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__slice", F.floor(F.col(order) / width).cast("long"))


def numbered(df: DataFrame, by: list[str], order: str, out: str, width: int = WIDTH, total: str | None = None, once: bool = False) -> DataFrame:
    """0-based position of each row in its group, by the unique integer ``order``; with ``total`` the size of the group too.

    ``once``: ``df`` ends in an exchange that is worth reading twice instead of making twice.  Spark reuses an exchange if both
    readers want the same columns, so the counts look at all of them.
    """
    cut = sliced(df, order, width)
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # Never null for a group that has rows, but the optimizer can't know and keeps the columns.
    seen = F.max(F.xxhash64(*df.columns)).isNull().cast("int") if once else F.lit(0)
    counts = cut.groupBy(*by, "__slice").agg((F.count("*") + seen).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("__n").over(Window.partitionBy(*by)))
    counts = counts.drop("__n")
    at = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(order)) - 1
    return cut.withColumn("__at", at).join(counts, [*by, "__slice"]).withColumn(out, (F.col("__before") + F.col("__at")).cast("long")).drop("__slice", "__at", "__before")


def running_max(df: DataFrame, by: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """Largest ``value`` of the group up to each row."""
    cut = sliced(df, order, width).withColumn("__value", value)
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*by, "__slice").agg(F.max("__value").alias("__top")).withColumn("__before", F.max("__top").over(before)).drop("__top")
    own = F.max("__value").over(Window.partitionBy(*by, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__own", own).join(tops, [*by, "__slice"]).withColumn(out, F.greatest("__own", "__before")).drop("__slice", "__value", "__own", "__before")


def counted(df: DataFrame, by: list[str], order: str, flag: str, out: str, width: int = WIDTH, total: str | None = None) -> DataFrame:
    """How many rows of the group up to each row have ``flag`` 1 (not 0), less one; with ``total`` how many the group has."""
    cut = sliced(df, order, width)
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "__slice").agg(F.sum(flag).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("__n").over(Window.partitionBy(*by)))
    at = F.sum(flag).over(Window.partitionBy(*by, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__at", at).join(counts.drop("__n"), [*by, "__slice"]).withColumn(out, (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__slice", "__at", "__before")
