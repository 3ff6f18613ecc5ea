"""Order-book state: folded from events, and seen by trades as of their time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators.sliced import WIDTH


def as_of(trades: DataFrame, events: DataFrame, state: list[str], order: str = "ts", tie: str = "arrival", width: int = WIDTH) -> DataFrame:
    """Trades with the ``state`` columns of the symbol's last event at or before their time; nulls before the first event.

    The state a live engine shows a trade is whatever it has at that moment; by time it is deterministic.  At one time
    events come before trades.  The order is cut into slices of ``width``, each of which starts from the last state of the
    slices before, so a hot symbol is not one task's work.
    """
    left = trades.select("symbol", F.col(order).alias("__o"), F.lit(1).alias("__side"), F.col(tie).alias("__t"), F.struct(*trades.columns).alias("__trade"), F.lit(None).cast(events.select(F.struct(*state)).schema[0].dataType).alias("__state"))
    right = events.select("symbol", F.col(order).alias("__o"), F.lit(0).alias("__side"), F.col(tie).alias("__t"), F.lit(None).cast(trades.select(F.struct(*trades.columns)).schema[0].dataType).alias("__trade"), F.struct(*state).alias("__state"))
    both = left.unionByName(right).withColumn("__slice", F.floor(F.col("__o") / width))
    ends = both.where("__side = 0").groupBy("symbol", "__slice").agg(F.max_by("__state", F.struct("__o", "__t")).alias("__end"))
    # A state for every slice that has any row: the last of the slices before.
    every = both.groupBy("symbol", "__slice").agg(F.count("*").alias("__n")).join(ends, ["symbol", "__slice"], "left")
    before = Window.partitionBy("symbol").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.select("symbol", "__slice", F.last("__end", ignorenulls=True).over(before).alias("__start"))
    inside = Window.partitionBy("symbol", "__slice").orderBy("__o", "__side", "__t").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__own", F.last("__state", ignorenulls=True).over(inside)).where("__side = 1").join(starts, ["symbol", "__slice"], "left")
    seen = seen.withColumn("__seen", F.coalesce("__own", "__start"))
    return seen.select("__trade.*", *[F.col("__seen")[c].alias(f"book_{c}") for c in state])


def final_state(events: DataFrame, state: list[str], by: list[str] | None = None) -> DataFrame:
    """The state after all events: the last one of each symbol, or of each level with ``by`` (such as side and price)."""
    keys = ["symbol", *(by or [])]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*state), F.struct("ts", "arrival")).alias("s"), F.count("*").alias("updates")).select(*keys, "s.*", "updates")
