"""Audits of bars: gaps, tick counts, latencies, histograms and percentiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators.bars import previous

#: Ranges of the latency histogram: up to (ns), width (ns).  Larger values go to one overflow bin.
RANGES = ((1_000_000, 100), (10_000_000, 1_000), (100_000_000, 10_000), (1_000_000_000, 100_000))
OVERFLOW = 1_000_000_000


def audited(candles: DataFrame, threshold: int | None = None) -> DataFrame:
    """Closed bars behind the first closed one of each symbol and type (which only sets the cursor) with two flags.

    ``gap``: the bar's first id does not follow the last id of the bar before.  ``tick_error``: the number of trades is not
    ``threshold`` (None: not checked, as for time bars).
    """
    closed = candles.where("is_closed")
    flagged = closed.withColumn("__before", previous("end_id")).where("__before IS NOT NULL")
    wrong = F.lit(False) if threshold is None else F.col("tick_count") != threshold
    return flagged.withColumn("gap", F.col("start_id") != F.col("__before") + 1).withColumn("tick_error", wrong).drop("__before")


def counters(checked: DataFrame) -> DataFrame:
    """Bars, gaps and tick errors of each type."""
    return checked.groupBy("candle_type").agg(F.count("*").alias("candles"), F.sum(F.col("gap").cast("long")).alias("gaps"), F.sum(F.col("tick_error").cast("long")).alias("tick_errors"))


def newer(candles: DataFrame, cursors: DataFrame) -> DataFrame:
    """Closed bars whose key lies behind the cursor (candle_type, symbol, last_key) of their symbol and type."""
    return candles.where("is_closed").join(cursors, ["candle_type", "symbol"]).where("key > last_key").drop("last_key")


def latencies(rows: DataFrame, exchange: str = "exchange_ts", feed: str = "feed_ts", local: str = "local_ts", read: str = "read_ts") -> DataFrame:
    """Feed, internal and audit latency, none below zero."""
    span = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0))
    return rows.withColumns({"feed_latency": span(exchange, feed), "internal_latency": span(feed, local), "audit_latency": span(local, read)})


def sample_percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """The value at place floor(n * p) of the sorted sample of numbers, and the largest; no interpolation.

    Values are counted first.  Then two steps, so that no task sorts a group: running counts of coarse bins, of which
    a group has 100,000 or so at most, name the bin that each place lies in, and running counts of the values of these bins find it.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    whole = F.floor(value).cast("long")
    counts = counts.withColumn("__bin", F.when(whole < 0, -hdr_bin(-whole)).otherwise(hdr_bin(whole)))
    w = Window.partitionBy(*by)
    bins = counts.groupBy(*by, "__bin").agg(F.sum("__n").alias("__n"), F.max(value).alias("__top"))
    bins = bins.withColumn("__upto", F.sum("__n").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__total", F.sum("__n").over(w)).withColumn("max", F.max("__top").over(w))
    places = F.array(*[F.struct(F.lit(name).alias("point"), F.least(F.floor(F.col("__total") * p), F.col("__total") - 1).alias("place")) for name, p in points.items()])
    asked = bins.select(*by, "__bin", "max", "__total", (F.col("__upto") - F.col("__n")).alias("__before"), "__upto", F.explode(places).alias("__p")).where("__p.place >= __before AND __p.place < __upto")
    asked = asked.select(*by, "__bin", "max", "__total", "__before", "__p.point", "__p.place")
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"a.{c}")) for c in (*by, "__bin")]
    few = counts.alias("v").join(asked.select(*by, "__bin").distinct().alias("a"), same, "left_semi")
    few = few.withColumn("__at", F.sum("__n").over(Window.partitionBy(*by, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    met = few.alias("v").join(asked.alias("a"), same).where("v.__at > a.place - a.__before")
    found = lambda name: F.min(F.when(F.col("a.point") == name, F.col(f"v.{value}"))).alias(name)
    return met.groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(*[found(name) for name in points], F.first("a.max").alias("max"), F.first("a.__total").alias("n"))


def bin_start(value: Column) -> Column:
    """Lower bound of the histogram bin of a latency in ns; the overflow bin starts at ``OVERFLOW``."""
    out = F.lit(OVERFLOW).cast("long")
    for upto, width in reversed(RANGES):
        out = F.when(value < upto, value - F.pmod(value, F.lit(width))).otherwise(out)
    return out


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, bucket_start_ns, count) of non-negative values."""
    return rows.where(F.col(value) >= 0).groupBy(*by, bin_start(F.col(value)).alias("bucket_start_ns")).agg(F.count("*").alias("count"))


def merged(histograms: DataFrame, by: list[str]) -> DataFrame:
    """Sum of histograms, bin by bin."""
    return histograms.groupBy(*by, "bucket_start_ns").agg(F.sum("count").alias("count"))


def histogram_percentiles(hist: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    """Start of the first bin where the running count reaches ceil(p * n); one row a group.  At most 37,001 bins each."""
    w = Window.partitionBy(*by)
    run = hist.withColumn("__upto", F.sum("count").over(w.orderBy("bucket_start_ns").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__total", F.sum("count").over(w))
    at = lambda p: F.min(F.when(F.col("__upto") >= F.greatest(F.ceil(F.col("__total") * p), F.lit(1)), F.col("bucket_start_ns")))
    return run.groupBy(*by).agg(*[at(p).alias(name) for name, p in points.items()], F.first("__total").alias("n"))


def hdr_bin(value: Column, sub_bits: int = 11) -> Column:
    """Lower bound of the bin of a histogram with 2^sub_bits bins for each doubling; values below that are exact."""
    shift = F.greatest(F.length(F.bin(F.greatest(value, F.lit(1)))) - sub_bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value.cast("long"), shift), shift)


def hdr_summary(rows: DataFrame, by: list[str], value: str, points: dict[str, float], sub_bits: int = 11) -> DataFrame:
    """Percentiles (the bin where the running count reaches int(p * n + 0.5)), mean and maximum, all from lower bounds."""
    bins = rows.where(F.col(value) >= 0).groupBy(*by, hdr_bin(F.col(value), sub_bits).alias("__bin")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    run = bins.withColumn("__upto", F.sum("__n").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__total", F.sum("__n").over(w))
    at = lambda p: F.min(F.when(F.col("__upto") >= F.greatest(F.floor(F.col("__total") * p + 0.5), F.lit(1)), F.col("__bin")))
    return run.groupBy(*by).agg(*[at(p).alias(name) for name, p in points.items()], (F.sum(F.col("__bin") * F.col("__n")) / F.first("__total")).alias("mean"), F.max("__bin").alias("max"), F.first("__total").alias("n"))


def phase_summary(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric over the samples of a phase."""
    return samples.groupBy("phase").agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("samples"))


#: Percentiles of the report.
POINTS = {"p50": 0.5, "p99": 0.99, "p999": 0.999}


def interval_report(checked: DataFrame, at: str, period_ms: int = 600_000) -> DataFrame:
    """For every period: cumulative bars, gaps and tick errors, and percentiles of the three latencies in the period (win)
    and up to its end (glb).  ``checked`` has the flags, the latencies and the time ``at`` in ms.

    Samples become histograms of periods in one pass with partial sums.  One task for each latency goes through its periods in
    order with one running histogram of 37,001 bins, so the cost is that of the bins that occur, whatever the samples.
    """
    names = ("feed", "internal", "audit")
    own = checked.withColumn("period", F.col(at) - F.pmod(F.col(at), F.lit(period_ms)))
    sums = own.groupBy("period").agg(F.count("*").alias("c"), F.sum(F.col("gap").cast("long")).alias("g"), F.sum(F.col("tick_error").cast("long")).alias("t"))
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)  # one row a period
    out = sums.select("period", F.sum("c").over(upto).alias("total_candles"), F.sum("g").over(upto).alias("gaps"), F.sum("t").over(upto).alias("tick_errors"))
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_latency").cast("long").alias("v")) for n in names])).alias("x")
    hist = own.select("period", values).select("period", "x.*").where("v IS NOT NULL")
    hist = hist.groupBy("name", "period", F.when(F.col("v") >= 0, bin_start(F.col("v"))).alias("bin")).agg(F.count("*").alias("n"), F.max("v").alias("top"))

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("period", "ascending"), ("bin", "ascending")])
        period, bins, n, top = (table[c].combine_chunks() for c in ("period", "bin", "n", "top"))
        period, top, counted = np.asarray(period), np.asarray(top), np.asarray(bins.is_valid())  # values below zero count for the maximum only
        bins, n = np.asarray(bins.fill_null(0)), np.asarray(n)
        known = np.unique(bins[counted])
        place, running, most, rows = np.searchsorted(known, bins), np.zeros(len(known), np.int64), None, []
        cuts = np.flatnonzero(np.diff(period)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(period)]):
            now = np.zeros(len(known), np.int64)
            np.add.at(now, place[a:b][counted[a:b]], n[a:b][counted[a:b]])
            running += now
            win = int(top[a:b].max())
            most = win if most is None else max(most, win)
            rows.append((int(period[a]), *_reached(known, now), win, *_reached(known, running), most))
        columns = [pa.array([table["name"][0].as_py()] * len(rows)), *[pa.array(c, pa.int64()) for c in zip(*rows)]]
        return pa.table(columns, ["name", "period", *fields])

    fields = [f"{scope}_{p}" for scope in ("win", "glb") for p in (*POINTS, "max")]
    found = hist.groupBy("name").applyInArrow(walk, "name string, period long, " + ", ".join(f"{f} long" for f in fields))
    wide = [F.max(F.when(F.col("name") == n, F.col(f))).alias(f.replace("_", f"_{n}_")) for n in names for f in fields]
    return out.join(found.groupBy("period").agg(*wide), "period", "left")


def _reached(bins: np.ndarray, counts: np.ndarray) -> list[int | None]:
    """The first bin where the running count reaches ceil(p * n), for each point of the report."""
    upto = np.cumsum(counts)
    if not len(upto) or not upto[-1]:
        return [None] * len(POINTS)
    return [int(bins[np.searchsorted(upto, max(int(np.ceil(upto[-1] * p)), 1))]) for p in POINTS.values()]
