"""Files that audits and engines leave: CSV reports and histograms, and trades by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Times the report's rows, then the counters, then window and global percentiles of the three latencies.
REPORT = ["period", "total_candles", "gaps", "tick_errors", *[f"{scope}_{name}_{p}" for name in ("feed", "internal", "audit") for scope in ("win", "glb") for p in ("p50", "p99", "p999", "max")]]


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The interval report as one CSV file: a row a period."""
    report.select(*REPORT).orderBy("period").coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_histogram(histogram: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A histogram as one CSV file in the order of its bins, of which there are 37,001 at most."""
    histogram.select("bucket_start_ns", "count").orderBy("bucket_start_ns").coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_by_symbol(trades: DataFrame, path: str, mode: str = "append", files: int = 1) -> None:
    """Trades in a folder for each symbol, in arrival order within a file; a hot symbol can be spread over ``files`` files."""
    dealt = trades.withColumn("__file", F.pmod(F.floor(F.col("arrival") / (1 << 20)), F.lit(files))).repartition("symbol", "__file")
    dealt.drop("__file").sortWithinPartitions("symbol", "arrival").write.mode(mode).partitionBy("symbol").parquet(path)
