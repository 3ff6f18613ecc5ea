"""Workloads to measure: feeding a skewed tape, reading archives, and both by turns; reports have fixed columns."""

from __future__ import annotations

import random
import time

from pyspark.sql import DataFrame, SparkSession

from barsmith.engine import Engine
from barsmith.operators.bars import bars
from barsmith.operators.query import CandleReader
from barsmith.operators.specs import CandleSpec
from barsmith.sources.trades import zipf_tape

#: Bar types and reads of the published workloads.
FEED_SPECS = (CandleSpec("tick3", "tick_count", 3), CandleSpec("minute", "time_fixed", 60000))
SIZES = (10, 100, 1000, 10_000, 100_000)
FIELDS = (None, ("high", "low", "close"))

READ_REPORT = "QuerySize long, NumFields int, AccessPattern string, ReaderThreads int, TotalQueries long, FailedQueries long, MeanLatency_ns long, P50_ns long, P95_ns long, P99_ns long, Max_ns long"
MIXED_REPORT = "Timestamp long, ElapsedSec double, Phase int, PhaseName string, FeedThreads int, ActiveReaders int, WorkerThreads int, ZipfS double, ReadDelay_us long, FeedCountPerSec double, QueryCountPerSec double, FailedQueriesPerSec double, QueryLatency_Mean_ns long, QueryLatency_P50_ns long, QueryLatency_P99_ns long"
FEED_REPORT = "Timestamp long, ElapsedSec double, FeedThreads int, WorkerThreads int, ZipfS double, FeedCountPerSec double"


def _drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def feed(spark: SparkSession, trades: int, symbols: int = 1024, s: float = 0.99, specs: tuple[CandleSpec, ...] = FEED_SPECS) -> DataFrame:
    """Trades a second from a Zipf tape into bars of each type: one row a type, all samples kept."""
    tape = zipf_tape(spark, trades, symbols, s).cache()
    tape.count()
    rows, threads = [], spark.sparkContext.defaultParallelism
    for spec in specs:
        began = time.time()
        _drain(bars(tape, spec))
        took = time.time() - began
        rows.append((int(began), took, 1, threads, s, trades / took))
    tape.unpersist()
    return spark.createDataFrame(rows, FEED_REPORT)


def reads(spark: SparkSession, reader: CandleReader, symbol: str, candle_type: str, sizes=SIZES, fields=FIELDS, queries: int = 5, offsets: int = 10_000, seed: int = 1) -> DataFrame:
    """Latencies of reads by random offset and by random existing key, for each size and projection.

    A read that returns another number of bars than asked counts as failed.
    """
    rnd, rows = random.Random(seed), []
    own = reader.candles.where((reader.candles.symbol == symbol) & (reader.candles.candle_type == candle_type))
    newest = own.agg({"seq": "max"}).first()[0]
    if newest is None:
        raise LookupError(f"symbol {symbol!r} has no {candle_type} bars")
    for size in sizes:
        for names in fields:
            for pattern in ("offset", "key"):
                took, failed = [], 0
                for _ in range(queries):
                    back = rnd.randrange(min(offsets, newest + 1))
                    key = own.where(own.seq == newest - back).select("key").first()[0] if pattern == "key" else None
                    began = time.perf_counter_ns()
                    found = reader.by_offset(symbol, candle_type, back, size, names) if pattern == "offset" else reader.by_key(symbol, candle_type, key, size, names)
                    failed += len(found.toArrow()) != size
                    took.append(time.perf_counter_ns() - began)
                took.sort()
                at = lambda p: took[min(len(took) - 1, int(len(took) * p))]  # noqa: B023, E731
                rows.append((size, len(names or reader.fields), pattern, 1, queries, failed, sum(took) // len(took), at(0.5), at(0.95), at(0.99), took[-1]))
    return spark.createDataFrame(rows, READ_REPORT)


def mixed(spark: SparkSession, engine: Engine, name: str, trades: int, phases: tuple[tuple[str, int], ...] = (("feed", 0), ("mixed", 4)), rounds: int = 2, symbols: int = 1024, s: float = 0.99, count: int = 10_000, offsets: int = 500, delay_us: int = 0, seed: int = 1) -> DataFrame:
    """Feeding and reading by turns over an engine: one row a round.

    A round feeds ``trades`` trades of a Zipf tape that goes on, takes them in, and then does the phase's number of reads of ``count`` bars (high,
    low, close) of random symbols by random offset, ``delay_us`` apart.  A read that returns another number of bars counts as failed.
    """
    rnd, rows, threads, began, fed = random.Random(seed), [], spark.sparkContext.defaultParallelism, time.time(), 0
    names = [f"SYM{i:04d}" for i in range(symbols)]
    engine.register_all(names)
    for no, (phase, queries) in enumerate(phases):
        for _ in range(rounds):
            at = time.time()
            tape = zipf_tape(spark, trades, symbols, s, seed=seed + fed)
            engine.feed_trades(tape.withColumns({c: tape[c] + fed for c in ("arrival", "trade_id")}).withColumn("ts", tape.ts + fed // 10 * 1000))
            engine.refresh()
            fed, feeding, took, failed = fed + trades, time.time() - at, [], 0
            reader = CandleReader(engine.bars(name), strict=False)
            for _ in range(queries):
                start = time.perf_counter_ns()
                found = reader.by_offset(rnd.choice(names), name, rnd.randrange(offsets), count, ["high", "low", "close"])
                failed += len(found.toArrow()) != count
                took.append(time.perf_counter_ns() - start)
                time.sleep(delay_us / 1e6)
            took.sort()
            spent = max(sum(took) / 1e9, 1e-9)
            place = lambda p: took[min(len(took) - 1, int(len(took) * p))] if took else None  # noqa: B023, E731
            rows.append((int(at), time.time() - began, no, phase, 1, int(queries > 0), threads, s, delay_us, trades / feeding, queries / spent if queries else 0.0, failed / spent if queries else 0.0, sum(took) // len(took) if took else None, place(0.5), place(0.99)))
    return spark.createDataFrame(rows, MIXED_REPORT)
