"""Column functions: the packed latency, alignment, units, JSON fields, smoothing and rates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_LOW = 0xFFFFFFFF


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack_latency(exchange_ns, feed_ns) -> Column:
    """High 32 bits: feed - exchange, from 0 to 2^32 - 1; low 32 bits: those of the feed time.  A signed long."""
    exchange_ns, feed_ns = _col(exchange_ns), _col(feed_ns)
    late = F.least(F.greatest(feed_ns - exchange_ns, F.lit(0)), F.lit(_LOW)).cast("long")
    return F.shiftleft(late, 32).bitwiseOR(feed_ns.bitwiseAND(F.lit(_LOW)))


def unpack_latency(packed) -> Column:
    return F.shiftrightunsigned(_col(packed), 32)


def unpack_feed(packed, local_ns) -> Column:
    """The feed time: low bits from the packed word, high bits from the local time, one wrap back if that lies ahead."""
    packed, local_ns = _col(packed), _col(local_ns)
    guess = local_ns.bitwiseAND(F.lit(~_LOW)).bitwiseOR(packed.bitwiseAND(F.lit(_LOW)))
    return F.when(guess > local_ns, guess - (_LOW + 1)).otherwise(guess)


def align_down(x, step: int) -> Column:
    return _col(x) - F.pmod(_col(x), F.lit(step))


def ms_to_ns(x) -> Column:
    return _col(x) * 1_000_000


def ns_to_ms(x) -> Column:
    return F.round((_col(x) - F.pmod(_col(x), F.lit(1_000_000))) / 1_000_000).cast("long")  # rounds what double division leaves


def epoch_ms(ts: str) -> Column:
    """Epoch milliseconds of a timestamp without a time zone, whatever the session's."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


def integer_ema(values: str) -> Column:
    """(value + 3 * average) >> 2 over an array column in its order; the first value seeds it."""
    return F.expr(f"aggregate(slice({values}, 2, greatest(size({values}) - 1, 0)), element_at({values}, 1), (e, v) -> shiftright(v + 3 * e, 2))")


def rates(counters: DataFrame, by: list[str], at_ns: str, count: str) -> DataFrame:
    """Events a second between samples of a counter, and their integer average after each sample.

    Each average needs the one before, rounded, so a counter's samples (one a second at most) are folded in order, with one
    number in hand.
    """
    w = Window.partitionBy(*by).orderBy(at_ns)
    step = counters.withColumn("__dt", F.col(at_ns) - F.lag(at_ns).over(w)).withColumn("__dn", F.col(count) - F.lag(count).over(w)).where("__dt > 0")
    # In doubles before the product, which leaves 64 bits at 9.2 billion counts; below 2^53 counts it is rounded once, as from integers.
    rate = step.withColumn("rate", F.floor(F.col("__dn").cast("double") * 1e9 / F.col("__dt")).cast("long"))
    rate = rate.select(*by, at_ns, "rate")
    dealt = rate.repartition(*by).sortWithinPartitions(*by, at_ns) if by else rate.coalesce(1).sortWithinPartitions(at_ns)

    def fold(batches):
        key, average = None, None
        for batch in batches:
            own, values, out = list(zip(*(batch.column(c).to_pylist() for c in by))) or [()] * batch.num_rows, batch.column("rate").to_pylist(), []
            for k, v in zip(own, values):
                average = v if k != key or average is None else (v + 3 * average) >> 2
                key = k
                out.append(average)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "smoothed"])

    return dealt.mapInArrow(fold, StructType(dealt.schema.fields + [StructField("smoothed", LongType())]))
