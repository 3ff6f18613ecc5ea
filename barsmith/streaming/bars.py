"""Bars carried across micro-batches, and the sinks that keep them.

The state of a symbol is its open bar.  Trades of a micro-batch are sorted by arrival before they are folded; across
batches the order is that of the batches.  No watermark is needed: bars close by data.  Every batch emits the bars that
are done (``final``: no later batch changes them) and each touched symbol's last one.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from barsmith.operators.specs import CandleSpec

FIELDS = "open double, high double, low double, close double, volume double, amount double, tick_count long, start_id long, end_id long, last_ts long"


def bar_schema(fields: str = FIELDS) -> str:
    """Columns of streamed bars with these fields."""
    return f"candle_type string, symbol string, seq long, key long, is_closed boolean, {fields}, final boolean"


def _floor(ts: int, unit: str, zone: ZoneInfo) -> int:
    """Start of the day, week or month of a time in ms."""
    day = datetime.fromtimestamp(ts // 1000, zone).replace(hour=0, minute=0, second=0)
    day = day - timedelta(days=day.weekday()) if unit == "week" else day.replace(day=1) if unit == "month" else day
    return int(day.timestamp()) * 1000


def coded(spec: CandleSpec, zone: str = "UTC"):
    """(init, update) of any kind of bar: ``init(trade) -> bar``, ``update(bar, trade) -> bool`` as in ``bars.fold_bars``."""
    if spec.kind == "fold":
        return spec.init, spec.update
    step, kind, where = spec.threshold if spec.kind == "volume" else int(spec.threshold), spec.kind, ZoneInfo(zone)

    def key_of(t: dict) -> int:
        if kind in ("tick_count", "volume"):
            return t["trade_id"]
        if kind == "calendar":
            return _floor(t["ts"], spec.unit, where)
        return t["trade_id"] - t["trade_id"] % step if kind == "tick_modulo" else t["ts"] - t["ts"] % step

    def init(t: dict) -> dict:
        closed = kind == "volume" and t["volume"] >= step
        return {"key": key_of(t), "open": t["price"], "high": t["price"], "low": t["price"], "close": t["price"], "volume": t["volume"], "amount": t["price"] * t["volume"], "tick_count": 1, "start_id": t["trade_id"], "end_id": t["trade_id"], "last_ts": t["ts"], "is_closed": closed}

    def update(bar: dict, t: dict) -> bool:
        """Take a trade into the open bar, or close the bar and leave the trade."""
        if kind in ("time_fixed", "tick_modulo", "calendar") and key_of(t) > bar["key"]:
            bar["is_closed"] = True
            return False
        bar["high"], bar["low"], bar["close"] = max(bar["high"], t["price"]), min(bar["low"], t["price"]), t["price"]
        bar["volume"] += t["volume"]
        bar["amount"] += t["price"] * t["volume"]
        bar["tick_count"] += 1
        bar["end_id"], bar["last_ts"] = t["trade_id"], t["ts"]
        bar["is_closed"] = (kind == "tick_count" and bar["tick_count"] >= step) or (kind == "tick_modulo" and (t["trade_id"] + 1) % step == 0) or (kind == "volume" and bar["volume"] >= step)
        return True

    return init, update


def fold(spec: CandleSpec, bar: dict | None, trades, zone: str = "UTC") -> tuple[list[dict], dict | None]:
    """Bars that are done, and the last bar, after ``trades`` in order; the plain statement of the routing of trades."""
    init, update = coded(spec, zone)
    done = []
    for t in trades:
        if bar is not None and not bar["is_closed"] and update(bar, t):
            continue
        seq = 0 if bar is None else bar["seq"] + 1
        if bar is not None:
            done.append(bar)
        bar = init(t) | {"seq": seq}
    return done, bar


def bar_stream(trades: DataFrame, spec: CandleSpec) -> DataFrame:
    """Streaming bars of one type, of any kind, from a streaming tape; columns of ``bar_schema``.

    A symbol's trades of one micro-batch are sorted in one task, so bound the micro-batch (``maxFilesPerTrigger``).
    """
    if spec.kind == "fold" and not spec.schema:
        raise ValueError("streams of fold bars need the schema of their fields")
    if spec.last:
        raise ValueError("last columns have no streaming form")
    fields = spec.schema or FIELDS
    kept = f"seq long, key long, is_closed boolean, {fields}"
    names, columns = StructType.fromDDL(kept).names, StructType.fromDDL(bar_schema(fields)).names
    zone = spec.zone or trades.sparkSession.conf.get("spark.sql.session.timeZone")

    def step(key, frames, state: GroupState):
        bar = dict(zip(names, state.get)) if state.exists else None
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values("arrival", kind="stable").to_dict("records")
        rows = [t for t in rows if t["price"] == t["price"] and t["price"] is not None]
        done, bar = fold(spec, bar, rows, zone)
        if bar is not None:
            state.update(tuple(bar[c] for c in names))
            out = pd.DataFrame([b | {"final": True} for b in done] + [bar | {"final": False}])
            yield out.assign(candle_type=spec.name, symbol=key[0])[columns]

    return trades.groupBy("symbol").applyInPandasWithState(step, bar_schema(fields), kept, "update", GroupStateTimeout.NoTimeout)


class ChunkSink:
    """A ``foreachBatch`` sink that only appends: bars that are done, a folder for each batch, and beside them the open bars.

    A batch writes ``done/batch=N`` and then ``open/batch=N``: the open bar of every symbol so far, one row each.  The second
    commits the batch (by its ``_SUCCESS`` file): readers take the newest committed set of open bars and done bars up to it.  So a
    batch that died half way is not seen, and when it comes again it writes the same folders anew; nothing that is
    kept is ever rewritten by a batch.  ``compact`` joins small folders and drops chunks that are not to be kept.

    Files are sorted by symbol and seq, so filters on symbol, key and seq skip row groups; a symbol has no folder of its own.
    """

    def __init__(self, path: str, batch: int = 1024, fields: str = FIELDS):
        if batch <= 0:
            raise ValueError("a chunk holds one bar at least")
        self.path, self.batch, self.schema = path, batch, bar_schema(fields)

    def __call__(self, bars: DataFrame, batch_id: int) -> None:
        spark = bars.sparkSession
        if batch_id <= self.committed(spark):  # a batch that is in already
            return
        rows = bars.withColumn("chunk_no", F.expr(f"seq div {self.batch}"))
        rows.persist()
        try:
            done = rows.where("final").repartition("symbol", F.expr("chunk_no div 64")).sortWithinPartitions("symbol", "seq")
            done.write.mode("overwrite").parquet(f"{self.path}/done/batch={batch_id}")
            now = rows.where("NOT final")
            before = self._open(spark)
            if before is not None:
                now = now.unionByName(before.join(now.select("candle_type", "symbol"), ["candle_type", "symbol"], "left_anti"))
            now.write.mode("overwrite").parquet(f"{self.path}/open/batch={batch_id}")
        finally:
            rows.unpersist()
        for old in self._batches(spark, "open"):
            if old < batch_id - 1:  # the one before may still be read
                self._delete(spark, f"open/batch={old}")

    def committed(self, spark: SparkSession) -> int:
        """Number of the newest batch that is in, -1 without any."""
        return max((b for b in self._batches(spark, "open") if self._exists(spark, f"open/batch={b}/_SUCCESS")), default=-1)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All bars that are kept, the open ones too; None before the first batch."""
        upto = self.committed(spark)
        if upto < 0:
            return None
        base = self._base(spark, upto)
        at = [f"base/upto={base}"] * (base >= 0) + [f"done/batch={b}" for b in self._batches(spark, "done") if base < b <= upto] + [f"open/batch={upto}"]
        return spark.read.schema(f"{self.schema}, chunk_no long").parquet(*[f"{self.path}/{x}" for x in at]).drop("final")

    def compact(self, spark: SparkSession, cached: int | None = None) -> None:
        """Join the done bars of all batches in one folder; with ``cached`` drop all but the last ``cached`` full chunks of a symbol."""
        upto, kept = self.committed(spark), self.read(spark)
        if kept is None or self._base(spark, upto) == upto and cached is None:
            return
        open_ = self._open(spark).select("candle_type", "symbol", F.col("seq").alias("__newest"))
        done = kept.join(open_, ["candle_type", "symbol"]).where("seq < __newest")
        if cached is not None:
            done = done.where((F.floor(F.col("__newest") / self.batch) - F.col("chunk_no")) <= cached)
        done = done.drop("__newest").withColumn("final", F.lit(True)).repartition("symbol", F.expr("chunk_no div 64")).sortWithinPartitions("symbol", "seq")
        # A base of the same batches, made before: the new one is written beside it and takes its place.
        done.write.mode("overwrite").parquet(f"{self.path}/base/next")
        self._delete(spark, f"base/upto={upto}")
        if not self._fs(spark)[0].rename(self._at(spark, "base/next"), self._at(spark, f"base/upto={upto}")):
            raise OSError(f"could not rename {self.path}/base/next")
        for kind, name in (("done", "batch"), ("base", "upto")):
            for old in self._batches(spark, kind):
                if old < upto + (kind == "done"):
                    self._delete(spark, f"{kind}/{name}={old}")

    def _open(self, spark: SparkSession) -> DataFrame | None:
        upto = self.committed(spark)
        return None if upto < 0 else spark.read.schema(f"{self.schema}, chunk_no long").parquet(f"{self.path}/open/batch={upto}")

    def _base(self, spark: SparkSession, upto: int) -> int:
        return max((b for b in self._batches(spark, "base") if b <= upto and self._exists(spark, f"base/upto={b}/_SUCCESS")), default=-1)

    def _at(self, spark: SparkSession, name: str):
        return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self, spark: SparkSession):
        at = self._at(spark, "open")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, spark: SparkSession, name: str) -> bool:
        return self._fs(spark)[0].exists(self._at(spark, name))

    def _delete(self, spark: SparkSession, name: str) -> None:
        self._fs(spark)[0].delete(self._at(spark, name), True)

    def _batches(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the folders of a kind, ascending."""
        if not self._exists(spark, kind):
            return []
        names = [x.getPath().getName() for x in self._fs(spark)[0].listStatus(self._at(spark, kind))]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)


def write_bars(bars: DataFrame, path: str, checkpoint: str, batch: int = 1024, fields: str = FIELDS):
    """Start a query that takes what is there, keeps the archive up to date and ends with the open bars in it."""
    return bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(ChunkSink(path, batch, fields)).trigger(availableNow=True).start()


def write_raw(rows: DataFrame, path: str, checkpoint: str):
    """Raw trades or book events to Parquet, exactly once, apart from any bars."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def book_stream(events: DataFrame, init, update, state_schema: str) -> DataFrame:
    """State of each symbol's book after every micro-batch: ``init(event) -> tuple``, ``update(state, event) -> tuple``."""

    def step(key, frames, state: GroupState):
        now = state.get if state.exists else None
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        for e in pd.concat(parts).sort_values("arrival", kind="stable").to_dict("records"):
            now = init(e) if now is None else update(now, e)
        state.update(tuple(now))
        names = [p.split()[0] for p in state_schema.split(",")]
        yield pd.DataFrame([(key[0], *now)], columns=["symbol", *names])

    return events.groupBy("symbol").applyInPandasWithState(step, f"symbol string, {state_schema}", state_schema, "update", GroupStateTimeout.NoTimeout)
