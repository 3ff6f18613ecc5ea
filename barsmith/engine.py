"""An engine over a folder: feed trades and book events, keep bars of all types up to date, read them, drain.

What is fed is appended to a tape of Parquet files.  ``refresh`` runs one Structured Streaming query for each bar type over
what is new, so many files at a time.  Sinks get every full chunk once, and ``close`` also hands them what is left, with the
open bars still marked open.  ``trim`` frees what is not needed any more: done bars that a sink has had and that have left
the hot window, and files of the tape that every bar type has taken in.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.operators import symbols as sym
from barsmith.operators.bars import clean
from barsmith.operators.book import as_of, final_state
from barsmith.operators.query import CandleReader
from barsmith.operators.specs import BASE, CandleSpec, EngineConfig
from barsmith.operators.store import full_chunks, hot, with_chunks, with_open
from barsmith.sources.trades import TAPE
from barsmith.streaming.bars import FIELDS, ChunkSink, bar_schema, bar_stream, book_stream, write_bars

_SYMBOLS = "symbol_id int, symbol string"
_FLUSHED = "candle_type string, symbol string, chunk_no long"


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig, path: str):
        self.spark, self.config, self.path, self.closed = spark, config, path.rstrip("/"), False
        self.specs = {s.name: s for s in config.specs}
        if bad := [s.name for s in config.specs if s.kind == "fold" and not s.schema]:
            raise ValueError(f"bar types {bad} need the schema of their fields")
        if bad := [s.name for s in config.specs if s.last]:
            raise ValueError(f"bar types {bad} have last columns, which an engine's tape has not")
        self.register_all(config.symbols)

    # ---- symbols
    def symbols(self) -> DataFrame:
        return self._read("symbols", _SYMBOLS)

    def register(self, symbol: str) -> int:
        """The id of a symbol, a new one if needed; ``LookupError`` if the engine is full."""
        return self.register_all((symbol,))[0]

    def register_all(self, names) -> list[int]:
        """Ids of symbols, new ones in order where needed, in one file.  An engine has one writer, as its tape has."""
        names = list(names)
        if not names:
            return []
        known = {r.symbol: r.symbol_id for r in self.symbols().where(F.col("symbol").isin(names)).collect()}
        new = [s for s in dict.fromkeys(names) if s not in known]
        if new:
            n = self.symbols().count()
            if self.config.max_symbols is not None and n + len(new) > self.config.max_symbols:
                raise LookupError(f"no room for symbol {new[max(0, self.config.max_symbols - n)]!r}")
            known |= {s: n + i for i, s in enumerate(new)}
            self.spark.createDataFrame([(known[s], s) for s in new], _SYMBOLS).coalesce(1).write.mode("append").parquet(f"{self.path}/symbols")
        return [known[s] for s in names]

    def symbol_id(self, symbol: str) -> int:
        return sym.id_of(self.symbols(), symbol)

    def symbol_name(self, symbol_id: int) -> str:
        return sym.name_of(self.symbols(), symbol_id)

    # ---- feeds
    def feed_trades(self, trades: DataFrame) -> None:
        """Append trades of registered symbols; those of others are refused with ``LookupError`` and nothing is appended."""
        self._feed(clean(trades.select(*[c.split()[0] for c in TAPE.split(", ")])), "trades")

    def feed_book(self, events: DataFrame) -> None:
        """Append book events (symbol, ts, arrival and the book's own columns); refused if nothing here would use them."""
        if self.config.book_state[0] is None and self.config.book_flush[0] is None:
            raise ValueError("the engine has neither a book state nor a sink for book events")
        self._feed(events, "book")

    def _feed(self, rows: DataFrame, name: str) -> None:
        if self.closed:
            raise ValueError("the engine is closed")
        unknown = rows.join(self.symbols(), "symbol", "left_anti").select("symbol").first()
        if unknown is not None:
            raise LookupError(f"symbol {unknown[0]!r} is not registered")
        rows.write.mode("append").option("maxRecordsPerFile", self.config.feed_rows).parquet(f"{self.path}/{name}")

    def trades(self) -> DataFrame:
        return self._read("trades", TAPE)

    def book_state(self, columns: list[str], by: list[str] | None = None) -> DataFrame:
        return final_state(self.spark.read.parquet(f"{self.path}/book"), columns, by)

    def with_book(self, columns: list[str]) -> DataFrame:
        """Trades with the state of the book as of their time."""
        return as_of(self.trades(), self.spark.read.parquet(f"{self.path}/book"), columns)

    # ---- bars
    def refresh(self) -> None:
        """Take in what has been fed, give full chunks to the sink, and free what the configuration says."""
        if not self._exists("trades"):
            return
        for spec in self.config.specs:
            tape = self.spark.readStream.schema(TAPE).option("maxFilesPerTrigger", self.config.files_per_trigger).parquet(f"{self.path}/trades")
            self._wait(write_bars(bar_stream(tape, spec), f"{self.path}/bars/{spec.name}", f"{self.path}/checkpoints/{spec.name}", self.config.batch, spec.schema or FIELDS))
        if self.config.candle_flush[0] is not None:
            for spec in self.config.specs:
                self._flush(full_chunks(self._kept(spec), self.config.batch))
        if self.config.retain:
            self.trim()

    @staticmethod
    def _wait(query) -> None:
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()

    def _sink(self, spec: CandleSpec) -> ChunkSink:
        return ChunkSink(f"{self.path}/bars/{spec.name}", self.config.batch, spec.schema or FIELDS)

    def _kept(self, spec: CandleSpec) -> DataFrame:
        made = self._sink(spec).read(self.spark)
        if made is None:
            made = self.spark.createDataFrame([], bar_schema(spec.schema or FIELDS)).drop("final")
        return made.drop("chunk_no") if spec.kind == "fold" else made.select(*BASE, *spec.fields)

    def bars(self, name: str, archive: DataFrame | None = None) -> DataFrame:
        """All bars of a type that are kept, the open ones too; with an ``archive`` (what a sink wrote) also those that left."""
        spec = self._spec(name)
        kept = self._kept(spec)
        return kept if archive is None else with_open(archive.where(F.col("candle_type") == name), kept)

    def cached_bars(self, name: str) -> DataFrame:
        """The bars that the configured number of chunks keeps at hand."""
        return hot(self.bars(name), self.config.batch, self.config.cached)

    def trim(self) -> None:
        """Join small files; if ``retain`` is set, remove chunks that left the hot window and were handed over; remove files of the
        tape that all bar types have taken in, once the trades' sink, if there is one, has had them (``close``)."""
        for spec in self.config.specs:
            self._sink(spec).compact(self.spark, self.config.cached if self.config.retain else None)
        if self.config.retain and self.config.trade_flush[0] is None:
            taken = None
            for spec in self.config.specs:
                own = self._taken(spec)
                taken = own if taken is None else taken & own
            for path in taken or ():
                self._delete(path)

    def _taken(self, spec: CandleSpec) -> set[str]:
        """Files of the tape that a bar type's query has committed: its source log says which."""
        logs = f"{self.path}/checkpoints/{spec.name}"
        if not self._exists(f"checkpoints/{spec.name}/commits"):
            return set()
        rows = self.spark.read.text(f"{logs}/sources/0").where("value LIKE '{%'").select(F.get_json_object("value", "$.path").alias("p"), F.get_json_object("value", "$.batchId").cast("long").alias("b"))
        last = max(int(x.getPath().getName().split(".")[0]) for x in self._list(f"{logs}/commits") if x.getPath().getName().isdigit())
        return {r.p for r in rows.where(F.col("b") <= last).select("p").distinct().collect()}  # names of files

    def book_now(self) -> DataFrame:
        """State of each symbol's book by the configured code, over all events so far, kept as a stream."""
        init, update, schema = self.config.book_state
        if init is None:
            raise ValueError("the engine has no book state")
        if self._exists("book"):
            kinds = self.spark.read.parquet(f"{self.path}/book").schema
            events = self.spark.readStream.schema(kinds).option("maxFilesPerTrigger", self.config.files_per_trigger).parquet(f"{self.path}/book")
            out = f"{self.path}/states"

            def keep(df: DataFrame, batch_id: int) -> None:
                df.write.mode("overwrite").parquet(f"{out}/batch_no={batch_id}")

            states = book_stream(events, init, update, schema).writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/checkpoints/__book").foreachBatch(keep)
            self._wait(states.trigger(availableNow=True).start())
        made = self._read("states", f"symbol string, {schema}, batch_no long")
        names = [c for c in made.columns if c not in ("symbol", "batch_no")]
        return made.groupBy("symbol").agg(F.max_by(F.struct(*names), "batch_no").alias("s")).select("symbol", "s.*")

    def reader(self, name: str) -> CandleReader:
        return CandleReader(self.bars(name), self.symbols())

    def by_offset(self, symbol, name: str, offset: int, count: int, fields=None) -> DataFrame:
        return self.reader(name).by_offset(symbol, name, offset, count, fields)

    def by_key(self, symbol, name: str, key: int, count: int, fields=None) -> DataFrame:
        return self.reader(name).by_key(symbol, name, key, count, fields)

    def by_key_range(self, symbol, name: str, start: int, end: int, fields=None) -> DataFrame:
        return self.reader(name).by_key_range(symbol, name, start, end, fields)

    def count_range(self, symbol, name: str, start: int, end: int) -> int:
        return self.reader(name).count_range(symbol, name, start, end)

    def close(self) -> None:
        """Drain: book events first, then trades, then every chunk that no sink has had, the last one with its open bar."""
        if self.closed:
            return
        for name, (flush, done) in (("book", self.config.book_flush), ("trades", self.config.trade_flush)):
            if flush is not None and self._exists(name):
                self._hand(flush, done, self.spark.read.parquet(f"{self.path}/{name}"))
        self.refresh()
        if self.config.candle_flush[0] is not None:
            for spec in self.config.specs:
                self._flush(with_chunks(self._kept(spec), self.config.batch))
        self.closed = True

    # ---- plumbing
    def _spec(self, name: str) -> CandleSpec:
        if name not in self.specs:
            raise LookupError(f"there is no bar type {name!r}")
        return self.specs[name]

    def _flush(self, chunked: DataFrame) -> None:
        """Chunks that the sink has not had; recorded when it says that it is done."""
        keys = ["candle_type", "symbol", "chunk_no"]
        new = chunked.join(self._read("flushed", _FLUSHED), keys, "left_anti")
        if not new.isEmpty():
            new.select(*keys).distinct().write.mode("overwrite").parquet(f"{self.path}/flushing")
            self._hand(*self.config.candle_flush, new)
            self.spark.read.schema(_FLUSHED).parquet(f"{self.path}/flushing").write.mode("append").parquet(f"{self.path}/flushed")

    @staticmethod
    def _hand(flush, done, rows: DataFrame) -> None:
        """``flush(rows) -> handle`` starts a sink, ``done(handle)`` is polled until it is true."""
        handle = flush(rows)
        while not done(handle):
            time.sleep(0.01)

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _list(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)
