"""Reading bars of one symbol and one type: by offset, by key, by key range, and counts, oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.operators import symbols as sym
from barsmith.operators.specs import BASE


class CandleReader:
    """Queries over a table of bars.

    Symbols are named, or given by id with the dictionary.  A field list is by name, or by index in the order of the
    table's fields; None is all of them, base columns always come.  Filters on symbol, type, seq and key reach the scan.
    Unknown symbols, keys and offsets raise ``LookupError``, bad arguments ``ValueError``.  With ``strict=False`` nothing is looked
    up beforehand: a read is one plan, and what is not known gives no rows.
    """

    def __init__(self, candles: DataFrame, symbols: DataFrame | None = None, strict: bool = True):
        self.candles, self.symbols, self.strict = candles, symbols, strict
        self.fields = [c for c in candles.columns if c not in BASE]

    def by_offset(self, symbol, candle_type: str, offset: int, count: int, fields=None) -> DataFrame:
        """``count`` bars that end ``offset`` before the newest, which may be open; fewer if there are fewer."""
        self._counts(count)
        if offset < 0:
            raise ValueError("offset must not be negative")
        own = self._own(symbol, candle_type)
        if not self.strict:
            return self._cut(own.orderBy(F.desc("seq")).offset(offset).limit(count), fields)
        newest = own.agg(F.max("seq")).first()[0]
        if newest is None or offset > newest:
            raise LookupError(f"no bar at offset {offset}")
        return self._cut(own.where(F.col("seq").between(newest - offset - count + 1, newest - offset)), fields)

    def by_key(self, symbol, candle_type: str, key: int, count: int, fields=None) -> DataFrame:
        """``count`` bars by position that end with the bar of this key; of bars with one key the newest counts."""
        self._counts(count)
        own = self._own(symbol, candle_type)
        if not self.strict:
            end = own.where(F.col("key") == key).agg(F.max("seq").alias("__end"))  # one row
            return self._cut(own.join(F.broadcast(end), F.col("seq") <= F.col("__end")).orderBy(F.desc("seq")).limit(count), fields)
        end = own.where(F.col("key") == key).agg(F.max("seq")).first()[0]
        if end is None:
            raise LookupError(f"no bar has key {key}")
        return self._cut(own.where(F.col("seq").between(end - count + 1, end)), fields)

    def by_key_range(self, symbol, candle_type: str, start: int, end: int, fields=None) -> DataFrame:
        """Bars with ``start <= key <= end``; none is a result too."""
        return self._cut(self._own(symbol, candle_type).where(F.col("key").between(start, end)), fields)

    def count_range(self, symbol, candle_type: str, start: int, end: int) -> int:
        return self._own(symbol, candle_type).where(F.col("key").between(start, end)).count()

    def counted(self, symbol, candle_type: str, start: int, end: int) -> DataFrame:
        """The same as a table of one row (n)."""
        return self._own(symbol, candle_type).where(F.col("key").between(start, end)).agg(F.count("*").alias("n"))

    def seq_range(self, symbol, candle_type: str, start: int, end: int) -> tuple[int, int] | None:
        """First and last seq of the bars in a key range, or None."""
        row = self._own(symbol, candle_type).where(F.col("key").between(start, end)).agg(F.min("seq"), F.max("seq")).first()
        return None if row[0] is None else (row[0], row[1])

    def _own(self, symbol, candle_type: str) -> DataFrame:
        if isinstance(symbol, int):
            if self.symbols is None:
                raise ValueError("ids of symbols need the dictionary")
            if not self.strict:
                named = self.symbols.where(F.col("symbol_id") == symbol).select("symbol").limit(1)
                return self.candles.where(F.col("candle_type") == candle_type).join(F.broadcast(named), "symbol", "left_semi")  # one row
            symbol = sym.name_of(self.symbols, symbol)
        elif self.symbols is not None and self.strict:
            sym.id_of(self.symbols, symbol)
        return self.candles.where((F.col("symbol") == symbol) & (F.col("candle_type") == candle_type))

    def _cut(self, rows: DataFrame, fields) -> DataFrame:
        chosen = []
        for f in self.fields if fields is None else fields:
            if isinstance(f, int):
                if not 0 <= f < len(self.fields):
                    raise ValueError(f"there is no field {f}")
                f = self.fields[f]
            if f not in self.fields:
                raise ValueError(f"there is no field {f!r}")
            chosen.append(f)
        return rows.select(*BASE, *chosen).orderBy("seq")

    @staticmethod
    def _counts(count: int):
        if count <= 0:
            raise ValueError("count must be positive")


def last_of_each(candles: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """The ``count`` bars that end ``offset`` before the newest, for every symbol and type at once."""
    newest = candles.groupBy("candle_type", "symbol").agg(F.max("seq").alias("__newest"))
    end = F.col("__newest") - offset
    return candles.join(newest, ["candle_type", "symbol"]).where(F.col("seq").between(end - count + 1, end)).drop("__newest")
