"""What bars to build: validated once, before any plan is made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: Kinds of bars: a number of trades, aligned trade ids, aligned time, calendar units, a sum of volume, user code.
KINDS = ("tick_count", "tick_modulo", "time_fixed", "calendar", "volume", "fold")
UNITS = ("day", "week", "month")
#: The most bar types of one engine.
MAX_SPECS = 32
#: Columns of every bar besides its fields.
BASE = ("candle_type", "symbol", "seq", "key", "is_closed")
FIELDS = ("open", "high", "low", "close", "volume", "amount", "tick_count", "start_id", "end_id", "last_ts")


@dataclass(frozen=True)
class CandleSpec:
    """A named bar type.

    ``threshold``: trades (``tick_count``, at least 2), the id step (``tick_modulo``), milliseconds (``time_fixed``) or volume.
    ``last``: further columns of the tape of which a bar has its last trade's value, such as exchange or local times.
    ``unit``: day, week or month for ``calendar``, in ``zone`` (empty: the session's).  ``init``/``update``: user code for ``fold`` and ``schema``: its fields
    (see ``bars.fold_bars``).
    """

    name: str
    kind: str
    threshold: float = 0
    unit: str = ""
    zone: str = ""
    fields: tuple[str, ...] = FIELDS
    last: tuple[str, ...] = ()
    init: Callable | None = None
    update: Callable | None = None
    schema: str = ""

    def __post_init__(self):
        if not self.name:
            raise ValueError("a bar type needs a name")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of bar {self.kind!r}")
        if self.kind == "tick_count" and self.threshold < 2:
            raise ValueError("tick_count needs a threshold of 2 at least: with 1 a bar would be closed by its second trade")
        if self.kind in ("tick_modulo", "time_fixed", "volume") and self.threshold <= 0:
            raise ValueError(f"{self.kind} needs a positive threshold")
        if self.kind in ("tick_count", "tick_modulo", "time_fixed") and self.threshold != int(self.threshold):
            raise ValueError(f"{self.kind} needs a whole threshold")
        if self.kind == "calendar" and self.unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        if (self.kind == "fold") != (self.init is not None and self.update is not None):
            raise ValueError("fold takes init and update, both of them; other kinds take neither")
        if self.schema and self.kind != "fold":
            raise ValueError("only fold takes a schema")
        if self.last and self.kind in ("fold", "volume"):
            raise ValueError(f"{self.kind} bars have the fields that their code makes")
        if taken := [c for c in self.last if c in BASE + FIELDS]:
            raise ValueError(f"columns {taken} are taken")
        if unknown := [f for f in self.fields if f not in FIELDS] if self.kind != "fold" else []:
            raise ValueError(f"unknown fields {unknown}")


@dataclass(frozen=True)
class EngineConfig:
    """Bar types and storage sizes of one engine; sinks come as callables, both parts of a pair or neither.

    ``files_per_trigger`` and ``feed_rows`` bound what a micro-batch takes in: so many files of the tape, of at most so many rows each.
    ``retain``: full chunks that leave the hot window are removed once a sink has had them.
    ``book_state``: (init, update, schema) of the book, as in ``streaming.bars.book_stream``.
    """

    specs: tuple[CandleSpec, ...]
    batch_pow2: int = 10
    cached_pow2: int = 4
    max_symbols: int | None = None
    trade_flush: tuple[Callable | None, Callable | None] = (None, None)
    candle_flush: tuple[Callable | None, Callable | None] = (None, None)
    book_flush: tuple[Callable | None, Callable | None] = (None, None)
    book_state: tuple[Callable | None, Callable | None, str | None] = (None, None, None)
    symbols: tuple[str, ...] = field(default=())
    files_per_trigger: int = 64
    feed_rows: int = 1 << 20
    retain: bool = False

    def __post_init__(self):
        if not 1 <= len(self.specs) <= MAX_SPECS:
            raise ValueError(f"an engine has 1 to {MAX_SPECS} bar types")
        if len({s.name for s in self.specs}) != len(self.specs):
            raise ValueError("names of bar types must differ")
        if not 0 <= self.batch_pow2 <= 30 or not 0 <= self.cached_pow2 <= 30:
            raise ValueError("powers of two must be between 0 and 30")
        if self.files_per_trigger <= 0 or self.feed_rows <= 0:
            raise ValueError("a micro-batch takes in one file of one row at least")
        if self.retain and self.candle_flush[0] is None:
            raise ValueError("chunks are removed when a sink has had them: retain needs candle_flush")
        if self.max_symbols is not None and (self.max_symbols <= 0 or len(self.symbols) > self.max_symbols):
            raise ValueError("max_symbols must be positive and hold all symbols")
        for name in ("trade_flush", "candle_flush", "book_flush", "book_state"):
            if len({f is None for f in getattr(self, name)}) > 1:
                raise ValueError(f"{name} takes all of its parts or none")

    @property
    def batch(self) -> int:
        return 1 << self.batch_pow2

    @property
    def cached(self) -> int:
        return 1 << self.cached_pow2


def least_memory(specs: int, symbols: int, chunk_bytes: int, batch_bytes: int, page_bytes: int, pages: int, cached_pow2: int) -> int:
    """Bytes that an in-memory store of these sizes would hold at least; advice for sizing executors, never enforced."""
    if min(specs, symbols) <= 0:
        raise ValueError("specs and symbols must be positive")
    return specs * symbols * (1 << cached_pow2) * (chunk_bytes + batch_bytes + pages * page_bytes)
