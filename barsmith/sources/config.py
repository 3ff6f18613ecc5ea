"""Engine and audit settings from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from barsmith.operators.specs import CandleSpec

#: Names of bar kinds in files.
_KINDS = {"TIME_FIXED": "time_fixed", "TICK_MODULO": "tick_modulo", "TICK_COUNT": "tick_count"}


@dataclass(frozen=True)
class AuditConfig:
    exchange: str = ""
    top_n: int = 5
    manual_symbols: tuple[str, ...] = ()
    memory_limit_mb: int = 1024
    worker_threads: int = 4
    batch_size_pow2: int = 10
    cached_batch_count_pow2: int = 4
    enable_order_book: bool = False
    candles: tuple[CandleSpec, ...] = ()
    csv_output_path: str = ""
    append_timestamp: bool = False
    options: dict = field(default_factory=dict)


def load(text: str) -> AuditConfig:
    """Settings from JSON text; what is missing has its default, an unknown bar type is an error."""
    raw = json.loads(text)
    target, engine, report = raw.get("target", {}), raw.get("engine", {}), raw.get("reporting", {})
    specs = []
    for i, c in enumerate(raw.get("candles", [])):
        kind = c.get("type", "TIME_FIXED")
        if kind not in _KINDS:
            raise ValueError(f"unknown bar type {kind!r}")
        specs.append(CandleSpec(c.get("name", f"{kind.lower()}_{i}"), _KINDS[kind], c.get("threshold", 60000)))
    return AuditConfig(
        raw.get("exchange", ""), target.get("top_n", 5), tuple(target.get("manual_symbols", ())), engine.get("memory_limit_mb", 1024), engine.get("worker_threads", 4), engine.get("batch_size_pow2", 10),
        engine.get("cached_batch_count_pow2", 4), engine.get("enable_order_book", False), tuple(specs), report.get("csv_output_path", ""), report.get("append_timestamp", False), raw.get("options", {}),
    )
