"""Secret scans by one combined deterministic automaton.

Every rule is a regular expression over bytes with a least length.  Its leftmost, longest, non-overlapping matches are
found first, then those that are too short are dropped (a dropped match still covers its bytes).

All rules are reversed and compiled together, by subset construction and minimisation, into one transition array.  One
backward pass over a text's bytes, one look-up a byte, marks for all rules where a match can start.  From the marks, in
ascending order and behind the last match of the rule, the rule's own forward automaton finds the longest end.

Null and empty texts have no spans; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.automaton import Dfa, compile_rules, parse, reverse
from barsmith.llm.common import small, utf8


@dataclass(frozen=True)
class Rule:
    """``kind`` names spans; of a match ``least`` bytes are asked, counted behind the separator for ``after``."""

    kind: str
    pattern: str
    least: int
    any_case: bool = False
    after: str = ""


#: The first three are the base kinds; the others add spans.  Counts stand in ``least``, not in expressions: that keeps
#: the automaton small.  Only the hexadecimal run needs its count, or every word would mark a start.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, True, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 30),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 35),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
BASE = ("assign", "access", "hex")


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    back: list[int]  # flat: (state * 256 + byte) -> next state * 256; accepting states come last
    accepting: int  # the first of these, times 256
    marks: list[list[int]]  # rules of each accepting state
    start: int
    forward: list[Dfa]
    prefix: list[Dfa | None]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches that are long enough, in bytes, by start and rule."""
        back, limit, state = self.back, self.accepting, self.start
        found: list[tuple[int, int]] = []
        at = len(data)
        for byte in reversed(data):
            state = back[state + byte]
            at -= 1
            if state >= limit:
                found.append((at, state))
        if not found:
            return []
        ends, out = [0] * len(self.rules), []
        for at, state in reversed(found):
            for r in self.marks[(state - limit) >> 8]:
                if at >= ends[r]:
                    end = self.forward[r].longest(data, at)
                    ends[r] = end
                    rule, own = self.rules[r], at
                    if self.prefix[r] is not None:
                        own = self.value(r, data, at, end)
                    if end - own >= rule.least:
                        out.append((at, end, r))
        return sorted(out, key=lambda s: (s[0], s[2]))

    def value(self, r: int, data: bytes, at: int, end: int) -> int:
        """Where the value of an assignment starts: behind the longest prefix that leaves something of the match."""
        return self.prefix[r].longest(data[: end - 1], at)


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once per Python worker."""
    trees = [parse(r.pattern, r.any_case) for r in rules]
    dfa = compile_rules([reverse(t) for t in trees], anywhere=True)
    plain = [s for s, a in enumerate(dfa.accepts) if not a]
    order = plain + [s for s, a in enumerate(dfa.accepts) if a]
    place = np.argsort(order)
    back = (place[dfa.moves[order]] * 256).ravel().tolist()
    marks = [[r for r in range(len(rules)) if dfa.accepts[s] >> r & 1] for s in order[len(plain) :]]
    forward = [compile_rules([t], anywhere=False) for t in trees]
    prefix = [compile_rules([parse(r.after, r.any_case)], anywhere=False) if r.after else None for r in rules]
    return Scanner(rules, back, len(plain) * 256, marks, int(place[0]) * 256, forward, prefix)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (id, spans: array of (kind, start, end) in code points, by start and then by rule)."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def each(batches):
        machine = scanner(rules)
        for batch in small(batches):
            data, at = utf8(batch.column(1))
            out = []
            for a, b in zip(at[:-1], at[1:]):
                found = machine.spans(data[a:b].tobytes())
                if found:
                    points = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
                    found = [{"kind": rules[r].kind, "start": int(points[s]), "end": int(points[e])} for s, e, r in found]
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], ["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digests(scanned: DataFrame) -> DataFrame:
    written_out = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return scanned.select(F.col("id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``[secret]``; other columns pass."""
    names, where = docs.columns, docs.columns.index(text_col)

    def each(batches):
        machine = scanner(rules)
        for batch in small(batches):
            data, at = utf8(batch.column(where))
            valid = batch.column(where).is_valid().to_pylist()
            out = []
            for a, b, ok in zip(at[:-1], at[1:], valid):
                text = data[a:b].tobytes()
                parts, last = [], 0
                for s, e, _ in machine.spans(text):
                    if s >= last:
                        parts += [text[last:s], b"[secret]"]
                    last = max(last, e)
                out.append(b"".join([*parts, text[last:]]).decode() if ok else None)
            columns = [*batch.columns]
            columns[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(each, docs.schema)
