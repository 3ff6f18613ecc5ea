"""Small tapes and a plain replay of the routing of trades, for tests."""

import random

TAPE = "symbol string, arrival long, trade_id long, ts long, price double, volume double"
#: trade_id, ts, price, volume: late trades, a missing id, empty minutes.
GOLDEN = [(1, 0, 10.0, 1), (2, 30000, 12.0, 2), (3, 61000, 11.0, 1), (4, 59000, 9.0, 5), (5, 125000, 13.0, 1), (7, 126000, 8.0, 2), (8, 300000, 10.0, 1), (9, 301000, 10.5, 1), (10, 302000, 10.2, 3)]


def golden():
    return [("x", i, i, ts, p, float(v)) for i, ts, p, v in GOLDEN]


def random_tape(seed: int, n: int, symbols=("a", "b", "c")):
    rnd, out, ts = random.Random(seed), [], 0
    for i in range(n):
        ts += rnd.choice([0, 1, 500, 40000])
        out.append((rnd.choice(symbols), i, i + (i > n // 2) * 7, max(0, ts - (rnd.random() < 0.1) * 90000), round(rnd.uniform(1, 9), 2), float(rnd.randint(0, 9))))
    return out


def late_ids(seed: int, n: int, symbols=("a", "b")):
    """A tape whose ids come out of order, in blocks and singly."""
    rnd, out, top = random.Random(seed), [], 0
    for i in range(n):
        top += rnd.choice([0, 1, 1, 1, 2, 9])
        out.append((rnd.choice(symbols), i, max(0, top - rnd.choice([0, 0, 0, 1, 3, 7, 30])), i, 1.0 + i, 1.0))
    return out


def replay(rows, spec):
    """Bars of each symbol by the sequential rule."""
    from barsmith.streaming.bars import fold

    names = ["symbol", "arrival", "trade_id", "ts", "price", "volume"]
    out = []
    for s in sorted({r[0] for r in rows}):
        done, bar = fold(spec, None, [dict(zip(names, r)) for r in sorted(rows, key=lambda r: r[1]) if r[0] == s])
        out += [(s, *(b[c] for c in ("seq", "key", "is_closed", "open", "high", "low", "close", "volume", "tick_count", "start_id", "end_id"))) for b in [*done, bar]]
    return out
