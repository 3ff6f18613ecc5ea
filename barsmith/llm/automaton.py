"""Byte automata from regular expressions: parsing, subset construction, minimisation, transition arrays.

The dialect: literals, ``\\xHH``, ``\\`` escapes, classes with ranges and negation, ``.``, groups, ``|``, ``? * +`` and ``{m}``,
``{m,}``, ``{m,n}``.  Expressions are over bytes and match leftmost-longest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# ---- expressions: ("set", frozenset of bytes) | ("cat", [..]) | ("alt", [..]) | ("rep", x, least, most or None)


def parse(pattern: str, any_case: bool = False):
    """The tree of an expression; with ``any_case`` ASCII letters match either case."""
    at = 0

    def fold(chars: set[int]):
        if any_case:
            chars = chars | {c ^ 32 for c in chars if 65 <= c & ~32 <= 90}
        return ("set", frozenset(chars))

    def peek() -> str:
        return pattern[at : at + 1]

    def escape() -> int:
        nonlocal at
        at += 1
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "r": "\r", "t": "\t"}.get(c, c))

    def symbol() -> int:
        nonlocal at
        if peek() == "\\":
            return escape()
        at += 1
        return ord(pattern[at - 1])

    def alternatives():
        nonlocal at
        out = [sequence()]
        while peek() == "|":
            at += 1
            out.append(sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def sequence():
        out = []
        while peek() and peek() not in "|)":
            out.append(repeated())
        return ("cat", out)

    def repeated():
        nonlocal at
        x = atom()
        while peek() and peek() in "?*+{":
            c = peek()
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                least, _, most = pattern[at:end].partition(",")
                span = (int(least), int(most) if most else None if "," in pattern[at:end] else int(least))
                at = end + 1
            else:
                span = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            x = ("rep", x, *span)
        return x

    def atom():
        nonlocal at
        if peek() == "(":
            at += 1
            x = alternatives()
            if peek() != ")":
                raise ValueError(f"missing ) in {pattern!r}")
            at += 1
            return x
        if peek() == ".":
            at += 1
            return ("set", frozenset(range(256)) - {10})
        if peek() != "[":
            return fold({symbol()})
        at += 1
        inverse = peek() == "^"
        at += inverse
        chars: set[int] = set()
        while peek() != "]":
            a = symbol()
            if peek() == "-" and pattern[at + 1] != "]":
                at += 1
                chars |= set(range(a, symbol() + 1))
            else:
                chars.add(a)
        at += 1
        kind, found = fold(chars)
        return (kind, frozenset(range(256)) - found) if inverse else (kind, found)

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"unexpected {pattern[at]!r} in {pattern!r}")
    return tree


def reverse(tree):
    """The tree of the reversed strings."""
    if tree[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """The state after ``tree`` from ``start``."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        _, x, least, most = tree
        for _ in range(least):
            start = self.add(x, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(x, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(x, start)
        self.empty[start].append(end)
        return end


@dataclass
class Dfa:
    """``moves[state, byte]``; ``accepts[state]`` has bit r if rule r ends there; the start is 0, a dead state moves to itself."""

    moves: np.ndarray
    accepts: list[int]

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match from ``at``, or -1."""
        state, end, rows, accepts = 0, -1, self.rows(), self.accepts
        for i in range(at, len(data)):
            state = rows[state][data[i]]
            if state < 0:
                break
            if accepts[state]:
                end = i + 1
        return end

    def rows(self) -> list[list[int]]:
        if not hasattr(self, "_rows"):
            dead = [s for s in range(len(self.accepts)) if not self.accepts[s] and (self.moves[s] == s).all()]
            moves = np.where(np.isin(self.moves, dead), -1, self.moves)
            self._rows = moves.tolist()
        return self._rows


def compile_rules(trees: list, anywhere: bool, most_states: int = 20000) -> Dfa:
    """One minimal automaton for all rules at once; ``anywhere``: a match may start at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for r, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[nfa.add(tree, first)] = r
    if anywhere:
        nfa.moves[start].append((frozenset(range(256)), start))

    # Bytes that no set tells apart share a column.
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    column: dict[tuple, int] = {}
    of_byte = np.array([column.setdefault(tuple(b in s for s in sets), len(column)) for b in range(256)])
    sample = [int(np.flatnonzero(of_byte == c)[0]) for c in range(len(column))]

    def closed(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    # Subset construction.
    first = closed([start])
    number, todo, table = {first: 0}, [first], []
    while todo:
        nexts = []
        now = todo.pop(0)
        for b in sample:
            to = closed({t for s in now for chars, t in nfa.moves[s] if b in chars})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
                if len(number) > most_states:
                    raise ValueError(f"the rules need over {most_states} states; use + and a least length instead of counts")
            nexts.append(number[to])
        table.append(nexts)
    moves = np.array(table)
    accepts = [0] * len(number)
    for states, k in number.items():
        accepts[k] = sum({1 << ends[s] for s in states if s in ends})

    # Minimisation: split classes by what they accept and by the classes they move to, until nothing splits.
    _, part = np.unique(np.array([str(a) for a in accepts]), return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)
    names = 0
    for p in [part[0], *part]:
        if order[p] < 0:
            order[p], names = names, names + 1
    part = order[part]
    small = np.zeros((names, moves.shape[1]), np.int64)
    small[part] = part[moves]
    kept = [0] * names
    for k, p in enumerate(part):
        kept[p] = accepts[k]
    return Dfa(small[:, of_byte], kept)
