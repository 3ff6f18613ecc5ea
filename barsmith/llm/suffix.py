"""Suffix-array deduplication: maximal repeats of at least k bytes, by common-prefix interval trees.

Super-k-mers (see ``repeats``) bring all occurrences of every k-byte window together under its minimiser.  The different
sequences there, each from its earliest occurrence and with a mark if it has more, form a small text of its own, of which
an *enhanced suffix array* is made: its suffixes of k bytes or more in sorted order, with the length of the prefix
that each shares with the one before, counted in bytes.  A stack scan over these lengths walks the tree of common-prefix intervals from
the leaves.  An interval whose members differ in the byte on their left (or have none) cannot be extended to the left, and
by construction not to the right: it is a maximal repeat, and it is output with *all* its members, not just neighbours.  A
whole sequence that occurs more than once is such an interval by itself, with one leaf that stands for all its occurrences.

``repeat_groups`` gives these groups with the coordinates of every member.  ``removals`` is what follows from them and
nothing else: of each group the first member, by id and place, stays; the others are covered for the full length.
Sequences end where the minimiser changes, so a group is maximal within the sequences that hold its minimiser (up to 2 k
bytes); a longer repeat is a chain of groups that overlap by k - 1 bytes, one for each minimiser on its way.

A minimiser that over ``SEQUENCES`` sequences share (a common line in ever other surroundings) is dealt by two further minimisers of each
window, taken beside the first: equal windows have equal ones, and different surroundings different ones.  One that over ``ROWS_HELD``
share is dealt by whole windows, whose groups are scanned without holding them.  So a task holds some ``ROWS_HELD`` sequences.

Null texts are empty; rows with a null id are kept whole; rows with one id count as one document, compared by place;
repeated rows are cut alike; other columns are not read; an empty table gives an empty result.  Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm import repeats
from barsmith.llm.common import partitions_for, scratch, small, unused, utf8, written
from barsmith.llm.repeats import NONE
from barsmith.llm.rolling import Prefix, byte_codes, mix, side_keys, sliding_min, split_crowded, super_kmers

BYTES = 100
GRAM = 20
#: Sequences above which a minimiser counts as crowded, and parts of the join that says so.
SEQUENCES, SALTS = 512, 16
#: Sequences, of under 2 k bytes each, that one scan takes at a time.
ROWS_HELD = 8192


def _cutter(k: int):
    gram = min(GRAM, k)
    width = k - gram + 1

    def cut(data, at, crowd):
        sums = Prefix(byte_codes(0)[data])
        grams = sums.grams(gram)
        least = sliding_min(grams, width)
        if not len(least):
            return (np.zeros(0, np.int64),) * 7
        inside = np.zeros(len(least) + 1, np.int64)
        ends = at[1:] - k + 1  # windows of a text start before this
        some = ends > at[:-1]
        np.add.at(inside, at[:-1][some], 1)
        np.add.at(inside, ends[some], -1)
        run, size = super_kmers(least, np.flatnonzero(np.cumsum(inside[:-1]) > 0), width)
        run, size, mini, level = split_crowded(grams, run, size, least[run], crowd, width, gram, lambda at: sums.slices(at, at + k))
        owner = np.searchsorted(at, run, side="right") - 1
        # A sequence in which its minimiser stands twice may repeat a window within itself.
        most = ~sliding_min(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
        chosen = np.flatnonzero(grams == most[: len(grams)])
        again = np.concatenate([[0], np.cumsum(grams[chosen[1:]] == grams[chosen[:-1]])]) if len(chosen) else np.zeros(1, np.int64)
        lo = np.searchsorted(chosen, run)
        hi = np.searchsorted(chosen, run + size + width - 1)
        loop = again[np.maximum(hi - 1, lo).clip(0, len(again) - 1)] > again[lo.clip(0, len(again) - 1)]
        content = Prefix(byte_codes(3)[data], 3).slices(run, run + size + k - 1)
        return owner, mini, content, run - at[owner], size, loop, level

    return cut


def suffix_array(text: np.ndarray, start: np.ndarray, end: np.ndarray, klass: np.ndarray, k: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes that share k bytes or more with a neighbour (and those of ``keep``), and the common prefix with the one before.

    Suffix i is ``text[start[i]:end[i]]``, at least k bytes; ``klass`` is the class of its first k bytes (classes come in any
    order, which does not matter for intervals of k bytes or more).  0 stands where a class begins.  Members of a class are
    compared byte by byte, so classes that fall together by chance part again.
    """
    order = np.argsort(klass, kind="stable")
    same = klass[order][1:] == klass[order][:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    if keep is not None:
        tied |= keep[order]
    who = order[tied]
    if not len(who):
        return who, np.zeros(0, np.int64)
    rest = end[who] - start[who] - k
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) + 1,), ">u8", padded.tobytes(), 0, (1,))
    chunks = []
    for j in range(0, int(rest.max()), 8):
        left = np.clip(rest - j, 0, 8)
        value = eight[np.minimum(start[who] + k + j, len(text))].astype(np.uint64)
        drop = ((8 - left) * 8).astype(np.uint64)
        chunks.append(np.where(left > 0, (value >> (drop % np.uint64(64))) << (drop % np.uint64(64)), np.uint64(0)))
    sort = np.lexsort((rest, *reversed(chunks), klass[who]))
    who, rest = who[sort], rest[sort]
    shared = np.zeros(len(who), np.int64)
    alike = klass[who][1:] == klass[who][:-1]
    for j in range(0, k, 8):  # the first k bytes, where classes say that they are equal
        differ = eight[start[who[1:]] + j] ^ eight[start[who[:-1]] + j]
        alike &= (differ >> np.uint64(8 * max(0, j + 8 - k))) == 0
    more, going = np.zeros(len(who) - 1, np.int64), alike.copy()
    for chunk in chunks:
        differ = chunk[sort]
        differ = differ[1:] ^ differ[:-1]
        equal = sum((differ >> np.uint64(56 - 8 * b) == 0).astype(np.int64) for b in range(8))
        more += np.where(going, equal, 0)
        going &= equal == 8
    shared[1:] = np.where(alike, k + np.minimum(more, np.minimum(rest[1:], rest[:-1])), 0)
    return who, shared


def maximal_repeats(shared: list[int], left: list[int], rank: list[int], k: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats (first row, last row, length, smallest rank) of a sorted suffix list, by a stack scan.

    ``left``: the byte before each suffix, or a negative number of its own where there is none; ``rank``: the place of each
    suffix in the order of sources.
    """
    found = []
    # Open intervals: common prefix, first row, byte on the left (None: several), smallest rank.
    depth, first, side, least = [0], [0], [None], [0]
    n = len(shared)
    for i in range(1, n + 1):
        now = shared[i] if i < n else 0
        # What is merged into the interval on top: the suffix before, then each interval that closes.
        own, byte, low = i - 1, left[i - 1], rank[i - 1]
        while now < depth[-1]:
            if side[-1] != byte:
                side[-1] = None
            if low < least[-1]:
                least[-1] = low
            length, own, byte, low = depth.pop(), first.pop(), side.pop(), least.pop()
            if byte is None and length >= k:
                found.append((own, i - 1, length, low))
        if now > depth[-1]:
            depth.append(now)
            first.append(own)
            side.append(byte)
            least.append(low)
        elif now:
            if side[-1] != byte:
                side[-1] = None
            if low < least[-1]:
                least[-1] = low
    return found


class Groups:
    """Maximal repeat groups of sequences ``text[at[i]:at[i + 1]]`` with ``n[i]`` windows each, from ``place[i]`` of document ``source[i]``.

    ``many``: the sequence occurs more than once, all later than that place; ``part``: sequences of different parts have nothing in
    common; ``loop``: a window may stand twice in the sequence.

    ``length`` and ``least`` (rank of the first member) are those of each group; its members are the rows
    ``member[bound[g]:bound[g + 1]]`` of ``owner`` (sequence) and ``no`` (first window), sorted suffixes, with their ``rank`` by source.
    """

    def __init__(self, text: np.ndarray, at: np.ndarray, n: np.ndarray, source: np.ndarray, place: np.ndarray, k: int, many: np.ndarray | None = None, part: np.ndarray | None = None, loop: np.ndarray | None = None):
        many = np.zeros(len(n), bool) if many is None else many
        part = np.zeros(len(n), np.uint64) if part is None else part
        # All suffixes of a sequence that meets no other and itself but once are alone, but for the whole sequence.
        _, where, met = np.unique(part, return_inverse=True, return_counts=True)
        sole = (met[where] == 1) & (np.zeros(len(n), bool) if loop is None else ~loop)
        size = np.where(sole, np.minimum(many, n), n)
        owner = np.repeat(np.arange(len(n)), size)
        no = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = at[:-1][owner] + no
        klass = mix(Prefix(byte_codes(1)[text], 1).slices(start, start + k) ^ mix(part[owner].astype(np.uint64)))
        who, shared = suffix_array(text, start, at[1:][owner], klass, k, many[owner] & (no == 0))
        self.owner, self.no, start = owner[who], no[who], start[who]
        order = np.lexsort((place[self.owner] + self.no, source[self.owner]))
        new = np.ones(len(order), np.int64)
        new[1:] = (np.diff(source[self.owner][order]) != 0) | (np.diff((place[self.owner] + self.no)[order]) != 0)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new)
        left = np.where(self.no > 0, text[np.maximum(start - 1, 0)].astype(np.int64) if len(text) else 0, -1 - np.arange(len(who)))
        found = maximal_repeats(shared.tolist(), left.tolist(), self.rank.tolist(), k)
        first, last, length, least = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        # Leaves that stand for several occurrences, unless a larger interval has the same length.
        whole = at[1:][self.owner] - start
        leaf = np.flatnonzero(many[self.owner] & (self.no == 0) & (shared < whole) & (np.append(shared[1:], 0) < whole))
        first, last, length, least = (np.concatenate(x) for x in ((first, leaf), (last, leaf), (length, whole[leaf]), (least, self.rank[leaf])))
        size = last - first + 1
        self.length, self.least, self.bound = length, least, np.concatenate([[0], np.cumsum(size)])
        self.member = np.repeat(first - self.bound[:-1], size) + np.arange(self.bound[-1])
        # A group is named by its bytes.
        named = Prefix(byte_codes(2)[text], 2).slices(start[first], start[first] + length) if len(first) else NONE
        self.name = mix(named ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
        self.n, self.k, self.many, self.at = n, k, many, at

    def group(self) -> np.ndarray:
        """The group of each member."""
        return np.repeat(np.arange(len(self.length)), np.diff(self.bound))

    def first_runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, first window, windows) that repeat where sequences occur first: what members cover that are not the first of
        their group.  Intervals nest, and what nests says nothing new."""
        group, member = self.group(), self.member
        later = self.rank[member] > self.least[group]
        member, length = member[later], self.length[group[later]]
        base = np.cumsum(self.n + 1) - (self.n + 1)
        edge = np.zeros(int((self.n + 1).sum()) + 1, np.int64)
        window = base[self.owner[member]] + self.no[member]
        np.add.at(edge, window, 1)
        np.add.at(edge, np.minimum(window + length - self.k + 1, base[self.owner[member]] + self.n[self.owner[member]]), -1)
        on = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]]))
        begin, finish = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
        of = np.searchsorted(base, begin, side="right") - 1
        return of, begin - base[of], finish - begin

    def later_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, group): groups of which a sequence is a member in its full length, so that its later occurrences repeat."""
        group, owner = self.group(), self.owner[self.member]
        full = (self.no[self.member] == 0) & (self.length[group] == (self.at[1:] - self.at[:-1])[owner]) & self.many[owner]
        own, at = np.unique(owner[full], return_index=True)
        return own, group[full][at]


def repeats_within(text: np.ndarray, at: np.ndarray, n: np.ndarray, source: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows (sequence, first window, windows) of sequences that may share windows with each other and with themselves."""
    return Groups(text, at, n, source, place, k, loop=np.ones(len(n), bool)).first_runs()


def pieces(text: np.ndarray, mini: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, key) of the runs of windows of ``text`` with one side key."""
    gram = min(GRAM, k)
    views = np.lib.stride_tricks.sliding_window_view(Prefix(byte_codes(0)[text]).grams(gram), k - gram + 1)
    key = side_keys(views, np.full(len(views), mini, np.uint64), gram)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return new, np.diff(np.append(new, len(key))), key[new]


def singles(text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of single windows, by their own hash."""
    key = Prefix(byte_codes(0)[text]).grams(k)
    return np.arange(len(key)), np.ones(len(key), np.int64), key


_STRINGS = "mini long, part long, sk long, id long, start int, shift int, n int, loop boolean, many boolean, single boolean, text binary"


def _strings(docs: DataFrame, reps: DataFrame, k: int, put: Callable = lambda df, what: df) -> DataFrame:
    """The bytes of every representative; those of crowded minimisers in pieces.  ``put``: what is done with what is wanted of
    each text before texts are dealt."""
    # Only crowded minimisers are named, which are few, and for each salt, so that the join does not gather a crowd in one task.
    salt = F.pmod(F.col("sk"), F.lit(SALTS))
    crowd = reps.groupBy("mini").agg(F.count("*").alias("n")).where(F.col("n") > SEQUENCES).select("mini", F.when(F.col("n") > ROWS_HELD, 2).otherwise(1).alias("crowd"))
    crowd = crowd.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    marked = reps.withColumn("salt", salt).join(crowd, ["mini", "salt"], "left")
    wanted = marked.groupBy("id", "hash").agg(F.collect_list(F.struct("mini", "sk", "start", "n", "loop", "many", F.coalesce("crowd", F.lit(0)).alias("crowd"))).alias("wanted"))
    wanted = put(wanted, "wanted")

    def each(batches):
        for batch in small(batches):
            ids = np.asarray(batch.column(0))
            data, at = utf8(batch.column(1))
            lists = batch.column(2)
            items, per = lists.flatten(), np.diff(np.asarray(lists.offsets))
            mini, sk, start, n, loop, many, crowd = (items.field(f).to_numpy(zero_copy_only=False) for f in ("mini", "sk", "start", "n", "loop", "many", "crowd"))
            owner = np.repeat(np.arange(len(ids)), per)
            begin = at[owner] + start
            plain = np.flatnonzero(crowd == 0)
            row, part, shift, size = plain, np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64), n[plain].astype(np.int64)
            split = []
            for i in np.flatnonzero(crowd):
                own = data[begin[i] : begin[i] + n[i] + k - 1]
                split.append((i, *(pieces(own, mini.view(np.uint64)[i], k) if crowd[i] == 1 else singles(own, k))))
            if split:
                row = np.concatenate([row, *(np.full(len(key), i) for i, _, _, key in split)])
                part = np.concatenate([part, *(key.view(np.int64) for *_, key in split)])
                shift = np.concatenate([shift, *(first for _, first, _, _ in split)])
                size = np.concatenate([size, *(m for _, _, m, _ in split)])
            for x in range(0, len(row), 1 << 13):
                r, p, f, m = (c[x : x + (1 << 13)] for c in (row, part, shift, size))
                texts = [data[a : a + z + k - 1].tobytes() for a, z in zip((begin[r] + f).tolist(), m.tolist())]
                columns = [pa.array(c) for c in (mini[r], p, sk[r], ids[owner[r]], start[r], f.astype(np.int32), m.astype(np.int32), loop[r], many[r], crowd[r] == 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names)

    names = [c.split()[0] for c in _STRINGS.split(", ")]
    return docs.join(wanted, ["id", "hash"]).select("id", "text", "wanted").mapInArrow(each, _STRINGS)


class _Alone:
    """Single windows, which come grouped by (mini, part): all of a group are one repeat.  Of the group that is open only the
    earliest member is held, so a window that any number of sequences share costs no memory."""

    def __init__(self, k: int):
        self.k, self.best = k, None

    def feed(self, table: pa.Table) -> pa.Table:
        """Columns of ``table`` with ``repeats``: not the first of its group.  The one held comes at last (``close``)."""
        if self.best is not None:
            table = pa.concat_tables([self.best, table])
        mini, part, source, place = (table[c].to_numpy() for c in ("mini", "part", "id", "start"))
        place = place.astype(np.int64) + table["shift"].to_numpy()
        new = np.ones(len(mini), bool)
        new[1:] = (mini[1:] != mini[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(new) - 1
        order = np.lexsort((place, source, group))
        first = order[np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))][group]
        text, at = utf8(table["text"])
        text = text.reshape(-1, self.k)
        differs = (text != text[first]).any(axis=1)  # equal hashes of different windows: no repeat
        later = (np.arange(len(mini)) != first) & ~differs & ((source != source[first]) | (place != place[first]))
        held = first[-1]
        out = np.arange(len(mini)) != held
        self.best = table.slice(held, 1)
        return table.filter(pa.array(out)).append_column("repeats", pa.array(later[out]))

    def close(self) -> pa.Table | None:
        return None if self.best is None else self.best.append_column("repeats", pa.array([False]))


def _grouped(strings: DataFrame, k: int, whole: Callable, alone: Callable, kinds: str) -> DataFrame:
    """``whole(table, groups)`` of some minimisers' sequences at a time, and ``alone(table)`` of single windows."""

    def scan(rows: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        text, at = utf8(table["text"])
        column = lambda c: table[c].to_numpy()
        part = mix(column("mini").view(np.uint64) ^ mix(column("part").view(np.uint64).copy()))
        place = column("start").astype(np.int64) + column("shift")
        return whole(table, Groups(text, at, column("n").astype(np.int64), column("id"), place, k, column("many"), part, column("loop")))

    def each(batches):
        held, size, key, lone = [], 0, None, _Alone(k)
        for batch in small(batches):
            single = np.asarray(batch.column("single"))
            if single.any():
                yield alone(lone.feed(pa.Table.from_batches([batch]).filter(pa.array(single))))
                batch = batch.filter(pa.array(~single))
                if not batch.num_rows:
                    continue
            # Rows come sorted: what is held is scanned at the start of a group, so groups stay whole.
            keys = np.stack([np.asarray(batch.column("mini")), np.asarray(batch.column("part"))])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            if key is not None and (keys[:, 0] != key).any():
                cuts = np.concatenate([[0], cuts])
            done, key = 0, keys[:, -1]
            for c in cuts.tolist():
                if size + c - done >= ROWS_HELD:
                    rows = held + ([batch.slice(done, c - done)] if c > done else [])
                    if rows:
                        yield scan(rows)
                    held, size, done = [], 0, c
            if done < batch.num_rows:
                held.append(batch.slice(done))
                size += batch.num_rows - done
        if held:
            yield scan(held)
        rest = lone.close()
        if rest is not None:
            yield alone(rest)

    dealt = strings.repartition(partitions_for(strings), "mini", "part").sortWithinPartitions("mini", "part")
    return dealt.mapInArrow(each, kinds)


def _scan(strings: DataFrame, k: int) -> DataFrame:
    """What the groups say of each sequence: (mini, sk, first_id, first_start, runs)."""
    kinds = "mini long, sk long, id long, start int, later boolean, at int, n int, of long, digest long"
    names = [c.split()[0] for c in kinds.split(", ")]

    def batch_of(table: pa.Table, row: np.ndarray, later, at, n, of, digest) -> pa.RecordBatch:
        own = [pa.array(table[c].to_numpy(zero_copy_only=False)[row]) for c in ("mini", "sk", "id", "start")]
        return pa.RecordBatch.from_arrays([*own, pa.array(later), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(of, pa.int64()), pa.array(digest, pa.int64())], names)

    def whole(table: pa.Table, groups: Groups) -> pa.RecordBatch:
        shift, n, text = table["shift"].to_numpy(), table["n"].to_numpy(), table["text"]
        first, at, size = groups.first_runs()
        own, group = groups.later_runs()
        digests = [repeats.digest(text[i].as_py()) for i in own.tolist()]
        row = np.concatenate([first, own])
        later = np.arange(len(row)) >= len(first)
        of = [None] * len(first) + groups.name[group].tolist()
        return batch_of(table, row, later, np.concatenate([at + shift[first], shift[own]]), np.concatenate([size, n[own]]), of, [None] * len(first) + digests)

    def alone(table: pa.Table) -> pa.RecordBatch:
        shift, many, text = table["shift"].to_numpy(), table["many"].to_numpy(zero_copy_only=False), table["text"]
        first, own = np.flatnonzero(table["repeats"].to_numpy(zero_copy_only=False)), np.flatnonzero(many)
        row = np.concatenate([first, own])
        of = mix(table["mini"].to_numpy().view(np.uint64) ^ mix(table["part"].to_numpy().view(np.uint64).copy())).view(np.int64)
        digests = [None] * len(first) + [repeats.digest(text[i].as_py()) for i in own.tolist()]
        return batch_of(table, row, np.arange(len(row)) >= len(first), shift[row], np.ones(len(row)), of[row], digests)

    run = F.struct("later", "at", "n", "of", "digest")
    return _grouped(strings, k, whole, alone, kinds).groupBy("mini", "sk").agg(F.min("id").alias("first_id"), F.min("start").alias("first_start"), F.collect_list(run).alias("runs"))


def repeat_groups(docs: DataFrame, k: int = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (group, length, id, start): every member of every maximal repeat group, as bytes ``start`` to ``start + length`` of the text.

    One row a member, so a group of any size is never gathered; nested groups share members.  Rows with one id and one text
    count once.
    """
    names = ["mini", "sk", "group", "length", "at"]

    def whole(table: pa.Table, groups: Groups) -> pa.RecordBatch:
        group, row = groups.group(), groups.owner[groups.member]
        at = table["shift"].to_numpy()[row] + groups.no[groups.member]
        return pa.RecordBatch.from_arrays([pa.array(table[c].to_numpy()[row]) for c in ("mini", "sk")] + [pa.array(groups.name[group]), pa.array(groups.length[group]), pa.array(at.astype(np.int32))], names)

    def alone(table: pa.Table) -> pa.RecordBatch:
        of = mix(table["mini"].to_numpy().view(np.uint64) ^ mix(table["part"].to_numpy().view(np.uint64).copy())).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(table[c].to_numpy()) for c in ("mini", "sk")] + [pa.array(of), pa.array(np.full(len(of), k)), pa.array(table["shift"].to_numpy().astype(np.int32))], names)

    own = repeats.keyed(docs, id_col, text_col)
    met = repeats.repeated(repeats.super_rows(own, _cutter(k), True), True)
    made = _grouped(_strings(own, repeats.representatives(met, True), k), k, whole, alone, "mini long, sk long, group long, length long, at int")
    rows = met.select("mini", "sk", "id", "start").join(made, ["mini", "sk"]).select("group", "length", "id", (F.col("start") + F.col("at")).alias("start")).distinct()
    few = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")  # a window that its bucket has once
    return rows.join(few, "group", "left_semi")


def removals(docs: DataFrame, k: int = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, hash, runs: array of (start, n, of, digest)): the k-byte windows of each document that also start earlier."""
    own = repeats.keyed(docs, id_col, text_col)
    met = repeats.repeated(repeats.super_rows(own, _cutter(k), True), True)
    # Written, so that the next join can part a sequence that very many documents have, and disk that is not needed any more is free:
    # what is wanted of a text before texts are dealt, the sequences before these are, and all that when the groups are known.
    with scratch(docs.sparkSession) as keep:
        found = keep(_scan(written(_strings(own, repeats.representatives(met, True), k, written), "strings"), k), "found")
    return repeats.by_document(repeats.spans(met, found, True))


def without_repeats(docs: DataFrame, k: int = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept: the bytes that stay, as binary), one for each row."""

    def each(batches):
        for batch in small(batches):
            out = []
            data, at = utf8(batch.column(1))
            for a, b, runs in zip(at[:-1], at[1:], batch.column(2)):
                own, spans = data[a:b], 0
                if runs.is_valid:
                    start, end, _ = repeats.verified(runs.values, lambda a, b: own[a:b].tobytes(), k - 1)  # noqa: B023
                    gone = repeats.covered(len(own), start, end)
                    spans = int(gone[0]) + int(((~gone[:-1]) & gone[1:]).sum())
                    own = own[~gone]
                out.append((b - a, b - a - len(own), spans, own.tobytes()))
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else ((),) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = removals(docs, k, id_col, text_col)
    joined = repeats.keyed(docs, id_col, text_col).join(found, ["id", "hash"], "left").select("id", "text", "runs")
    kinds = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<start: int, n: int, of: bigint, digest: bigint>>").alias("runs"))
    return joined.mapInArrow(each, kinds).unionByName(nameless.mapInArrow(each, kinds))


def deduplicated(docs: DataFrame, k: int = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every character taken out whose bytes all stand in repeated strings; other columns pass.

    Rows with a null id and rows with a null text come through as they are.
    """
    names = docs.columns
    hash_, runs = unused(docs, "__hash"), unused(docs, "__runs")
    found = removals(docs, k, id_col, text_col).select(F.col("id").alias("__id"), F.col("hash").alias("__other"), F.col("runs").alias(runs))
    own = docs.withColumn(hash_, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = own.join(found, (own[id_col].cast("long") == found["__id"]) & (own[hash_] == found["__other"]), "left").select(*[own[f"`{c}`"] for c in names], found[runs])
    where = names.index(text_col)

    def each(batches):
        for batch in small(batches):
            data, at = utf8(batch.column(where))
            valid, out = batch.column(where).is_valid().to_pylist(), []
            for a, b, runs, ok in zip(at[:-1], at[1:], batch.column(len(names)), valid):
                own = data[a:b]
                if runs.is_valid:
                    start, end, _ = repeats.verified(runs.values, lambda a, b: own[a:b].tobytes(), k - 1)  # noqa: B023
                    gone = repeats.covered(len(own), start, end)
                    # A character goes if all of its bytes go.
                    head = np.flatnonzero((own & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(gone, head)
                    own = own[~np.repeat(whole, np.diff(np.append(head, len(own))))]
                out.append(own.tobytes().decode() if ok else None)
            columns = list(batch.columns[:-1])
            columns[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(each, docs.schema)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
