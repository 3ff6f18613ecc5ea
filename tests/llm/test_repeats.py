import corpus
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barsmith.llm import repeats, substring, suffix
from barsmith.llm.rolling import Prefix, byte_codes, sliding_min


@pytest.mark.parametrize("k", [13, 4, 1])
def test_words(spark, k):
    got = substring.without_repeats(corpus.table(spark), k).collect()
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=repr) == corpus.without_words(corpus.texts(), k)


@pytest.mark.parametrize("k", [100, 40])
def test_bytes(spark, k):
    got = suffix.without_repeats(corpus.table(spark), k).collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=repr) == corpus.without_bytes(corpus.texts(), k)


@pytest.mark.parametrize("crowd", [64, 1])
def test_split_groups(spark, monkeypatch, crowd):
    """Crowds are split without loss, before the scan and in it."""
    monkeypatch.setattr(suffix, "SEQUENCES", 2)
    monkeypatch.setattr(suffix, "ROWS_HELD", 3)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    if crowd == 1:
        own = repeats.keyed(corpus.table(spark), "doc_id", "text")
        for cutter, least in ((suffix._cutter(40), 10), (substring._cutter(13), 5)):
            one, two = repeats.crowds(own, cutter)
            assert len(one) > least and len(two) > least
    got = suffix.without_repeats(corpus.table(spark), 40).collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=repr) == corpus.without_bytes(corpus.texts(), 40)
    got = substring.without_repeats(corpus.table(spark), 13).collect()
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=repr) == corpus.without_words(corpus.texts(), 13)


def removed_by_groups(groups, rows, k):
    """(id, covered) by the rule: of each group the first member stays."""
    members = {}
    for r in groups:
        members.setdefault((r.group, r.length), set()).add((r.id, r.start))
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    gone = {i: bytearray(len(b)) for i, b in texts.items()}
    for (_, length), own in members.items():
        assert len(own) > 1 and len({texts[i][a : a + length] for i, a in own}) == 1 and length >= k
        for i, a in sorted(own)[1:]:
            gone[i][a : a + length] = b"\1" * length
    return members, gone


@pytest.mark.parametrize("held", [8192, 3])
def test_removals_are_what_groups_say(spark, monkeypatch, held):
    """Nothing is removed but by a group, every occurrence of a repeated window is a member of one, and groups are left-diverse."""
    if held == 3:
        monkeypatch.setattr(suffix, "SEQUENCES", 2)
        monkeypatch.setattr(suffix, "ROWS_HELD", held)
    rows = sorted({i: (i, t) for i, t in corpus.texts() if i is not None and i not in (74, 75, 76, 77, 90, 91) and not 20 < i < 50}.values())
    members, gone = removed_by_groups(suffix.repeat_groups(corpus.table(spark, rows), 40).collect(), rows, 40)
    want = {i: bytes(g) for i, _, g in ((i, b, bytes(map(int, mask))) for i, b, mask in corpus.byte_masks(rows, 40))}
    assert {i: bytes(g) for i, g in gone.items()} == want and sum(map(sum, gone.values())) > 5_000
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 39):
            seen.setdefault(b[a : a + 40], set()).add((i, a))
    inside = {}
    for (_, length), own in members.items():
        for i, a in own:
            for d in range(length - 39):
                inside.setdefault((i, a + d), []).append({(j, c + d) for j, c in own})
    for own in seen.values():  # all occurrences of a window are together in one group, not only neighbours
        if len(own) > 1:
            assert all(any(own == g for g in inside[x]) for x in own)


def test_a_wrong_hash_removes_nothing():
    import pyarrow as pa

    text = b"abcdefgh"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("of", pa.int64()), ("digest", pa.int64())]))
    runs = pa.array([[(4, 1, 7, repeats.digest(b"efg")), (0, 1, 7, 12345)]], kind)[0]
    start, end, of = repeats.verified(runs.values, lambda a, b: text[a:b], 2)
    assert (start.tolist(), end.tolist(), of.tolist()) == ([4], [7], [7])


def largest_group(spark, docs, cutter, by_start):
    """Sequences under one key, of those that are dealt by it."""
    rows = repeats.super_rows(repeats.keyed(docs, "doc_id", "text"), cutter, by_start)
    return rows.where("NOT done").groupBy("mini").count().agg({"count": "max"}).first()[0]


def with_line(line, n, joined=" "):
    rnd = np.random.default_rng(len(line))
    words = ["".join(chr(97 + c) for c in rnd.integers(0, 26, 6)) for _ in range(5000)]
    pick = lambda: joined.join(words[x] for x in rnd.integers(0, 5000, 30))
    return [(i, f"{pick()} {line} {pick()}") for i in range(n)]


@pytest.mark.parametrize("size", [60, 80, 90, 98, 99, 120])
def test_hot_lines_of_bytes(spark, size):
    """A common line in ever other surroundings parts, whether shorter than a window or longer."""
    rnd = np.random.default_rng(1)
    line = "".join(chr(97 + c) for c in rnd.integers(0, 26, size - 2))  # and the spaces around it
    rows = with_line(line, 1200)
    docs = corpus.table(spark, rows).repartition(4)
    # 4 blocks, each of which may have CROWD sequences under a key that is no crowd.
    assert largest_group(spark, docs, suffix._cutter(100), True) <= 5 * repeats.CROWD
    if size in (99, 120):
        got = suffix.without_repeats(docs, 100).collect()
        assert sorted(((*r[:4], bytes(r[4])) for r in got), key=repr) == corpus.without_bytes(rows, 100)


def test_hot_lines_of_words(spark):
    for n in (8, 12, 14):
        rows = with_line(" ".join(f"line{i}" for i in range(n)), 1200)
        docs = corpus.table(spark, rows).repartition(4)
        assert largest_group(spark, docs, substring._cutter(13), False) <= 5 * repeats.CROWD
    got = substring.without_repeats(docs, 13).collect()
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=repr) == corpus.without_words(rows, 13)


def test_paths(spark):
    """Spans are verified parts of compacted paths: they cover what is removed; a path between branches is one."""
    rnd = np.random.default_rng(2)
    words = [f"w{i}" for i in range(2000)]
    pick = lambda n: [words[x] for x in rnd.integers(0, 2000, n)]
    passage = pick(300)
    rows = [(i, " ".join(pick(20) + passage + pick(20))) for i in range(4)] + [(9, " ".join(passage[100:200]))]
    spans = substring.repeated_spans(corpus.table(spark, rows)).collect()
    assert sorted((r.id, sum(s.n for s in spans if s.id == r.id)) for r in spans)[0][0] == 1
    assert max(r.n for r in spans) >= 250 and all(r.n >= 13 for r in spans)
    rows = corpus.texts()
    got, masks = substring.repeated_spans(corpus.table(spark), 4).collect(), {}
    for r in got:
        masks.setdefault(r.id, set()).update(range(r.start, r.start + r.n))
    ids = [i for i, _ in rows]
    for i, n, gone, _ in corpus.without_words(rows, 4):
        if ids.count(i) == 1 and i is not None:
            assert len(masks.get(i, ())) == gone


def test_degrees(spark):
    """Two paths that follow each other are one path where nothing else enters or leaves their node."""
    row = lambda id_, start, n, head, tail: (start, start, id_, 0, start, n, True, head, tail, 0, None, None)
    rows = [row(1, 0, 5, 10, 11), row(1, 5, 5, 11, 12), row(1, 10, 5, 12, 13), row(2, 0, 4, 99, 12), row(3, 20, 3, 13, 14), row(1, 16, 2, 13, 20)]
    made = {(r.id, r.start): r.of for r in substring._compact(spark.createDataFrame(rows, substring._OPENED)).collect()}
    assert made[1, 0] == made[1, 5] and len({made[1, 0], made[1, 10], made[2, 0], made[3, 20], made[1, 16]}) == 5


def test_whole_characters(spark):
    rows = corpus.texts()
    got = suffix.deduplicated(corpus.table(spark), 40)
    assert got.columns == corpus.table(spark).columns
    want = []
    for (i, b, gone), (_, t) in zip(corpus.byte_masks(rows, 40), rows):
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        want.append((i, None if t is None else "".join(kept)))
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert substring.without_repeats(corpus.table(spark, [])).count() == 0
    assert suffix.without_repeats(corpus.table(spark, [])).count() == 0
    assert substring.without_repeats(corpus.table(spark, [(1, None), (None, None)])).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=24), min_size=1, max_size=8), st.integers(2, 4))
def test_maximal_repeats(texts, k):
    """All windows of k bytes that occur earlier are covered, and nothing else."""
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    n = np.array([len(t) - k + 1 for t in raw])
    owner, first, size = suffix.repeats_within(np.frombuffer(b"".join(raw), np.uint8), at, n, np.arange(len(raw)), np.zeros(len(raw), np.int64), k)
    got = {(int(o), int(f) + j) for o, f, s in zip(owner, first, size) for j in range(s)}
    seen, want = set(), set()
    for o, t in enumerate(raw):
        for a in range(len(t) - k + 1):
            want |= {(o, a)} if t[a : a + k] in seen else set()
            seen.add(t[a : a + k])
    assert got == want


def test_intervals_hold_all_members():
    raw = [b"xabcabcy", b"zabcabcw", b"qabcr"]
    at, n = np.cumsum([0, *map(len, raw)]), np.array([6, 6, 3])
    text = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(3), n)
    start = at[:-1][owner] + np.concatenate([np.arange(x) for x in n])
    klass = Prefix(byte_codes(1)[text], 1).slices(start, start + 3)
    who, shared = suffix.suffix_array(text, start, at[1:][owner], klass, 3)
    left = [int(text[s - 1]) if s not in at else -1 - int(s) for s in start[who]]
    found = suffix.maximal_repeats(shared.tolist(), left, list(range(len(who))), 3)
    groups = {(text[start[who[a]] : start[who[a]] + d].tobytes(), b - a + 1) for a, b, d, _ in found}
    assert groups == {(b"abc", 5), (b"abcabc", 2)}


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for w in (1, 2, 5, 13, 50):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]
