import hashlib
import random
import re

import corpus
import numpy as np
import pytest
import xxhash

from barsmith.llm import lempel, nearcopies, rolling, simhash


def plain_print(text, shingle=3):
    w = corpus.WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + shingle]), 42) for k in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows = corpus.texts()
    prints = {}
    for i, t in rows:
        prints.setdefault(plain_print(t), []).append(i)
    root = corpus.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    name = {r: min((i for p in prints if root[p] == r for i in prints[p] if i is not None), default=None) for r in set(root.values())}
    got = simhash.digests(simhash.near_duplicates(corpus.table(spark))).collect()
    want = [(i, f"{plain_print(t):016x}", name[root[plain_print(t)]]) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [8192, 3])
def test_links_lose_nothing(spark, monkeypatch, hot):
    """Random and crowded fingerprints, also when every bucket counts as hot."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = np.random.default_rng(hot)
    base = int(rnd.integers(0, 2**63))
    prints = {base ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 9), replace=False)) for _ in range(150)} | {int(x) for x in rnd.integers(0, 2**63, 50)}
    signed = {p - 2**64 if p >= 2**63 else p: p for p in prints}
    edges = simhash.links(simhash.with_pivots(spark.createDataFrame([(s,) for s in signed], "fp long")), 3).collect()
    assert all((signed[r.a] ^ signed[r.b]).bit_count() <= 3 for r in edges)
    want = corpus.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    linked = {frozenset((signed[r.a], signed[r.b])) for r in edges}
    assert corpus.components(prints, lambda a, b: frozenset((a, b)) in linked) == want


def test_components(spark):
    rnd = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 240)] + [tuple(map(int, rnd.integers(300, 400, 2))) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    want = corpus.components({x for e in pairs for x in e}, lambda a, b: frozenset((a, b)) in pairs)
    assert {n: r for n, r in want.items() if n != r} == {n: r for n, r in got.items() if n != r}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(t):
    w = corpus.WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


@pytest.mark.parametrize("hot", [1024, 3])
def test_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(nearcopies, "HOT", hot)
    rows = corpus.texts()
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    want = corpus.components(sets, lambda a, b: any(jaccard(x, y) >= 0.8 for x in sets[a] for y in sets[b]))
    assert dict(map(tuple, nearcopies.classes(corpus.table(spark)).collect())) == want
    kept = nearcopies.one_of_each(corpus.table(spark))
    assert kept.columns == corpus.table(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i is None or want[i] == i), key=repr)


def test_near_copies_with_repeated_lines(spark):
    """Sets are alike, counts of shingles are not."""
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(40):
        own = [f"w{k}" for k in rnd.integers(0, 5000, 200)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own + own[-12:] * (10, 20, 40)[i % 3]))]
    assert all(jaccard(shingles(a), shingles(b)) >= 0.9 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    assert dict(map(tuple, nearcopies.classes(corpus.table(spark, rows)).collect())) == {i: i - i % 2 for i, _ in rows}


def test_kind_counts_discard_only_what_cannot_link():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 40, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rnd.permutation(base)[: 400 - k], rnd.integers(0, 1 << 40, k).astype(np.uint64)])) for k in range(0, 90)]
    for least in (0.5, 0.8, 0.9):
        edges = {frozenset(e) for e in nearcopies.cell_forest(np.arange(90), nearcopies.kind_counts(sets), sets, np.zeros(90, int), least)}
        linked = lambda a, b: jaccard(frozenset(sets[a].tolist()), frozenset(sets[b].tolist())) >= least  # noqa: B023, E731
        assert corpus.components(range(90), lambda a, b: frozenset((a, b)) in edges) == corpus.components(range(90), linked)  # noqa: B023


def plain_fingerprint(text):
    """The phrase set by the textbook parse, each phrase hashed by itself, the smallest 32 bits of each bin."""
    known, phrase = set(), b""
    for byte in text.encode():
        phrase += bytes([byte])
        if phrase not in known:
            known.add(phrase)
            phrase = b""
    codes, most = rolling.byte_codes(2).tolist(), 1 << 64

    def scatter(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) % most
        x = ((x ^ (x >> 29)) * 0xFF51AFD7ED558CCD) % most
        return x ^ (x >> 32)

    out = [0xFFFFFFFF] * 128
    for p in known:
        h = scatter(sum(codes[b] * pow(rolling._ODD[2], i, most) for i, b in enumerate(p)) % most)
        out[h % 128] = min(out[h % 128], h >> 32, key=lambda x: min(x, 0xFFFFFFFF))
    return out


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x != 0xFFFFFFFF or y != 0xFFFFFFFF]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_lempel(spark):
    rows = corpus.texts()
    got = lempel.digests(lempel.edits(corpus.table(spark).repartition(5))).collect()
    assert len(got) == len(rows)
    # Null ids first, rows of one id in the order of the hashes of their texts.
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    prints, want = {}, []
    of = lambda t: prints[t] if t in prints else prints.setdefault(t, plain_fingerprint(t))
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        line = lambda p: "".join(f"{x:08x}" for x in p)
        want.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), line(of(a)), line(of(edited)), plain_likeness(of(a), of(edited)), plain_likeness(of(a), of(b))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_parse():
    assert lempel.likeness(lempel.fingerprint(""), lempel.fingerprint("")) == 1.0
    a = lempel.fingerprint("the quick brown fox " * 40)
    assert lempel.likeness(a, a) == 1.0 and lempel.likeness(a, lempel.fingerprint("0123456789" * 80)) < 0.1
    whole = lempel.Parse()
    parts = np.minimum(whole.feed("héllo wörld".encode()), whole.feed("héllo wörld again".encode()))
    assert (parts == lempel.fingerprint("héllo wörldhéllo wörld again")).all()


def test_long_unrelated_texts_differ():
    rnd = np.random.default_rng(6)
    start = np.arange(0, 4_000_000, 8)
    a, b = (lempel.signature(rnd.integers(0, 256, 4_000_000).astype(np.uint8).tobytes(), start, start + 8) for _ in range(2))
    assert lempel.likeness(a, b) == 0.0 and len(lempel.as_hex(a)) == 8 * lempel.BINS


def test_single_and_empty(spark):
    r = lempel.edits(corpus.table(spark, [(5, "abcdef")])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    empty = corpus.table(spark, [])
    assert lempel.edits(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0 and nearcopies.classes(empty).count() == 0


def test_cells():
    rnd = np.random.default_rng(8)
    sets = [np.unique(rnd.integers(0, 60, 50)).astype(np.uint64) for _ in range(40)]
    assert (nearcopies.shared(sets[:25], sets[25:]) == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]).all()
    prints, ids = np.zeros(40, np.uint64), np.arange(40)
    for few in (0, 10**6):
        nearcopies.FEW, kept = few, nearcopies.FEW
        for side in (np.zeros(40, int), np.arange(40) % 2):
            edges = {frozenset(e) for e in nearcopies.cell_forest(ids, prints, sets, side, 0.5)}
            meet = lambda a, b: (side[a] != side[b] or not side.any()) and jaccard(frozenset(sets[a]), frozenset(sets[b])) >= 0.5  # noqa: B023, E731
            assert corpus.components(range(40), lambda a, b: frozenset((a, b)) in edges) == corpus.components(range(40), meet)  # noqa: B023
        nearcopies.FEW = kept


def test_near_copies_come_by_fingerprints_too(spark, monkeypatch):
    """Pairs of near fingerprints are those of brute force, and link without the partial fingerprints, where the exact check agrees."""
    rnd = random.Random(11)
    rows = []
    for i in range(12):
        w = [f"w{rnd.randrange(5000)}" for _ in range(400)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w[:-1] + ["other"])), (3 * i + 2, " ".join(w[:-2] + ["x", "y"]))]
    prints = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    pairs = nearcopies.print_pairs(spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "id long, fp long")).collect()

    def named(edges):
        name = {i: i for i in prints}
        for _ in prints:
            for a, b in edges:
                name[a] = name[b] = min(name[a], name[b])
        return name

    want = named([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert named([tuple(p) for p in pairs]) == want and len(set(want.values())) < 36
    # Partial fingerprints of their own for every text: nothing meets by them.
    count = iter(range(1, 10**6))
    monkeypatch.setattr(nearcopies, "sketch", lambda hashes, bound: np.array([[next(count)] * (2 * nearcopies.TABLES) for _ in bound[1:]], np.uint64))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.id: r.component for r in nearcopies.classes(docs).collect()} == want
