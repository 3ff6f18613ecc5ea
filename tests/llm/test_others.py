import datetime
import hashlib
import random
import re
import zlib

import corpus
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barsmith.llm import packing, pii, quality, secrets, topk
from barsmith.llm.automaton import compile_rules, parse
from barsmith.llm.tokenizers import fast, pattern, ranks, vocabulary

JSON, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


# ---- packing
def test_ranks_split_like_tokenizer():
    a, b = fast(JSON), ranks(RANKS, pattern())
    for c in range(0x2000):
        x = f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}  {chr(c)} .{chr(c)}'s{chr(c)}"
        assert a.encode(x, add_special_tokens=False).ids == b.encode_ordinary(x), hex(c)


@pytest.mark.parametrize("bundle", [50_000, 20])
def test_packing(spark, bundle):
    rows = corpus.texts()
    got = packing.digests(packing.pack(packing.pieces(corpus.table(spark), JSON, RANKS, pattern(), 64), 64, bundle)).collect()
    want = []
    for i, t in rows:
        ids = np.array(fast(JSON).encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want += [(i, n, s, z, zlib.crc32(ids[s : s + z].tobytes())) for n, (s, z) in enumerate(packing.cut(len(ids), 64))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(z for _, z in b[:k]) for k in range(len(b))] and sum(z for _, z in b) <= 64


def test_ids_are_the_librarys(spark):
    """Also of strings that a tokenizer file adds as tokens, by a tokenizer that nothing has been set on."""
    from tokenizers import Tokenizer

    plain, texts = Tokenizer.from_file(JSON), ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|>" * 3 + "é", "<|endoftext", "—<|endoftext|>", "plain words"]
    got = packing.pieces(corpus.table(spark, list(enumerate(texts))), JSON, RANKS, pattern(), with_ids=True).collect()
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert {r.id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got} == want and 50256 in want[0]


def test_packing_fills():
    rnd = random.Random(2)
    sizes = [min(1023, 1 + int(rnd.expovariate(1 / 350))) for _ in range(6000)]
    big = sorted((s for s in sizes if s > 256), reverse=True)
    bins, offsets, gaps = packing.sum_of_squares(big + [s for s in sizes if s <= 256], 1024)
    assert len(gaps) <= 1.005 * -(-sum(sizes) // 1024) and min(gaps) >= 0 and max(bins) == len(gaps) - 1
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)] and packing.cut(1, 1024) == [(0, 1)]


def test_packing_empty(spark):
    assert packing.pack(packing.pieces(corpus.table(spark, []), JSON)).count() == 0


# ---- top-k
def brute(vectors, k):
    ok = [(i, np.floor(64 * np.array(v, dtype=np.float64))) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, v in ok:
        if q % 3 == 0:
            best = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e7])
def test_top_k(spark, scale):
    rnd = np.random.default_rng(3)
    vectors = [(i, (rnd.integers(-3, 4, 6) * scale / 5).tolist()) for i in range(90)]
    vectors += [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [float("nan")] * 6), (207, [float("inf")] * 6), (None, [1.0] * 6), (300, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, id string, score int").repartition(4)
    got = topk.top_k(topk.quantised(df), topk.quantised(df.where("vec_id % 3 = 0")), 5, query_block=7, row_block=16)
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(vectors, 5)


def test_ties_are_bounded(spark):
    """Of any number of equal vectors a cell sends k entries a query, those of smallest id."""
    df = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    got = topk.top_k(topk.quantised(df), topk.quantised(df.where("vec_id % 5000 = 0")), 20, row_block=4096).collect()
    assert sorted(map(tuple, got)) == sorted((q, r + 1, i, 64 * 64 + 32 * 32) for q in range(0, 20_000, 5000) for r, i in enumerate([i for i in range(21) if i != q][:20]))
    queries, ids, same = np.arange(50), np.arange(1000)[::-1], np.ones((1000, 2), np.int64)
    q, i, s = topk.enough(same[:50], same, queries, ids, np.full(50, -np.inf), 20)
    assert len(q) == 50 * 20 and i[q == 49].tolist() == list(range(20)) and i[q == 3].tolist() == [x for x in range(21) if x != 3] and set(s) == {2}


def test_top_k_deals_no_cells(spark):
    """More cells on the same vectors cost no more shuffled bytes than their lists: blocks are not dealt to each other."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=64)]) for i in range(2000)], "vec_id long, embedding array<double>")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    made, name = [], "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")  # as for tables that are too large
    try:
        for block in (2000, 40):
            before = shuffled()
            got = topk.top_k(topk.quantised(df), topk.quantised(df), 5, query_block=block, row_block=block).collect()
            assert len(got) == 10000
            made.append((shuffled() - before, {tuple(r) for r in got}))
    finally:
        spark.conf.unset(name)
    assert made[0][1] == made[1][1]
    assert made[1][0] - made[0][0] < 2000 * 50 * 64 / 2  # dealt, the 50 x 50 cells carry each query's bytes 50 times


def test_top_k_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(topk.quantised(df), topk.quantised(df.where("vec_id = 0")), 20).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(topk.quantised(df.where("false")), topk.quantised(df)).count() == 0


# ---- secrets
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def base_spans(b):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(b) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(rb"AKIA[A-Z0-9]+", b) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), m.end(), 2) for m in re.finditer(rb"[0-9a-f]+", b) if m.end() - m.start() >= 24], key=lambda s: (s[0], s[2]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "ZZ", "AKIA", "A1B2C3D4", "0a1b2c3d", "ffffffff", "é", ".", "-", "x", "\n"]), max_size=16))
def test_spans(parts):
    b = "".join(parts).encode()
    assert [s for s in secrets.scanner().spans(b) if s[2] < 3] == base_spans(b)


def test_added_rules():
    found = lambda t: {secrets.RULES[r].kind for _, _, r in secrets.scanner().spans(t.encode())}
    assert found("ghp_" + "a1B2" * 9) == {"github"} and found("-----BEGIN RSA PRIVATE KEY-----") == {"pem"}
    assert found("eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSMeK") == {"jwt"} and found("plain words, 12 of them") == set()


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["a(b|c)*d", "(ab|a)(bc)?", "[a-c]{2,3}d?", "a+b{2}", "(a|b|cd)+", "[^a]b?"]), st.text("abcd", max_size=10))
def test_automaton(rule, text):
    """The longest match at the start, as an exhaustive search by ``re`` finds it."""
    want = max((e for e in range(1, len(text) + 1) if re.fullmatch(rule, text[:e])), default=-1)
    assert compile_rules([parse(rule)], anywhere=False).longest(text.encode(), 0) == want


def test_secret_documents(spark):
    rows = corpus.texts()
    got = secrets.digests(secrets.scan(corpus.table(spark))).collect()
    assert len(got) == len(rows)
    row = next(r for r in got if r.doc_id == 80)
    text = dict(rows)[80]
    assert (row.n_assign, row.n_access, row.n_hex) == (2, 1, 1)
    assert [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in row.spans.split(","))][-1] == "PassWd: hunter22"
    clean = {r.doc_id: r.text for r in secrets.redacted(corpus.table(spark)).collect()}
    assert clean[80] == '[secret]" [secret] é [secret]' and clean[1] is None and clean[5] == "two words"
    assert secrets.scan(corpus.table(spark, [])).count() == 0


# ---- quality
def labelled(spark, n=600):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rnd.choice(["river", "stone", "walks", "under", "bright", "seven"]) for _ in range(rnd.randint(10, 60))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "%%%" for w in words)))
        labels.append((i, int(good)))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled(spark)
    docs = corpus.table(spark, rows + [(9001, None), (9002, ""), (None, "text")])
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, known.where(~quality.held_out()))
    got = quality.scores(docs, model).select("doc_id", "score", quality.held_out().alias("held")).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held and r.doc_id in truth]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 80 and np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in held]) > 0.97


def test_quality_is_plain_ridge(spark):
    """The summed normal equations are those of all rows at once, and the calibration that of scores a fit hasn't seen."""
    rows, labels = labelled(spark, 200)
    docs, known = corpus.table(spark, rows).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, known)
    raw = [t.encode() for _, t in rows]
    stats = np.stack([quality.statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in raw])
    y = np.array([dict(labels)[i] for i, _ in rows], float)
    centre, scale = stats.mean(axis=0), stats.std(axis=0)
    scale[scale < 1e-9] = 1
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale, atol=1e-6)
    z = quality.fourier(stats, model.centre, model.scale)
    ridge = lambda z, y: np.linalg.solve(z.T @ z + quality.RIDGE * len(rows) * np.eye(z.shape[1]) / quality.FEATURES, z.T @ y)
    assert np.allclose(z @ model.weights, z @ ridge(z, y), atol=1e-6)
    fold = np.array([r[0] for r in spark.createDataFrame([(i,) for i, _ in rows], "id long").selectExpr("cast(xxhash64(id, 1) & 1 AS int)").collect()])
    unseen = np.where(fold == 0, z @ ridge(z[fold == 1], y[fold == 1]), z @ ridge(z[fold == 0], y[fold == 0]))
    # Isotonic regression by its min-max formula.
    order = np.argsort(unseen, kind="stable")
    own = y[order]
    level = [max(min(own[a : b + 1].mean() for b in range(i, len(own))) for a in range(i + 1)) for i in range(len(own))]
    assert np.allclose(np.interp(unseen[order], model.knots, model.levels)[[0, -1]], [level[0], level[-1]], atol=1e-6) and np.allclose(sorted(set(np.round(level, 6))), sorted(set(np.round(model.levels, 6))))
    assert quality.scores(corpus.table(spark, []), model).count() == 0


def test_quality_without_labels(spark):
    docs = corpus.table(spark)
    for labels, want in (([], 0.5), ([(4, 1)], 1.0), ([(4, 0)], 0.0)):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.score for r in quality.scores(docs, model).collect()} == {want}


def test_isotonic():
    knots, levels = quality.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(levels) > 0).all() and levels.tolist() == [0, 0.5, 1]


def test_statistics_of_each_text_alone():
    rows = [(t or "").encode() for _, t in corpus.texts()]
    at = np.cumsum([0, *map(len, rows)])
    together = quality.statistics(np.frombuffer(b"".join(rows), np.uint8), at)
    for i in range(len(rows)):
        alone = quality.statistics(np.frombuffer(rows[i], np.uint8), np.array([0, len(rows[i])]))
        assert np.allclose(together[i], alone[0])


# ---- personal data
def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def pseudonym(spark, values):
    df = spark.createDataFrame([(i, f"a {v} b", "f") for i, v in enumerate(values)], "doc_id long, text string, found string")
    return {values[r.doc_id]: (r.text[2:-2], r.found) for r in pii.pseudonyms(df, "k").collect()}


def test_forms_stay(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "378282246310005", "4111-1111-1111-1111"]
    dates = ["2024-02-29", "1999-12-31", "02/28/2001", "31/12/1999", "05.06.2010", "1/2/1980"]
    others = ["+1 (974) 555-3436", "555-123-4567", "+49 30 1234567", "192.168.0.1", "123-45-6789", "jo.do@mail.example.com", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    got = pseudonym(spark, cards + dates + others)
    for c in cards:
        new, kinds = got[c]
        assert kinds == ["card"] and new != c and luhn(re.sub(r"\D", "", new)) and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", c) and new[0] == c[0]
    assert re.sub(r"\D", "", got[cards[1]][0]) == got[cards[0]][0] == re.sub(r"\D", "", got[cards[3]][0])
    for d, form in zip(dates, ["%Y-%m-%d", "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y"]):
        new, kinds = got[d]
        assert kinds == ["date"] and new != d and 1800 <= datetime.datetime.strptime(new, form).year < 2200
    assert int(got["31/12/1999"][0][:2]) > 12
    assert [got[o][1] for o in others] == [["phone"], ["phone"], ["phone"], ["ip"], ["ssn"], ["email"], ["iban"], ["iban"]]
    assert all(got[o][0] != o for o in others) and got["+49 30 1234567"][0].startswith("+49 ") and all(int(x) < 256 for x in got["192.168.0.1"][0].split("."))
    for o in others[-2:]:
        new = got[o][0].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1 and re.sub(r"\d", "9", got[o][0]) == re.sub(r"\d", "9", o)


def test_long_ibans(spark):
    """Up to 30 digits behind the check digits."""
    longest = next(f"XX{c:02}{'123456789' * 3}012" for c in range(2, 99) if int(f"{'123456789' * 3}0123333{c:02}") % 97 == 1)
    values = ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "FR1420041010050500013M02606", "IT60X0542811101000000123456", "PL61109010140000071219812874", "PL61 1090 1014 0000 0712 1981 2874", "PT50000201231234567890154", longest]
    got = pseudonym(spark, values)
    for v in values:
        new, kinds = got[v]
        bare = new.replace(" ", "")
        assert kinds == ["iban"] and new != v and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v) and new[:2] == v[:2]
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert got[values[0]][0] == got[values[1]][0].replace(" ", "")


def test_tokens_behind_ibans(spark):
    """What follows a grouped number is no part of it, and is searched."""
    ibans = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00"]
    unknown = next(f"XX{c:02} 1234 5678 9012 3456" for c in range(2, 99) if int(f"12345678901234563333{c:02}") % 97 == 1)
    got = pseudonym(spark, [v + tail for v in [*ibans, unknown] for tail in ("", " EUR", " BIC", " A1", " GEBA", " 1234", ".")])
    for v in [*ibans, unknown]:
        new = got[v][0]
        assert got[v][1] == ["iban"] and new != v and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v)
        for tail in (" EUR", " BIC", " A1", " GEBA", " 1234", "."):
            assert got[v + tail] == (new + tail, ["iban"]), v + tail
    card = pseudonym(spark, ["BE68 5390 0754 7034 4111 1111 1111 1111"])
    assert [kinds for _, kinds in card.values()] == [["iban", "card"]]
    # A candidate that fails, or whose shorter run is right, hides nothing.
    plain = pseudonym(spark, ["4111 1111 1111 1111"])["4111 1111 1111 1111"][0]
    wrong = ["ID12 4111 1111 1111 1111", "NO12 4111 1111 1111 1111", "ID42 BE68 5390 0754 7034", "NO42 BE68 5390 0754 7034", f"{unknown[:4]} {unknown[5:]} BE68 5390 0754"]
    got2 = pseudonym(spark, wrong)
    assert [got2[v] for v in wrong[:2]] == [(f"ID12 {plain}", ["card"]), (f"NO12 {plain}", ["card"])]
    assert [got2[v] for v in wrong[2:4]] == [(f"ID42 {got[ibans[0]][0]}", ["iban"]), (f"NO42 {got[ibans[0]][0]}", ["iban"])]
    assert got2[wrong[4]] == (got[unknown][0] + " BE68 5390 0754", ["iban"])


def test_phones(spark):
    """Groups of one digit, and numbers with a trunk 0."""
    values = ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "020 7946 0958", "01 23 45 67 89", "0171 2345678", "+1 2 34567 8", "+44 20 7946 0958", "+33123456789"]
    for v, (new, kinds) in pseudonym(spark, values).items():
        assert kinds == ["phone"] and new != v and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v) and new[:2] == v[:2], v
    for v, (new, kinds) in pseudonym(spark, ["01-02-2003", "+1 2 3", "0 7946 0958", "020 79", "1.02 345"]).items():
        assert (new, kinds) == (v, []), v


def test_widths_of_dates(spark):
    values = [f"{m}/{d}/{y}" for m in (1, 9, 12) for d in (1, 9, 10, 28) for y in (1999, 2020)] + ["31/1/1999", "5.6.2010", "15.6.2010", "5.12.2010"]
    got = pseudonym(spark, values)
    for v, (new, kinds) in got.items():
        assert kinds == ["date"] and new != v and [len(x) for x in re.split("[/.]", new)] == [len(x) for x in re.split("[/.]", v)], v
    assert len({new for new, _ in got.values()}) == len(values)


def valid_iban(country, body):
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02}{body}"


def test_every_country(spark):
    """One valid number of every country of the registry, of digits and with letters."""
    rnd, values = random.Random(3), []
    for length, names in pii._IBAN_LENGTHS.items():
        for c in names.split():
            values.append(valid_iban(c, "".join(rnd.choice("0123456789") for _ in range(length - 4))))
            values.append(valid_iban(c, "AB" + "".join(rnd.choice("0123456789") for _ in range(length - 6))))
    got = pseudonym(spark, values)
    assert len(values) > 150 and len({new for new, _ in got.values()}) == len(values)
    for v, (new, kinds) in got.items():
        assert kinds == ["iban"] and new != v and new[:2] == v[:2] and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v)
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1


def feistel(key, kind, left, right, a, b):
    """Ten rounds, in plain Python."""
    half = lambda i, other, size: int(hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()[:15], 16) % size
    for i in range(1, 11):
        if i % 2:
            left = (left + half(i, right, a)) % a
        else:
            right = (right + half(i, left, b)) % b
    return left, right


def plain_digits(kind, d):
    u = len(d) // 2
    left, right = feistel(f"k/{len(d)}", kind, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
    return f"{left:0{u}}{right:0{len(d) - u}}"


def refill(form, digits):
    at = iter(digits)
    return re.sub(r"\d", lambda _: next(at), form)


def plain_pseudonym(kind, v):
    d = re.sub(r"\D", "", v)
    if kind == "card":
        head = d[0] + plain_digits("card", d[1:-1])
        return refill(v, head + next(c for c in "0123456789" if luhn(head + c)))
    if kind == "phone":
        code = v[:2] if re.fullmatch(r"\+\d{8,}", v) or v.startswith("0") else re.match(r"\+?\d*", v)[0] if v[0] == "+" else ""
        return code + refill(v[len(code) :], plain_digits("phone", re.sub(r"\D", "", v[len(code) :])))
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        area, rest = feistel("k", "ssn", area - 1 if area < 666 else area - 2, (group - 1) * 9999 + serial - 1, 898, 989901)
        return f"{area + 1 if area < 665 else area + 2:03}-{rest // 9999 + 1:02}-{rest % 9999 + 1:04}"
    if kind == "ip":
        w, x, y, z = map(int, v.split("."))
        a, b = feistel("k", "ip", w * 256 + x, y * 256 + z, 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "iban":
        body = refill(v[4:], plain_digits("iban", re.sub(r"\D", "", v[4:])))
        return valid_iban(v[:2], body)
    start = datetime.date(1800, 1, 1)
    day = (datetime.date.fromisoformat(v) - start).days
    a, b = feistel("k", "date", day // 773, day % 773, 189, 773)
    return (start + datetime.timedelta(a * 773 + b)).isoformat()


def test_like_plain_python(spark):
    cases = {"card": ["4111111111111111", "4111 1111 1111 1111", "378282246310005"], "phone": ["555-123-4567", "+49 30 1234567", "+33 1 23 45 67 89", "+33123456789", "020 7946 0958"], "ssn": ["123-45-6789", "899-01-0001"], "ip": ["192.168.0.1", "8.8.8.8"], "iban": ["DE89370400440532013000", "PL61109010140000071219812874", "FR1420041010050500013M02606"], "date": ["2024-02-29", "1999-12-31", "1800-01-01"]}
    got = pseudonym(spark, [v for own in cases.values() for v in own])
    for kind, own in cases.items():
        for v in own:
            assert got[v] == (plain_pseudonym(kind, v), [kind]), v


def test_no_plan_has_the_key(spark):
    done = pii.pseudonyms(corpus.table(spark), "very secret's key")
    plans = done._jdf.queryExecution()
    assert done.count() and "very secret" not in plans.toString() + plans.executedPlan().toString() + done._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))


def test_what_fails_stays(spark):
    for v, (new, kinds) in pseudonym(spark, ["4111111111111112", "2023-02-29", "13/13/2020", "000-12-3456", "666-12-3456", "300.1.1.1", "DE88370400440532013000", "1234567", "3.14", "x@y", "2500-01-01"]).items():
        assert (new, kinds) == (v, [])


def test_permutations(spark):
    days = [(datetime.date(1990, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(400)]
    slashed = [f"{d:02}/{m:02}/1990" for m in range(1, 13) for d in range(1, 28)]
    ips = [f"10.0.{k}.{j}" for k in range(10) for j in range(30)]
    for values in (days, slashed, ips):
        assert len({new for new, _ in pseudonym(spark, values).values()}) == len(values)


def test_pii_table(spark):
    rows = corpus.texts()
    done = pii.counted(pii.pseudonyms(corpus.table(spark), "k"))
    assert len(done.collect()) == len(rows) and {r.doc_id: r.text for r in done.collect()}[1] is None
    assert pii.pseudonyms(corpus.table(spark, []), "k").count() == 0
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        pii.pseudonyms(corpus.table(spark), "")
    assert done.select(F.sum("n_email")).first()[0] == 0
