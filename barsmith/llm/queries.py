"""The registered corpus queries: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.llm import bpe, lempel, packing, pii, quality, secrets, simhash, substring, suffix, topk
from barsmith.llm.common import table
from barsmith.llm.tokenizers import pattern, vocabulary

#: The key of the registered pseudonyms; a deployment passes its own secret.
KEY = "example key of the registered query"

QUERIES: dict = {}
#: What SQL can state over whole tables (more below); tests hold the others against brute force.
SQL: dict[str, str] = {
    "op2_substring": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
        g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM g),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM f WHERE first < doc_id),
        k AS (SELECT p.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p.pos) AS text FROM p ANTI JOIN c USING (doc_id, pos) GROUP BY p.doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op9_suffix_array": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        g AS (SELECT doc_id, i, b[i + 1 : i + 100] AS k FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM d WHERE octet_length(b) >= 100)),
        f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM g) WHERE nth > 1),
        n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM f),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n) GROUP BY doc_id, span),
        p AS (SELECT doc_id, string_agg(hex(b[before + 1 : a]), '' ORDER BY a) AS head, max(z) AS last, count(*) AS n_spans, sum(z - a) AS gone
            FROM (SELECT s.doc_id, a, z, b, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before FROM s JOIN d ON s.doc_id = d.doc_id) GROUP BY doc_id)
        SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(CASE WHEN last IS NULL THEN b ELSE unhex(head || hex(b[last + 1 : octet_length(b)])) END) AS kept_sha256 FROM d LEFT JOIN p ON d.doc_id = p.doc_id""",
    "op4_top_k": """WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 20""",
}


def _either_case(pattern: str) -> str:
    """The expression with its letters outside classes in either case."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        c = pattern[at]
        size = 4 if pattern[at : at + 2] == "\\x" else 2 if c == "\\" else 1
        inside = c == "[" or (inside and c != "]")
        out += f"[{c}{c.upper()}]" if size == 1 and not inside and c.isalpha() else pattern[at : at + size]
        at += size
    return out


def _spans_sql(rules) -> str:
    """Matches by splitting: what lies before a match is the parts and matches before it."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = []
    for no, rule in enumerate(rules):
        form = _either_case(rule.pattern) if rule.any_case else rule.pattern
        size = "len(ms[j])" + (f" - len(regexp_extract(ms[j], {quoted('^' + _either_case(rule.after))}))" if rule.after else "")
        found.append(f"SELECT doc_id, {no} AS rule, '{rule.kind}' AS kind, list_sum([len(x) FOR x IN ss[1 : j]]) + coalesce(list_sum([len(x) FOR x IN ms[1 : j - 1]]), 0) AS a, len(ms[j]) AS n FROM (SELECT doc_id, ms, ss, unnest(range(1, len(ms) + 1)) AS j FROM (SELECT doc_id, regexp_extract_all(t, {quoted(form)}) AS ms, regexp_split_to_array(t, {quoted(form)}) AS ss FROM t)) WHERE {size} >= {rule.least}")
    item = "kind || ':' || a || ':' || (a + n)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, rule, kind, CAST(a AS BIGINT) AS a, n FROM ({" UNION ALL ".join(found)})),
        s AS (SELECT doc_id, {counts}, string_agg({item}, ',' ORDER BY a, rule) FILTER (rule < {len(secrets.BASE)}) AS base, string_agg({item}, ',' ORDER BY a, rule) AS spans FROM f GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (doc_id)"""


SQL["op7_secrets"] = _spans_sql(secrets.RULES)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_byte_bpe(spark, sf_dir):
    """Ids and decoded bytes of every whole text, as digests."""
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern()))


@query
def op5_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate class of every document."""
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


@query
def op10_quality(spark, sf_dir):
    """Quality score of every document; labels of held-out documents are never seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.scores(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_packing(spark, sf_dir):
    """Every document, cut where it must be and packed into sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.digests(packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())))


@query
def op4_top_k(spark, sf_dir):
    """The 20 best inner products of every twentieth vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(topk.quantised(vectors), topk.quantised(vectors.where("vec_id % 20 = 0")))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op7_secrets(spark, sf_dir):
    """Spans of secrets in every whole text."""
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op6_lempel_ziv(spark, sf_dir):
    """Phrase fingerprints of every whole text and of its edited text."""
    return lempel.digests(lempel.edits(table(spark, sf_dir, "documents")))


@query
def op2_substring(spark, sf_dir):
    """Words of 13-word windows that also start in an earlier document, taken out of every text."""
    return substring.digests(substring.without_repeats(table(spark, sf_dir, "documents")))


@query
def op9_suffix_array(spark, sf_dir):
    """Bytes of 100-byte strings that also start earlier, taken out of every text."""
    return suffix.digests(suffix.without_repeats(table(spark, sf_dir, "documents")))


@query
def op8_pii_pseudonyms(spark, sf_dir):
    """Every text with personal numbers and dates under keyed pseudonyms, and how many of each kind were found."""
    return pii.counted(pii.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY))
