"""A corpus pipeline: quality filter, near-copy removal, suffix-array deduplication, secret redaction, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of ``documents``; the
last returns packed pieces.  ``run`` writes each stage's result to the shared folder and reads it back, so a stage starts
from files and a lost executor costs its own tasks only; a stage's own intermediate tables go when its result is written.

In every stage repeated rows are rows of their own, other columns pass as they are, whatever their names, and an empty table
gives an empty one.

No stage can be stated in SQL over whole tables (a fitted classifier, connected components, byte offsets, an automaton,
greedy packing): ``ORACLE_SQL`` is None and tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import nearcopies, packing, quality, secrets, suffix
from barsmith.llm.common import scratch, table, unused
from barsmith.llm.tokenizers import pattern, vocabulary

#: Scores below this are rejected.
LEAST_QUALITY = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is ``LEAST_QUALITY`` or more.

    Null and empty texts are scored as empty ones, rows with a null id by their text; ties at the threshold stay.  A text of any
    length is scored whole.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    score = unused(docs, "__score")
    return quality.scores(docs, model, out=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near copies (five words, 0.8).

    Texts without words (null, empty, blank) are copies of each other; rows with a null id stay; rows with one id stay or go
    together; a similarity of 0.8 sharp is a link.
    """
    return nearcopies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what stands in 100-byte strings that start earlier, in whole characters.

    Null texts stay null, empty ones empty; rows with a null id are whole; of equal strings the first by id and place stays.
    """
    return suffix.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret span replaced; spans that overlap become one.  Null texts stay null; ids are not looked at."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 tokens.  Null texts count as empty (an end mark); rows with a
    null id are packed too."""
    return packing.digests(packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())))


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
