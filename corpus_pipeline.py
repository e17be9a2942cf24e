"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last returns packed pieces. Results
are written as Parquet and read again between stages; each goes once the next
is written.

Defined cases, in every stage: a null text counts as empty, and an empty one is
not toxic, holds no line or secret and is one piece, the end mark; texts
without words are copies of each other, so one of them stays; a document
without a doc_id stays (no stage can say which one it is); rows that repeat are
copies, one of which stays; very long texts are worked on whole; columns
besides doc_id, text and n_chars pass unchanged, whatever their names; no rows
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weavegrid.llm import line_dedup, ngram_join, packing, secrets, toxicity
from weavegrid.llm.common import discard, free_name, stored
from weavegrid.llm.queries import byte_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without recurring lines; a document that held nothing else goes, and what is half a copy of another is left to the next stage."""
    counts = free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns)
    kept = line_dedup.deduplicated(docs, min_tokens=1, leave_copies=True, counts=counts)
    return kept.where((F.col(counts[1]) == 0) | F.col("text").rlike(r"\S")).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without near copies of documents that stay: in order of doc_id, each stays that is within the threshold of none before it that does."""
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked; every document stays."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 1024 tokens."""
    return packing.pack(packing.tokenized(docs, *byte_bpe()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs


#: SQL can't express the trained classifier, the template tree or the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None
