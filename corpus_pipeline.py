"""The corpus pipeline: documents through quality rules, near-duplicate groups, repeated passages and secrets to packed
sequences of tokens. Each stage gets what its predecessor kept, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import jaccard, packing, quality, repeats, secrets
from weft.llm.queries import vocabulary
from weft.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REDACTED = "[SECRET]"


def _documents(found: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of documents; where texts have changed, n_chars anew (null texts: as it was)."""
    if changed:
        found = found.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return found.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps. The ledger is written first, so that a filter on it evaluates no rule again.

    Null and empty texts have no words, which fails a rule; repeated rows are judged alike; extra columns go."""
    entries = Scratch(spark, "ledger").table(quality.ledger(docs.select(*COLUMNS)), "ledger")
    return _documents(entries.filter(quality.kept("web-2")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the least id, once. What goes is decided by row: a document whose id
    repeats with another, unlinked text stays. Null ids come last in their group; documents without words all stay."""
    return _documents(jaccard.deduplicated(docs.select(*COLUMNS)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their passages that occur again; nothing may be left of some. Null texts stay null; every
    row is a document, also where ids or whole rows repeat."""
    return _documents(repeats.remove(docs), changed=True)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; null and empty texts stay as they are, repeated rows change alike."""
    return _documents(secrets.scan(docs, redact=REDACTED), changed=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of tokens; null texts are empty documents of one token, repeated rows are
    packed each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scans", secret_scans),
    ("packing", packed),
]

#: Shingle sets, repeated strings and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
