"""From raw documents to packed sequences: quality rules, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of `documents`; the last returns the
pieces and their places. Between stages the documents are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecount.llm import jaccard, packing, quality, secret_scan, spans, suffixes
from gatecount.llm.common import documents, fresh, quoted, text_or_empty, written
from gatecount.llm.queries import WORD_TOKENIZER

REDACTED = "[SECRET]"


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Brings n_chars up to date with a changed text."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*quoted(columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles and a similarity of 0.8, the smallest id stays."""
    return jaccard.representatives(docs, percent=80, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that started earlier are cut out; documents of which nothing is left go."""
    rewritten = suffixes.rewritten(docs)
    return counted(rewritten.where(F.col("text").isNull() | (F.trim("text") != "")), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    model = secret_scan.train(docs)
    base, every = fresh(docs, "base_spans"), fresh(docs, "secret_spans")
    scanned = secret_scan.scanned(docs, model, base, every)
    clean = F.when(F.col("text").isNotNull(), spans.replaced(text_or_empty(), F.col(every), REDACTED))
    return counted(scanned.withColumn("text", clean), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.packed(docs, WORD_TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]
#: Thresholds from labels, hash-built regions and a tokenizer cannot be said in SQL; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
