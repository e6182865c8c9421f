"""The corpus pipeline: from raw documents to packed token sequences, in five stages.

Each stage takes what the one before it has kept, written as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import jaccard, packing, passages, pseudonyms, substrings
from tracewell.llm.learning import remainder
from tracewell.llm.tables import Staging
from tracewell.session import configure

# SQL can express neither the trained classifier nor the tokens.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model scores at the threshold or above; trained on the labels outside fold 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id") != 0)
    scored = passages.score(docs, passages.fit(docs, labels), column="_score")
    return scored.where(F.col("_score") >= passages.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; texts that lose nothing stay as they are."""
    cut = substrings.remove_repeats(docs)
    return _with_text(cut, docs, F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return _with_text(pseudonyms.protect(docs), docs, F.col("text"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


def _with_text(changed: DataFrame, docs: DataFrame, text) -> DataFrame:
    new = changed.withColumn("text", text)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(docs.columns)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    configure(spark)
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staging.write(stage(spark, docs, sf_dir), name)
    return docs
