"""From raw documents to packed training sequences, as stages over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarflow.llm import decontaminate, language_id, line_dedup, minhash, packing
from scholarflow.llm.common import staged
from scholarflow.llm.queries import vocabulary


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; the prediction becomes lang.

    Rejected are documents without any letter, NULL texts among them.
    """
    model = language_id.fit(docs, F.lit(True))
    named = language_id.predict(docs, model, keep=("text", "source"))
    kept = named.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return _documents(kept.withColumn("lang", F.col("lang_pred")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats on its pages.

    Copies of a text count as one page of the source, and a document that would
    lose all its lines stays whole: which of a group of copies goes is decided by
    the next stage, that keeps one.
    """
    return _documents(line_dedup.line_dedup(docs, host="source", copies=False, spare=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return _documents(minhash.first_of_each(docs, shingle=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontaminate.decontaminate(docs, benchmark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents and their places in the training sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# The language model and the tokenizer are no SQL; tests/llm holds the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``, with a staged table between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
