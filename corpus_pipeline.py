"""A training-data pipeline over `documents`: five stages, each one operator, each written and read again by the next.

Every stage works on all rows its predecessor kept, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import decontamination, language_id, mixing, ngram_join, pii_votes
from veilmark.llm.common import drop_written, held_out, written

#: A document goes where no language is this likely; texts without a letter always go.
LEAST_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows; a missing `lang` becomes the predicted one."""
    model = language_id.fit(docs, ~held_out("doc_id"))
    found = language_id.predict_rows(docs, model)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE)
    return found.where(known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the smallest id; rows that repeat that id stay together.

    Documents without words, or without an id, are no copies of anything and stay.
    """
    groups = ngram_join.join(docs)
    # written, so that the join knows its size
    gone = written(groups.where("doc_id != component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_leaks(docs, benchmark).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes its kind in brackets; `n_chars` follows."""
    return pii_votes.masked(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each document and epoch."""
    placed = docs.withColumn("domain", mixing.domain(F.col("source")))
    taken = mixing.mix(placed, mixing.weight_table(docs), mixing.LEVELS)
    return taken.withColumnsRenamed({"m_epoch": "epoch", "m_tokens": "n_tokens"})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmarks", clean_of_benchmarks),
    ("private_data", private_data),
    ("mixing", mixed),
]

#: Language identification has no SQL form; the tests hold the pipeline against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return docs
