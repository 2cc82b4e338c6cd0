"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, embedding_dedup, language_id, lexical_search, mixing, ngram_join, pii_votes, quality, secret_scan, substring_dedup, turn_repair, vantage_points
from .common import documents, held_out


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", mixing.domain(F.col("source")).alias("domain"), "lang", "source")
    taken = mixing.mix(docs, mixing.weight_table(docs), mixing.LEVELS)
    return taken.select("doc_id", "domain", "lang", "source", F.col("m_tokens").alias("n_tokens"), F.col("m_epoch").alias("epoch"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.digest(pii_votes.find_personal_data(documents(spark, sf_dir)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "contaminated", F.sort_array(F.array_distinct(F.transform("leaks", lambda x: x["item"].cast("bigint")))).alias("items"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digest(chat_format.format_windows(talks.unionByName(own)))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), n=4, hundredths=85)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.find_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(documents(spark, sf_dir)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), least=20, lengthen=True)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality.predict(docs, quality.fit(docs, labels, lambda c: ~held_out(c)))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, ~held_out("doc_id"))
    return language_id.predict(docs, model).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", F.col("score"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vantage_points.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=1.0)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.digest(talks, turn_repair.damaged(talks))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_quality": op2_quality, "op10_language_id": op10_language_id, "op3_mixing": op3_mixing, "op4_pii": op4_pii, "op5_decontamination": op5_decontamination, "op6_chat_format": op6_chat_format, "op7_ngram_join": op7_ngram_join, "op8_embedding_dedup": op8_embedding_dedup, "op9_secret_scan": op9_secret_scan, "op11_nearest": op11_nearest, "op12_turn_repair": op12_turn_repair, "op13_lexical_search": op13_lexical_search}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.oracle(), "op6_chat_format": chat_format.ORACLE, "op11_nearest": vantage_points.ORACLE, "op12_turn_repair": turn_repair.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
