"""JSON and binary sources and sinks of the pipeline's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of one JSON record a file; files whose names begin with _ are left out by Spark's own listing."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_name"))


def predictions(spark: SparkSession, path: str, detection: str) -> DataFrame:
    """One file with `screens`, a map by screen id: a row per screen."""
    whole = spark.read.schema(f"screens map<string, struct<detections: array<{detection}>, error: string>>").option("multiLine", True).json(path)
    return whole.select(F.explode("screens").alias("screen_id", "screen")).select("screen_id", "screen.*")


def screenshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content", "length")


def requests(df: DataFrame, json: str, schema: str) -> DataFrame:
    """Bodies as structs; what doesn't parse is null and kept beside."""
    return df.withColumn("request", F.from_json(json, schema))


def write_json(df: DataFrame, path: str) -> None:
    """Overwrites; NaN becomes null and doubles have four places."""
    clean = {c: F.when(~F.isnan(c), F.bround(c, 4)) for c, kind in df.dtypes if kind == "double"}
    df.withColumns(clean).write.mode("overwrite").json(path) if clean else df.write.mode("overwrite").json(path)


def report_lines(df: DataFrame, label: str, values: list[str], width: int = 24) -> DataFrame:
    """Fixed-width text lines; what is undefined shows as n/a."""
    cells = [F.lpad(F.coalesce(F.when(~F.isnan(v), F.format_string("%.3f", F.col(v))), F.lit("n/a")), 10, " ") for v in values]
    return df.select(F.concat(F.rpad(F.col(label), width, " "), *cells).alias("line"))
