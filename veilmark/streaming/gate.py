"""The ingress gate over a stream: accepted, scrubbed and refused records, each batch written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingress


def parted(records: DataFrame, id_cols: list[str], fields: list[str], policy: str = "reject") -> DataFrame:
    """Records with `verdict` (clean, scrubbed or rejected) and `patterns`, a list `field: pattern` in the order of fields and
    patterns. Of what is rejected only ids and patterns are left, never a value."""
    judged = ingress.judged(records.select(*id_cols, *fields), fields, policy)
    kept = [F.when(F.col("verdict") != "rejected", F.col(f)).alias(f) for f in fields]
    return judged.select(*id_cols, *kept, "patterns", "verdict")


def run_gate(stream: DataFrame, out: str, checkpoint: str, id_cols: list[str], fields: list[str], policy: str = "reject") -> None:
    """Runs the gate over what is there. `out` gets a folder a batch with one a verdict in it, so refused records lie apart
    from the others; a batch that runs again after a failure replaces its own folder and nothing else."""

    def sink(batch: DataFrame, number: int) -> None:
        parted(batch, id_cols, fields, policy).write.partitionBy("verdict").mode("overwrite").parquet(f"{out}/number={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
