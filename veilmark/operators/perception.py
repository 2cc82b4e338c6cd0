"""Faces found in a capture: several passes become one list, which joins the manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up
from .boxes import suppressed
from .ordered import numbered


def merged(frame: DataFrame, regions: DataFrame, least: float = 0.6, most: float = 0.3) -> DataFrame:
    """Faces (image_id, i, score, bbox) of the pass over the whole frame and of passes over regions, whose boxes count from
    the region's `offset` [x, y]: those sure enough, in the frame's places, without the ones that a surer face covers. `i`
    must be unique in an image; of equal scores the smaller one is kept."""
    moved = F.transform("bbox", lambda x, k: x + F.col("offset")[k % 2])
    every = frame.select("image_id", "i", "score", "bbox").unionByName(regions.select("image_id", "i", "score", moved.alias("bbox")))
    return suppressed(every.where(F.col("score") >= least), most)


def numbered_faces(kept: DataFrame) -> DataFrame:
    """Faces as manifest input: numbered in their image from 0, the surest first."""
    order = kept.withColumn("less", -F.col("score"))
    rows = numbered(order, ["image_id"], ["less", "i"], "n")
    return rows.select(F.col("image_id").cast("string").alias("snapshot_id"), (F.col("n") - 1).cast("int").alias("face"), "bbox", "score")


def timings(passes: DataFrame, by: Sequence[str], kind: str, took: str, kinds: Sequence[str]) -> DataFrame:
    """What the passes of each capture took, a column a kind and their total, to two places, halves up; a pass that didn't run
    took nothing."""
    each = passes.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(took))), F.lit(0.0)).alias(k) for k in kinds])
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return each.select(*by, *[half_up(k, 2).alias(f"{k}_ms") for k in kinds], half_up(total, 2).alias("total_ms"))
