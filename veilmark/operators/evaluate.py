"""Scoring: matched detections, precision and recall, masked areas, latency percentiles, and targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from .boxes import begins, crowded, edges, matched, meeting, overlaps, ranges, whole_groups, within
from .quantiles import quantiles


OUTCOME = "screen_id {}, outcome string, tier int, type string"


def match_screens(predictions: DataFrame, truth: DataFrame, least: float = 0.5, rescue: float = 0.9) -> DataFrame:
    """Outcomes (screen_id, outcome tp/fp/fn, tier, type): tp and fp by the prediction, fn by the truth, of the screens
    that have both. Screens with few boxes are matched in order; in others boxes meet on a grid, so a screen may hold any
    number of them."""
    many = crowded([predictions, truth], ["screen_id"])
    if many is None:
        return _in_order(predictions, truth, least, rescue)
    few = _in_order(*[within(df, many, ["screen_id"], "left_anti") for df in (predictions, truth)], least, rescue)
    return few.unionByName(_in_rounds(*[within(df, many, ["screen_id"]) for df in (predictions, truth)], least, rescue))


def _in_order(predictions: DataFrame, truth: DataFrame, least: float, rescue: float) -> DataFrame:
    """The rules of boxes.matched(), screen by screen: truths by item, then predictions by confidence, each of which takes
    the open truth that it wishes most."""
    told = lambda df, mine, *order: df.where("screen_id IS NOT NULL").select("screen_id", "type", F.col("tier").cast("int").alias("tier"), F.lit(mine).alias("mine"), *[c.alias(f"o_{k}") for k, c in enumerate(order)], *edges(F.col("bbox")))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    p = told(predictions, True, -F.coalesce("confidence", F.lit(0.0)), F.col("seq"), none(truth, "item_idx"))
    t = told(truth, False, F.lit(None).cast("double"), none(predictions, "seq"), F.col("item_idx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["screen_id"]):
            mine = table["mine"].combine_chunks().to_numpy(zero_copy_only=False)
            start = np.flatnonzero(begins(table, ["screen_id", "type"]))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))
            truths = np.bincount(group[~mine], minlength=len(start))
            rows = np.flatnonzero(mine)
            a, b = ranges(start[group[rows]], truths[group[rows]]), np.repeat(rows, truths[group[rows]])
            meet, share, inside = overlaps(table, a, b)
            wished = meet & ((share >= least) | (inside >= rescue))
            a, b, score = a[wished], b[wished], np.where(share >= least, share, least)[wished]
            order = np.lexsort((a, -score, b))
            hit, last = np.zeros(len(table), bool), -1
            for y, x in zip(a[order].tolist(), b[order].tolist(), strict=True):
                if x != last and not hit[y]:
                    hit[x] = hit[y] = True
                    last = x
            # of the screens that have both, all predictions and the truths that none took
            screen = np.cumsum(begins(table, ["screen_id"])) - 1
            n, own = np.bincount(screen), np.bincount(screen[mine], minlength=screen[-1] + 1)
            kept = ((own > 0) & (own < n))[screen] & (mine | ~hit)
            outcome = pa.array(np.where(~mine, "fn", np.where(hit, "tp", "fp")), pa.string())
            yield from pa.table([table["screen_id"], outcome, table["tier"], table["type"]], names=["screen_id", "outcome", "tier", "type"]).filter(pa.array(kept)).to_batches()

    dealt = p.unionByName(t).repartition("screen_id").sortWithinPartitions("screen_id", "type", "mine", "o_0", "o_1", "o_2")
    return dealt.select("screen_id", "type", "tier", "mine", *[f"e_{k}" for k in range(4)]).mapInArrow(run, OUTCOME.format(dealt.schema["screen_id"].dataType.simpleString()))


def _in_rounds(predictions: DataFrame, truth: DataFrame, least: float, rescue: float) -> DataFrame:
    both = lambda df, other: df.join(other.select("screen_id").distinct(), "screen_id", "left_semi")
    found = matched(predictions, truth, least, rescue)
    told = lambda df, outcome: df.select("screen_id", outcome.alias("outcome"), F.col("tier").cast("int").alias("tier"), "type")
    hits = both(predictions, truth).join(found.select("screen_id", "seq", F.lit(True).alias("hit")), ["screen_id", "seq"], "left")
    missed = both(truth, predictions).join(found.select("screen_id", F.col("truth").alias("item_idx")), ["screen_id", "item_idx"], "left_anti")
    return told(hits, F.when(F.col("hit"), "tp").otherwise("fp")).unionByName(told(missed, F.lit("fn")))


def unscorable(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Screens without a prediction: put aside, not failed."""
    return truth.select("screen_id").distinct().join(predictions.select("screen_id").distinct(), "screen_id", "left_anti")


def confusion(outcomes: DataFrame) -> DataFrame:
    """tp, fp and fn overall, by tier and by type, with precision, recall and F1, null where undefined."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    sets = outcomes.groupingSets([[], [F.col("tier")], [F.col("type")]], "tier", "type").agg(count("tp"), count("fp"), count("fn"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "tier").otherwise("type")
    key = F.when(F.col("g") == 1, F.col("tier").cast("string")).when(F.col("g") == 2, F.col("type")).otherwise("all")
    precision, recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return sets.select(level.alias("level"), key.alias("key"), "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def redaction_precision(manifest: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Of the masked boxes, how many lie on a labelled item (best IoU >= least): by tier, and overall with tier null."""
    entries = manifest.where("bbox IS NOT NULL").select("screen_id", "seq", "tier", F.col("bbox").alias("b_bbox"))
    pairs = meeting(truth.select("screen_id", F.col("bbox").alias("a_bbox")), entries, ["screen_id"])
    on = pairs.where(iou(F.col("a_bbox"), F.col("b_bbox")) >= least).select("screen_id", "seq").distinct().withColumn("hit", F.lit(True))
    rows = entries.join(on, ["screen_id", "seq"], "left").withColumn("on", F.coalesce("hit", F.lit(False)).cast("bigint"))
    out = rows.groupingSets([[], [F.col("tier")]], "tier").agg(F.sum("on").alias("on_target"), F.count(F.lit(1)).alias("masked"))
    return out.withColumn("precision", F.try_divide(F.col("on_target").cast("double"), F.col("masked")))


def percentiles(df: DataFrame, stages: list[str], by: list[str] = ()) -> DataFrame:
    """Exact p50 and p95 of each stage, by linear interpolation, and of the rows' totals; a row per stage. A stage without
    a value in a group has nulls."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    named = [*[(s, F.col(s)) for s in stages], ("total", total)]
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), c.cast("double").alias("x")) for n, c in named])).alias("v")).select(*by, "v.*")
    found = quantiles(long, [*by, "stage"], "x", [0.5, 0.95])
    at = lambda q: F.max(F.when(F.col("share") == q, F.col("quantile")))
    wide = found.groupBy(*by, "stage").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    absent = long.groupBy(*by, "stage").agg(F.count("x").alias("n")).where("n = 0").select(*by, "stage", F.lit(None).cast("double").alias("p50"), F.lit(None).cast("double").alias("p95"))
    return wide.unionByName(absent)


def stage_sums(found: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sum of the stages' medians, which isn't the median of the sums: what the rows of percentiles() add up to."""
    return found.where("stage != 'total'").groupBy(*by).agg(F.sum("p50").alias("p50_sum"), F.count(F.lit(1)).alias("stages"))


def measured(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hand-set labels (snapshot_id, item, selector, needle) with the box of the node that the selector names and where in
    its value or text the needle stands; without a node, or without the needle in it, `problem` says so."""
    at = nodes.select("snapshot_id", F.col("path").alias("selector"), "bbox", F.coalesce("value", "text").alias("content"), F.lit(True).alias("there"))
    rows = labels.join(at, ["snapshot_id", "selector"], "left")
    start = F.when(F.col("needle").isNotNull(), F.nullif(F.instr("content", F.col("needle")), F.lit(0)) - 1)
    problem = F.when(F.col("there").isNull(), "no such node").when(F.col("needle").isNotNull() & start.isNull(), "text not found").when(F.col("bbox").isNull(), "no box")
    return rows.select("snapshot_id", "item", "selector", F.array_join(F.transform("bbox", lambda x: x.cast("int").cast("string")), ",").alias("box"), start.cast("int").alias("start"), problem.alias("problem"))


def gate(value: Column, target: Column, most: bool = False) -> Column:
    """PASS where the target is met, BELOW (or OVER, for a budget) where not or undefined."""
    met = (value <= target) if most else (value >= target)
    return F.when(F.coalesce(met & ~F.isnan(value), F.lit(False)), "PASS").otherwise("OVER" if most else "BELOW")
