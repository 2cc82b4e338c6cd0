"""Pairs of boxes that meet, and greedy choices among them, for screens with any number of boxes.

Boxes lie on a grid of squares at every scale: a box's own level is the one whose squares are as wide as its longer side
or up to twice that, so it touches at most four of them. At coarser levels that other boxes have it is a visitor in at
most four squares as well. A pair meets at the level of the larger box, in every square that both touch, and counts in
the one that holds the corner where their overlap begins. So no pair is found twice, and no square gathers more than
boxes that are about as large as itself or visit it.

That is for keys with many boxes. Those of keys with few, which are counted first, meet one another in a plain join.

Greedy choices (a prediction takes the best open truth, a face stays if no better one covers it) look sequential. They are
settled in rounds: whatever is first among all that it competes with chooses at once, everywhere; each round settles the
first of every chain, and only pairs that are still open go on. A screen with few boxes is settled in order in one pass:
Spark deals and sorts the screens, and each Arrow batch of whole ones is a few steps over arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import containment, iou
from ..tables import written

#: Boxes of a key, of both sides together, that need no grid and no rounds.
FEW = 256


def _alike(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def crowded(sides: list[DataFrame], keys: list[str]) -> DataFrame | None:
    """The keys with more than FEW rows in all sides together, as a table; None where there are none."""
    every = reduce(DataFrame.union, [df.select(*keys) for df in sides])
    many = written(every.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select(*keys), "crowded")
    return None if many.isEmpty() else many


def within(df: DataFrame, many: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose keys are among `many`, or with left_anti the others."""
    return df.join(many.withColumnsRenamed({k: f"m_{k}" for k in keys}), _alike(keys, "m_"), how)


def fit(b: Column) -> Column:
    """Whether a box is one: not null, its ends in order."""
    return b.isNotNull() & (b[2] > b[0]) & (b[3] > b[1])


def edges(b: Column) -> list[Column]:
    """A box as four columns, null where it is none."""
    return [F.when(fit(b), b[k]).alias(f"e_{k}") for k in range(4)]


def begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before."""
    out = np.ones(len(table), bool)
    out[1:] = False
    for k in keys:
        c = table[k].combine_chunks()
        now, before = c[1:], c[:-1]
        out[1:] |= pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.not_equal(now.is_null(), before.is_null())).to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches again, cut between groups: the rows of a batch's last group wait for the next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        last = int(np.flatnonzero(begins(table, keys))[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def overlaps(table: pa.Table, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows whether they overlap in more than an edge, their IoU, and how much of the first lies in the second."""
    e = [table[f"e_{k}"].combine_chunks().to_numpy(zero_copy_only=False) for k in range(4)]
    size = (e[2] - e[0]) * (e[3] - e[1])
    w, h = (np.minimum(e[k + 2][a], e[k + 2][b]) - np.maximum(e[k][a], e[k][b]) for k in (0, 1))
    with np.errstate(all="ignore"):
        inter = w * h
        return (w > 0) & (h > 0), inter / (size[a] + size[b] - inter), inter / size[a]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each count, one after another."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _level(b: Column) -> Column:
    side = F.greatest(b[2] - b[0], b[3] - b[1])
    return F.when(side > 0, F.ceil(F.log2(side))).otherwise(F.lit(-60)).cast("int")


def _cells(b: Column, level: Column) -> Column:
    """The squares of a level that a box touches, edges included."""
    width = F.pow(F.lit(2.0), level)
    at = lambda x: F.floor(x / width).cast("bigint")
    span = lambda k: F.sequence(at(b[k]), at(b[k + 2]))
    return F.flatten(F.transform(span(0), lambda x: F.transform(span(1), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], left_box: str = "a_bbox", right_box: str = "b_bbox") -> DataFrame:
    """The pairs of rows of both sides with equal keys whose boxes overlap in more than an edge; the sides' other columns
    must differ in name. Boxes that are null, or whose ends are out of order, meet nothing."""
    left, right = left.where(fit(F.col(left_box))), right.where(fit(F.col(right_box)))
    many = crowded([left, right], keys)
    if many is None:
        return _each_other(left, right, keys, left_box, right_box)
    few = _each_other(within(left, many, keys, "left_anti"), within(right, many, keys, "left_anti"), keys, left_box, right_box)
    return few.unionByName(_on_grid(within(left, many, keys), within(right, many, keys), keys, left_box, right_box))


def _overlap(x: Column, y: Column) -> Column:
    return (x[0] < y[2]) & (y[0] < x[2]) & (x[1] < y[3]) & (y[1] < x[3])


def _each_other(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str) -> DataFrame:
    right = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    return left.join(right, _alike(keys, "r_") & _overlap(F.col(left_box), F.col(right_box))).drop(*[f"r_{k}" for k in keys])


def _on_grid(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str) -> DataFrame:
    sides = [df.withColumn("g_level", _level(F.col(box))) for df, box in ((left, left_box), (right, right_box))]
    levels = sides[0].select(*keys, "g_level").union(sides[1].select(*keys, "g_level")).groupBy(*keys).agg(F.collect_set("g_level").alias("levels"))  # some 120 at most
    levels = levels.withColumnsRenamed({k: f"l_{k}" for k in keys})
    same = _alike(keys, "l_")

    def spread(df: DataFrame, box: str, home: str) -> DataFrame:
        levelled = df.join(levels, same).select(*df.columns, F.explode(F.filter("levels", lambda x: x >= F.col("g_level"))).alias("at"))
        return levelled.select(*[c for c in df.columns if c != "g_level"], (F.col("at") == F.col("g_level")).alias(home), "at", F.explode(_cells(F.col(box), F.col("at"))).alias("cell"))

    a, b = spread(sides[0], left_box, "a_home"), spread(sides[1], right_box, "b_home")
    b = b.withColumnsRenamed({k: f"r_{k}" for k in keys} | {"at": "r_at", "cell": "r_cell"})
    met = _alike(keys, "r_") & (F.col("at") == F.col("r_at")) & (F.col("cell") == F.col("r_cell"))
    x, y = F.col(left_box), F.col(right_box)
    width = F.pow(F.lit(2.0), F.col("at"))
    corner = (F.floor(F.greatest(x[0], y[0]) / width).cast("bigint") == F.col("cell.x")) & (F.floor(F.greatest(x[1], y[1]) / width).cast("bigint") == F.col("cell.y"))
    pairs = a.join(b, met & (F.col("a_home") | F.col("b_home")) & _overlap(x, y) & corner)
    return pairs.drop("a_home", "b_home", "at", "cell", "r_at", "r_cell", *[f"r_{k}" for k in keys])


def settle(wishes: DataFrame, rounds: int | None = None) -> DataFrame:
    """Greedy matching from wishes (screen_id, seq, first, truth, wish): predictions in order of `first`, a struct that is unique
    in its screen, each take the open truth that they wish most, the least struct `wish`. Returns (screen_id, seq, truth).

    A round settles each prediction that is the first at the truth it wishes most. That one has no rival before it, and what
    it would take in order is what it takes now.
    """
    keys, open_, out = ["screen_id", "seq"], written(wishes, "wishes"), None
    while not open_.isEmpty():
        best = open_.groupBy(*keys).agg(F.min_by("truth", "wish").alias("truth"), F.min("first").alias("first"))
        # the first among all that could still take the truth, whether they wish it most or not
        heads = open_.groupBy("screen_id", "truth").agg(F.min("first").alias("head"))
        taken = written(best.join(heads, ["screen_id", "truth"]).where("first = head").select(*keys, "truth"), "taken")
        out = taken if out is None else out.unionByName(taken)
        left = open_.join(taken.select(*keys), keys, "left_anti").join(taken.select("screen_id", "truth"), ["screen_id", "truth"], "left_anti")
        open_ = written(left.select(*open_.columns), "wishes")
    return wishes.select(*keys, "truth").limit(0) if out is None else out


def matched(predictions: DataFrame, truth: DataFrame, least: float = 0.5, rescue: float = 0.9) -> DataFrame:
    """(screen_id, seq, truth): for each prediction (screen_id, seq, confidence, type, bbox), most confident first, the best
    unclaimed truth (screen_id, item_idx, type, bbox) of its type: by IoU of at least `least`, or just `least` where the
    truth lies `rescue` inside the prediction; of equal scores the first item. Predictions without one have no row."""
    p = predictions.select("screen_id", "type", "seq", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("bbox").alias("b_bbox"))
    t = truth.select("screen_id", "type", F.col("item_idx").alias("truth"), F.col("bbox").alias("a_bbox"))
    pairs = meeting(t, p, ["screen_id", "type"])
    share = iou(F.col("a_bbox"), F.col("b_bbox"))
    score = F.when(share >= least, share).when(containment(F.col("a_bbox"), F.col("b_bbox")) >= rescue, F.lit(least))
    wishes = pairs.withColumn("score", score).where("score IS NOT NULL")
    return settle(wishes.select("screen_id", "seq", F.struct((-F.col("confidence")).alias("c"), F.col("seq").alias("s")).alias("first"), "truth", F.struct((-F.col("score")).alias("s"), F.col("truth").alias("t")).alias("wish")))


def suppressed(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Of boxes (image_id, i, score, bbox) those that non-maximum suppression keeps: the best first, a box stays unless it
    overlaps a kept one by an IoU of `most` or more.

    Images with few boxes go through them in order. Of the others, pairs that exclude each other are found on the grid; in
    each round a box with no better open rival is kept and its rivals go.
    """
    many = crowded([boxes], ["image_id"])
    if many is None:
        return _suppressed_in_order(boxes, most)
    few = _suppressed_in_order(within(boxes, many, ["image_id"], "left_anti"), most)
    return few.unionByName(_suppressed_in_rounds(within(boxes, many, ["image_id"]), most))


def _suppressed_in_order(boxes: DataFrame, most: float) -> DataFrame:
    columns = boxes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["image_id"]):
            start, at = np.flatnonzero(begins(table, ["image_id"])), np.arange(len(table))
            first = np.repeat(start, np.diff(np.append(start, len(table))))
            worse, better = np.repeat(at, at - first), ranges(first, at - first)
            meet, share, _ = overlaps(table, better, worse)
            rival, kept = meet & (share >= most), np.ones(len(table), bool)
            for b, w in zip(better[rival].tolist(), worse[rival].tolist(), strict=True):
                if kept[b]:
                    kept[w] = False
            yield from table.select(columns).filter(pa.array(kept)).to_batches()

    dealt = boxes.repartition("image_id").sortWithinPartitions("image_id", -F.col("score"), "i")
    return dealt.select(*columns, *edges(F.col("bbox"))).mapInArrow(run, boxes.schema)


def _suppressed_in_rounds(boxes: DataFrame, most: float) -> DataFrame:
    first = F.struct((-F.col("score")).alias("s"), F.col("i").alias("i"))
    every = boxes.select("image_id", "i", "score", "bbox", first.alias("first"))
    a = every.select("image_id", F.col("i").alias("better"), F.col("first").alias("a_first"), F.col("bbox").alias("a_bbox"))
    b = every.select("image_id", F.col("i").alias("worse"), F.col("first").alias("b_first"), F.col("bbox").alias("b_bbox"))
    rivals = meeting(a, b, ["image_id"]).where((F.col("a_first") < F.col("b_first")) & (iou(F.col("a_bbox"), F.col("b_bbox")) >= most))
    rivals = written(rivals.select("image_id", "better", "worse"), "rivals")
    gone, open_ = rivals.select("image_id", F.col("worse").alias("i")).limit(0), rivals
    while not open_.isEmpty():
        heads = open_.select("image_id", "better").distinct().join(open_.select("image_id", F.col("worse").alias("better")).distinct(), ["image_id", "better"], "left_anti")
        out = written(open_.join(heads, ["image_id", "better"]).select("image_id", F.col("worse").alias("i")).distinct(), "suppressed")
        gone = gone.unionByName(out)
        left = open_.join(heads, ["image_id", "better"], "left_anti").join(out.select("image_id", F.col("i").alias("better")), ["image_id", "better"], "left_anti")
        open_ = written(left.join(out.select("image_id", F.col("i").alias("worse")), ["image_id", "worse"], "left_anti").select("image_id", "better", "worse"), "rivals")
    return boxes.join(gone, ["image_id", "i"], "left_anti")
