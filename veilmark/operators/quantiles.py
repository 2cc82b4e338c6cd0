"""Exact quantiles without a buffer of a group's values.

The rank that a quantile asks for is narrowed down: values are counted by slot, map-side, the slot that holds the rank is
cut into slots again, until its least and largest value are one. The first slots are steps of the logarithm, 16 to a
factor of e, on either side of zero; a later round cuts a slot into 4,096 equal parts. So a group never needs more than
some 50,000 counts, one number a slot, and a double is settled after five rounds. Rows of slots that no rank falls in
leave after the first round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Slots to a factor of e at first, and equal parts of a slot later.
STEPS, PARTS = 16, 4096


def _log_slot(x: Column) -> Column:
    """Slots that follow the values, negative ones mirrored; infinities have their own."""
    size = F.floor(F.least(F.ln(F.abs(x)) * STEPS, F.lit(30_000.0))) + 20_000
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("bigint")


def _part_slot(x: Column, low: Column, high: Column) -> Column:
    half = high / 2 - low / 2  # a range may be wider than the largest double
    part = F.least(F.floor(F.try_divide(x / 2 - low / 2, half) * PARTS), F.lit(PARTS - 1))
    return F.when(half > 0, part).otherwise((x > low).cast("bigint")).cast("bigint")  # the halves of the smallest doubles may be equal


def _picked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of counted slots the one that holds the rank `k`, and the rows before it in all."""
    before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    sums = counts.withColumn("below", F.col("under") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    return sums.where((F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("n")))


def quantiles(values: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, share, quantile): exact quantiles of each group's values by linear interpolation between neighbours.

    Null and NaN values don't count; a group of none but such has no rows. An empty `by` is one group. Groups may be null.
    """
    if not by:
        return quantiles(values.withColumn("q_all", F.lit(0)), ["q_all"], value, shares).drop("q_all")
    by = list(by)
    names = {c: f"q_{i}" for i, c in enumerate(by)}
    groups = [*names.values()]
    x = F.col(value).cast("double")
    rows = values.select(*[F.col(c).alias(n) for c, n in names.items()], x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    slots = rows.groupBy(*groups, _log_slot(F.col("x")).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    slots = written(slots, "slots")
    sizes = slots.groupBy(*groups).agg(F.sum("n").alias("all"))
    places = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("all") - 1)).alias("place")) for s in shares]))
    asked = sizes.select(*groups, places.alias("a")).select(*groups, "a.share", "a.place")
    # the two neighbours of a place, mostly in one slot
    asked = asked.select(*groups, "share", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("k"))

    def same(left: Sequence[str], right: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])

    ranks = asked.select(*[F.col(g).alias(f"r_{g}") for g in groups], "k").distinct()
    met = slots.join(ranks, same(groups, [f"r_{g}" for g in groups]))
    keys = [*groups, "k"]
    found = written(_picked(met.select(*keys, "slot", "n", "low", "high", F.lit(0).alias("under")), keys).select(*keys, "below", "low", "high"), "ranks")
    while not (open_ := found.where("low < high")).isEmpty():
        narrow = open_.select(*[F.col(g).alias(f"r_{g}") for g in groups], "k", F.col("below").alias("under"), F.col("low").alias("from"), F.col("high").alias("to"))
        inside = (F.col("x") >= F.col("from")) & (F.col("x") <= F.col("to"))
        some = rows.join(narrow, same(groups, [f"r_{g}" for g in groups]) & inside)
        counted = some.groupBy(*keys, "under", _part_slot(F.col("x"), F.col("from"), F.col("to")).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        found = written(found.where("low >= high").unionByName(_picked(counted, keys).select(*keys, "below", "low", "high")), "ranks")
    value_of = found.select(*[F.col(g).alias(f"r_{g}") for g in groups], F.col("k").alias("r_k"), F.col("low").alias("at"))
    joined = asked.join(value_of, same([*groups, "k"], [*[f"r_{g}" for g in groups], "r_k"]))
    ends = joined.groupBy(*groups, "share", "place").agg(F.min_by("at", "k").alias("a"), F.max_by("at", "k").alias("b"))
    between = F.col("place") - F.floor("place")
    out = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - between) * F.col("a") + between * F.col("b"))
    return ends.select(*[F.col(n).alias(c) for c, n in names.items()], "share", out.alias("quantile"))
