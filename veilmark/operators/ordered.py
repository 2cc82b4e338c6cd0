"""Orders within groups of which one may hold a large part of all rows.

A window over a whole group is one task. Here rows are dealt by ranges of (group, order), so a large group becomes many
chunks; what a row needs from before its chunk comes from one small row a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def _chunked(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with `o_chunk`, the number of its range; a table, so that every later step sees the same chunks."""
    return written(df.repartitionByRange(*by, *order).withColumn("o_chunk", F.spark_partition_id()), "chunks")


def _with_chunks(rows: DataFrame, chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows joined with what is known of their chunk; null groups meet themselves."""
    named = chunks.withColumnsRenamed({c: f"o_{c}" for c in by} | {"o_chunk": "o_of"})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in by], F.col("o_chunk") == F.col("o_of"))
    return rows.join(named, same).drop("o_of", *[f"o_{c}" for c in by])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """`df` with `name`: the rows of a group numbered from 1 in order. Rows of equal order are numbered in any order."""
    rows = _chunked(df, by, order)
    counts = rows.groupBy(*by, "o_chunk").agg(F.count(F.lit(1)).alias("o_n"))
    before = Window.partitionBy(*by).orderBy("o_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    offsets = counts.select(*by, "o_chunk", F.coalesce(F.sum("o_n").over(before), F.lit(0)).alias("o_before"))
    own = rows.withColumn("o_own", F.row_number().over(Window.partitionBy(*by, "o_chunk").orderBy(*order)))
    return _with_chunks(own, offsets, by).withColumn(name, F.col("o_before") + F.col("o_own")).drop("o_chunk", "o_before", "o_own")


def with_prior(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, most: int, name: str = "prior") -> DataFrame:
    """`df` with `name`: the values of the `most` rows before each in its group, oldest first; null values are left out of
    them but count as rows."""
    rows = _chunked(df, by, order)
    w = Window.partitionBy(*by, "o_chunk").orderBy(*order)
    item = F.struct(F.col(value).alias("v"))
    own = rows.withColumn("o_own", F.collect_list(item).over(w.rowsBetween(-most, -1)))
    back = Window.partitionBy(*by, "o_chunk").orderBy(*[F.desc(c) for c in order])
    last = rows.withColumn("o_back", F.row_number().over(back)).where(F.col("o_back") <= most)
    ends = last.groupBy(*by, "o_chunk").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("o_back", item.alias("x"))))), lambda s: s["x"]).alias("o_ends"))
    # no chunk is without rows, so as many chunks before as rows are asked for hold them all
    earlier = Window.partitionBy(*by).orderBy("o_chunk").rowsBetween(-most, -1)
    carried = ends.select(*by, "o_chunk", F.flatten(F.collect_list("o_ends").over(earlier)).alias("o_carried"))
    every = F.concat("o_carried", "o_own")
    kept = F.slice(every, F.greatest(F.size(every) - most + 1, F.lit(1)), F.lit(most))
    said = F.transform(F.filter(kept, lambda x: x["v"].isNotNull()), lambda x: x["v"])
    return _with_chunks(own, carried, by).withColumn(name, said).drop("o_chunk", "o_own", "o_carried")


def up_to_first(df: DataFrame, by: Sequence[str], order: Sequence[str], stop: Column) -> DataFrame:
    """Per group the rows up to and with the first in order at which `stop` holds: one combinable minimum a group and a
    join that Spark can split, no window."""
    place = F.struct(*order)
    firsts = df.where(stop).groupBy(*by).agg(F.min(place).alias("o_first")).withColumnsRenamed({c: f"o_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in by])
    return df.join(firsts, same, "left").where(F.col("o_first").isNull() | (place <= F.col("o_first"))).drop("o_first", *[f"o_{c}" for c in by])
