"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors are ordered along a few fixed directions and cut into shards of bounded size; each gets a tree. The inner product
becomes a distance: with one component more, sqrt(M^2 - |x|^2) for a vector and 0 for a query, where M is the largest norm
of the shard, |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest point has the largest product. A node keeps, for each of
its two sides, the least and the largest distance to its vantage point; by the triangle inequality no point of a side is
nearer than the gap between that range and the query's own distance. A side goes where `factor` times its gap exceeds
the distance of the query's k-th best so far: with a factor of 1 the search is exact, larger ones skip more.

Shards and queries meet in the cells of a grid: a cell holds some blocks of queries of bounded size and lets the shards
of its group go by, so the k-th best of one shard prunes the next. A cell reports at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_written, in_small_batches, written
from .embedding_dedup import DIRECTIONS, _matrix, _places, usable

#: Vectors in a shard and in a leaf of its tree, shards in a group at least, queries in a block, and bytes of queries that
#: a cell holds about.
SHARD, LEAF, GROUP, BLOCK, CELL_BYTES = 2048, 64, 32, 256, 64_000_000


def build(ids: np.ndarray, x: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The tree of a shard. Equal vectors are one point with at most k + 1 of their ids, the smallest: a query never needs
    more of them, its own id aside.

    Arrays: `points`, their `first` id among `ids`, `order` of the points by leaf, and per node its vantage `point` (-1: a leaf), the
    stretch of `order` from `lo` to `hi`, the number of its inner side's node (the outer side's is one more), and `near`, the
    ranges of distances of both sides.
    """
    turn = np.argsort(ids, kind="stable")
    ids, x = ids[turn], x[turn] + 0.0  # negative zeros equal zeros
    _, first, which = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")  # points together, ids ascending
    place = np.arange(len(ids)) - np.searchsorted(which[by], which[by])
    by = by[place <= k]
    points = x[first]
    starts = np.searchsorted(which[by], np.arange(len(points) + 1))
    square = (points * points).sum(axis=1)
    most = square.max()
    raised = np.column_stack([points, np.sqrt(most - square)])
    order = np.arange(len(points))
    nodes: list[tuple] = [(-1, 0, len(points), -1, 0.0, 0.0, 0.0, 0.0)]
    todo = [0]
    while todo:
        node = todo.pop()
        _, lo, hi, *_ = nodes[node]
        if hi - lo <= LEAF:
            continue
        own = order[lo:hi]
        centre = raised[own].mean(axis=0)
        at = own[((raised[own] - centre) ** 2).sum(axis=1).argmax()]  # far out, so that distances spread
        away = np.sqrt(((raised[own] - raised[at]) ** 2).sum(axis=1))
        by_distance = np.argsort(away, kind="stable")
        order[lo:hi], away = own[by_distance], away[by_distance]
        half = (hi - lo) // 2
        nodes[node] = (int(at), lo, hi, len(nodes), away[0], away[half - 1], away[half], away[-1])
        todo += [len(nodes), len(nodes) + 1]
        nodes += [(-1, lo, lo + half, -1, 0.0, 0.0, 0.0, 0.0), (-1, lo + half, hi, -1, 0.0, 0.0, 0.0, 0.0)]
    table = np.array(nodes, dtype=np.float64)
    return {"points": points, "ids": ids[by], "starts": starts, "order": order, "nodes": table, "most": np.array([most])}


class Best:
    """The k best of each query so far: larger products first, then smaller ids."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def least(self, of: np.ndarray) -> np.ndarray:
        return self.scores[of, -1]

    def add(self, at: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        other = found != self.ids[at]
        at, found, scores = at[other], found[other], scores[other]
        if not len(at):
            return
        some = np.unique(at)
        at = np.concatenate([np.repeat(some, self.k), at])
        found = np.concatenate([self.found[some].ravel(), found])
        scores = np.concatenate([self.scores[some].ravel(), scores])
        by = np.lexsort((found, -scores, at))
        at, found, scores = at[by], found[by], scores[by]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        self.scores[some], self.found[some] = scores[kept].reshape(-1, self.k), found[kept].reshape(-1, self.k)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, component by component in order, so that equal vectors have equal products wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def search(tree: dict[str, np.ndarray], best: Best, factor: float = 1.0) -> int:
    """Adds the shard's vectors to the best of the queries; returns how many products were made."""
    points, nodes, most = tree["points"], tree["nodes"], float(tree["most"][0])
    q, made = best.queries, 0
    norm2 = best.norms**2
    slack = 1e-9 * (best.norms + np.sqrt(most)) + 1e-300
    raised_last = np.sqrt(np.maximum(0.0, most - (points * points).sum(axis=1)))

    def away(node: np.ndarray, of: np.ndarray) -> np.ndarray:
        v = int(node[0])
        dots = q[of] @ points[v]
        return np.sqrt(np.maximum(0.0, norm2[of] + (points[v] ** 2).sum() + raised_last[v] ** 2 - 2 * dots))

    def gap(node: np.ndarray, side: int, d: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, np.maximum(d - node[5 + 2 * side], node[4 + 2 * side] - d))

    def open_(of: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        reach = np.sqrt(np.maximum(0.0, norm2[of] + most - 2 * best.least(of)))  # of the k-th best; infinite while there are fewer
        return of[factor * (gaps - slack[of]) <= reach + slack[of]]

    def scan(node: np.ndarray, of: np.ndarray) -> None:
        nonlocal made
        own = tree["order"][int(node[1]) : int(node[2])]
        made += len(own) * len(of)
        dots = q[of] @ points[own].T
        near = best.least(of) - 1e-12 * (norm2[of] + most)
        i, j = np.nonzero(dots >= near[:, None])
        exact = products(q[of[i]], points[own[j]])
        n = tree["starts"][own[j] + 1] - tree["starts"][own[j]]
        each = np.repeat(np.arange(len(i)), n)
        place = np.repeat(tree["starts"][own[j]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        best.add(of[i][each], tree["ids"][place], exact[each])

    def leaf_of(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaf that each query falls into, which gives it a k-th best to prune with."""
        todo = [(0, of)]
        while todo:
            at, mine = todo.pop()
            node = nodes[at]
            if not len(mine):
                continue
            if node[0] < 0:
                yield at, mine
                continue
            inner = away(node, mine) <= (node[5] + node[6]) / 2
            todo += [(int(node[3]), mine[inner]), (int(node[3]) + 1, mine[~inner])]

    every = np.arange(len(best.ids))
    home = np.full(len(every), -1)
    for at, mine in leaf_of(every[~np.isfinite(best.least(every))]):
        scan(nodes[at], mine)
        home[mine] = at
    todo = [(0, every)]
    while todo:
        at, of = todo.pop()
        node = nodes[at]
        if not len(of):
            continue
        if node[0] < 0:
            if len(rest := of[home[of] != at]):
                scan(node, rest)
            continue
        d = away(node, of)
        todo += [(int(node[3]) + side, open_(of, gap(node, side, d))) for side in (1, 0)]
    return made


def _packed(df: DataFrame, size: int, k: int, tree: bool) -> DataFrame:
    """Rows (dim, id, v) of a partition, in order, as blocks of at most `size` vectors of equal length: a row each."""
    schema = T.StructType.fromDDL("block bigint, dim int, n int, ids binary, points binary, starts binary, order binary, nodes binary, most double")
    out = to_arrow_schema(schema)

    def row(dim: int, ids: np.ndarray, x: np.ndarray, number: int) -> pa.RecordBatch:
        made = build(ids, x, k) if tree else {"ids": ids, "points": x, "starts": np.empty(0), "order": np.empty(0), "nodes": np.empty(0), "most": np.zeros(1)}
        blobs = {c: made[c].tobytes() for c in ("ids", "points", "starts", "order", "nodes")}
        return pa.RecordBatch.from_pylist([{"block": (TaskContext.get().partitionId() << 32) + number, "dim": dim, "n": len(made["points"]), "most": float(made["most"][0]), **blobs}], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, dim = count(), [], None
        for batch in batches:
            dims = batch.column(0).to_numpy()
            change = np.flatnonzero(dims[1:] != dims[:-1]) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                if a == b:
                    continue
                if dim is not None and dims[a] != dim:
                    yield from flush(held, dim, 0, numbers)
                dim = int(dims[a])
                held.append((batch.column(1).slice(a, b - a).to_numpy(), _matrix(batch.column(2).slice(a, b - a))))
                yield from flush(held, dim, size, numbers)
        yield from flush(held, dim, 0, numbers)

    def flush(held: list, dim: int | None, least: int, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        if not held or sum(len(x[0]) for x in held) < least:
            return
        ids, x = (np.concatenate([h[c] for h in held]) for c in (0, 1))
        whole = len(ids) // size * size if least else len(ids)
        for a in range(0, whole, size):
            yield row(dim, ids[a : min(a + size, whole)], x[a : min(a + size, whole)], next(numbers))
        held[:] = [(ids[whole:], x[whole:])] if whole < len(ids) else []

    return in_small_batches(df, run, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest of `vectors` by inner product in double precision,
    the largest first, ties to smaller ids; all of them where there are fewer.

    Both tables have an id and a vector. A query is compared with vectors of its own length and never with its own id.
    Rows without an id, and vectors that are null, empty, all zero or hold a null, NaN or infinite component take no part. Ids
    are taken to be unique; a repeated row of `vectors` is found once for each time it is there, a repeated query gives the
    ranks once. Components must be small enough for their squares to be finite. Empty tables give no rows; further
    columns are not read. With `factor` 1 the result is exact.
    """
    def rows(df: DataFrame) -> DataFrame:
        good = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        placed = good.select(F.size("v").alias("dim"), "id", "v", norm.alias("norm")).where("norm > 0")
        places = [f"p{i}" for i in range(DIRECTIONS)]
        placed = placed.select("dim", "id", "v", *[p.alias(n) for p, n in zip(_places("v", "norm"), places, strict=True)])
        return placed.repartitionByRange("dim", *places, "id").sortWithinPartitions("dim", *places, "id").select("dim", "id", "v")

    asked = queries.select(F.col(id_col).alias(id_col), F.col(vector_col).alias(vector_col)).dropDuplicates([id_col])
    shards = written(_packed(rows(vectors), SHARD, k, True), "shards")
    blocks = written(_packed(rows(asked), BLOCK, k, False), "query-blocks")
    spark = vectors.sparkSession
    # A side of queries is as many as a cell may hold, or fewer where that keeps all cores busy. Shards are dealt into groups
    # only as far as cores would be idle else: each cell reports k rows a query, so these grow with the groups.
    wanted = float(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = blocks.groupBy("dim").agg(F.sum("n").alias("asked"), F.count(F.lit(1)).alias("blocks"))
    asked = asked.withColumn("needed", F.ceil(F.col("asked") * (F.col("dim") * 8 + 16 * k + 32) / F.lit(CELL_BYTES)))
    counts = shards.groupBy("dim").agg(F.sum("n").alias("there"), F.count(F.lit(1)).alias("shards")).join(asked, "dim")
    counts = counts.withColumn("groups", F.greatest(F.lit(1), F.least(F.ceil(F.col("there") / (GROUP * SHARD)), F.ceil(wanted / F.col("needed")), F.col("shards"))))
    counts = counts.withColumn("sides", F.least("blocks", F.greatest("needed", F.least(F.ceil(F.col("asked") / BLOCK), F.ceil(wanted / F.col("groups"))))))
    counts = written(counts.select("dim", "sides", "groups"), "cells")
    deal = lambda n: F.pmod(F.xxhash64("block"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = blocks.join(counts, "dim").select("*", deal("sides").alias("side")).select("*", every("groups").alias("group"), F.lit(0).alias("kind"))
    passing = shards.join(counts, "dim").select("*", deal("groups").alias("group")).select("*", every("sides").alias("side"), F.lit(1).alias("kind"))
    cell = ["dim", "side", "group"]
    columns = [*cell, "kind", "n", "ids", "points", "starts", "order", "nodes", "most"]
    work = dealt.select(*columns, "block").unionByName(passing.select(*columns, "block")).repartition(*cell).sortWithinPartitions(*cell, "kind", "block").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, parts = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now != (now := tuple(r[c] for c in cell)):
                    yield from told(best)
                    best, parts = None, []
                x = np.frombuffer(r["points"], dtype=np.float64).reshape(r["n"], r["dim"])
                ids = np.frombuffer(r["ids"], dtype=np.int64)
                if r["kind"] == 0:
                    parts.append((ids, x))
                elif parts or best:
                    if best is None:
                        best, parts = Best(*(np.concatenate([p[c] for p in parts]) for c in (0, 1)), k), []
                    kinds = {"starts": np.int64, "order": np.int64, "nodes": np.float64}
                    tree = {c: np.frombuffer(r[c], dtype=t) for c, t in kinds.items()} | {"points": x, "ids": ids, "most": np.array([r["most"]])}
                    tree["nodes"] = tree["nodes"].reshape(-1, 8)
                    search(tree, best, factor)
        yield from told(best)

    def told(best: Best | None) -> Iterator[pa.RecordBatch]:
        if best is not None:
            at, place = np.nonzero(np.isfinite(best.scores))
            for a in range(0, len(at), 100_000):
                i, j = at[a : a + 100_000], place[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[i]), pa.array(best.found[i, j]), pa.array(best.scores[i, j])], names=["query_id", "vec_id", "score"])

    found = written(in_small_batches(work, run, "query_id bigint, vec_id bigint, score double"), "nearest")
    for table in (shards, blocks, counts):
        drop_written(table)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]), lambda a, x: a + x, 0.0::DOUBLE) AS score
  FROM v AS q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
