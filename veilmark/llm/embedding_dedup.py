"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors of equal label and length are ordered along a few fixed directions and cut into tiles. A unit vector x is kept
as s*q + e, with q of int8 and the norm of e known; then |x.y - s q.s' q'| <= |e| + |e'| + |e||e'|. The product of two
int8 tiles with that bound leaves the pairs that may reach the threshold, and only those are computed again in double
precision. Tiles whose centres are farther apart than their radii and the threshold allow are not multiplied at all.

The tiles of a label are dealt over a grid: a cell holds two runs of tiles of bounded size and multiplies each of the one
with each of the other, so a label with very many vectors becomes many cells, and a tile is sent once to each of its row
of cells, not once for each product. A tile product reports how many links each vector has and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, in_small_batches, written
from .components import components

#: Vectors in a tile, at most twice as many.
TILE = 1024
#: Tiles that a side of a cell has about, more of them for a label with more than CELLS times as many, and the bytes of
#: a side at most, unless a single tile has more.
CELL, CELLS, CELL_BYTES = 16, 32, 32_000_000
#: Fixed directions along which vectors are ordered, and how finely.
DIRECTIONS, STEP = 3, 0.25


def usable(vector: str) -> Column:
    """Not null, no null, NaN or infinite component, and not all zero."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and a bound on the norm of what they leave out."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    rest = x - scale[:, None] * q
    return q.astype(np.int8), scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-12


def _near(qa, sa, ea, qb, sb, eb, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine may reach the threshold. Products of int8 are whole numbers: exact in float32 up to
    1,040 components, in float64 beyond."""
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    dots = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    dots *= sa[:, None]
    dots *= sb[None, :]
    return np.nonzero(dots + (ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :]) >= threshold - 1e-9)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs that join two trees; `a` in order."""
    tree, kept = np.arange(n), []
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    for s, e in zip(first, np.append(first[1:], len(a)), strict=True):
        x, others = int(a[s]), b[s:e]
        for y in others[tree[others] != tree[x]].tolist():
            if tree[y] != tree[x]:
                tree[tree == tree[y]] = tree[x]
                kept.append((x, y))
    return np.array(kept)


def _tile_rows(df: DataFrame, width: str) -> DataFrame:
    """Vectors packed into tiles: a row each with ids, weights, unit vectors, int8 rows and the ball around them.

    Range partitions by label, length and the places along the directions hold neighbouring vectors; each is cut where
    label or length changes and at TILE rows, so a tile stays small whatever a label's size.
    """
    schema = T.StructType.fromDDL("tile bigint, label string, dim int, n int, ids binary, weights binary, raw binary, q binary, scales binary, errors binary, centre binary, radius double")
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def pack(ids: np.ndarray, weights: np.ndarray, x: np.ndarray, label: str, number: int) -> pa.RecordBatch:
        u = _unit(x)
        q, s, e = quantised(u)
        centre = u.mean(axis=0)
        radius = float(np.sqrt(((u - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9) + 1e-9
        tile = (TaskContext.get().partitionId() << 32) + number
        row = {"tile": tile, "label": label, "dim": x.shape[1], "n": len(ids), "ids": ids.tobytes(), "weights": weights.tobytes(), "raw": x.astype(width).tobytes(), "q": q.tobytes(), "scales": s.tobytes(), "errors": e.tobytes(), "centre": centre.tobytes(), "radius": radius}
        return pa.RecordBatch.from_pylist([row], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        order: tuple | None = None
        numbers = count()
        for batch in batches:
            label, dim = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            change = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                if a == b:
                    continue
                key = (label[a], int(dim[a]))
                if order is not None and key != order:
                    yield from flush(held, order, 0, numbers)
                order = key
                part = batch.slice(a, b - a)
                held.setdefault("ids", []).append(part.column(2).to_numpy())
                held.setdefault("weights", []).append(part.column(3).to_numpy())
                held.setdefault("x", []).append(_matrix(part.column(4)))
                yield from flush(held, order, TILE, numbers)
        if order is not None:
            yield from flush(held, order, 0, numbers)

    def flush(held: dict, key: tuple, keep: int, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        """Whole tiles of what is held; with keep 0 also the rest."""
        if not held or (keep and sum(map(len, held["ids"])) < keep):
            return
        ids, weights, x = (np.concatenate(held[k]) for k in ("ids", "weights", "x"))
        whole = len(ids) // TILE * TILE if keep else len(ids)
        for i in range(0, whole, TILE):
            yield pack(ids[i : min(i + TILE, whole)], weights[i : min(i + TILE, whole)], x[i : min(i + TILE, whole)], key[0], next(numbers))
        held.clear()
        if whole < len(ids):
            held.update(ids=[ids[whole:]], weights=[weights[whole:]], x=[x[whole:]])

    return in_small_batches(df, run, schema)


def _places(vector: str, norm: str) -> list[Column]:
    """Places along fixed directions of +1 and -1, in steps; they only order vectors, so rounding does no harm."""
    out = []
    for k in range(DIRECTIONS):
        dot = F.aggregate(F.transform(F.col(vector), _signed(k)), F.lit(0.0), lambda a, x: a + x)
        out.append(F.floor(dot / F.col(norm) / STEP))
    return out


def _signed(k: int):
    return lambda x, i: F.when(F.pmod(F.xxhash64(F.lit(k), i), F.lit(2)) == 0, x.cast("double")).otherwise(-x.cast("double"))


def find_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per row of `vectors`: the id, `n_links` (other vectors of equal label with cosine >= threshold),
    `component_id` (the smallest id that links reach) and `kept` (it is that id).

    A null label, a vector that is null or all zero or holds a null, NaN or infinite component, and vectors of unequal
    length link with nothing. Equal vectors of a label count as so many links but are compared once. Ids are taken to be
    unique; a repeated row is a vector of its own under the same id. An empty table gives no rows; further columns are
    not read.
    """
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    real = "float" if single else "double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{real}>").alias("v"), F.col(label_col).cast("string").alias("label"))
    good = F.col("label").isNotNull() & usable("v")
    # negative zeros equal zeros
    same = F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.hex(F.when(x == 0, F.lit(0.0).cast(real)).otherwise(x).cast("string")))), 256)
    keyed = written(rows.select("id", F.when(good, F.col("label")).alias("label"), F.when(good, same).alias("same"), F.when(good, F.col("v")).alias("v")), "vectors")
    classes = keyed.where("same IS NOT NULL").groupBy("label", "same").agg(F.min(F.struct("id", "v")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select("label", "same", F.col("first.id").alias("id"), F.col("first.v").alias("v"), "n"), "classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    placed = classes.select("label", F.size("v").alias("dim"), "id", "n", "v", norm.alias("norm")).where("norm > 0")
    placed = placed.select("label", "dim", "id", "n", "v", *[p.alias(f"p{k}") for k, p in enumerate(_places("v", "norm"))])
    spread = placed.repartitionByRange("label", "dim", *[f"p{k}" for k in range(DIRECTIONS)], "id").sortWithinPartitions("label", "dim", *[f"p{k}" for k in range(DIRECTIONS)], "id").select("label", "dim", "id", "n", "v")
    width = "<f4" if single else "<f8"
    tiles = written(_tile_rows(spread, width), "tiles")
    # unit vectors with cosine >= t are at most sqrt(2 - 2t) apart
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    keys = tiles.select("tile", "label", "dim")
    sizes = keys.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("tiles"))
    most = F.floor(F.lit(CELL_BYTES) / (F.col("dim") * TILE * (1 + np.dtype(width).itemsize)))
    side = F.greatest(F.lit(1), F.least(most, F.greatest(F.lit(CELL), F.ceil(F.col("tiles") / CELLS))))
    dealt = keys.join(sizes, ["label", "dim"]).withColumn("sides", F.ceil(F.col("tiles") / side)).withColumn("own", F.pmod(F.xxhash64("tile"), "sides"))
    # a cell of the upper triangle: its row of tiles is held, its column of tiles goes by; on the diagonal they are the same
    cells = dealt.select("tile", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides") - 1)).alias("other"))
    cells = cells.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("other") < F.col("own")).cast("int").alias("by"))
    work = cells.join(tiles, "tile").repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "by", "tile")

    def opened(r: dict) -> dict:
        kinds = {"ids": "<i8", "weights": "<i8", "raw": width, "q": "i1", "scales": "<f8", "errors": "<f8", "centre": "<f8"}
        return {c: np.frombuffer(r[c], t).reshape((-1, r["dim"]) if c in ("raw", "q") else -1) for c, t in kinds.items()} | {"radius": r["radius"], "tile": r["tile"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if cell != (cell := (r["label"], r["dim"], r["i"], r["j"])):
                    held = []
                tile = opened(r)
                if not r["by"]:
                    held.append(tile)
                if r["by"] or r["i"] == r["j"]:
                    for other in held:
                        if np.sqrt(((other["centre"] - tile["centre"]) ** 2).sum()) <= other["radius"] + tile["radius"] + reach:
                            yield from product(other, tile)

    def product(a: dict, b: dict) -> Iterator[pa.RecordBatch]:
        own = a["tile"] == b["tile"]
        i, j = _near(a["q"], a["scales"], a["errors"], b["q"], b["scales"], b["errors"], threshold)
        if own:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        unit = [_unit(x["raw"].astype(np.float64)) for x in (a, b)]
        linked = np.concatenate([np.einsum("ij,ij->i", unit[0][i[k : k + 65536]], unit[1][j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)])
        i, j = i[linked], j[linked]
        if not len(i):
            return
        shift = 0 if own else len(a["ids"])
        every, heavy = (a["ids"], a["weights"]) if own else (np.concatenate([a[c], b[c]]) for c in ("ids", "weights"))
        from_, to = i, j + shift
        n = np.bincount(from_, weights=heavy[to], minlength=len(every)) + np.bincount(to, weights=heavy[from_], minlength=len(every))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(every[some]), pa.array([None] * len(some), pa.int64()), pa.array(n[some].astype(np.int64))], names=["a", "b", "n"])
        kept = _forest(len(every), from_, to)
        yield pa.RecordBatch.from_arrays([pa.array(every[kept[:, 0]]), pa.array(every[kept[:, 1]]), pa.array([None] * len(kept), pa.int64())], names=["a", "b", "n"])

    found = written(in_small_batches(work.select("label", "dim", "i", "j", "by", "tile", "ids", "weights", "raw", "q", "scales", "errors", "centre", "radius"), run, "a bigint, b bigint, n bigint"), "links")
    drop_written(tiles)
    groups = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "g_id")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("l_id")).agg(F.sum("n").alias("others"))
    classes = classes.select(F.col("label").alias("c_label"), F.col("same").alias("c_same"), F.col("id").alias("c_id"), F.col("n").alias("c_n"))
    classes = classes.join(counts, F.col("c_id") == F.col("l_id"), "left").join(groups, F.col("c_id") == F.col("g_id"), "left").select("c_label", "c_same", "c_n", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "c_id").alias("component"))
    out = keyed.select("id", "label", "same").join(classes, (F.col("label") == F.col("c_label")) & (F.col("same") == F.col("c_same")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("others") + F.col("c_n") - 1, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
