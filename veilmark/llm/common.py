"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python helper turns into arrays at once; one longer text makes a larger slice.
SLICE_BYTES = 500_000
#: Bytes of an Arrow batch between Spark and a Python worker, which holds several copies of it; a longer row is a batch.
BATCH_BYTES = "4m"
#: Bits of a filter over hashes.
FILTER_BITS = 24


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veilmark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a copy in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: compressed, column by column, and safe from a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veilmark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table of written() that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is written inside; the former ones come back."""
    former = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in former.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def in_small_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches bounded in bytes. Plans read the bound when they run, so it stays set for the session."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(work, schema)


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits over the only column, a bigint of hash values: a value that is in it always passes, any other
    rarely as long as they are fewer than the bits. Its size never grows; fuller filters only let more rows pass."""
    low = F.pmod(F.col(hashes.columns[0]), F.lit(1 << FILTER_BITS))
    words = hashes.select(F.shiftright(low, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (low % 64).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^FILTER_BITS / 64 rows at most
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    low = hashes.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def with_few(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """`df` left-joined with a table that has rows for few of its keys, the first of them a hash; `few` has a row a key.

    Only rows whose key may be in `few` go into the join, by a filter of fixed size; the others stay where they are.
    """
    bits = df.sparkSession.sparkContext.broadcast(hash_filter(few.select(keys[0])))  # 2^FILTER_BITS bits
    at = df.columns.index(keys[0])

    def rows(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                maybe = passes(bits.value, batch.column(at).to_numpy())
                yield batch.filter(pa.array(maybe if inside else ~maybe))

        return in_small_batches(df, run, df.schema)

    added = [f for f in few.schema if f.name not in keys]
    return rows(True).join(few, keys, "left").select(*df.columns, *[f.name for f in added]).unionByName(rows(False).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}))


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that no model learns from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chosen(df: DataFrame, key: Column, label: str, bound: int, seed: int) -> DataFrame:
    """About `bound` rows, spread evenly over the values of `label`; the choice hangs on the key and the seed alone.

    A classifier may be fitted on a bounded sample; this is the only use. Rows without a label are left out.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return df.limit(0)
    share, left = {}, bound
    for i, (value, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        take = min(n, left // (len(counts) - i))
        left -= take
        share[value] = take / n
    point = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)).cast("double") / float(1 << 30)
    limit = F.lit(0.0)
    for value, part in share.items():
        limit = F.when(F.col(label) == F.lit(value), F.lit(float(part))).otherwise(limit)
    return df.where(F.col(label).isNotNull() & (point < limit))


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about `size` bytes of text each; rows stay whole."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def add_columns(df: DataFrame, text: str, added: T.StructType | str, work: Callable[[pa.Array], dict], size: int = SLICE_BYTES) -> DataFrame:
    """`df` with further columns that `work` makes of its text column, row by row and in place."""
    more = added if isinstance(added, T.StructType) else T.StructType.fromDDL(added)
    if clash := {f.name for f in more} & {*df.columns}:
        df = df.drop(*clash)
    names, own = df.columns, "v_text"
    while own in names:
        own += "_"
    inner = df.withColumn(own, F.col(text).cast("string"))

    def all_columns(part: pa.RecordBatch) -> dict:
        return {n: part.column(i) for i, n in enumerate(names)} | work(part.column(len(names)))

    return map_slices(inner, own, T.StructType([*df.schema.fields, *more.fields]), all_columns, size)


def set_aside(df: DataFrame, prefixes: tuple[str, ...], needed: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns out of the way whose names an operator uses for itself, and how to rename them back."""
    names = {c: f"aside_{i}" for i, c in enumerate(df.columns) if c.startswith(prefixes) and c not in needed}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def map_slices(df: DataFrame, text: str, schema: T.StructType | str, work: Callable[[pa.RecordBatch], dict | None], size: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices; `work` returns the columns of the result by name."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, size):
                made = work(part)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) and x.type == f.type else pa.array(x, type=f.type) for f in out], schema=out)

    return in_small_batches(df, run, kind)
