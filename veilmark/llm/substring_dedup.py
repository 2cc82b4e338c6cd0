"""Substring dedup: runs of consecutive sentences that other documents, or earlier places, have too are removed.

A sentence ends at a full stop, exclamation or question mark before white space, or at a line feed. A word that is
MARGIN words or more away from both ends of its sentence ends a part of it where its hash is the least of the NEAR words
on either side of it, so that a passage is cut alike wherever it stands, but for a few words at its ends. From each
sentence or part on, the run of `run` of them, longer where the words are few, is hashed.

One aggregation over all runs finds the hashes that occur more than once; a filter of fixed size over them lets a second
pass over the texts send only runs that may be repeated into the join. A run's first place keeps it, and the sentences of
all its other places go. Only texts that lose something meet the list of what they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_filter, in_small_batches, map_slices, passes, written
from .words import U, mix, words

#: Words at a sentence's ends that end no part, and on how many words to either side of it one that does is the least.
MARGIN, NEAR = 6, 4
_NEVER = np.iinfo(np.uint64).max


def least_nearby(keys: np.ndarray, near: int) -> np.ndarray:
    """True where a key is the least of itself and the `near` keys on either side; the largest number never is."""
    edge = np.full(near, _NEVER)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, keys, edge]), 2 * near + 1)
    return (around.min(axis=1) == keys) & (keys != _NEVER)


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words, first word of each sentence and the end, first sentence of each text and the end, bytes,
    first byte of each word)."""
    hashes, at, data, first, last = words(column)
    n = len(hashes)
    if not n:
        return hashes, np.zeros(1, dtype=np.int64), np.zeros(len(at), dtype=np.int64), data, first
    end = np.isin(data[last - 1], np.frombuffer(b".!?", np.uint8))
    # a line feed among the bytes up to the next word
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    until = np.append(first[1:], len(data))
    end |= feeds[until] > feeds[last]
    end[at[1:][at[1:] > 0] - 1] = True

    def starts(end: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(end) + 1])

    s = starts(end)
    size = np.diff(s)
    place = np.arange(n) - np.repeat(s[:-1], size)
    apart = (place >= MARGIN - 1) & (np.repeat(size, size) - place > MARGIN)
    s = starts(end | least_nearby(np.where(apart, mix(hashes), _NEVER), NEAR))
    return hashes, s, np.searchsorted(s, at), data, first


def runs(hashes: np.ndarray, s: np.ndarray, of: np.ndarray, run: int, least: int, lengthen: bool = False) -> tuple[np.ndarray, ...]:
    """(text, number of the first sentence in it, how many sentences, hash) of each run, of `least` words at least.

    From each sentence on `run` of them, or with `lengthen` the fewest from there on, `run` at least, that have the words.
    A text of fewer sentences is one run; so are the shorter runs of all texts, which count only where they are a whole
    text: their size is negative.
    """
    total = len(s) - 1
    if total < 1:
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.uint64),)
    # order within a sentence counts: words are weighted by powers of an odd number
    place = np.arange(len(hashes)) - np.repeat(s[:-1], np.diff(s))
    power = np.full(int(np.diff(s).max()) + 1, U(0x9E3779B97F4A7C15))
    power[0] = 1
    each = mix(np.add.reduceat(hashes * np.multiply.accumulate(power)[place], s[:-1]) + np.diff(s).astype(np.uint64))
    count = np.diff(of)
    text = np.repeat(np.arange(len(count)), count)
    number = np.arange(total)
    on = np.maximum(np.searchsorted(s, s[:-1] + least), number + run)  # where the run from here on ends
    if not lengthen:
        on[on > number + run] = total + 1
    fits = on <= of[text + 1]
    begin, end = [number[fits]], [on[fits]]
    for k in range(1, run):
        fits = (number + k <= of[text + 1]) & (s[np.minimum(number + k, total)] - s[:-1] >= least)
        begin.append(number[fits])
        end.append(number[fits] + k)
    begin, end = np.concatenate(begin), np.concatenate(end)
    length, text = end - begin, text[begin]
    h = length.astype(np.uint64)
    for k in range(int(length.max(initial=0))):
        more = np.flatnonzero(k < length)
        h[more] = mix((h[more] + each[begin[more] + k]) * U(0xD6E8FEB86659FD93))
    size = np.where((length >= run) | (length == count[text]), length, -length)
    return text, begin - of[text], size, h


def without(raw: bytes, bounds: np.ndarray, gone: np.ndarray) -> bytes:
    """A text without the sentences of which `gone` is true; `bounds` are their first bytes, counted from the first's."""
    lead = len(raw) - len(raw.lstrip(b" \t\n\v\f\r"))
    bounds = np.append(bounds + lead, len(raw))
    return raw[:lead] + b"".join(raw[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(~gone))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, least: int = 12, lengthen: bool = False) -> DataFrame:
    """One row per row of `docs`: the id, `sentences` (how many), `removed` (their numbers) and `kept_text`.

    A run is `run` consecutive sentences of `least` words together (where they have fewer, with `lengthen` as many more
    sentences as it takes, and without it none), or all of a text that has fewer sentences and enough words, wherever
    the same sentences stand; ASCII case doesn't count. The first place of a run is the one of the smallest id, then of
    the smallest hash of the text, then sentence; rows that repeat an id and its text count as one document and lose the
    same, rows that repeat an id with another text are documents of their own. A removed sentence takes the white space
    after it along. A null text stays null and an empty one empty, a null id is compared with nothing, an empty table
    gives no rows, and further columns are not read. Texts are read whole, however long.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("version"))
    known = base.where("id IS NOT NULL")

    def whole_short_texts(part: pa.RecordBatch) -> dict:
        words_, s, of, *_ = sentences(part.column(0))
        _, _, size, h = runs(words_, s, of, run, least)
        return {"hash": pa.array(h[(size > 0) & (size < run)].view(np.int64))}

    short = spark.sparkContext.broadcast(hash_filter(map_slices(known.select("text"), "text", "hash bigint", whole_short_texts)))  # 2^FILTER_BITS bits

    def spans(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        words_, s, of, *_ = sentences(part.column(part.schema.get_field_index("text")))
        found = runs(words_, s, of, run, least, lengthen)
        keep = (found[2] > 0) | passes(short.value, found[3])
        return tuple(x[keep] for x in found)

    def hashed(part: pa.RecordBatch) -> dict:
        _, _, size, h = spans(part)
        return {"hash": pa.array(h.view(np.int64)), "size": pa.array(size, pa.int32())}

    counts = map_slices(known.select("text"), "text", "hash bigint, size int", hashed).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    repeated = written(counts.where("n > 1 AND most > 0").select("hash"), "repeated")
    often = spark.sparkContext.broadcast(hash_filter(repeated))  # 2^FILTER_BITS bits

    def placed(part: pa.RecordBatch) -> dict:
        of, number, size, h = spans(part)
        keep = passes(often.value, h)
        rows = pa.array(of[keep])
        return {"id": part.column(0).take(rows), "version": part.column(2).take(rows), "number": pa.array(number[keep], pa.int32()), "size": pa.array(size[keep], pa.int32()), "hash": pa.array(h[keep].view(np.int64))}

    maybe = map_slices(known, "text", f"id {kind}, version bigint, number int, size int, hash bigint", placed)
    places = written(maybe.join(repeated, "hash"), "places")
    place = F.struct("id", "version", "number")
    # written, so that the join is of two exchanges and a hash with very many places can be split
    first = written(places.groupBy(F.col("hash").alias("f_hash")).agg(F.min(place).alias("first")), "first")
    later = places.join(first, F.col("hash") == F.col("f_hash")).where(place != F.col("first"))
    gone = later.groupBy("id", "version").agg(F.collect_set(F.struct("number", F.abs("size").alias("size"))).alias("starts"))
    gone = written(gone.select(F.col("id").alias("g_id"), F.col("version").alias("g_version"), "starts"), "gone")
    losing = spark.sparkContext.broadcast(hash_filter(gone.select("g_version")))  # 2^FILTER_BITS bits

    def losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(losing.value, batch.column(2).to_numpy())))

    out = f"id {kind}, sentences bigint, removed array<bigint>, kept_text string"

    def whole(part: pa.RecordBatch) -> dict:
        part = part.filter(pa.array(~passes(losing.value, part.column(2).to_numpy())))
        _, _, of, *_ = sentences(part.column(1))
        return {"id": part.column(0), "sentences": pa.array(np.diff(of), pa.int64()), "removed": pa.array([[]] * part.num_rows, pa.list_(pa.int64())), "kept_text": part.column(1).cast(pa.string())}

    def cleaned(part: pa.RecordBatch) -> dict:
        _, s, of, _, first = sentences(part.column(1))
        texts, removed, count = part.column(1).to_pylist(), [], np.diff(of)
        for i, starts in enumerate(part.column(3).to_pylist()):
            edges = np.zeros(int(count[i]) + 1, dtype=np.int64)
            for x in starts or []:
                edges[x["number"]] += 1
                edges[x["number"] + x["size"]] -= 1
            marked = np.cumsum(edges[:-1]) > 0
            removed.append(np.flatnonzero(marked).tolist())
            if marked.any():
                bounds = first[s[of[i] : of[i + 1]]]
                texts[i] = without(texts[i].encode(), bounds - bounds[0], marked).decode()
        return {"id": part.column(0), "sentences": pa.array(count, pa.int64()), "removed": pa.array(removed, pa.list_(pa.int64())), "kept_text": pa.array(texts, pa.string())}

    found = in_small_batches(base, losers, base.schema).join(gone, (F.col("id") == F.col("g_id")) & (F.col("version") == F.col("g_version")), "left").select("id", "text", "version", "starts")
    return map_slices(found, "text", out, cleaned).union(map_slices(base, "text", out, whole)).withColumnRenamed("id", id_col)
