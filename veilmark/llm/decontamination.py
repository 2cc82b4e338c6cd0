"""Benchmark decontamination by spaced-seed hashing.

A mask reads some of a few neighbouring words and ignores the rest, so a substituted word spoils only the seeds that
read it. Seeds of the benchmark's items and seeds of the documents are joined by their hash; each hit fixes how a
document and an item would lie on each other, and there the words are compared one by one: the longest stretch whose
words agree in the share asked for counts as a leak when enough of them do. An item too short for the masks has masks of
its own, one for each choice of words that suffices.

Seeds, items and leaks are tables: nothing of the benchmark passes through the driver but which short lengths occur. A
filter of fixed size over the benchmark's seeds keeps all other seeds of the documents out of the join. Equal texts are
searched once, and only texts that hold a seed meet the items' words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_filter, in_small_batches, map_slices, passes, set_aside, with_few, written
from .words import PUNCTUATION, U, mix, words

#: 1: the word counts, 0: any word. Five words each; together they hit every stretch of nine words or more in which a
#: fifth of the words are substituted, wherever these are, as the tests try out.
MASKS = ("11111", "111011", "11001011")
#: Items of fewer words have masks of their own.
SHORT = 8


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place at which the whole mask fits."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out + hashes[k : k + n]) * U(0xD6E8FEB86659FD93)
            out ^= out >> U(32)
    return mix(out)


def enough(size: int, least: int, share: float) -> int:
    """How many words of an item must agree."""
    return max(1, min(least, math.ceil(_fraction(share) * size)))


def _fraction(share: float) -> Fraction:
    return Fraction(share).limit_denominator(10**6)


def short_masks(size: int, need: int) -> list[tuple[str, int]]:
    """(mask, its place in the item) for each choice of `need` of an item's `size` words."""
    return [("".join("01"[k in c] for k in range(c[0], c[-1] + 1)), c[0]) for c in combinations(range(size), need)]


def masks_of(size: int, least: int, share: float) -> list[tuple[str, int | None]]:
    """(mask, its place in an item of that many words; None: every place) of an item's seeds."""
    if size < SHORT:
        return list(short_masks(size, enough(size, least, share))) if size else []
    return [(m, None) for m in MASKS]


def item_seeds(hashes: np.ndarray, least: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(seed, its first word's place) of an item."""
    found, place = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for mask, at in masks_of(len(hashes), least, share):
        s = seeds(hashes, mask)
        here = np.arange(len(s)) if at is None else np.array([at])
        found.append(s[here])
        place.append(here)
    return np.concatenate(found), np.concatenate(place)


def best_stretch(same: np.ndarray, share: float = 0.8) -> tuple[int, int, int]:
    """(words that agree, start, end) of the longest stretch of which `share` agrees, without words at its ends that don't.

    No other stretch with that share has more agreeing words: each could grow to the length at which its agreeing words
    are just the share, or over all.
    """
    part = _fraction(share)
    sums = np.concatenate([[0], np.cumsum(np.where(same, part.denominator - part.numerator, -part.numerator))])
    low = np.minimum.accumulate(sums)
    starts = np.searchsorted(-low, -sums, "left")  # the first place with a sum that is no greater
    end = int(np.argmax(np.arange(len(sums)) - starts))
    start = int(starts[end])
    agree = np.flatnonzero(same[start:end])
    return (len(agree), start + int(agree[0]), start + int(agree[-1]) + 1) if len(agree) else (0, 0, 0)


def leak_at(text: np.ndarray, item: np.ndarray, shift: int, least: int, share: float) -> tuple[int, int, int] | None:
    """(start, end, words that agree) of the leak where the item's first word lies on the text's word `shift`."""
    begin, end = max(0, -shift), min(len(item), len(text) - shift)
    agree, i, j = best_stretch(text[begin + shift : end + shift] == item[begin:end], share)
    return (begin + shift + i, begin + shift + j, agree) if agree >= enough(len(item), least, share) else None


def leaks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, least: int, share: float) -> DataFrame:
    """A row (v_one, v_two, leaks) for each text of `docs` (v_one, v_two, v_text) that holds leaks."""
    spark = docs.sparkSession
    raw = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    raw = raw.withColumn("key", F.xxhash64("item", "text")).dropDuplicates(["item", "text"])

    def items_(part: pa.RecordBatch) -> dict:
        hashes, at, *_ = words(part.column(1), PUNCTUATION)
        own = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return {"item": part.column(0), "key": part.column(2), "n": pa.array(np.diff(at), pa.int64()), "item_words": pa.array(own, pa.binary())}

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed, place = item_seeds(np.frombuffer(own, "<u8"), least, share)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(seed), key)), pa.array(place, pa.int32())], names=["seed", "key", "place"])

    items = written(map_slices(raw, "text", "item string, key bigint, n bigint, item_words binary", items_).where("n > 0"), "items")
    seeds_ = written(in_small_batches(items.select("key", "item_words"), seeded, "seed bigint, key bigint, place int"), "seeds")
    sizes = [r["n"] for r in items.where(F.col("n") < SHORT).select("n").distinct().collect()]  # SHORT rows at most
    masks = list(dict.fromkeys([*MASKS, *[m for n in sorted(sizes) for m, _ in masks_of(n, least, share)]]))
    wanted = spark.sparkContext.broadcast(hash_filter(seeds_.select("seed")))  # 2^FILTER_BITS bits

    def hits(part: pa.RecordBatch) -> dict:
        hashes, at, *_ = words(part.column(2), PUNCTUATION)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        found, where = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        for mask in masks:
            s = seeds(hashes, mask)
            here = np.flatnonzero(passes(wanted.value, s))
            here = here[text[here] == text[here + len(mask) - 1]]
            found.append(s[here])
            where.append(here)
        seed, here = np.concatenate(found), np.concatenate(where)
        of = text[here]
        rows = pa.array(of)
        return {"v_one": part.column(0).take(rows), "v_two": part.column(1).take(rows), "seed": pa.array(seed.view(np.int64)), "at": pa.array(here - at[of], pa.int32())}

    found = map_slices(docs, "v_text", "v_one bigint, v_two bigint, seed bigint, at int", hits)
    # a text's places in an item: as many as both have words, however often a seed occurs in them
    lying = found.join(seeds_, "seed").groupBy("v_one", "v_two", "key").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    lying = written(lying, "lying")
    texts = with_few(docs, lying.select("v_one", "v_two").distinct().withColumn("some", F.lit(True)), ["v_one", "v_two"]).where("some").dropDuplicates(["v_one", "v_two"])
    pairs = lying.join(items.select("key", "item", "item_words"), "key").join(texts, ["v_one", "v_two"]).select("v_one", "v_two", "v_text", "item", "item_words", "shifts")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if (r["v_one"], r["v_two"]) != last:
                    last, own = (r["v_one"], r["v_two"]), words(pa.array([r["v_text"]], pa.string()), PUNCTUATION)[0]
                item = np.frombuffer(r["item_words"], "<u8")
                for shift in r["shifts"]:
                    if leak := leak_at(own, item, shift, least, share):
                        rows.append((*last, r["item"], *leak))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["v_one", "v_two", "item", "start", "end", "agree"])

    compared_ = in_small_batches(pairs, compared, "v_one bigint, v_two bigint, item string, start bigint, end bigint, agree bigint")
    return written(compared_.groupBy("v_one", "v_two").agg(F.sort_array(F.collect_set(F.struct("item", "start", "end", "agree"))).alias("leaks")), "leaks")


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 8, share: float = 0.8) -> DataFrame:
    """`docs` with `leaks`, the stretches (item, start and end word, words that agree) that each text shares with items.

    A stretch is a leak where at least `least` words agree, or `share` of a shorter item, and they are at least `share`
    of the stretch. Words are runs of letters and digits, ASCII letters in either case. Null and empty texts and items
    hold nothing, an item repeated with its id and text counts once, repeated rows stay repeated, an empty table on
    either side gives no leaks, texts are read whole however long, and a column `leaks` is replaced.
    """
    docs, back = set_aside(docs.drop("leaks"), ("v_",), (text_col,))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({"v_one": F.xxhash64(text), "v_two": F.xxhash64(F.lit(1), text)})
    found = leaks(keyed.select("v_one", "v_two", text.alias("v_text")), benchmark, item_col, item_text, least, share)
    out = with_few(keyed, found, ["v_one", "v_two"])
    return out.withColumn("leaks", F.coalesce("leaks", F.array().cast(found.schema["leaks"].dataType))).drop("v_one", "v_two").withColumnsRenamed(back)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: the id, `contaminated`, and `leaks` as in with_leaks; further columns are not read."""
    found = with_leaks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, **options)
    return found.select(F.col("id").alias(id_col), (F.size("leaks") > 0).alias("contaminated"), "leaks")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose text holds no leak."""
    return with_leaks(docs, benchmark, text_col, **options).where(F.size("leaks") == 0).select(*docs.columns)
