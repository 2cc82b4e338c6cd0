"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Texts become sets of word shingles. Equal sets are one class. Classes that may be similar are brought together by a
pigeonhole: with the shingles' hash range cut into m parts, sets of a similarity of t or more differ in at most d parts,
so of any fixed order of parts they share one among the first d + 1 of either. Parts that two sets have are found by one
combinable aggregation; a filter of fixed size over them lets only postings that may be shared into the join. Sets that
share such a part, directly or through others, form a group; sets of different groups can't be similar. Within a group,
cut into blocks of bounded size, every set is a query against inverted lists: short lists are merged by counting, the few
longest are only probed by binary search for what the short ones leave, and what reaches the required overlap is linked.
Blocks report a spanning forest of their links, so a group of copies never becomes all its pairs.

A group of many blocks is first searched within each block and against its first block, which takes as many searches as
it has blocks. Two blocks whose members are all one component by then have nothing left to join and are not compared;
only the others meet one another.

All comparisons are of 64-bit hashes of shingles, whole numbers, and exact on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, hash_filter, in_small_batches, map_slices, passes, settings, slices, written
from .components import components
from .words import U, mix, shingles, words

#: Sizes whose ratio is less than this share the number of parts.
RATIO = 1.5
#: Shingles in a block of sets.
BLOCK = 200_000
#: Spark's own filter of joins at run time, of a megabyte whatever the input: texts that are in no group stay where they
#: are. By default Spark leaves it out for scans under 10 GB.
RUNTIME_FILTER = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1m"}
#: Sets that a task remembers to let copies speak once.
SEEN = 100_000


def differ(largest: int, hundredths: int) -> int:
    """The most elements in which two sets of at most that size differ if their similarity is hundredths / 100 or more."""
    return 2 * largest * (100 - hundredths) // (100 + hundredths)


def band(n: int) -> int:
    """Bands of sizes: band b holds the sizes from edge(b) up to and without edge(b + 1)."""
    b = int(np.log(max(n, 1)) / np.log(RATIO))
    while edge(b + 1) <= n:
        b += 1
    while edge(b) > n:
        b -= 1
    return b


def edge(b: int) -> int:
    return int(np.ceil(RATIO**b)) if b > 0 else 1


def signatures(s: np.ndarray, hundredths: int) -> np.ndarray:
    """What a sorted set shares with every similar set: the hashes of its fullest parts, one more than it can differ in,
    for its own band of sizes and for the next one where a similar set may lie there. Parts are ordered by their size, then their hash; an empty
    part is last and counts like others, so sets with few filled parts lose nothing."""
    n = len(s)
    if not n:
        return np.empty(0, dtype=np.uint64)
    out = []
    mixed = mix(s)
    b = band(n)
    for c in range(b, band(n * 100 // hundredths) + 1):
        top = edge(c + 1) - 1
        d = differ(top, hundredths)  # fixes the parts of the band; what this set itself can differ by, its share of them
        own = (n + min(top, n * 100 // hundredths)) * (100 - hundredths) // (100 + hundredths)
        m = d + 1 + (d + 1) * 3 // 10 + (4 if d else 0)
        part = ((s >> U(32)) * U(m)) >> U(32)
        size = np.bincount(part.astype(np.int64), minlength=m)
        total = np.zeros(m, dtype=np.uint64)
        first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        total[part[first].astype(np.int64)] = np.add.reduceat(mixed, first)
        h = mix(total + np.arange(m, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(c * 0x66D9FD93) + size.astype(np.uint64))
        order = np.lexsort((h, -size))[: own + 1]
        out.append(h[order])
    return np.concatenate(out)


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set; the first also names it while groups are found."""
    return (int(np.bitwise_xor.reduce(mix(s))), int(np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D))))) if len(s) else (0, 0)


def search(query: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, hundredths: int) -> np.ndarray:
    """The indexed sets whose similarity to the query is hundredths / 100 or more, by DivideSkip.

    `lists`: the distinct elements, where each one's inverted list begins (and the end), and the lists, each sorted.
    """
    elements, start, owners = lists
    place = np.minimum(np.searchsorted(elements, query), len(elements) - 1)
    place = place[elements[place] == query]
    least = -(-hundredths * len(query) // 100)
    if len(place) < least:
        return np.empty(0, dtype=np.int64)
    length = start[place + 1] - start[place]
    place = place[np.argsort(length, kind="stable")]
    length = np.sort(length)
    long = min(least - 1, int(least / (np.log2(max(2, int(length[-1]))) + 1)))
    short = place[: len(place) - long]
    n = length[: len(short)]
    at = np.repeat(start[short] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    counts = np.bincount(owners[at], minlength=len(sizes))
    found = np.flatnonzero(counts >= least - long)
    for p in place[len(short) :]:
        if not len(found):
            break
        row = owners[start[p] : start[p + 1]]
        k = np.minimum(np.searchsorted(row, found), len(row) - 1)
        counts[found] += row[k] == found
    both = counts[found]
    return found[100 * both >= hundredths * (len(query) + sizes[found] - both)]


def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1])
    return flat[first], np.append(first, len(flat)), owner


def links(a: list[np.ndarray], b: list[np.ndarray] | None, hundredths: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within `a`, or between `a` and `b`, whose numbers follow those of `a`."""
    index = a if b is None else b
    lists, sizes = inverted(index), np.array([len(s) for s in index])
    shift = 0 if b is None else len(a)
    tree, trees, kept = np.arange(len(a) + (len(b) if b is not None else 0)), len(a) + (len(b) if b is not None else 0), []
    for i, s in enumerate(a):
        if trees == 1:
            break
        found = search(s, lists, sizes, hundredths) + shift
        for j in found[tree[found] != tree[i]].tolist():
            if tree[j] != tree[i]:
                tree[tree == tree[j]] = tree[i]
                trees -= 1
                kept.append((i, j))
    return kept


def _blocks(sets: DataFrame) -> DataFrame:
    """Sets in the order of group and size, packed into rows of BLOCK shingles or one larger set."""

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        groups = [r[0] for r in rows]
        own = {"block": f"{groups[0]}:{rows[0][1]}:{rows[0][2]}", "first": groups[0], "last": groups[-1], "groups": np.array(groups, "<i8").tobytes(), "ids": np.array([r[2] for r in rows], "<i8").tobytes(), "sizes": np.array([r[1] for r in rows], "<i8").tobytes(), "sets": b"".join(r[3] for r in rows)}
        for side, g in (("first", groups[0]), ("last", groups[-1])):
            n = [r[1] for r in rows if r[0] == g]
            own |= {f"{side}_low": n[0], f"{side}_high": n[-1]}
        return pa.RecordBatch.from_pylist([own], schema=schema)

    schema = pa.schema([("block", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("first_low", pa.int64()), ("first_high", pa.int64()), ("last_low", pa.int64()), ("last_high", pa.int64()), ("groups", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("sets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a block ends where it is full, or where a group ends and it is half full: few groups lie across
                if held and (size + row[1] > BLOCK or (2 * size > BLOCK and row[0] != held[-1][0])):
                    yield pack(held)
                    held, size = [], 0
                held.append(row)
                size += row[1]
        if held:
            yield pack(held)

    ordered = sets.select("group", "n", "id", "set").repartitionByRange("group", "n", "id").sortWithinPartitions("group", "n", "id")
    return in_small_batches(ordered, run, "block string, first bigint, last bigint, first_low bigint, first_high bigint, last_low bigint, last_high bigint, groups binary, ids binary, sizes binary, sets binary")


def _open(r: dict, p: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    groups, ids, sizes = (np.frombuffer(r[f"{p}{c}"], "<i8") for c in ("groups", "ids", "sizes"))
    return groups, ids, np.split(np.frombuffer(r[f"{p}sets"], "<u8"), np.cumsum(sizes)[:-1])


def _edges(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, hundredths: int = 80) -> DataFrame:
    """One row per row of `docs`: the id, `n_shingles` and `component_id`, the smallest id that links reach.

    Words are runs of other characters than space and 0x09-0x0D, ASCII letters in either case; a set holds the distinct
    runs of `n` words, of a shorter text all its words as one. Sets link when 100 * intersection >= hundredths * union.
    A null text or one without words has an empty set and links with nothing; a null id keeps a null component and links
    with nothing. Rows that repeat an id count as one document with several texts, and their rows share a component.
    An empty table gives no rows; further columns are not read.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def profile(part: pa.RecordBatch) -> dict:
        hashes, at, *_ = words(part.column(1))
        sets = shingles(hashes, at, n)
        one, two = np.array([identity(s) for s in sets], dtype=np.uint64).reshape(-1, 2).T.copy()
        return {"id": part.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64))}

    def parts(shared):
        """(part, id) of each set; with a filter only the parts that pass it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # copies in a task speak once
            for batch in batches:
                for piece in slices(batch, "text"):
                    hashes, at, *_ = words(piece.column(1))
                    found, keys = [], []
                    for s in shingles(hashes, at, n):
                        one, two = identity(s)
                        if len(s) and one not in seen:
                            seen.add(one)
                            part = signatures(s, hundredths)
                            found.append(part if shared is None else part[passes(shared.value, part)])
                            keys.append(one)
                    if len(seen) > SEEN:
                        seen.clear()
                    if found:
                        count = [len(x) for x in found]
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(keys, dtype=np.uint64), count).view(np.int64))], names=["part", "id"])

        return in_small_batches(base.where("id IS NOT NULL"), run, "part bigint, id bigint")

    profiles = written(map_slices(base, "text", "id bigint, n bigint, one bigint, two bigint", profile), "profiles")
    classes = profiles.where("n > 0 AND id IS NOT NULL").groupBy("one", "two", "n").agg(F.min("id").alias("rep"))
    classes = classes.select(F.col("one").alias("c_one"), F.col("two").alias("c_two"), F.col("n").alias("c_n"), "rep")
    # every set with the first set that has the same part
    shared = parts(None).groupBy("part").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last")
    shared = written(shared.select("part", "pivot"), "shared")
    some = docs.sparkSession.sparkContext.broadcast(hash_filter(shared.select("part")))  # 2^FILTER_BITS bits
    stars = parts(some).join(shared, "part").where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    groups = components(stars)
    drop_written(shared)
    members = groups.select(F.col("id").alias("g_one"), F.col("component").alias("group")).join(classes, F.col("g_one") == F.col("c_one"))
    groups = written(members.select(F.col("rep").alias("g_id"), F.col("c_n").alias("g_n"), "group"), "groups")

    def whole(part: pa.RecordBatch) -> dict:
        hashes, at, *_ = words(part.column(1))
        sets = shingles(hashes, at, n)
        return {"id": part.column(0), "group": part.column(2), "n": pa.array([len(s) for s in sets], pa.int64()), "set": pa.array([s.tobytes() for s in sets], pa.binary())}

    # the condition on g_n always holds; Spark makes the filter only from a side that has one
    near = base.join(groups.where("g_n > 0"), F.col("id") == F.col("g_id")).select("id", "text", "group")
    with settings(docs.sparkSession, RUNTIME_FILTER):
        blocks = written(_blocks(map_slices(near, "text", "id bigint, group bigint, n bigint, set binary", whole).where("n > 0")), "blocks")
    drop_written(groups)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                of, ids, sets = _open(r, "")
                bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                found = [(x + a, y + a) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1 for x, y in links(sets[a:b], None, hundredths)]
                yield _edges(ids, found)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (of_a, ids_a, a), (of_b, ids_b, b) = _open(r, "a_"), _open(r, "b_")
                i, j = np.flatnonzero(of_a == r["group"]), np.flatnonzero(of_b == r["group"])
                yield _edges(np.concatenate([ids_a[i], ids_b[j]]), links([a[k] for k in i], [b[k] for k in j], hundredths))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the groups that go on in other blocks, where each member is."""
        for batch in batches:
            for r in batch.to_pylist():
                of, ids = np.frombuffer(r["groups"], "<i8"), np.frombuffer(r["ids"], "<i8")
                at = np.flatnonzero((of == r["first"]) | (of == r["last"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(at), pa.string()), pa.array(of[at]), pa.array(ids[at])], names=["m_block", "m_group", "m_id"])

    inner = in_small_batches(blocks.select("groups", "ids", "sizes", "sets"), within, "a bigint, b bigint")
    # a group that goes on in another block is the first or the last of both
    ends = blocks.select("block", F.explode(F.array_distinct(F.array(*[F.struct(F.col(x).alias("group"), F.col(f"{x}_low").alias("low"), F.col(f"{x}_high").alias("high")) for x in ("first", "last")]))).alias("e")).select("block", "e.*")
    spread = ends.groupBy(F.col("group").alias("s_group")).agg(F.min(F.struct("low", "block")).alias("lead"), F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    spread = written(ends.join(spread, F.col("group") == F.col("s_group")).select("block", "group", "low", "high", F.col("lead.block").alias("lead")), "spread")
    side = lambda rows, p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    fits = (F.col("x_high") * 100 >= F.col("y_low") * hundredths) & (F.col("y_high") * 100 >= F.col("x_low") * hundredths)
    full = lambda p: side(blocks.select("block", "groups", "ids", "sizes", "sets"), p)

    def searched(pairs: DataFrame) -> DataFrame:
        met = pairs.select("x_block", "y_block", F.col("x_group").alias("group")).join(full("a"), F.col("x_block") == F.col("a_block")).join(full("b"), F.col("y_block") == F.col("b_block"))
        return in_small_batches(met, across, "a bigint, b bigint")

    if spread.isEmpty():
        linked = components(inner)
    else:
        first = side(spread.where("block = lead"), "x").join(side(spread.where("block <> lead"), "y"), (F.col("x_group") == F.col("y_group")) & fits)
        linked = components(inner.union(searched(first)))
        inside = in_small_batches(blocks.select("block", "first", "last", "groups", "ids"), members, "m_block string, m_group bigint, m_id bigint")
        inside = inside.join(linked, F.col("m_id") == F.col("id"), "left").withColumn("now", F.coalesce("component", "m_id"))
        state = inside.groupBy(F.col("m_block").alias("block"), F.col("m_group").alias("group")).agg(F.min("now").alias("least"), F.max("now").alias("most"))
        rest = written(spread.where("block <> lead").join(state, ["block", "group"]), "rest")
        settled = (F.col("x_least") == F.col("x_most")) & (F.col("y_least") == F.col("y_most")) & (F.col("x_least") == F.col("y_least"))
        open_ = written(side(rest, "x").join(side(rest, "y"), (F.col("x_group") == F.col("y_group")) & (F.col("x_block") < F.col("y_block")) & fits & ~settled).select("x_block", "y_block", "x_group"), "open")
        if not open_.isEmpty():
            linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(searched(open_)))
    drop_written(blocks)
    linked = linked.select(F.col("id").alias("l_id"), "component")
    found = classes.select("c_one", "c_two", "c_n", "rep").join(linked, F.col("rep") == F.col("l_id"), "left").select("c_one", "c_two", "c_n", F.coalesce("component", "rep").alias("component"))
    out = profiles.select("id", "n", "one", "two").join(found, (F.col("one") == F.col("c_one")) & (F.col("two") == F.col("c_two")) & (F.col("n") == F.col("c_n")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
