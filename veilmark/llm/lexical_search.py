"""Ranked lexical search with Block-Max WAND over sharded, compressed postings.

Each task turns its own documents into shards: for every term of the queries, postings (document, occurrences) in
document order, packed into blocks of 128 with fixed bit widths. Nothing but counts is gathered: documents, terms and
document frequencies. An impact hangs on these, so a block keeps the pairs of occurrences and length that no other pair in
it beats on both; once the counts are known its largest impact is that of its best pair, and a search moves over blocks
without opening them.

A search of a shard goes through its documents in order. Block ends cut them into stretches in which every term stays in
one block; the sum of the weighted block maxima bounds what a document of the stretch can score (shallow moves), and only
stretches whose bound reaches the least of the best so far have their blocks unpacked and their documents scored. The
least score is raised after each batch of stretches. Ties are kept, so results are exact.

Shards and blocks of queries meet in the cells of a grid; a cell reports at most k rows a query. All scores are 64-bit
integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, hash_filter, in_small_batches, map_slices, passes, slices, written
from .words import PUNCTUATION, words

#: Postings in a block; documents and postings in a shard at most, where one document may add to the latter; queries in a block.
POSTINGS, SHARD_DOCS, SHARD_POSTINGS, QUERIES = 128, 16_384, 2_000_000, 1024
#: Fixed values of the score: a document's length counts for these hundredths, and occurrences saturate with these factors.
LENGTH, SCALE, TIMES, SPREAD = 75, 1_000_000_000, 1000, 8
#: Stretches that are looked at before the least score is raised, at first and at most.
FIRST_BATCH, LAST_BATCH = 32, 4096
#: Numbers in the head of a block: postings, first and last document, place and bit widths of its data, pairs.
HEAD = 7
#: Stands for a missing id, which no document has.
NO_ID = np.iinfo(np.int64).min


def packed(values: np.ndarray) -> tuple[bytes, int]:
    """Non-negative numbers in as many bits each as the largest needs."""
    width = max(1, int(values.max()).bit_length())
    bits = (values[:, None] >> np.arange(width)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), width


def unpacked(data: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.int64) @ (1 << np.arange(width))


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (TIMES * tf + SPREAD * length)


def unbeaten(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pairs (occurrences, length) that no other pair has at least as many occurrences and at most the length of."""
    order = np.lexsort((length, -tf))
    least = np.minimum.accumulate(length[order])
    kept = order[np.concatenate([[True], least[1:] < least[:-1]])]
    return np.column_stack([tf[kept], length[kept]]).astype(np.int64)


def shard_postings(ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, at: np.ndarray, tf: np.ndarray) -> dict:
    """Postings of a shard by term: (term, place of the document, occurrences) packed in blocks; documents by id."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    at = rank[at]
    by = np.lexsort((at, terms))
    terms, at, tf = terms[by], at[by], tf[by]
    names, first, df = np.unique(terms, return_index=True, return_counts=True)
    blobs, offset, heads, pairs = [], 0, [], []
    length = lengths[order]
    for start, n in zip(first.tolist(), df.tolist(), strict=True):
        for a in range(start, start + n, POSTINGS):
            b = min(a + POSTINGS, start + n)
            gaps, wide = packed(np.diff(at[a:b], prepend=at[a]))
            counts, narrow = packed(tf[a:b] - 1)
            best = unbeaten(tf[a:b], length[at[a:b]])
            heads.append((b - a, at[a], at[b - 1], offset, wide, narrow, len(best)))
            pairs.append(best)
            blobs += [gaps, counts]
            offset += len(gaps) + len(counts)
    blocks = np.array(heads, dtype=np.int64).reshape(-1, HEAD)
    return {"ids": ids[order], "lengths": length, "terms": names, "df": df.astype(np.int64), "blocks": blocks, "pairs": np.concatenate(pairs) if pairs else np.empty((0, 2), dtype=np.int64), "data": b"".join(blobs)}


class Shard:
    """The postings of a shard with the largest impact of each block; a block is unpacked when it is first needed."""

    def __init__(self, row: dict, documents: int, terms: int) -> None:
        number = lambda c: np.frombuffer(row[c], dtype=np.int64)
        self.ids, lengths, self.terms, self.df = (number(c) for c in ("ids", "lengths", "terms", "df"))
        self.terms = self.terms.view(np.uint64)
        self.blocks, self.data = number("blocks").reshape(-1, HEAD), np.frombuffer(row["data"], dtype=np.uint8)
        weigh = lambda n: 100 - LENGTH + (LENGTH * n * documents) // max(1, terms)
        self.lengths = weigh(lengths)
        self.first = np.concatenate([[0], np.cumsum(-(-self.df // POSTINGS))])
        pairs = number("pairs").reshape(-1, 2)
        starts = np.cumsum(self.blocks[:, 6]) - self.blocks[:, 6]
        self.most = np.maximum.reduceat(impacts(pairs[:, 0], weigh(pairs[:, 1])), starts) if len(starts) else np.empty(0, dtype=np.int64)
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents of a block and their impacts."""
        n, start, _, offset, wide, narrow, _ = self.blocks[block].tolist()
        middle = offset + (n * wide + 7) // 8
        at = start + np.cumsum(unpacked(self.data[offset:middle], n, wide))
        return at, impacts(unpacked(self.data[middle : middle + (n * narrow + 7) // 8], n, narrow) + 1, self.lengths[at])

    def postings(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if (found := self.opened.get(block)) is None:
            found = self.opened[block] = self.open(block)
        return found


def search(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of a shard that score `least` or more: (places, scores, blocks opened), larger scores first,
    then smaller ids. `weights` holds for each of the distinct `terms` its weight times its repeats."""
    at = np.searchsorted(shard.terms, terms)
    there = (at < len(shard.terms)) & (weights > 0)
    there[there] = shard.terms[at[there]] == terms[there]
    at, weights = at[there], weights[there]
    none = np.empty(0, dtype=np.int64)
    if not len(at):
        return none, none, 0
    lists = [np.arange(shard.first[t], shard.first[t + 1]) for t in at]
    ends = np.unique(np.concatenate([np.concatenate([shard.blocks[b, 1] - 1, shard.blocks[b, 2]]) for b in lists]))
    ends = ends[ends >= 0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    # the block of each term that holds documents of a stretch, and what it can add: shallow moves
    bound = np.zeros(len(ends), dtype=np.int64)
    current = np.full((len(lists), len(ends)), -1)
    for i, (b, w) in enumerate(zip(lists, weights.tolist(), strict=True)):
        place = np.searchsorted(shard.blocks[b, 2], starts)
        inside = place < len(b)
        inside[inside] = shard.blocks[b[place[inside]], 1] <= starts[inside]
        current[i, inside] = b[place[inside]]
        bound[inside] += w * shard.most[current[i, inside]]
    score = np.zeros(len(shard.ids), dtype=np.int64)
    best_at, best = none, none
    opened, size, s = 0, FIRST_BATCH, 0
    while s < len(ends):
        part = np.arange(s, min(s + size, len(ends)))
        s, size = s + size, min(2 * size, LAST_BATCH)
        part = part[bound[part] >= least]
        if not len(part):
            continue
        lo, hi = starts[part], ends[part]
        touched = []
        for i, w in enumerate(weights.tolist()):
            needed = np.unique(current[i, part])
            for b in needed[needed >= 0].tolist():
                docs, parts = shard.postings(b)
                opened += 1
                stretch = np.searchsorted(hi, docs)
                inside = stretch < len(hi)
                inside[inside] = lo[stretch[inside]] <= docs[inside]
                score[docs[inside]] += w * parts[inside]
                touched.append(docs[inside])
        docs = np.unique(np.concatenate(touched)) if touched else none
        found = score[docs]
        score[docs] = 0
        keep = found >= least
        best_at, best = np.concatenate([best_at, docs[keep]]), np.concatenate([best, found[keep]])
        by = np.lexsort((shard.ids[best_at], -best))[:k]
        best_at, best = best_at[by], best[by]
        if len(best) == k:
            least = max(least, int(best[-1]))
    return best_at, best, opened


def _counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, times) of each different word of each row."""
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.empty(0, dtype=np.int64)
    return h[new], row[new], np.diff(np.append(new, len(h)))


def _item_terms(items: DataFrame) -> DataFrame:
    """(number, item, term, times) of items (item, text); a row that repeats both counts once."""
    rows = items.distinct().select("item", F.monotonically_increasing_id().alias("number"), "text")

    def work(part: pa.RecordBatch) -> dict:
        h, at, *_ = words(part.column(2), PUNCTUATION)
        h, row, times = _counted(h, np.repeat(np.arange(part.num_rows), np.diff(at)))
        who = pa.array(row)
        return {"item": part.column(0).take(who), "number": part.column(1).take(who), "term": h.view(np.int64), "times": times}

    return map_slices(rows, "text", rows.select("item", "number").schema.add("term", "long").add("times", "long"), work)


def _shards(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents (id, text) as shards of postings of the wanted terms (a column of hashes), where they are read; the number of
    their documents with terms and of all their terms."""
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(wanted))  # of fixed size
    schema = "shard bigint, documents bigint, n_terms bigint, ids binary, lengths binary, terms binary, df binary, blocks binary, pairs binary, data binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parts = count(), []
        held = postings = 0

        def flush() -> pa.RecordBatch:
            made = shard_postings(*(np.concatenate([p[c] for p in parts]) for c in range(5)))
            row = {"shard": (TaskContext.get().partitionId() << 32) + next(numbers), "documents": len(made["ids"]), "n_terms": int(made["lengths"].sum())}
            row |= {c: x if isinstance(x := made[c], bytes) else x.tobytes() for c in names[3:]}
            parts.clear()
            return pa.RecordBatch.from_pylist([row]).select(names)

        for batch in batches:
            for part in slices(batch, "text"):
                h, at, *_ = words(part.column(1), PUNCTUATION)
                n = np.diff(at)
                some = np.flatnonzero(n)  # documents without terms take no part
                row = np.repeat(np.arange(len(some)), n[some])
                maybe = passes(bits.value, h)
                terms, row, tf = _counted(h[maybe], row[maybe])
                parts.append((part.column(0).fill_null(NO_ID).to_numpy()[some], n[some], terms, row + held, tf))
                held, postings = held + len(some), postings + len(terms)
                if held >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield flush()
                    held = postings = 0
        if held:
            yield flush()

    return in_small_batches(docs, run, schema)


def _frequencies(shards: DataFrame) -> DataFrame:
    """(f_term, df): the documents that hold each term, summed over shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, dtype=np.int64)) for x in (t, n)], names=["f_term", "df"])

    return in_small_batches(shards.select("terms", "df"), run, "f_term bigint, df bigint").groupBy("f_term").agg(F.sum("df").alias("df"))


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Queries (block, number, terms) as rows of at most QUERIES of a block."""
    schema = "block bigint, q_numbers binary, q_starts binary, q_terms binary, q_weights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            numbers, starts = np.array([n for n, _ in held], dtype=np.int64), np.cumsum([0, *[len(t) for _, t in held]])
            flat = np.array([(x["term"], x["weight"]) for _, t in held for x in t], dtype=np.int64)
            held.clear()
            return pa.RecordBatch.from_pylist([{"block": now, "q_numbers": numbers.tobytes(), "q_starts": starts.tobytes(), "q_terms": flat[:, 0].tobytes(), "q_weights": flat[:, 1].tobytes()}])

        for batch in batches:
            for block, number, terms in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if held and (block != now or len(held) >= QUERIES):
                    yield flush()
                now = block
                held.append((number, terms))
        if held:
            yield flush()

    return in_small_batches(queries.repartition("block").sortWithinPartitions("block"), run, schema)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents with the largest scores above 0, equal scores by
    ascending document id, missing ids first; all of them where there are fewer.

    Terms are runs of letters, digits and everything beyond ASCII, A-Z as a-z, known by 64-bit hashes. Null and empty
    texts have no terms, nor ranks. Each row of a repeated document id is a document of its own. An item's repeated rows count
    once; another text under its id is an item of its own, with ranks of its own. Texts are read whole, however long.
    Empty tables give no rows; further columns are not read. A term that nearly all documents hold may weigh 0.
    """
    spark = docs.sparkSession
    asked = written(_item_terms(items.select(F.col(item_col).alias("item"), F.col(text).cast("string").alias("text"))), "item-terms")
    shards = written(_shards(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")), asked.select("term").distinct()), "postings")
    totals = shards.agg(F.sum("documents"), F.sum("n_terms"), F.count(F.lit(1))).first()
    documents, terms, n_shards = (int(x or 0) for x in totals)
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))) * F.col("times")
    weighed = asked.join(_frequencies(shards), F.col("term") == F.col("f_term")).groupBy("item", "number").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("terms"))
    queries = written(weighed, "queries")
    # every block of queries goes to every group of shards; enough groups for all cores
    blocks = max(1, -(-queries.count() // QUERIES))
    groups = max(1, min(n_shards, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    packs = _query_blocks(queries.select(F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("bigint").alias("block"), "number", "terms"))
    held = packs.select("*", every(groups).alias("group"), F.lit(0).alias("kind"))
    passing = shards.select("shard", "ids", "lengths", "terms", "df", "blocks", "pairs", "data", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("bigint").alias("group"), every(blocks).alias("block"), F.lit(1).alias("kind"))
    cells = held.unionByName(passing, allowMissingColumns=True).repartition("group", "block").sortWithinPartitions("group", "block", "kind", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, {}
        none = np.empty(0, dtype=np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            rows = [(number, ids, scores) for number, (_, _, ids, scores) in best.items() if len(ids)]
            for a in range(0, len(rows), 10_000):
                part = rows[a : a + 10_000]
                numbers = np.repeat([r[0] for r in part], [len(r[1]) for r in part])
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *[pa.array(np.concatenate([r[c] for r in part])) for c in (1, 2)]], names=["number", "doc_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if now != (now := (r["group"], r["block"])):
                    yield from told()
                    best = {}
                if r["kind"] == 0:
                    numbers, starts, names, weights = (np.frombuffer(r[c], dtype=np.int64) for c in ("q_numbers", "q_starts", "q_terms", "q_weights"))
                    for i, number in enumerate(numbers.tolist()):
                        own = slice(starts[i], starts[i + 1])
                        best[number] = (names[own].view(np.uint64), weights[own], none, none)
                elif best:
                    shard = Shard(r, documents, terms)
                    for number, (names, weights, ids, scores) in best.items():
                        at, found, _ = search(shard, names, weights, k, int(scores[-1]) if len(scores) == k else 1)
                        ids, scores = np.concatenate([ids, shard.ids[at]]), np.concatenate([scores, found])
                        by = np.lexsort((ids, -scores))[:k]
                        best[number] = (names, weights, ids[by], scores[by])
        yield from told()

    found = written(in_small_batches(cells, run, "number bigint, doc_id bigint, score bigint"), "ranked")
    for table in (asked, shards):
        drop_written(table)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    doc = F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id"))
    return ranked.join(queries.select("item", "number"), "number").select(F.col("item").alias("item_id"), "rank", doc.alias("doc_id"), "score")


_TERMS = r"unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE = f"""
WITH w AS (SELECT row, doc_id, {_TERMS.format('text')} AS term FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
d AS (SELECT row, doc_id, count(*) AS n FROM w GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT row, term, count(*) AS tf FROM w GROUP BY ALL),
q AS (SELECT item_id, own, term, count(*) AS times FROM (SELECT item_id, own, {_TERMS.format('text')} AS term
  FROM (SELECT *, row_number() OVER () AS own FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (
  SELECT item_id, own, d.row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (row), c GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
