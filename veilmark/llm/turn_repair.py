"""Structure repair of conversations by A* on the edit lattice.

A node of the lattice is (rows used up, what the output ends in); edges keep, rerole, delete or insert a turn. Its key is
(cost so far plus heuristic, audit so far). The heuristic sums over the rows that are left what each costs at least: the
deletion that a blank or repeated row must have, and for a truncated row the cheaper of its deletion and its charge. It
never falls by more than an edge costs, so the first time a node is taken it has its least cost and, among those, its
least audit.

Rows are ordered by ranges, so a long conversation is spread over tasks, and cut into segments of bounded size. A segment
that is a whole conversation is settled at once. Any other gets the best way from each state to each state; the ways of
a conversation's segments are put together from small rows (costs and audits, no texts), and only the states at the cuts
go back to the segments, which then repair their own rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import in_small_batches, written

#: Rows of a segment, and bytes of text, at most; a longer row is a segment.
SEGMENT, SEGMENT_BYTES = 256, 2_000_000
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK, REPEATED, CUT, FINE = "b", "d", "t", "-"
#: What the output ends in: nothing, the system's turn, a user's, an assistant's. A conversation ends in the first or last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NOTHING, ASSISTANT)
STATES = 4
Way = tuple[int, str]


def _after(state: int, initial: str) -> int | None:
    """The state once a turn with this initial follows, or None where it may not."""
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return SYSTEM if initial == "s" and state == NOTHING else None


def ways(rows: Sequence[tuple[str, str]], start: int, final: bool) -> dict[int, Way]:
    """The cheapest edits of rows (initial of the role, fault) from a state: (cost, audit) by the state at the end, or of
    the best final state alone. Ties go to the audit that is least."""
    n = len(rows)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + {FINE: 0, CUT: min(DELETE, TRUNCATED)}.get(rows[i][1], DELETE)
    heap: list[tuple[int, str, int, int, int]] = [(least[0], "", 0, start, 0)]
    done: set[tuple[int, int]] = set()
    out: dict[int, Way] = {}
    while heap:
        _, audit, i, state, cost = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if not final:
                out[state] = (cost, audit)
            elif state in FINAL:
                return {state: (cost, audit)}
        steps = [(i, to, INSERT, "I") for role in "ua" if (to := _after(state, role)) is not None]
        if i < n:
            initial, fault = rows[i]
            steps.append((i + 1, state, DELETE, "D"))
            if fault in (FINE, CUT):
                extra = TRUNCATED if fault == CUT else 0
                if (to := _after(state, initial)) is not None:
                    steps.append((i + 1, to, extra, "K"))
                steps += [(i + 1, to, REROLE + extra, "R") for role in "ua" if (to := _after(state, role)) is not None]
        for at, to, more, edit in steps:
            if (at, to) not in done:
                heapq.heappush(heap, (cost + more + least[at], audit + edit, at, to, cost + more))
    return out


def repaired(roles: Sequence[str], texts: Sequence[str], audit: str, start: int) -> tuple[list[str], list[str], int]:
    """Roles and texts after the edits, and the state at the end."""
    out_roles, out_texts, i, state = [], [], 0, start
    for edit in audit:
        if edit != "D":
            role = roles[i] if edit == "K" else "assistant" if state == USER else "user"
            out_roles.append(role)
            out_texts.append("" if edit == "I" else texts[i])
            state = _after(state, role[:1])
        i += edit != "I"
    return out_roles, out_texts, state


def damaged(talks: DataFrame) -> DataFrame:
    """Test damage by crc32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 takes `[.!?]` out of it, 3
    repeats it, 4 makes it the user's. A null is one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = talks.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _segments(talks: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Segments of all conversations, those settled that are whole."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = talks.select(F.col(conv).alias("c"), F.col(turn).cast("bigint").alias("t"), spaced(role).alias("role"), spaced(text).alias("text"))
    # rows that are wholly equal are one row with a number of copies
    rows = rows.groupBy("c", "t", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("key", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    # what is said at more than one turn, with the first of them; mostly few rows
    first = rows.groupBy("c", "key").agg(F.min(F.struct(F.col("t").isNotNull(), F.col("t"))).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    first = first.select(F.col("c").alias("f_c"), F.col("key").alias("f_key"), F.col("first.t").alias("f_t"), F.lit(True).alias("again"))
    rows = rows.join(first, F.col("c").eqNullSafe(F.col("f_c")) & (F.col("key") == F.col("f_key")), "left")
    later = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("t").eqNullSafe(F.col("f_t"))
    said = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(later, REPEATED).when(~said.isin(".", "!", "?"), CUT).otherwise(FINE)
    order = [F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("key")]
    rows = rows.select("c", "t", "role", "text", "copies", "key", fault.alias("fault"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "role", "text", "copies", "fault")
    kind = rows.schema["c"].dataType
    head = "at bigint, whole boolean, n bigint, blank bigint, repeated bigint, cut bigint, illegal bigint, first string, last string, roles array<string>, texts array<string>, faults string, costs array<int>, audits array<string>, start int, audit string, cost bigint"
    schema = T.StructType([T.StructField("c", kind), *T.StructType.fromDDL(head)])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size, now, begun = TaskContext.get().partitionId(), 0, [], 0, None, False
        seen_other = False  # the first conversation of a partition may have begun before it

        def flush(ended: bool) -> pa.RecordBatch:
            nonlocal made
            row = segment(now[0], held, begun and ended, begun) | {"at": (part << 32) + made}
            made += 1
            return pa.RecordBatch.from_pylist([row], schema=out)

        for batch in batches:
            for c, role, text, copies, fault in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if now is not None and now[0] != c:
                    if held:
                        yield flush(True)
                    held, size, seen_other = [], 0, True
                if now is None or now[0] != c:
                    now, begun = (c,), seen_other
                for k in range(copies):
                    if held and (len(held) >= SEGMENT or size + len(text) > SEGMENT_BYTES):
                        yield flush(False)
                        held, size, begun = [], 0, False
                    # a further copy goes in any case, so its text isn't kept
                    held.append((role, text if not k else "", fault if not k or fault == BLANK else REPEATED))
                    size += len(text) if not k else 0
        if held:
            yield flush(False)

    return in_small_batches(rows, run, schema)


def segment(c: object, rows: Sequence[tuple[str, str, str]], whole: bool, begins: bool) -> dict:
    """A segment as a row; one that is a whole conversation is settled, another has the ways between all states."""
    roles, texts, faults = ([r[k] for r in rows] for k in range(3))
    initials = [r[:1] for r in roles]
    said = list(zip(initials, faults, strict=True))
    row = {"c": c, "whole": whole, "n": len(rows), "blank": faults.count(BLANK), "repeated": faults.count(REPEATED), "cut": faults.count(CUT), "first": initials[0], "last": initials[-1]}
    row |= {"illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "roles": roles, "texts": texts, "faults": "".join(faults), "costs": None, "audits": None, "start": None, "audit": None, "cost": None}
    if whole:
        ((_, (cost, audit)),) = ways(said, NOTHING, True).items()
        return row | {"start": NOTHING, "audit": audit, "cost": cost}
    found = [ways(said, s, False) if s == NOTHING or not begins else {} for s in range(STATES)]
    flat = [found[s].get(e) for s in range(STATES) for e in range(STATES)]
    return row | {"costs": [w and w[0] for w in flat], "audits": [w and w[1] for w in flat]}


class Chain:
    """Puts the ways of a conversation's segments together, in order: per state at the cut the least cost and audit so
    far. Of the audits only what differs between states is held."""

    def __init__(self) -> None:
        self.now: dict[int, Way] = {NOTHING: (0, "")}
        self.back: list[tuple[int, dict[int, tuple[int, int]]]] = []

    def add(self, at: int, costs: Sequence[int | None], audits: Sequence[str | None]) -> None:
        to: dict[int, tuple[int, str, int, int]] = {}
        for s, (cost, audit) in self.now.items():
            for e in range(STATES):
                if (more := costs[STATES * s + e]) is not None:
                    way = (cost + more, audit + audits[STATES * s + e], s, more)
                    if e not in to or way[:2] < to[e][:2]:
                        to[e] = way
        self.back.append((at, {e: (w[2], w[3]) for e, w in to.items()}))
        shared = 0
        texts = [w[1] for w in to.values()]
        for letters in zip(*texts, strict=False):
            if len(set(letters)) > 1:
                break
            shared += 1
        self.now = {e: (w[0], w[1][shared:]) for e, w in to.items()}

    def chosen(self) -> Iterator[tuple[int, int, int, int]]:
        """(segment, state before, state after, cost), last segment first."""
        end = min((e for e in FINAL if e in self.now), key=lambda e: self.now[e])
        for at, ways_back in reversed(self.back):
            start, cost = ways_back[end]
            yield at, start, end, cost
            end = start


def repair(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of conversations with their cheapest repair: `c`, the conversation, `at`, in whose order its segments
    stand, counts of rows and faults (`n`, `blank`, `repeated`, `cut`, `illegal`: rows that follow one another unlawfully), `audit`,
    `cost`, and `roles` and `texts` after the edits.

    Turns are taken by number, nulls first, turns of one number by a digest of role and text; a null role or text is one
    space, a null conversation is one of its own. A row's first fault counts: blank, repeated (role and text were there
    before) or cut (it doesn't end in a mark). Roles other than system, user and assistant, by initial, can't stay. Rows
    that are wholly equal are repeats of one another. Very long texts stay whole; further columns are not read. An empty
    table has no segments.
    """
    parts = written(_segments(talks, conv, turn, role, text), "segments")
    kind = parts.schema["c"].dataType
    open_ = parts.where("NOT whole").select("c", "at", "costs", "audits", "first", "last")
    ordered = open_.repartition("c").sortWithinPartitions("c", "at")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, last, breaks = None, None, None, {}

        def told() -> Iterator[pa.RecordBatch]:
            rows = [] if chain is None else [(*x, breaks.get(x[0], 0)) for x in chain.chosen()]
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 10_000], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["g_at", "g_start", "g_end", "g_cost", "g_illegal"])

        for batch in batches:
            for c, at, costs, audits, first, end in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if now is None or now[0] != c:
                    yield from told()
                    now, chain, breaks = (c,), Chain(), {}
                elif last + first not in ("su", "ua", "au"):
                    breaks[at] = 1
                chain.add(at, costs, audits)
                last = end
        yield from told()

    settled = in_small_batches(ordered, settle, "g_at bigint, g_start int, g_end int, g_cost bigint, g_illegal bigint")
    joined = parts.where("NOT whole").join(settled, F.col("at") == F.col("g_at"))
    audit = F.element_at("audits", F.col("g_start") * STATES + F.col("g_end") + 1)
    keep = ["c", "at", "n", "blank", "repeated", "cut", "illegal", "roles", "texts", "start", "audit", "cost"]
    more = joined.withColumns({"illegal": F.col("illegal") + F.col("g_illegal"), "start": F.col("g_start"), "audit": audit, "cost": F.col("g_cost")})
    rows = parts.where("whole").select(*keep, "whole").unionByName(more.select(*keep, "whole"))
    schema = T.StructType([T.StructField("c", kind), *T.StructType.fromDDL("at bigint, whole boolean, n bigint, blank bigint, repeated bigint, cut bigint, illegal bigint, cost bigint, audit string, roles array<string>, texts array<string>")])
    out = to_arrow_schema(schema)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r | dict(zip(("roles", "texts"), repaired(r["roles"], r["texts"], r["audit"], r["start"]), strict=False)) for r in batch.to_pylist()]
            if made:
                yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in out} for r in made], schema=out)

    return in_small_batches(rows, edit, schema)


def _hashes(segments: DataFrame) -> DataFrame:
    """Per conversation its audit and the digest of its repaired rows. Whole ones have theirs where they are; the segments of
    others go by in order, as a digest must, without being held."""
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    rows = segments.select("c", "at", "whole", "audit", F.size("roles").alias("turns"), lines.alias("lines"))
    kind = segments.schema["c"].dataType
    schema = T.StructType([T.StructField("c", kind), *T.StructType.fromDDL("audit string, repaired_sha256 string")])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audits, digest, any_ = None, [], None, False

        def told() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield pa.RecordBatch.from_pylist([{"c": now[0], "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], schema=out)

        for batch in batches:
            for c, audit, turns, said in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if now is None or now[0] != c:
                    yield from told()
                    now, audits, digest, any_ = (c,), [], hashlib.sha256(), False
                audits.append(audit)
                if turns:
                    digest.update((("\n" if any_ else "") + said).encode())
                    any_ = True
        yield from told()

    split = rows.where("NOT whole").repartition("c").sortWithinPartitions("c", "at").select("c", "audit", "turns", "lines")
    return rows.where("whole").select("c", "audit", F.sha2("lines", 256).alias("repaired_sha256")).unionByName(in_small_batches(split, run, schema))


def digest(talks: DataFrame, rows: DataFrame) -> DataFrame:
    """What `repair` makes of `rows`, a row for each conversation of `talks`; the two are equal but for the damage.

    One without any row has zeros, an empty audit and the digest of nothing. `gaps` counts the numbers that are missing
    between its least and its largest turn.
    """
    done = written(repair(rows), "repaired")
    sums = done.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("blank", "repeated", "cut", "illegal", "cost")])
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("t_c")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = talks.select("conv_id").distinct()
    hashes = _hashes(done).withColumnRenamed("c", "h_c")
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    out = every.join(sums, same("c"), "left").join(turns, same("t_c"), "left").join(hashes, same("h_c"), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select("conv_id", number("gaps").alias("gaps"), number("blank").alias("blank"), number("repeated").alias("duplicate"), number("cut").alias("truncated"), number("illegal").alias("illegal"), number("cost").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text: eight steps of the reversed polynomial for each character."""
    byte = "list_reduce(range(8), lambda b, i: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END, xor(a, o))"
    codes = f"list_transform(range(1, len({text}) + 1), lambda k: ord(substr({text}, k, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, o: {byte}, 4294967295), 4294967295)"


def _oracle() -> str:
    """The same result by dynamic programming over the rows: a list of four states, each the least (cost and audit, text)."""
    add = lambda s, cost, letter, text: f"{{'k': lpad((left({s}.k, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({s}.k, 10) || '{letter}', 't': {s}.t || {text}}}"
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    ins = lambda s, role: add(s, 5, "I", line(f"'{role}'", "''"))
    least = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda z: z.k IS NOT NULL))"
    relax_user = f"[s[1], s[2], {least('s[3]', ins('s[1]', 'user'), ins('s[2]', 'user'), ins('s[4]', 'user'))}, s[4]]"
    relax = lambda s: f"list_transform(list_transform([{s}], lambda s: {relax_user}), lambda s: [s[1], s[2], s[3], {least('s[4]', ins('s[3]', 'assistant'))}])[1]"
    charge = "(CASE WHEN x.f = 't' THEN 5 ELSE 0 END)"
    when = lambda test, made: f"CASE WHEN {test} THEN {made} END"
    ok = "x.f IN ('t', '-')"
    kept = lambda s, i: when(f"{ok} AND x.i = '{i}'", add(s, charge, "K", line("x.r", "x.t")))
    told = lambda s, role: when(ok, add(s, f"1 + {charge}", "R", line(f"'{role}'", "x.t")))
    gone = lambda s: add(s, 2, "D", "''")
    row = "[" + ", ".join([
        gone("s[1]"),
        least(gone("s[2]"), kept("s[1]", "s")),
        least(gone("s[3]"), *[kept(f"s[{k}]", "u") for k in (1, 2, 4)], *[told(f"s[{k}]", "user") for k in (1, 2, 4)]),
        least(gone("s[4]"), kept("s[3]", "a"), told("s[3]", "assistant")),
    ]) + "]"
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    return rf"""
WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
k AS (SELECT *, {_crc32('id')} % 20 AS kind FROM o),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0
), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS pos FROM d),
f AS (
  SELECT *, CASE WHEN {blank} THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS former FROM p
), g AS (
  SELECT conv_id, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
    count_if(pos > 1 AND former || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    list({{'i': left(role, 1), 'r': role, 't': text, 'f': fault}} ORDER BY pos) AS rows FROM f GROUP BY conv_id
), e AS (
  SELECT * EXCLUDE (rows), list_reduce(rows, lambda s, x: list_transform([{relax('s')}], lambda s: {row})[1],
    [{{'k': '000000000', 't': ''}}, NULL, NULL, NULL]::STRUCT(k VARCHAR, t VARCHAR)[]) AS s FROM g
), z AS (SELECT * EXCLUDE (s), {relax('s')} AS s FROM e), b AS (SELECT * EXCLUDE (s), {least('s[1]', 's[4]')} AS s FROM z)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(s.k, 9)::BIGINT, 0) AS cost,
  coalesce(substr(s.k, 10), '') AS audit, sha256(coalesce(substr(s.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE = _oracle()
