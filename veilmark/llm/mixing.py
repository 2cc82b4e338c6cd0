"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

The token budget flows down a tree, here domain, language, source. At each node the children share its budget by
weight, and a child that can't hold its share, at so many epochs of its leaves, leaves the rest to its siblings; since
no node gets more than its leaves hold, a shortage reaches the siblings of an ancestor only when all nearer ones are
full. Each leaf then takes whole epochs and, of one more, the prefix of a seeded order up to its budget.

All shares are whole tokens, in decimal arithmetic. The tree has a row per leaf; documents are only summed by leaf,
scanned against budgets, and ordered within one slot of the hash where a budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import set_aside, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Hex digits of a document's place in an epoch by which each of two passes narrows down where a leaf's prefix ends.
SLOT = 3


def _whole(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, total: Column) -> DataFrame:
    """`leaves`: the level columns and `capacity`; `weights`: the level columns, null below a node, and `weight`.
    Returns the leaves with `budget`. A node without a weight has weight 1; one of weight 0 gets nothing."""
    nodes = leaves
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        own = weights.where(F.col(path[-1]).isNotNull() & (F.col(levels[depth]).isNull() if depth < len(levels) else F.lit(True)))
        own = own.groupBy(*[F.col(c).alias(f"w_{c}") for c in path]).agg(F.max("weight").alias(f"weight_{depth}"))
        on = F.lit(True)
        for c in path:
            on = on & F.col(c).eqNullSafe(F.col(f"w_{c}"))
        nodes = nodes.join(own, on, "left").drop(*[f"w_{c}" for c in path]).withColumn(f"weight_{depth}", _whole(F.coalesce(f"weight_{depth}", F.lit(1))))
    # what a node can hold: the sum over its leaves whose whole path has weight
    open_ = F.lit(True)
    for depth in range(1, len(levels) + 1):
        open_ = open_ & (F.col(f"weight_{depth}") > 0)
    nodes = nodes.withColumn("cap", F.when(open_, _whole("capacity")).otherwise(_whole(F.lit(0))))
    nodes = nodes.withColumn("budget_0", F.least(_whole(total), _whole(F.sum("cap").over(Window.partitionBy(F.lit(0))))))
    for depth in range(1, len(levels) + 1):
        path, above = levels[:depth], levels[: depth - 1]
        w, cap, budget = f"weight_{depth}", f"cap_{depth}", f"budget_{depth}"
        keep = [*above, f"budget_{depth - 1}"]
        tier = nodes.groupBy(*path).agg(F.sum("cap").cast("decimal(38,0)").alias(cap), F.max(w).alias(w), F.max(f"budget_{depth - 1}").alias(keep[-1]))
        by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        up = by.orderBy(F.col(cap).cast("decimal(38,0)") / F.when(F.col(w) > 0, F.col(w)), *path)
        before, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        live = F.col(w) > 0
        tier = tier.withColumns({
            "caps_before": _whole(F.coalesce(F.sum(F.when(live, F.col(cap))).over(before), F.lit(0))),
            "weights_on": _whole(F.coalesce(F.sum(w).over(onward), F.lit(0))),
        })
        room = F.col(keep[-1]) - F.col("caps_before")
        tier = tier.withColumn("full", live & (_whole(F.col(cap) * F.col("weights_on")) <= _whole(room * F.col(w))))
        tier = tier.withColumns({
            "left": _whole(F.col(keep[-1]) - F.coalesce(F.sum(F.when(F.col("full"), F.col(cap))).over(by), F.lit(0))),
            "rest": _whole(F.coalesce(F.sum(F.when(~F.col("full"), F.col(w))).over(by), F.lit(0))),
        })
        so_far = Window.partitionBy(*above, "full").orderBy(*path).rowsBetween(Window.unboundedPreceding, Window.currentRow) if above else Window.partitionBy("full").orderBy(*path).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        tier = tier.withColumn("run", _whole(F.sum(w).over(so_far)))
        part = lambda x: F.expr(f"CAST((`left` * ({x})) DIV rest AS DECIMAL(38,0))")
        share = part("run") - part(f"run - {w}")
        tier = tier.withColumn(budget, _whole(F.when(F.col("full"), F.col(cap)).when(live & (F.col("rest") > 0), F.least(share, F.col(cap))).otherwise(0)))
        on = F.lit(True)
        for c in path:
            on = on & F.col(c).eqNullSafe(F.col(f"t_{c}"))
        nodes = nodes.join(tier.select(*[F.col(c).alias(f"t_{c}") for c in path], budget), on, "left").drop(*[f"t_{c}" for c in path])
    return nodes.select(*leaves.columns, F.col(f"budget_{len(levels)}").cast("bigint").alias("budget"))


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _place(seed: int, id_col: str) -> Column:
    """A document's place in the epoch after its leaf's whole ones, as hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("m_whole").cast("string"), F.col(id_col).cast("string")).cast("binary"))


def _cut(slots: DataFrame, levels: list[str], left: str) -> DataFrame:
    """For each leaf the first slot at whose end the tokens pass `left`, and what is left where it begins."""
    by = Window.partitionBy(*levels).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = slots.withColumn("upto", F.sum("n").over(by)).where(F.col("upto") > F.col(left))
    return sums.groupBy(*[F.col(c).alias(f"c_{c}") for c in levels]).agg(F.min(F.struct("slot", (F.col(left) - F.col("upto") + F.col("n")).alias("left"))).alias("cut"))


def mix(docs: DataFrame, weights: DataFrame, levels: list[str], id_col: str = "doc_id", text_col: str = "text", share: float = 0.6, epochs: int = 3, seed: int = 20240) -> DataFrame:
    """The rows of `docs` that the mix takes, once for each epoch they are in, with `m_epoch` (from 0) and `m_tokens`.

    The budget is `share` of all words, a leaf holds `epochs` times its words. A leaf's place in the tree may hold
    nulls; they are values like others. A null or empty text has no words and comes with whole epochs only. Rows with
    equal ids and equal words are interchangeable, extra columns come along unread (m_epoch and m_tokens
    are replaced), and an empty table gives an empty
    mix. A budget ends before the document that would pass it. Where roundings meet a full leaf, up to a token a node
    may stay unspent.
    """
    docs, back = set_aside(docs, ("m_", "c_"), (id_col, text_col, *levels))
    back = {k: v for k, v in back.items() if v not in ("m_epoch", "m_tokens")}
    rows = docs.withColumn("m_tokens", F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint"))
    thin = written(rows.select(F.col(id_col).alias("m_id"), *levels, "m_tokens"), "mix-tokens")
    leaves = thin.groupBy(*levels).agg(F.sum("m_tokens").alias("available")).withColumn("capacity", F.col("available") * epochs)
    total = F.floor(F.sum("available").over(Window.partitionBy(F.lit(0))) * F.lit(share).cast("decimal(9,6)"))
    leaves = leaves.withColumn("total", total.cast("bigint"))
    shares = budgets(leaves, levels, weights, F.col("total"))
    m = [f"m_{c}" for c in levels]
    shares = written(shares.where((F.col("budget") > 0) & (F.col("available") > 0)).select(*[F.col(c).alias(f"m_{c}") for c in levels], F.floor(F.col("budget") / F.col("available")).alias("m_whole"), (F.col("budget") % F.col("available")).alias("m_rest")), "mix-budgets")
    known = thin.join(shares, _same(levels, m)).drop(*m).where("m_rest > 0").withColumn("place", _place(seed, "m_id"))
    first = known.groupBy(*levels, F.substring("place", 1, SLOT).alias("slot"), "m_rest").agg(F.sum("m_tokens").alias("n"))
    one = written(_cut(first, levels, "m_rest").select(*[F.col(f"c_{c}").alias(f"c_{c}") for c in levels], F.col("cut.slot").alias("m_slot1"), F.col("cut.left").alias("m_left1")), "mix-cut1")
    c = [f"c_{x}" for x in levels]
    inside = known.join(one, _same(levels, c)).drop(*c).where(F.substring("place", 1, SLOT) == F.col("m_slot1"))
    second = inside.groupBy(*levels, F.substring("place", SLOT + 1, SLOT).alias("slot"), "m_left1").agg(F.sum("m_tokens").alias("n"))
    two = _cut(second, levels, "m_left1").select(*c, F.col("cut.slot").alias("m_slot2"), F.col("cut.left").alias("m_left2"))
    # a row per leaf: whole epochs, and where the prefix of the next one ends; written, so that its size is known
    plan = shares.join(one, _same(m, c), "left").drop(*c).join(two, _same(m, c), "left").drop(*c)
    plan = written(plan, "mix-plan")
    placed = rows.join(plan, _same(levels, m)).withColumn("m_place", _place(seed, id_col))
    slot1, slot2 = F.substring("m_place", 1, SLOT), F.substring("m_place", SLOT + 1, SLOT)
    before = (slot1 < F.col("m_slot1")) | ((slot1 == F.col("m_slot1")) & (slot2 < F.col("m_slot2")))
    last = F.coalesce((slot1 == F.col("m_slot1")) & (slot2 == F.col("m_slot2")), F.lit(False))
    copies = F.col("m_whole") + F.when((F.col("m_rest") > 0) & before, 1).otherwise(0)
    sure = placed.where(copies > 0).withColumn("m_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    upto = Window.partitionBy(*levels).orderBy("m_place", id_col, "m_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where(last).withColumn("m_upto", F.sum("m_tokens").over(upto)).where(F.col("m_upto") <= F.col("m_left2")).withColumn("m_epoch", F.col("m_whole"))
    columns = [c for c in docs.columns if not c.startswith("aside_") or c in back]
    columns += ["m_epoch", "m_tokens"]
    return sure.select(*columns).unionByName(edge.select(*columns)).withColumnsRenamed(back)


def domain(source: Column) -> Column:
    """The synthetic tables have no domain: sources are dealt over three by their number, others are a fourth."""
    number = F.expr("try_cast(nullif(regexp_extract(source, '^src([0-9]+)$', 1), '') AS INT)")
    return F.coalesce(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("wiki")), number % 3 + 1), F.lit("other"))


#: Target weights of the registered query: (domain, lang, source, weight), null below the node.
WEIGHTS = (("web", None, None, 5), ("books", None, None, 3), ("wiki", None, None, 2), ("other", None, None, 1), ("web", "en", None, 6), ("web", "de", None, 3), ("books", "fr", None, 4), ("wiki", "es", None, 3), ("web", "en", "src0", 2), ("web", "en", "src3", 3), ("books", "en", "src1", 5))
LEVELS = ["domain", "lang", "source"]


_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in WEIGHTS)


def weight_table(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {_VALUES} AS w(domain, lang, source, weight)")


def _tier(depth: int) -> str:
    """One level of the tree in DuckDB's SQL."""
    path, above = LEVELS[:depth], LEVELS[: depth - 1]
    below = "".join(f" AND {c} IS NULL" for c in LEVELS[depth:])
    same = lambda a, b, cols: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)
    by = f"PARTITION BY {', '.join(above)}" if above else ""
    comma = ", " if above else ""
    order = ", ".join(path)
    return f"""
a{depth} AS (SELECT {order}, sum(cap)::HUGEINT AS cap, max(w{depth})::HUGEINT AS w, max(b{depth - 1})::HUGEINT AS b FROM n{depth - 1} GROUP BY {order}),
c{depth} AS (SELECT *, coalesce(sum(CASE WHEN w > 0 THEN cap END) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS cb,
  coalesce(sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::HUGEINT AS wo FROM a{depth}
  WINDOW u AS ({by} ORDER BY cap::DOUBLE / nullif(w, 0)::DOUBLE NULLS FIRST, {order.replace(',', ' NULLS FIRST,')} NULLS FIRST)),
d{depth} AS (SELECT *, w > 0 AND cap * wo <= (b - cb) * w AS is_full FROM c{depth}),
e{depth} AS (SELECT *, (b - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0))::HUGEINT AS lft, coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER ({by}), 0)::HUGEINT AS rest,
  (sum(w) OVER (PARTITION BY {', '.join(above)}{comma}is_full ORDER BY {order.replace(',', ' NULLS FIRST,')} NULLS FIRST ROWS UNBOUNDED PRECEDING))::HUGEINT AS run FROM d{depth}),
g{depth} AS (SELECT *, CASE WHEN is_full THEN cap WHEN w > 0 AND rest > 0 THEN least(lft * run // rest - lft * (run - w) // rest, cap) ELSE 0 END AS nb FROM e{depth}),
n{depth} AS (SELECT n.*, g.nb AS b{depth} FROM n{depth - 1} n JOIN g{depth} g ON {same('n', 'g', path)}),"""


def oracle(share: str = "0.6", epochs: int = 3, seed: int = 20240) -> str:
    weight = lambda d: f"coalesce((SELECT max(weight) FROM w WHERE {' AND '.join(f'w.{c} = l.{c}' for c in LEVELS[:d])}{''.join(f' AND w.{c} IS NULL' for c in LEVELS[d:])}), 1)::HUGEINT AS w{d}"
    return rf"""
WITH w(domain, lang, source, weight) AS (VALUES {_VALUES}),
t AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n,
  coalesce((['web', 'books', 'wiki'])[try_cast(nullif(regexp_extract(source, '^src([0-9]+)$', 1), '') AS INT) % 3 + 1], 'other') AS domain FROM documents),
l AS (SELECT domain, lang, source, sum(n)::HUGEINT AS available FROM t GROUP BY ALL),
n00 AS (SELECT *, {weight(1)}, {weight(2)}, {weight(3)}, (floor((SELECT sum(available) FROM l) * {share}::DECIMAL(9,6)))::HUGEINT AS total FROM l),
n01 AS (SELECT *, CASE WHEN w1 > 0 AND w2 > 0 AND w3 > 0 THEN available * {epochs} ELSE 0 END::HUGEINT AS cap FROM n00),
n0 AS (SELECT *, least(total, (SELECT sum(cap) FROM n01))::HUGEINT AS b0 FROM n01),{_tier(1)}{_tier(2)}{_tier(3)}
p AS (SELECT domain, lang, source, (b3 // available)::BIGINT AS whole, (b3 % available)::BIGINT AS rest FROM n3 WHERE b3 > 0 AND available > 0),
o AS (SELECT t.*, whole, rest, sum(n) OVER (PARTITION BY t.domain, t.lang, t.source ORDER BY md5('{seed}:' || whole || ':' || doc_id), doc_id, n ROWS UNBOUNDED PRECEDING) AS upto
  FROM t JOIN p ON t.domain = p.domain AND t.lang IS NOT DISTINCT FROM p.lang AND t.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, domain, lang, source, n::BIGINT AS n_tokens, unnest(range(copies))::BIGINT AS epoch FROM k WHERE copies > 0
"""
