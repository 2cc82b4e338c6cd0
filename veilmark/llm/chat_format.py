"""Chat formatting in budgeted windows, by DataFrame operations only.

Prefix sums of turn tokens lay a conversation's turns on a line that is cut at fixed distances; the turns that start
between two cuts make a window, so windows are turn-aligned and no turn waits for the one before it. A turn longer
than that distance has a window of its own. Every window repeats the system turn and a limited stretch of history;
loss falls on assistant turns where they are new, never where they are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks. Texts can't hold them: '<', '[' and the backslash are escaped there.
START, BODY, END = "<|start|>", "<|body|>", "<|end|>\n"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Tokens that the template adds to a turn.
OVERHEAD = 3
#: Turn numbers that share a partition while prefix sums are made.
CHUNK = 256


def escape(x: Column) -> Column:
    """Reversible: backslash, '<' and '[' become two characters each, of which the first is a backslash."""
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(x, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(x: Column) -> Column:
    """Pairs of backslashes, counted from the left, stand for one; what is left over starts an escape."""
    part = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), part), "\\")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)) + OVERHEAD


def numbered(turns: DataFrame) -> DataFrame:
    """Each turn with its place in its conversation (`pos`, from 1), the tokens before it (`s`) and with it (`e`), and
    the tokens of the conversation's system turn (`sys`, 0 without one), which itself has no tokens on the line.

    Prefix sums go by chunks of turn numbers and then over chunks, so that a long conversation isn't one task's work.
    """
    key = [F.col("conv").eqNullSafe(F.col("c_conv")), F.col("chunk").eqNullSafe(F.col("c_chunk"))]
    rows = turns.withColumns({"n": tokens(F.col("text")), "chunk": F.floor(F.col("turn") / CHUNK)})
    order = [F.asc_nulls_first("turn"), "role", "text"]
    own = Window.partitionBy("conv", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"own_pos": F.count(F.lit(1)).over(own), "own_end": F.sum("n").over(own)})
    first = F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", F.when(F.col("role") == "system", F.col("text")).alias("text"), "n"))
    over = Window.partitionBy("c_conv").orderBy(F.asc_nulls_first("c_chunk"))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    chunks = turns.withColumns({"n": tokens(F.col("text")), "chunk": F.floor(F.col("turn") / CHUNK)}).groupBy(F.col("conv").alias("c_conv"), F.col("chunk").alias("c_chunk")).agg(F.sum("n").alias("c_n"), F.count(F.lit(1)).alias("c_rows"), first.alias("c_first"))
    chunks = chunks.select("c_conv", "c_chunk", F.coalesce(F.sum("c_n").over(before), F.lit(0)).alias("c_tokens"), F.coalesce(F.sum("c_rows").over(before), F.lit(0)).alias("c_pos"), F.first(F.struct(F.col("c_first.role").alias("role"), F.col("c_first.n").alias("n"))).over(over).alias("head"))
    sys = F.when(F.col("head.role") == "system", F.col("head.n")).otherwise(0)
    joined = rows.join(chunks, key[0] & key[1])
    return joined.select("conv", "role", "text", "n", (F.col("c_pos") + F.col("own_pos")).alias("pos"), sys.alias("sys"), (F.col("c_tokens") + F.col("own_end") - sys).alias("e")).withColumn("s", F.col("e") - F.col("n")).withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))


def placed(rows: DataFrame, budget: int) -> DataFrame:
    """A row for each window that a turn is in: `window`, and `fresh`, false where the turn is repeated history.

    Of the budget, what the system turn leaves (a half at least) is shared by history, a fifth, and twice the distance
    of the cuts. Where all turns are within that distance, history and new turns together stay within it; a longer
    turn takes history along only as far as both fit.
    """
    body = F.greatest(F.lit(budget) - F.col("sys"), F.lit(budget // 2))
    rows = rows.where(~F.col("is_system")).withColumn("body", body).withColumn("past", F.floor(F.col("body") / 5)).withColumn("step", F.floor((F.col("body") - F.col("past")) / 2))
    rows = rows.withColumn("cell", F.floor(F.col("s") / F.col("step"))).withColumn("big", F.col("n") > F.col("step"))
    cell = Window.partitionBy("conv", "cell")
    rows = rows.withColumns({"big_start": F.max(F.when(F.col("big"), F.col("s"))).over(cell), "big_end": F.max(F.when(F.col("big"), F.col("e"))).over(cell)})
    entry = lambda window, fresh: F.struct(window.alias("window"), F.lit(fresh).alias("fresh"))
    small = ~F.col("big")
    nothing = F.lit(None).cast("struct<window:bigint,fresh:boolean>")
    uses = F.array(
        entry(F.col("cell") * 2 + F.col("big").cast("int"), True),
        F.when(small & (F.col("s") >= F.col("big_start") - F.col("past")) & (F.col("big_end") - F.col("s") <= F.col("body")), entry(F.col("cell") * 2 + 1, False)).otherwise(nothing),
        F.when(small & (F.col("s") >= (F.col("cell") + 1) * F.col("step") - F.col("past")), entry((F.col("cell") + 1) * 2, False)).otherwise(nothing),
    )
    return rows.select("conv", "pos", "role", "text", F.explode(F.array_compact(uses)).alias("use")).select("conv", "pos", "role", "text", "use.*")


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(BODY), escape(text), F.lit(END))


def format_windows(conversations: DataFrame, budget: int = 1024, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows of formatted text: conv_id, window, formatted, repeated (how many leading turns are repeats), loss (spans
    of code points in `formatted`, ends exclusive).

    A null role or text is empty, a null turn number comes before all others, equal turn numbers go by role and text,
    repeated rows are turns of their own, rows of a null conversation form one conversation, a conversation of only a
    system turn has one window, further columns are not read, and no rows give no windows. Only a conversation's first
    turn can be its system turn. A turn over the budget stays whole, in a window of its own.
    """
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = numbered(turns)
    used = placed(rows, budget)
    # a system turn without any other turn is a window of its own; else it's repeated from the second window on
    head = rows.where("is_system").select(F.col("conv").alias("h_conv"), segment(F.col("role"), F.col("text")).alias("head"))
    item = F.struct("pos", "fresh", (F.col("fresh") & (F.col("role") == "assistant")).alias("learn"), segment(F.col("role"), F.col("text")).alias("segment"), (F.length(escape(F.col("role"))) + len(START) + len(BODY)).alias("skip"))
    windows = used.groupBy("conv", "window").agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.exists("items", lambda x: x["fresh"]))
    first = windows.groupBy(F.col("conv").alias("f_conv")).agg(F.min("window").alias("first"))
    windows = windows.join(first, F.col("conv").eqNullSafe(F.col("f_conv"))).join(head, F.col("conv").eqNullSafe(F.col("h_conv")), "full_outer")
    items = F.coalesce("items", F.array().cast("array<struct<pos:bigint,fresh:boolean,learn:boolean,segment:string,skip:int>>"))
    lead = F.coalesce("head", F.lit(""))
    spans = F.aggregate(
        items,
        F.struct(F.length(lead).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["segment"])).alias("at"),
            F.when(x["learn"], F.array_append(a["spans"], F.struct((a["at"] + x["skip"]).alias("start"), (a["at"] + F.length(x["segment"]) - len(END)).alias("end")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    repeated = F.size(F.filter(items, lambda x: ~x["fresh"])) + F.when(F.col("head").isNotNull() & (F.col("window") > F.col("first")), 1).otherwise(0)
    conv = F.when(F.col("window").isNull(), F.col("h_conv")).otherwise(F.col("conv"))
    return windows.select(conv.alias(conv_col), F.coalesce("window", F.lit(0)).alias("window"), F.concat(lead, F.array_join(F.transform(items, lambda x: x["segment"]), "")).alias("formatted"), repeated.alias("repeated"), spans.alias("loss"))


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The turns and the learned texts of each conversation, from formatted windows alone.

    One row per conversation with its turns as `role\\ntext\\n` joined in order (`turns`), how many they are, all text
    under the loss mask (`learned`) and the characters of its windows.
    """
    pieces = F.slice(F.split(F.col("formatted"), "<\\|start\\|>", -1), 2 + F.col("repeated"), F.greatest(F.lit(0), F.size(F.split(F.col("formatted"), "<\\|start\\|>", -1)) - 1 - F.col("repeated")))
    body = lambda p: F.substring_index(F.substring_index(p, BODY, -1), END, 1)
    turn = lambda p: F.concat(unescape(F.substring_index(p, BODY, 1)), F.lit("\n"), unescape(body(p)), F.lit("\n"))
    learned = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    parsed = windows.select(conv_col, "window", F.size(pieces).alias("n"), F.array_join(F.transform(pieces, turn), "").alias("turns"), F.array_join(learned, "").alias("learned"), F.length("formatted").alias("chars"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    return parsed.groupBy(conv_col).agg(F.sum("n").alias("n_turns"), text("turns").alias("turns"), text("learned").alias("learned"), F.sum("chars").alias("formatted_chars"))


def digest(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    back = read_back(windows, conv_col)
    return back.select(conv_col, F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2("turns", 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


#: DuckDB: the turns from the table, the windows by the same arithmetic.
ORACLE = r"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t1 AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t0
), t2 AS (
  SELECT *, pos = 1 AND role = 'system' AS is_system,
    max(CASE WHEN pos = 1 AND role = 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
    sum(n) OVER (PARTITION BY conv_id ORDER BY pos) AS e0,
    25 + length(replace(replace(replace(role || text, '\', '\\'), '<', '\l'), '[', '\b')) AS chars FROM t1
), t3 AS (
  SELECT *, e0 - sys AS e, e0 - sys - n AS s, greatest(1024 - sys, 512) AS body FROM t2
), t4 AS (SELECT *, body // 5 AS past FROM t3 WHERE NOT is_system),
t5 AS (SELECT *, (body - past) // 2 AS step FROM t4),
t6 AS (SELECT *, s // step AS cell, n > step AS big FROM t5),
t7 AS (
  SELECT *, max(CASE WHEN big THEN s END) OVER (PARTITION BY conv_id, cell) AS bs,
    max(CASE WHEN big THEN e END) OVER (PARTITION BY conv_id, cell) AS be FROM t6
), u AS (
  SELECT conv_id, cell * 2 + CASE WHEN big THEN 1 ELSE 0 END AS w, true AS fresh, chars FROM t7
  UNION ALL SELECT conv_id, cell * 2 + 1, false, chars FROM t7 WHERE NOT big AND s >= bs - past AND be - s <= body
  UNION ALL SELECT conv_id, (cell + 1) * 2, false, chars FROM t7 WHERE NOT big AND s >= (cell + 1) * step - past
), w AS (SELECT conv_id, w, sum(chars) AS chars FROM u GROUP BY ALL HAVING bool_or(fresh)),
h AS (SELECT conv_id, chars AS head FROM t2 WHERE is_system),
f AS (
  SELECT coalesce(w.conv_id, h.conv_id) AS conv_id, sum(coalesce(w.chars, 0) + coalesce(h.head, 0)) AS formatted_chars
  FROM w FULL JOIN h ON w.conv_id = h.conv_id GROUP BY ALL
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM t1 GROUP BY conv_id
)
SELECT d.conv_id, n_turns::BIGINT AS n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256,
  formatted_chars::BIGINT AS formatted_chars FROM d JOIN f ON d.conv_id = f.conv_id
"""
