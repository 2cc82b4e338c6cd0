"""The receiving side: strict records, independent patterns, and the policy on what leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import INGRESS, matches

REDACTED = "[REDACTED:INGRESS]"
#: The keys that a request may have.
REQUEST_KEYS = ("session_id", "task_instruction", "screenshot_redacted", "dom_summary", "redaction_manifest", "prior_actions")


def strict(df: DataFrame, json: str, keys: tuple[str, ...] = REQUEST_KEYS, required: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """`df` with `unknown` (keys that aren't allowed), `missing` and `accepted`. What is no JSON object isn't accepted."""
    found = F.json_object_keys(F.col(json))
    unknown = F.array_sort(F.array_except(F.coalesce(found, F.array().cast("array<string>")), F.array(*map(F.lit, keys))))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.coalesce(found, F.array().cast("array<string>"))))
    return df.withColumns({"unknown": unknown, "missing": missing}).withColumn("accepted", found.isNotNull() & (F.size("unknown") == 0) & (F.size("missing") == 0))


def raw_patterns(text: Column) -> Column:
    """The patterns that match, each once, in the table's order; never the matched values."""
    return F.array_compact(F.array(*[F.when(matches(r, text), F.lit(r.detector)) for r in INGRESS]))


def findings(records: DataFrame, id_cols: list[str], fields: list[str]) -> DataFrame:
    """One row per leaking field and pattern: the ids, `field` and `pattern`. Empty text is no text."""
    stacked = records.select(*id_cols, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("r")).select(*id_cols, "r.*")
    return stacked.where("text IS NOT NULL AND text != ''").select(*id_cols, "field", F.explode(raw_patterns(F.col("text"))).alias("pattern"))


def findings_of_requests(nodes: DataFrame, tasks: DataFrame, session: str = "session_id") -> DataFrame:
    """A row per finding of a request: in its nodes (session, path, label, value), and in what it asks for (session,
    task_instruction), which counts as a field `text` of `task_instruction`."""
    inside = findings(nodes, [session, "path"], ["label", "value"])
    asked = findings(tasks.select(session, F.lit("task_instruction").alias("path"), F.col("task_instruction").alias("text")), [session, "path"], ["text"])
    return inside.unionByName(asked)


def reports(found: DataFrame, session: str = "session_id") -> DataFrame:
    """How many findings a request has, and which patterns; a request without findings has no row."""
    return found.groupBy(session).agg(F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set("pattern")).alias("patterns"))


def describe(path: Column, field: Column, pattern: Column) -> Column:
    return F.format_string("%s.%s matches %s", path, field, pattern)


def scrub(records: DataFrame, fields: list[str]) -> DataFrame:
    """Each leaking field becomes a marker as a whole; other fields stay. Row by row: no join with the findings."""
    return judged(records, fields, "redact").drop("verdict", "patterns")


def judged(records: DataFrame, fields: list[str], policy: str = "reject") -> DataFrame:
    """`records` with `patterns`, what was found as `field: pattern` in order, and `verdict`: clean, rejected, or scrubbed, with a
    marker for each leaking field. Any policy but `redact` rejects. Each pattern is tried once a field."""
    names = {f: f"found_{i}" for i, f in enumerate(fields)}
    found = records.withColumns({n: raw_patterns(F.coalesce(F.col(f), F.lit(""))) for f, n in names.items()})
    named = lambda f, n: F.transform(F.col(n), lambda p: F.concat(F.lit(f"{f}: "), p))
    found = found.withColumn("patterns", F.concat(*[named(f, n) for f, n in names.items()]))
    verdict = F.when(F.size("patterns") == 0, "clean").otherwise("scrubbed" if policy == "redact" else "rejected")
    out = found.withColumn("verdict", verdict)
    if policy == "redact":
        out = out.withColumns({f: F.when(F.size(n) > 0, F.lit(REDACTED)).otherwise(F.col(f)) for f, n in names.items()})
    return out.drop(*names.values())


def enforce(records: DataFrame, fields: list[str], policy: str = "reject") -> DataFrame:
    """`records` with `verdict`: clean, rejected, or scrubbed. Any policy but `redact` rejects."""
    return judged(records, fields, policy).drop("patterns")
