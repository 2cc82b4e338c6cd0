"""Redaction: session tokens, sanitised nodes, the manifest, and the gate that refuses what still leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import apply_spans, match_spans
from ..functions.text import blank_to_null, has_marker, let, masking_for, replacement_for, token_key
from .detect import listed, of_node
from .ordered import numbered
from .rules import PATTERNS, matches


def number_tokens(items: DataFrame, session: str, kind: str, key: str, order: list[str]) -> DataFrame:
    """`items` with `token`: within a session and type, keys are numbered as they first appear."""
    first = items.groupBy(F.col(session).alias("t_session"), F.col(kind).alias("t_kind"), F.col(key).alias("t_key")).agg(F.min(F.struct(*order)).alias("t_first"))
    ranked = numbered(first, ["t_session", "t_kind"], ["t_first"], "t_n").drop("t_first")
    on = F.col(session).eqNullSafe(F.col("t_session")) & F.col(kind).eqNullSafe(F.col("t_kind")) & F.col(key).eqNullSafe(F.col("t_key"))
    token = F.concat(F.upper(F.col(kind)), F.lit("_"), F.col("t_n").cast("string"))
    return items.join(ranked, on).withColumn("token", token).drop("t_session", "t_kind", "t_key", "t_n")


def redact_text(df: DataFrame, text: str, spans: str = "spans", id_col: str = "doc_id") -> Column:
    """A text column with its spans replaced; tier-2 values without a session are numbered within the row."""
    kinds = F.transform(F.col(spans), lambda s: F.concat_ws(":", s["type"], F.regexp_replace(F.lower(s["value"]), "[^a-z0-9@.]", "")))

    def token(s: Column) -> Column:
        own = F.array_distinct(F.filter(kinds, lambda k: k.startswith(F.concat(s["type"], F.lit(":")))))
        at = F.array_position(own, F.concat_ws(":", s["type"], F.regexp_replace(F.lower(s["value"]), "[^a-z0-9@.]", "")))
        return F.concat(F.upper(s["type"]), F.lit("_"), at.cast("string"))

    done = F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), replacement_for(s["type"], s["tier"], token(s), s["value"]).alias("replacement")))
    return F.when(F.size(spans) > 0, apply_spans(F.col(text), done)).otherwise(F.col(text))


def tokens_for(found: DataFrame, session: str = "session_id") -> DataFrame:
    """The detections of nodes with keys and tokens; content is the span's text, or the field's for a whole claim."""
    field = F.element_at(F.create_map(F.lit("value"), F.col("value"), F.lit("text"), F.col("text"), F.lit("label"), F.col("label")), F.col("field"))
    head = ["snapshot_id", session, "node_seq", "path", "bbox", "value", "text", "label"]
    order = F.create_map(F.lit("value"), F.lit(0), F.lit("text"), F.lit(1), F.lit("label"), F.lit(2))
    out = listed(found, head).drop("seq")
    content = F.when(F.col("start").isNull(), field).otherwise(F.substring(field, F.col("start") + 1, F.col("end") - F.col("start")))
    # the data field first, then the label; within a field by place
    out = out.withColumns({"content": blank_to_null(content), "field_order": F.element_at(order, F.col("field")), "place": F.coalesce("start", F.lit(-1))})
    out = out.withColumn("token_key", token_key("type", "content", "path"))
    return number_tokens(out, session, "type", "token_key", ["snapshot_id", "node_seq", "field_order", "place"]).withColumn("replacement", replacement_for("type", "tier", "token", "content"))


def sanitise(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """path, role, label and value of each node with detections replaced: a whole claim replaces the field, spans are
    spliced. A password that was never read is declared by its marker."""
    keys = ["snapshot_id", "node_seq"]
    marks = named.groupBy(*keys, "field").agg(F.max(F.when(F.col("start").isNull(), F.col("replacement"))).alias("whole"), F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end", "replacement"))).alias("spans"))
    by_field = marks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("whole", "spans")))).alias("marks"))
    rows = nodes.join(by_field, keys, "left")

    def clean(field: str) -> Column:
        m = F.try_element_at(F.col("marks"), F.lit(field))
        return F.when(m.isNull(), F.col(field)).when(m["whole"].isNotNull(), m["whole"]).otherwise(apply_spans(F.col(field), m["spans"]))

    data = F.when(F.col("tag").isin("input", "textarea", "select"), clean("value")).otherwise(clean("text"))
    value = F.when((F.col("value_omitted") == "password") & blank_to_null("value").isNull(), "[REDACTED:PASSWORD]").otherwise(data)
    return rows.select(*keys, "path", "role", clean("label").alias("label"), value.alias("value"))


def manifest(nodes: DataFrame, named: DataFrame, session: str = "session_id") -> DataFrame:
    """What was redacted: one row per detection, and one for each password that was never read."""
    listed = named.select("snapshot_id", "node_seq", "field_order", "place", F.col("token").alias("id"), "type", "tier", "bbox", F.col("path").alias("dom_path"), masking_for("type", "tier").alias("masking"), "detector", "confidence")
    seen = named.where(F.col("type") == "password").select("snapshot_id", "node_seq").distinct()
    unread = nodes.where((F.col("value_omitted") == "password") & blank_to_null("value").isNull()).join(seen, ["snapshot_id", "node_seq"], "left_anti")
    # numbered by path, as passwords that were claimed are; a threshold that claims one claims all
    unread = number_tokens(unread.withColumns({"kind": F.lit("password"), "key": token_key(F.lit("password"), F.lit(None).cast("string"), "path")}), session, "kind", "key", ["snapshot_id", "node_seq"])
    declared = unread.select("snapshot_id", "node_seq", F.lit(0).alias("field_order"), F.lit(-1).alias("place"), F.col("token").alias("id"), F.lit("password").alias("type"), F.lit(1).alias("tier"), "bbox", F.col("path").alias("dom_path"), F.lit("blackbox").alias("masking"), F.lit("capture:value-omitted").alias("detector"), F.lit(1.0).alias("confidence"))
    return listed.unionByName(declared)


def page_requests(found: DataFrame) -> DataFrame:
    """A row per page that is a session of its own, with what a planner is told: `dom_summary`, its nodes in order as `sanitise`
    leaves them, and `redaction_manifest`, what `manifest` lists. The nodes of a page are few enough for one row, so they meet once;
    tokens are numbered, fields replaced and unread passwords declared inside the row."""
    field = lambda d: F.when(d["field"] == "value", F.col("value")).when(d["field"] == "text", F.col("text")).otherwise(F.col("label"))
    content = lambda d: blank_to_null(F.when(d["start"].isNull(), field(d)).otherwise(F.substring(field(d), d["start"] + 1, d["end"] - d["start"])))
    rank = lambda d: F.when(d["field"] == "value", 0).when(d["field"] == "text", 1).otherwise(2)
    mark = lambda d, x: F.struct(rank(d).alias("field_order"), F.coalesce(d["start"], F.lit(-1)).alias("place"), *[d[c].alias(c) for c in ("field", "start", "end", "type", "tier")], x.alias("content"), token_key(d["type"], x, "path").alias("key"))
    marks = F.array_sort(F.transform(of_node(), lambda d: let(content(d), lambda x: mark(d, x))))
    data = F.when(F.col("data_field") == "value", F.col("value")).otherwise(F.col("text"))
    unread = F.coalesce((F.col("value_omitted") == "password") & blank_to_null("value").isNull(), F.lit(False))
    node = F.struct("node_seq", "path", "role", "label", data.alias("data"), "data_field", unread.alias("unread"), marks.alias("marks"))
    rows = found.select("snapshot_id", node.alias("node")).groupBy("snapshot_id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))

    of_all = lambda f: F.flatten(F.transform("nodes", lambda n: F.transform(n["marks"], lambda m: f(n, m))))
    kinds, keys = (F.array_distinct(of_all(lambda n, m, c=c: m[c])) for c in ("type", "key"))
    own = lambda keys, t: F.filter(keys, lambda k: k.startswith(F.concat(t, F.lit(":"))) | k.startswith(F.concat(t, F.lit("@"))))
    # by `let`, as a column that lambdas name may be put into them and worked out for each of their values
    numbers = let(keys, lambda keys: F.transform(kinds, lambda t: F.transform(own(keys, t), lambda k, i: F.struct(k.alias("key"), F.concat(F.upper(t), F.lit("_"), (i + 1).cast("string")).alias("token")))))
    tokens = F.map_from_entries(F.flatten(numbers))

    def clean(n: Column, tokens: Column, name: Column, x: Column) -> Column:
        own = F.filter(n["marks"], lambda m: m["field"] == name)
        done = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), replacement_for(m["type"], m["tier"], F.try_element_at(tokens, m["key"]), m["content"]).alias("replacement"))
        first = lambda o: F.get(o, F.lit(0))
        return let(F.transform(own, done), lambda o: F.when(F.size(o) == 0, x).when(first(o)["start"].isNull(), first(o)["replacement"]).otherwise(apply_spans(x, o)))

    value = lambda n, tokens: F.when(n["unread"], "[REDACTED:PASSWORD]").otherwise(clean(n, tokens, n["data_field"], n["data"]))
    summary = lambda tokens: F.transform("nodes", lambda n: F.struct(n["path"].alias("path"), n["role"].alias("role"), clean(n, tokens, F.lit("label"), n["label"]).alias("label"), value(n, tokens).alias("value")))
    entry = lambda n, token, kind, tier: F.struct(n["node_seq"].alias("node_seq"), token.alias("id"), kind.alias("type"), tier.alias("tier"), n["path"].alias("dom_path"), masking_for(kind, tier).alias("masking"))
    password, by_path = F.lit("password"), lambda n: token_key(F.lit("password"), F.lit(None).cast("string"), n["path"])
    left = F.filter("nodes", lambda n: n["unread"] & ~F.exists(n["marks"], lambda m: m["type"] == password))
    number = lambda unread, n: F.array_position(F.array_distinct(F.transform(unread, by_path)), by_path(n)).cast("string")
    declared = let(left, lambda unread: F.transform(unread, lambda n: entry(n, F.concat(F.lit("PASSWORD_"), number(unread, n)), password, F.lit(1))))
    entries = lambda tokens: F.array_sort(F.concat(of_all(lambda n, m: entry(n, F.try_element_at(tokens, m["key"]), m["type"], m["tier"])), declared))
    brief = lambda tokens: F.transform(entries(tokens), lambda m: F.struct(*[m[c].alias(c) for c in ("id", "type", "tier", "dom_path", "masking")]))
    told = let(tokens, lambda t: F.struct(summary(t).alias("dom_summary"), brief(t).alias("redaction_manifest")))
    return rows.select(F.col("snapshot_id").alias("session_id"), told.alias("told")).select("session_id", "told.*")


def faces(found: DataFrame) -> DataFrame:
    """Faces as manifest rows: blurred, keyed by their number in the capture."""
    return found.select("snapshot_id", "face", F.concat(F.lit("FACE_"), (F.col("face") + 1).cast("string")).alias("id"), F.lit("face").alias("type"), F.lit(1).alias("tier"), "bbox", F.lit("").alias("dom_path"), F.lit("blur").alias("masking"), F.lit("onnx:ultraface-rfb320").alias("detector"), F.col("score").alias("confidence"))


def with_faces(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A manifest with the faces of its captures, after all that stands in the page."""
    return rows.unionByName(faces(found).drop("face"), allowMissingColumns=True)


def regions(rows: DataFrame) -> DataFrame:
    """What is painted over: the manifest's entries that have a place on the screen."""
    return rows.where("bbox IS NOT NULL").select("snapshot_id", "bbox", "masking")


def malformed(rows: DataFrame) -> DataFrame:
    """Manifest entries that lack an id, type, masking or detector, or whose tier is neither 1 nor 2."""
    lacks = F.lit(False)
    for c in ("id", "type", "masking", "detector"):
        lacks = lacks | blank_to_null(c).isNull()
    return rows.where(lacks | ~F.coalesce(F.col("tier").isin(1, 2), F.lit(False)))


def undeclared(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Of the types that a capture should declare (snapshot_id, type) those that its manifest lacks."""
    return expected.join(rows.select("snapshot_id", "type").distinct(), ["snapshot_id", "type"], "left_anti")


def clobbered(clean: DataFrame) -> DataFrame:
    """Labels, terms and headings whose own text became a marker: they name data and are none."""
    return clean.where(F.col("path").rlike(r"(?:^|> )(?:label|dt|th)(?:[:#.][^ >]*)?\z") & F.coalesce(has_marker("value"), F.lit(False)))


def violations(clean: DataFrame) -> DataFrame:
    """What a sanitised payload must not hold: context-free patterns in labels or values, whatever the threshold was."""
    free = [r for r in PATTERNS if r.context is None]
    hits = F.array_compact(F.array(*[F.when(matches(r, F.col(f)), F.struct(F.lit(f).alias("field"), F.lit(r.detector).alias("detector"))) for f in ("label", "value") for r in free]))
    return clean.select("snapshot_id", "path", F.explode(hits).alias("v")).select("snapshot_id", "path", "v.*")


def refuse_leaks(clean: DataFrame) -> DataFrame:
    """`clean` as it is, or an error when it is read and a row leaks: the closed gate."""
    def leaks(row: Column) -> Column:
        bad = F.lit(False)
        for r in PATTERNS:
            if r.context is None:
                for f in ("label", "value"):
                    bad = bad | matches(r, row[f])
        return bad

    # Spark moves the filter below what makes the fields; they are worked out once for all patterns
    bad = let(F.struct("label", "value"), leaks)
    return clean.where(F.when(bad, F.raise_error(F.concat(F.lit("raw personal data at "), F.col("path"))).isNull()).otherwise(True))


def leak_audit(clean: DataFrame, spec: DataFrame) -> DataFrame:
    """Planted needles (fixture, kind, name, needle) against a fixture's output: mustNotAppear, mustAppear, redactedField,
    knownGap. The spec is a table of the test's author, small beside any output."""
    text = F.concat_ws("\n", "label", "value")
    per = clean.select(F.col("snapshot_id").alias("fixture"), text.alias("text"), "path", "value")
    hit = F.when(F.col("kind") == "redactedField", (F.col("path") == F.col("needle")) & F.coalesce(F.col("value").rlike(r"\[[A-Z_]+[_:]|\*\*\*@"), F.lit(False))).otherwise(F.contains(F.col("text"), F.col("needle")))
    joined = spec.join(per, "fixture", "left").groupBy("fixture", "kind", "name", "needle").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))
    verdict = F.when(F.col("kind") == "knownGap", F.when(F.col("found"), "known gap").otherwise("gap closed")).when(F.col("found") == (F.col("kind") != "mustNotAppear"), "ok").otherwise("FAIL")
    return joined.withColumn("verdict", verdict)


def email_spans(docs: DataFrame, id_col: str, text: str, pattern: str) -> DataFrame:
    """One row per match of a pattern, with code-point offsets."""
    return docs.where(F.col(text).contains("@")).select(id_col, F.explode(match_spans(F.col(text), pattern)).alias("s")).select(id_col, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
