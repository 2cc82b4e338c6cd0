"""The library's registered queries over the synthetic tables and fixtures."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, text, validators
from ..functions.folds import match_spans
from ..operators import boxes, detect, evaluate, ingress, perception, planning, redact, rules
from ..sources import html, records
from ..streaming import gate, sessions
from ..tables import dealt, shared
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Query:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


documents, conversations, pages, events, labels, lineitem, customer = (_table(t) for t in ("documents", "conversations", "pages", "events", "labels", "lineitem", "customer"))


def _values(df: DataFrame, id_col: str, column: str, pattern: str, check=None) -> DataFrame:
    """Valid matches of a pattern, one row each."""
    out = df.select(id_col, F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("value"))
    return out.where(check(F.col("value"))) if check else out


def pii_email_spans(spark: SparkSession, sf: str) -> DataFrame:
    return redact.email_spans(documents(spark, sf), "doc_id", "text", rules.EMAIL)


def pii_email_counts_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("lang", F.when(F.col("text").contains("@"), F.regexp_count("text", F.lit(rules.EMAIL))).otherwise(0).alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("emails"))


def pii_card_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _values(documents(spark, sf), "doc_id", "text", rules.CARD, validators.is_payment_card)


def pii_phone_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _values(documents(spark, sf), "doc_id", "text", rules.PHONE, validators.is_phone)


def pii_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _values(documents(spark, sf), "doc_id", "text", rules.DOB)


def pii_dob_context(spark: SparkSession, sf: str) -> DataFrame:
    """Dates where the surroundings speak of birth; the gate comes before the matcher."""
    said = conversations(spark, sf).select("conv_id", "turn", F.concat_ws(" ", "role", F.when(F.col("turn") == 1, "born 1990-01-31 or 5/6/77"), "text").alias("text"))
    gated = said.where(F.col("text").rlike(r"(?i)birth|\bdob\b|born"))
    return gated.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(rules.DOB), F.lit(0))).alias("value"))


IDENTITIES = ("xABCDE1234F ABCDE1234F, FGHIJ5678K.", "MERD0001234 and merd0001234", "123-45-6789 000-12-3456 666-12-3456 912-34-5678 123-00-4567 123-45-0000", "2345 6789 0124 and 234567890125", "no number")


def pii_identity_values(spark: SparkSession, sf: str) -> DataFrame:
    """Identity numbers in all documents, and in a few texts with numbers that are nearly right, whose ids are negative."""
    said = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(IDENTITIES)], "id BIGINT, text STRING")
    rows = documents(spark, sf).select(F.col("doc_id").cast("bigint").alias("id"), "text").union(said)
    parts = [_values(rows, "id", "text", p, c).withColumn("type", F.lit(k)) for k, p, c in (("pan", rules.PAN, None), ("ifsc", rules.IFSC, None), ("ssn", rules.SSN, None), ("aadhaar", rules.AADHAAR, validators.is_aadhaar))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detect_text(documents(spark, sf).select("doc_id", "text"), "text")


def pii_all_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.type", "s.tier", "s.detector", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = _resolved(spark, sf)
    return found.select("doc_id", F.size("spans").alias("n"), redact.redact_text(found, "text").alias("text"))


def redact_email_partial(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.folds import apply_spans

    docs = documents(spark, sf).where(F.col("text").contains("@")).select("doc_id", "text", match_spans(F.col("text"), rules.EMAIL).alias("spans")).where(F.size("spans") > 0)
    done = F.transform("spans", lambda s: F.struct(s["start"], s["end"], text.partial_email(s["value"]).alias("replacement")))
    return docs.select("doc_id", apply_spans(F.col("text"), done).alias("text"))


def pii_doc_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "lang", "source", F.coalesce(F.col("text").rlike("@") & F.col("text").rlike(rules.EMAIL), F.lit(False)).alias("email"))
    rows = docs.join(labels(spark, sf).select("doc_id", "quality", "toxic"), "doc_id", "left")
    return rows.groupingSets([[], [F.col("lang")], [F.col("source")]], "lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("email").alias("with_email"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


def session_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversations(spark, sf).select("conv_id", "turn", F.col("role").alias("kind"), text.token_key("role", "text", F.lit("path")).alias("key"))
    return redact.number_tokens(rows, "conv_id", "kind", "key", ["turn"]).select("conv_id", "turn", "kind", "token")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.col("source").alias("label"), F.col("text").alias("value"))


def ingress_findings(spark: SparkSession, sf: str) -> DataFrame:
    return ingress.findings(_records(spark, sf), ["doc_id"], ["label", "value"]).select("doc_id", "field", "pattern", ingress.describe(F.col("doc_id").cast("string"), F.col("field"), F.col("pattern")).alias("said"))


def ingress_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return ingress.scrub(_records(spark, sf), ["label", "value"])


def ingress_policy(spark: SparkSession, sf: str) -> DataFrame:
    return ingress.enforce(_records(spark, sf), ["label", "value"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("records"))


BODIES = ('{"session_id": "s", "dom_summary": []}', '{"session_id": "s", "raw_screenshot": "x", "a": 1}', '{"task_instruction": "t"}', "not json", "[1]", '{"session_id": null}')


def strict_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a request, of which the assistant's have a key too many and each fifth turn lacks its session, and a
    few bodies that are none."""
    session = F.when(F.col("turn") % 5 != 4, F.col("conv_id").cast("string"))
    body = F.to_json(F.struct(session.alias("session_id"), F.col("text").alias("task_instruction"), F.when(F.col("role") == "assistant", F.col("role")).alias("role")))
    turns = conversations(spark, sf).select(F.concat_ws(":", "conv_id", "turn").alias("id"), body.alias("body"))
    rows = turns.union(spark.createDataFrame([(f"body:{i}", b) for i, b in enumerate(BODIES)], "id STRING, body STRING"))
    return ingress.strict(rows, "body").select("id", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"), "accepted")


def _named(spark: SparkSession, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes, those of the fixture by default, and their detections with tokens. What is detected is kept by the session, which
    makes it when it is first read and again where an executor is lost; no file outlives it."""
    nodes = fixtures.nodes(spark) if nodes is None else nodes
    found = detect.detect_nodes(nodes).persist()
    return found.select(*nodes.columns), redact.tokens_for(found)


def node_detections(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detections(detect.detect_nodes(fixtures.nodes(spark))).select("path", "field", "type", "tier", "detector", "confidence", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def sanitised_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, named = _named(spark)
    return redact.refuse_leaks(redact.sanitise(nodes, named)).select("node_seq", "path", "role", "label", "value")


def redaction_manifest(spark: SparkSession, sf: str) -> DataFrame:
    nodes, named = _named(spark)
    return redact.manifest(nodes, named).select("node_seq", "id", "type", "tier", "dom_path", "masking", "detector", "confidence")


def gate_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The gate on the nodes as they came: what it would refuse."""
    return redact.violations(fixtures.nodes(spark).select("snapshot_id", "path", "label", F.coalesce("value", "text").alias("value")))


def leak_audit(spark: SparkSession, sf: str) -> DataFrame:
    nodes, named = _named(spark)
    return redact.leak_audit(redact.sanitise(nodes, named), fixtures.leak_spec(spark))


def _requests_of(nodes: DataFrame, named: DataFrame, session: Column) -> DataFrame:
    """A request per session, the fixture's or a page: at most MOST_NODES nodes each, in page order, and the manifest."""
    summary = redact.sanitise(nodes, named).groupBy(session.alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_seq", "path", "role", "label", "value"))), lambda n: F.struct(n["path"], n["role"], n["label"], n["value"])).alias("dom_summary"))
    rows = redact.manifest(nodes, named)
    listed = rows.groupBy(session.alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_seq", "id", "type", "tier", "dom_path", "masking"))), lambda m: F.struct(m["id"], m["type"], m["tier"], m["dom_path"], m["masking"])).alias("redaction_manifest"))
    none = F.array().cast(listed.schema["redaction_manifest"].dataType)
    return summary.join(listed, "session_id", "left").withColumns({"redaction_manifest": F.coalesce("redaction_manifest", none), "task_instruction": F.lit("Sign in"), "prior_actions": F.array().cast(f"array<{planning.ACTION}>")})


def _requests(spark: SparkSession) -> DataFrame:
    return _requests_of(*_named(spark), F.lit("s1"))


def _page_named(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _named(spark, html.snapshots(pages(spark, sf)))


def page_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    nodes, named = _page_named(spark, sf)
    return redact.sanitise(nodes, named).select(F.col("snapshot_id").cast("bigint").alias("page_id"), "node_seq", "path", "role", "label", "value")


def page_manifest(spark: SparkSession, sf: str) -> DataFrame:
    nodes, named = _page_named(spark, sf)
    return redact.manifest(nodes, named).select(F.col("snapshot_id").cast("bigint").alias("page_id"), "node_seq", "id", "type", "tier", "dom_path", "masking", "detector")


def page_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What the gate would refuse of the pages as they came."""
    nodes = html.snapshots(pages(spark, sf))
    found = redact.violations(nodes.select("snapshot_id", "path", "label", F.coalesce("value", "text").alias("value")))
    return found.select(F.col("snapshot_id").cast("bigint").alias("page_id"), "path", "field", "detector")


def page_plans(spark: SparkSession, sf: str) -> DataFrame:
    """What the rule planner does on each page, as far as every action may run; a page without a form has no rows."""
    judged = planning.rules_constrained(redact.page_requests(detect.detect_nodes(html.snapshots(pages(spark, sf)))))
    return judged.select(F.col("session_id").cast("bigint").alias("page_id"), "position", "action", "selector", "value_ref", "rejection")


#: A file of customers holds some 20 bytes a row, and each becomes a page of 2 KB.
PAGES_A_TASK = 2000


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    """A page of HTML for each customer: an account form whose controls and terms speak of what they hold, with values made of
    the customer's own numbers."""
    c = dealt(customer(spark, sf).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), PAGES_A_TASK)
    key, name, money = F.col("c_custkey").cast("string"), F.regexp_replace("c_name", "#0*", " "), F.floor(F.col("c_acctbal").cast("double") * 100).cast("bigint")
    pad = lambda x, n: F.lpad(x, n, "0")
    controls = {
        "text\" name=\"login\" autocomplete=\"username": F.concat(F.lit("user"), key),
        "password\" id=\"pin": F.concat(F.lit("secret"), key),
        "email\" id=\"mail": F.concat(F.lit("user"), key, F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.org")),
        "tel\" id=\"mobile": F.concat(F.lit("98765"), pad(key, 5)),
        "text\" autocomplete=\"one-time-code": pad(key, 6),
        "text\" autocomplete=\"cc-number": F.concat(F.lit("4000 0000 "), pad(key, 8)),
        "text\" autocomplete=\"cc-csc": pad(F.substring(key, 1, 3), 3),
        "text\" autocomplete=\"cc-exp": F.lit("11/31"),
        "text\" name=\"aadhaar": F.concat(F.lit("2345"), pad(key, 8)),
        "text\" placeholder=\"PAN": F.concat(F.lit("ABCDE"), pad(F.substring(key, 1, 4), 4), F.lit("F")),
        "text\" name=\"ssn": F.concat(F.lit("123-45-"), pad(F.substring(key, 1, 4), 4)),
        "text\" aria-label=\"Passport number": F.concat(F.lit("P"), pad(key, 7)),
        "text\" autocomplete=\"street-address": F.concat(key, F.lit(" Main Road")),
        "text\" autocomplete=\"bday": F.lit("1990-01-31"),
    }
    terms = {"Account number": F.concat(F.lit("30"), pad(key, 12)), "IFSC": F.concat(F.lit("KOTN0"), pad(F.substring(key, 1, 6), 6)), "Account holder": name, "Balance": money.cast("string")}
    inputs = [F.concat(F.lit(f'<input type="{a}" value="'), v, F.lit('">')) for a, v in controls.items()]
    listed = [F.concat(F.lit(f"<dt>{t}</dt><dd>"), v, F.lit("</dd>")) for t, v in terms.items()]
    note = F.concat(F.lit("<textarea id=\"note\">Write to "), F.lower("c_mktsegment"), key, F.lit("@example.net about ABCDE1234F, 123-45-6789 or KOTN0004417.</textarea>"))
    page = F.concat(F.lit("<!doctype html><title>Account</title><body><form>"), *inputs, note, F.lit("</form><dl>"), *listed, F.lit("</dl><button id=\"go\">Sign in</button>"))
    return c.select(F.col("c_custkey").alias("page_id"), page.alias("html"))


def _form_named(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _named(spark, html.snapshots(_forms(spark, sf)))


def form_detections(spark: SparkSession, sf: str) -> DataFrame:
    """What is found in every customer's form: attribute rules of all kinds, and patterns in its note."""
    found = detect.detections(detect.detect_nodes(html.snapshots(_forms(spark, sf))))
    return found.select(F.col("snapshot_id").cast("bigint").alias("page_id"), "field", "type", "tier", "detector", "confidence", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def form_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    nodes, named = _form_named(spark, sf)
    clean = redact.refuse_leaks(redact.sanitise(nodes, named))
    return clean.select(F.col("snapshot_id").cast("bigint").alias("page_id"), "node_seq", "role", "label", "value")


def form_manifest(spark: SparkSession, sf: str) -> DataFrame:
    nodes, named = _form_named(spark, sf)
    return redact.manifest(nodes, named).select(F.col("snapshot_id").cast("bigint").alias("page_id"), "id", "type", "tier", "masking", "detector", "confidence")


def form_plans(spark: SparkSession, sf: str) -> DataFrame:
    """What the rule planner does on each form, as far as every action may run."""
    judged = planning.rules_constrained(redact.page_requests(detect.detect_nodes(html.snapshots(_forms(spark, sf)))))
    return judged.select(F.col("session_id").cast("bigint").alias("page_id"), "position", "action", "value_ref", "rejection")


def plan_constrain(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([*fixtures.PLANS], "session_id STRING, n INT, action STRING, selector STRING, value STRING, value_ref STRING")
    plans = rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "action", "selector", "value", "value_ref"))), lambda a: F.struct(a["action"], a["selector"], a["value"], a["value_ref"])).alias("actions"))
    return planning.constrain(plans, _requests(spark)).select("position", "action", "rejection")


def plan_rules(spark: SparkSession, sf: str) -> DataFrame:
    return planning.rule_planner(_requests(spark)).select("session_id", F.posexplode("actions").alias("position", "a"), "requires_client_secret").select("session_id", "position", "a.action", "a.selector", "a.value_ref", "requires_client_secret")


def plan_message(spark: SparkSession, sf: str) -> DataFrame:
    requests = _requests(spark)
    return requests.select("session_id", planning.user_message(requests).alias("message"))


def plan_resolved(spark: SparkSession, sf: str) -> DataFrame:
    vault = spark.createDataFrame([("username", "ada"), ("password", "pw")], "slot STRING, value STRING")
    actions = plan_rules(spark, sf).select("position", "action", "selector", F.lit(None).cast("string").alias("value"), "value_ref")
    return planning.resolve_references(actions, vault).select("position", "action", "selector", "text")


def executor_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return planning.run_prefix(events(spark, sf), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "event_type")


def debounce_last(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.debounced(events(spark, sf), "user_id", "ts", F.col("event_id"), "6 hours").select("user_id", F.col("last").alias("event_id"), F.col("events").alias("n"))


def activity_ring(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 60").select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


def prior_actions(spark: SparkSession, sf: str) -> DataFrame:
    rows = planning.prior_actions(events(spark, sf), "user_id", ["ts", "event_id"], "event_type", 3)
    return rows.select("event_id", F.array_join("prior", ",").alias("prior"))


def last_capture(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


def selector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages(spark, sf).select(F.col("page_id"), F.lower(text.host_label("url")).alias("host"))
    return planning.one_match(rows, ["host"]).select("page_id", "host", "lookup")


def _number(name: str, by: float) -> Column:
    return F.col(name).cast("double") * by


def _line() -> Column:
    """A number for each order line; order and line alone aren't unique."""
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line as a box that a detector found on its part's screen: the type is its return flag."""
    at = F.array(_number("l_quantity", 4), _number("l_discount", 1000), _number("l_quantity", 4) + 60 + _number("l_linenumber", 10), _number("l_discount", 1000) + 40 + _number("l_tax", 300))
    seq = _line()
    return lineitem(spark, sf).select(F.col("l_partkey").alias("screen_id"), seq.alias("seq"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("tier"), (F.col("l_extendedprice") / 100000).alias("confidence"), geometry.rounded(at).alias("bbox"))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line as the box that should have been found, somewhat off the other, on most of the screens."""
    at = F.array(_number("l_quantity", 4) + _number("l_linenumber", 3), _number("l_discount", 1000), _number("l_quantity", 4) + 60 + _number("l_linenumber", 12), _number("l_discount", 1000) + 30 + _number("l_tax", 500))
    item = _line()
    screen = F.when(F.col("l_suppkey") == 1, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return lineitem(spark, sf).select(screen.alias("screen_id"), item.alias("item_idx"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("tier"), geometry.rounded(at).alias("bbox"))


def iou_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes of each screen that overlap."""
    p = _predictions(spark, sf).select("screen_id", "type", "seq", F.col("bbox").alias("b_bbox"))
    t = _truth(spark, sf).select("screen_id", "type", "item_idx", F.col("bbox").alias("a_bbox"))
    pairs, a, b = boxes.meeting(t, p, ["screen_id", "type"]), F.col("a_bbox"), F.col("b_bbox")
    return pairs.select("screen_id", "seq", "item_idx", F.round(geometry.iou(a, b), 9).alias("iou"), F.round(geometry.containment(a, b), 9).alias("inside"))


def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.match_screens(_predictions(spark, sf), _truth(spark, sf))


def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(greedy_match(spark, sf))


def eval_prf(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of a rule, documents over 500 characters are good, against the labels."""
    said = F.col("n_chars") > 500
    rows = documents(spark, sf).join(labels(spark, sf), "doc_id").select(F.when(said & (F.col("quality") == 1), "tp").when(said, "fp").when(F.col("quality") == 1, "fn").alias("outcome"), F.col("toxic").alias("tier"), F.col("lang").alias("type")).where("outcome IS NOT NULL")
    return evaluate.confusion(rows)


def eval_unscorable(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.unscorable(_truth(spark, sf), _predictions(spark, sf))


def redaction_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.redaction_precision(_predictions(spark, sf), _truth(spark, sf))


def _face_passes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as faces that a model saw, a part's on one image: the lines of status F in the whole frame, the others in a
    region that starts at the part's own offset."""
    rows = _predictions(spark, sf).select(F.col("screen_id").alias("image_id"), "seq", "confidence", "tier", "bbox")
    seen = rows.select("image_id", F.col("seq").alias("i"), text.half_up("confidence", 3).alias("score"), "tier", "bbox")
    offset = F.array(F.pmod("image_id", F.lit(40)).cast("double"), F.pmod("image_id", F.lit(25)).cast("double"))
    return seen.where("tier = 1").drop("tier"), seen.where("tier = 2").drop("tier").withColumn("offset", offset)


def nms_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Both passes as one, in the frame's own places, and of faces that cover one another the surest."""
    return perception.merged(*_face_passes(spark, sf), least=0.3).select("image_id", "i", "score")


def _face_rows(spark: SparkSession, sf: str) -> DataFrame:
    return redact.faces(perception.numbered_faces(perception.merged(*_face_passes(spark, sf), least=0.3)))


def face_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The faces that are kept as manifest rows."""
    return _face_rows(spark, sf).select("snapshot_id", "id", "type", "tier", "masking", "detector", "confidence")


def face_regions(spark: SparkSession, sf: str) -> DataFrame:
    """What is painted over them."""
    return redact.regions(_face_rows(spark, sf)).select("snapshot_id", "masking", *[F.col("bbox")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


def perception_timings(spark: SparkSession, sf: str) -> DataFrame:
    """What a capture's passes took, in milliseconds to two places: the events of a user by kind."""
    return perception.timings(events(spark, sf), ["user_id"], "event_type", "value", ("view", "click", "error"))


def blur_regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predictions(spark, sf).select(F.col("screen_id").alias("image_id"), F.col("seq").alias("i"), geometry.blur_region(F.col("bbox"), F.lit(2.0), F.lit(440), F.lit(160)).alias("r"))
    return rows.where("r IS NOT NULL").select("image_id", "i", "r.*")


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_type", F.col("value").alias("capture"), (F.col("value") * 2).alias("network"))
    out = evaluate.percentiles(rows, ["capture", "network"], ["event_type"])
    return out.select("event_type", "stage", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def latency_budget(spark: SparkSession, sf: str) -> DataFrame:
    return latency_percentiles(spark, sf).where("stage = 'total'").select("event_type", evaluate.gate(F.col("p95"), F.lit(100.0), most=True).alias("verdict"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = sessions.windowed_counts(events(spark, sf), "ts", "event_type", "value", "1 day")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def event_windows_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = sessions.windowed_counts(events(spark, sf), "ts", "event_type", "value", "2 days", "1 day")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def _stream(spark: SparkSession, sf: str, table: str = "events") -> DataFrame:
    """A table's files as a stream, some of them a batch."""
    return spark.readStream.schema(_table(table)(spark, sf).schema).option("maxFilesPerTrigger", 16).parquet(f"{sf}/{table}.parquet*")


def stream_tokens(spark: SparkSession, sf: str) -> DataFrame:
    items = _stream(spark, sf).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("key"))
    out = shared(spark, "tokens")
    sessions.run_available(sessions.session_tokens(items), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("session", "seq", "type", "token")


def stream_resets(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of sessions that start anew at each error."""
    kind = F.when(F.col("event_type") == "error", "reset").otherwise(F.col("event_type"))
    items = _stream(spark, sf).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("props").alias("key"))
    out = shared(spark, "resets")
    sessions.run_available(sessions.session_tokens(items), f"{out}/rows", f"{out}/state")
    return spark.read.schema(sessions.TOKENS).parquet(f"{out}/rows").select("session", "seq", "type", "token")


def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each burst that is over, as the watermark knows it: a day may pass before a late event doesn't count."""
    rows = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = shared(spark, "bursts")
    sessions.run_available(sessions.debounced(rows, "user_id", "ts", F.col("event_id"), "6 hours", late="1 day"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("user_id", F.col("last").alias("event_id"), F.col("events").alias("n"))


def stream_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as inspected pages, other events as what is open then."""
    kind = F.when(F.col("event_type") == "click", "inspected").otherwise("open")
    items = _stream(spark, sf).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("value"))
    out = shared(spark, "stale")
    sessions.run_available(sessions.stale_changes(items), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("session", "seq", "stale")


def _gated(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    rows = _stream(spark, sf, "documents").select("doc_id", F.col("source").alias("label"), F.col("text").alias("value"))
    out = shared(spark, "gate")
    gate.run_gate(rows, f"{out}/rows", f"{out}/state", ["doc_id"], ["label", "value"], policy)
    return spark.read.parquet(f"{out}/rows").select("doc_id", "verdict", "label", "value", F.array_join("patterns", ", ").alias("patterns"))


def stream_gate_reject(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf, "reject")


def stream_gate_redact(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf, "redact")


def stream_histories(spark: SparkSession, sf: str) -> DataFrame:
    items = _stream(spark, sf).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    out = shared(spark, "histories")
    sessions.run_available(sessions.histories(items, 3), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("session", "seq", F.array_join("prior", ",").alias("prior"))


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = shared(spark, "windows")
    sessions.run_available(sessions.windowed_counts(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 day", late="3 days"), f"{out}/rows", f"{out}/state", "update")
    rows = sessions.latest(spark.read.parquet(f"{out}/rows").drop("number"), ["start", "event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def html_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return html.nodes(pages(spark, sf)).select("page_id", "node_seq", "path", "tag", "role", "label", "text", "interactive", "truncated")


def html_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What each page says, in order: the text of all its elements, or the name of those that can be acted on."""
    rows = html.nodes(pages(spark, sf), most=sys.maxsize)
    said = rows.select("page_id", "node_seq", "tag", F.coalesce("text", "label").alias("said")).where("said IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("node_seq"))  # a page, which one row held
    return said.select("page_id", place.alias("place"), "tag", "said")


def html_elements(spark: SparkSession, sf: str) -> DataFrame:
    return html.parse(pages(spark, sf)).where(F.col("tag").isin("a", "article", "h1")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", text.host_label("url").alias("host"), text.is_restricted_url("url").alias("restricted"), text.is_restricted_url(F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("about:"), "url"))).alias("seen_restricted"))


def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", text.is_stable_id(F.regexp_replace("c_name", "#", "_")).alias("stable"), text.masked_preview("c_name").alias("preview"))


def rounding(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", text.half_up(-F.col("value") * 10).alias("near"), text.half_up(F.col("value") / 7, 2).alias("near_2"), text.half_up(-F.col("value") / 7, 3).alias("near_3"), text.half_up(F.col("value") / 7, 4).alias("near_4"), text.elapsed_label(F.floor("value")).alias("ago"), text.html_escape(F.concat(F.lit('<"'), "props")).alias("html"))


def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's value as a bar of at most 20 blocks, where 100 fills it."""
    return events(spark, sf).select("event_id", text.bar(F.least("value", F.lit(100.0)), F.lit(100.0), 20).alias("bar"))


def data_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names as data URLs, some without a head, and what is read back from them."""
    encoded = F.base64(F.encode("c_name", "UTF-8"))
    url = F.when(F.col("c_mktsegment") == "BUILDING", encoded).otherwise(F.concat(F.lit("data:text/"), F.lower("c_mktsegment"), F.lit(";base64,"), encoded))
    return customer(spark, sf).select("c_custkey", text.data_url_mime(url).alias("mime"), F.decode(text.data_url_bytes(url), "UTF-8").alias("name"))


def latency_report(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each kind of event as lines of text."""
    found = latency_percentiles(spark, sf).where("stage = 'capture'").withColumns({c: text.half_up(c, 3) for c in ("p50", "p95")})
    return records.report_lines(found, "event_type", ["p50", "p95"])


def user_chips(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by predicate, and the label that a panel shows for them."""
    out = events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.count_distinct("event_type").alias("kinds"))
    return out.select("user_id", "failed", "bought", "kinds", F.concat(F.col("failed").cast("string"), F.when(F.col("failed") == 1, " failure").otherwise(" failures")).alias("chip"))


def ingress_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each source as a request whose nodes are its documents and whose task is its first text."""
    nodes = documents(spark, sf).select(F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("label"), F.col("text").alias("value"))
    tasks = documents(spark, sf).groupBy(F.col("source").alias("session_id")).agg(F.min("text").alias("task_instruction"))
    return ingress.reports(ingress.findings_of_requests(nodes, tasks)).select("session_id", "findings", F.array_join("patterns", ",").alias("patterns"))


def find_one(spark: SparkSession, sf: str) -> DataFrame:
    hosts = pages(spark, sf).select(text.host_label("url").alias("host"))
    wanted = hosts.distinct().union(spark.createDataFrame([("nowhere.example",)], "host STRING"))
    return planning.find_one(wanted, hosts.withColumnRenamed("host", "path"), "host", "path")


def plan_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a planned action, of which those up to a user's first error were carried out."""
    done = executor_prefix(spark, sf).withColumn("ok", F.col("event_type") != "error")
    return planning.with_outcomes(events(spark, sf).select("user_id", "event_id"), done, ["user_id", "event_id"])


def saved_values(spark: SparkSession, sf: str) -> DataFrame:
    changes = events(spark, sf).select("user_id", F.col("event_type").alias("slot"), F.when(F.col("value") >= 10, F.col("props")).alias("value"), "ts", "event_id")
    return planning.saved_values(changes, ["user_id"], "slot", "value", ["ts", "event_id"])


def _entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*fixtures.ENTRIES], "snapshot_id STRING, id STRING, type STRING, tier INT, masking STRING, detector STRING")


def manifest_malformed(spark: SparkSession, sf: str) -> DataFrame:
    return redact.malformed(_entries(spark))


def manifest_undeclared(spark: SparkSession, sf: str) -> DataFrame:
    return redact.undeclared(_entries(spark), spark.createDataFrame([*fixtures.EXPECTED], "snapshot_id STRING, type STRING"))


def latency_stage_sum(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_type", F.col("value").alias("capture"), (F.col("value") * 2).alias("network"))
    return evaluate.stage_sums(evaluate.percentiles(rows, ["capture", "network"], ["event_type"]), ["event_type"]).select("event_type", F.round("p50_sum", 4).alias("p50_sum"), "stages")


def box_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes made of the numbers of order lines: rounded, tested against a screen, and carried to device pixels."""
    number = lambda c, by: F.col(c).cast("double") * by if by >= 1 else F.col(c).cast("double") / round(1 / by)
    box = geometry.rounded(F.array(number("l_quantity", 10), number("l_discount", 1000), number("l_extendedprice", 0.01), number("l_tax", 3000)))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", box.alias("b"))
    device = geometry.rescaled(F.col("b"), F.lit(1.5), F.lit(450), F.lit(120))
    return rows.select("l_orderkey", "l_linenumber", geometry.on_screen(F.col("b"), F.lit(300), F.lit(80)).alias("on_screen"), geometry.wide_enough(F.col("b")).alias("wide"), F.array_join(F.transform(device, lambda x: x.cast("int").cast("string")), ",").alias("device"))


def face_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([*fixtures.FACE_OUTPUT], "image_id STRING, s ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    found = rows.select("image_id", F.explode(geometry.decoded(F.col("s"), F.col("b"), F.lit(0.6), (90.0, 45.0), (10.0, 20.0))).alias("f"))
    return found.select("image_id", "f.i", "f.score", F.array_join(F.transform("f.bbox", lambda x: x.cast("int").cast("string")), ",").alias("box"))


def measured_labels(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.measured(spark.createDataFrame([*fixtures.HAND_LABELS], "snapshot_id STRING, item INT, selector STRING, needle STRING"), fixtures.nodes(spark))


CONTEXTS = {"bank_account": "Account number", "passport": "Passport", "otp": "Verification code"}


def pii_context_values(spark: SparkSession, sf: str) -> DataFrame:
    """What the patterns that need a context find in the documents where the context is given."""
    parts = []
    for kind, said in CONTEXTS.items():
        rule = [r for r in rules.PATTERNS if r.type == kind]
        found = detect.detect_text(documents(spark, sf).select("doc_id", "text").withColumn("said", F.lit(said)), "text", "said", rule)
        parts.append(found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.type", "s.value"))
    return parts[0].union(parts[1]).union(parts[2])


def page_detections(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.detections(detect.detect_nodes(html.snapshots(pages(spark, sf))))
    return found.select(F.col("snapshot_id").cast("bigint").alias("page_id"), "path", "field", "type", "tier", "detector", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    pii_email_spans, pii_email_counts_by_lang, pii_card_valid, pii_phone_valid, pii_dates, pii_dob_context, pii_identity_values, pii_all_resolved, pii_doc_profile, redact_documents, redact_email_partial, session_tokens,
    ingress_findings, ingress_scrub, ingress_policy, strict_schema, node_detections, sanitised_nodes, redaction_manifest, gate_violations, leak_audit, plan_constrain, plan_rules, plan_message, plan_resolved,
    executor_prefix, debounce_last, activity_ring, prior_actions, last_capture, selector_lookup, iou_matrix, greedy_match, eval_confusion, eval_prf, eval_unscorable, redaction_precision, nms_faces, face_manifest, face_regions, perception_timings, blur_regions,
    latency_percentiles, latency_budget, event_windows, event_windows_sliding, stream_tokens, stream_resets, stream_histories, stream_windows, stream_debounce, stream_stale, stream_gate_reject, stream_gate_redact, html_nodes, html_texts, html_elements, form_detections, form_sanitised, form_manifest, form_plans, page_hosts, page_detections, page_sanitised, page_manifest, page_violations, page_plans, pii_context_values, ingress_requests, find_one, plan_outcomes,
    saved_values, manifest_malformed, manifest_undeclared, latency_stage_sum, box_geometry, face_decode, measured_labels, stable_ids, rounding, event_bars, data_urls, latency_report, user_chips,
)}
