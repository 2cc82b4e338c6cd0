"""The detection cascade: attribute rules claim whole fields, patterns find spans in what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import match_spans, resolve_overlaps
from ..functions.text import blank_to_null
from .rules import DOM_RULES, PATTERNS, DomRule, PatternRule

SPAN = "struct<start:int,end:int,value:string,type:string,tier:int,detector:string,confidence:double,seq:int>"
CLAIM = "struct<type:string,tier:int,detector:string,confidence:double>"
LISTED = "struct<field:string,type:string,tier:int,detector:string,confidence:double,start:int,end:int,seq:int>"
KEPT = ("type", "tier", "detector", "confidence")
FIELDS = ("value", "text", "label")
#: Tags that label others, whose text isn't data, and tags whose data is their value.
STRUCTURAL = ("label", "dt", "th", "legend", "caption")
VALUED = ("input", "textarea", "select")


def context_string() -> Column:
    parts = [F.col("label"), F.col("context_label"), *[F.col(f"attrs.{a}") for a in ("name", "id", "placeholder", "aria_label", "autocomplete")]]
    return F.lower(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " "))


def data_field() -> Column:
    return F.when(F.col("tag").isin(*VALUED), "value").otherwise("text")


def claim(context: Column, rules: Sequence[DomRule] = DOM_RULES, threshold: float = 0.5) -> Column:
    """The rule that claims a node's data field, or null. Rules below the threshold are left out when the plan is made;
    the order of the rest (tier, confidence, listing) is fixed, so the first that holds is the best."""
    live = sorted((r for r in rules if r.confidence >= threshold), key=lambda r: (r.tier, -r.confidence))
    complete, kind = F.lower(F.coalesce("attrs.autocomplete", F.lit(""))), F.col("input_type")
    tests = [F.when(r.test(context, complete, kind), F.struct(F.lit(r.type).alias("type"), F.lit(r.tier).alias("tier"), F.lit(r.detector).alias("detector"), F.lit(r.confidence).alias("confidence"))) for r in live]
    return F.when(~((data_field() == "text") & F.coalesce(F.col("tag").isin(*STRUCTURAL), F.lit(False))), F.coalesce(*tests)) if tests else F.lit(None).cast(CLAIM)


def live_rules(rules: Sequence[PatternRule], threshold: float) -> list[PatternRule]:
    return [r for r in rules if r.confidence >= threshold]


def found_matches(text: Column, context: Column, r: PatternRule, digits: Column) -> Column:
    """What a rule's matcher finds in a text; cheap gates come before it. Only an address can do without a digit, so one look
    for `digits` spares a text all other matchers."""
    found = F.regexp_extract_all(text, F.lit(r.regex), F.lit(0))
    for gate in [text.contains(r.needs) if r.needs else digits] + [context.rlike(r.context)] * bool(r.context):
        found = F.when(gate, found)
    return F.coalesce(found, F.array().cast("array<string>"))


def found_spans(text: Column, matches: Sequence[Column], rules: Sequence[PatternRule]) -> Column:
    """Valid spans of all rules, overlaps resolved, from columns that hold each rule's matches. Without a rule there are none."""
    parts = [_labelled(match_spans(text, r.regex, m), r, seq) for seq, (r, m) in enumerate(zip(rules, matches, strict=True))]
    return resolve_overlaps(F.concat(*parts), f"array<{SPAN}>") if parts else F.array().cast(f"array<{SPAN}>")


def _labelled(spans: Column, r: PatternRule, seq: int) -> Column:
    kept = F.filter(spans, lambda s: (F.length(F.trim(s["value"])) > 0) & (F.coalesce(r.validate(s["value"]), F.lit(False)) if r.validate else F.lit(True)))
    return F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["value"], F.lit(r.type).alias("type"), F.lit(r.tier).alias("tier"), F.lit(r.detector).alias("detector"), F.lit(r.confidence).alias("confidence"), F.lit(seq).alias("seq")).cast(SPAN))


def detect_text(df: DataFrame, text: str, context: str | None = None, rules: Sequence[PatternRule] = PATTERNS, threshold: float = 0.5) -> DataFrame:
    """`df` with `spans`: what patterns find in a text column. Narrow: no row meets another."""
    said, around = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(context), F.lit("")) if context else F.lit("")
    live = live_rules(rules, threshold)
    names = [f"matches_{k}" for k in range(len(live))]
    # matches are a step of their own, so that each matcher runs once
    found = df.withColumn("has_digit", said.rlike("[0-9]"))
    found = found.withColumns({n: found_matches(said, around, r, F.col("has_digit")) for n, r in zip(names, live, strict=True)})
    return found.withColumn("spans", found_spans(said, [F.col(n) for n in names], live)).drop("has_digit", *names)


def detect_nodes(nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Page nodes with `whole`, the claim on the data field, and `spans`, per field what patterns find in the others."""
    out = nodes.withColumn("context", context_string()).withColumn("data_field", data_field())
    out = out.withColumn("whole", claim(F.col("context"), threshold=threshold))
    none, live = F.array().cast(f"array<{SPAN}>"), live_rules(PATTERNS, threshold)
    open_ = lambda f: blank_to_null(f).isNotNull() & ~(F.col("whole").isNotNull() & (F.col("data_field") == f))
    said = F.array(*[F.when(open_(f), F.col(f)).otherwise("") for f in FIELDS])
    # one expression for all fields; what holds neither a digit nor an @ meets no matcher
    own = lambda x: F.when(x.rlike("[0-9@]"), found_spans(x, [found_matches(x, F.col("context"), r, F.lit(True)) for r in live], live)).otherwise(none)
    return out.withColumn("spans", F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.transform(said, own)))


def of_node() -> Column:
    """All detections of a node: its field, what it is, and where it stands; without a start it claims the whole field."""
    whole = F.struct(F.col("data_field").alias("field"), *[F.col(f"whole.{c}").alias(c) for c in KEPT], *[F.lit(None).cast("int").alias(c) for c in ("start", "end")], F.lit(-1).alias("seq"))
    spans = F.transform(F.map_entries("spans"), lambda e: F.transform(e["value"], lambda s: F.struct(e["key"].alias("field"), *[s[c].alias(c) for c in (*KEPT, "start", "end", "seq")])))
    # an expression, not a column: of a column Spark would infer a filter, and evaluate it once more below all that made it
    return F.concat(F.when(F.col("whole").isNotNull(), F.array(whole)).otherwise(F.array().cast(f"array<{LISTED}>")), F.flatten(spans).cast(f"array<{LISTED}>"))


def listed(found: DataFrame, head: Sequence[str]) -> DataFrame:
    """The columns of `head` and one row per detection, in one pass."""
    return found.select(*head, F.explode(of_node()).alias("d")).select(*head, "d.*")


def detections(found: DataFrame) -> DataFrame:
    """One row per detection; a null span means the whole field."""
    rows = listed(found, ["snapshot_id", "node_seq", "path", "bbox"])
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    return rows.select("snapshot_id", "node_seq", "path", "bbox", "field", *KEPT, span.alias("span"), "seq")
