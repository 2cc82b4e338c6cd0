"""Plans: which proposed actions may run, a rule planner, the planner's message, and what an executor would run."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_marker, let
from .ordered import up_to_first, with_prior

ACTION = "struct<action:string,selector:string,value:string,value_ref:string>"
#: Verbs, those that need a selector, and the forms of references and slots.
VERBS = ("click", "type", "focus", "scroll", "read", "wait")
NEEDS_SELECTOR = ("click", "type", "focus")
VALUE_REF = r"^user_saved:[A-Za-z0-9_.\-]{1,64}\z"
SLOT = r"^[A-Za-z0-9_.-]{1,64}\z"


class Planner(Protocol):
    """What proposes actions: from requests (session_id, dom_summary, redaction_manifest) to (session_id, actions)."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


def _allowed() -> list[Column]:
    """Of a request its paths and, of these, those of tier 1."""
    return [F.transform("dom_summary", lambda n: n["path"]).alias("paths"), F.transform(F.filter("redaction_manifest", lambda m: (m["tier"] == 1) & (F.coalesce(m["dom_path"], F.lit("")) != "")), lambda m: m["dom_path"]).alias("tier1")]


def constrain(plans: DataFrame, requests: DataFrame, session: str = "session_id") -> DataFrame:
    """One row per proposed action: its position, and `rejection`, the first rule that it breaks, or null if it may run.

    A selector must be among the paths of its session's dom_summary; a tier-1 path takes references, never literals.
    """
    rows = plans.select(session, F.posexplode("actions").alias("position", "a")).select(session, "position", "a.*")
    return _judged(rows.join(requests.select(session, *_allowed()), session, "left"), session)


def rules_constrained(requests: DataFrame, session: str = "session_id") -> DataFrame:
    """What `constrain` says of the rule planner's plans, where plan and request are still one row."""
    rows = requests.select(session, "dom_summary", "redaction_manifest", *_allowed())
    # an expression, not a column: of a column Spark would infer a filter, and evaluate it once more below all that made it
    return _judged(rows.select(session, "paths", "tier1", F.posexplode(rule_actions()).alias("position", "a")).select(session, "paths", "tier1", "position", "a.*"), session)


def _judged(rows: DataFrame, session: str) -> DataFrame:
    selector = F.coalesce("selector", F.lit(""))
    known = F.coalesce(F.array_contains("paths", selector), F.lit(False))
    both = F.col("value").isNotNull() == F.col("value_ref").isNotNull()
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    rule = (
        F.when(~F.col("action").isin(*VERBS) | F.col("action").isNull(), F.lit("unknown verb"))
        .when(F.col("action").isin(*NEEDS_SELECTOR) & (selector == ""), F.lit("requires a selector"))
        .when((selector != "") & ~known, F.concat(F.lit("selector "), quoted("selector"), F.lit(" was not in dom_summary")))
        .when(F.coalesce(has_marker("value"), F.lit(False)), F.lit("value echoes a redaction marker"))
        .when(F.col("value_ref").isNotNull() & ~F.col("value_ref").rlike(VALUE_REF), F.concat(F.lit("value_ref "), quoted("value_ref"), F.lit(" is not a user_saved reference")))
        .when((F.col("action") == "type") & both, F.lit("needs exactly one of value / value_ref"))
        .when((F.col("action") == "type") & F.col("value").isNotNull() & F.coalesce(F.array_contains("tier1", selector), F.lit(False)), F.concat(F.col("selector"), F.lit(" is a tier 1 field and must use value_ref, not a literal")))
    )
    label = F.concat(F.lit("action["), F.col("position").cast("string"), F.lit("] "), F.coalesce("action", F.lit("?")), F.lit(": "))
    return rows.select(session, "position", "action", "selector", "value", "value_ref", F.concat(label, rule).alias("rejection"))


def executable(judged: DataFrame, session: str = "session_id") -> DataFrame:
    """Per session the actions that may run, in order, and whether any needs a saved secret."""
    kept = judged.where("rejection IS NULL").groupBy(session).agg(F.array_sort(F.collect_list(F.struct("position", "action", "selector", "value", "value_ref"))).alias("k"), F.bool_or(F.col("value_ref").isNotNull()).alias("requires_client_secret"))
    return kept.select(session, F.transform("k", lambda x: F.struct(x["action"], x["selector"], x["value"], x["value_ref"]).cast(ACTION)).alias("actions"), "requires_client_secret")


def rule_actions() -> Column:
    """A sign-in form's fields and button, first ones in page order; none where there is no form."""
    hint = lambda n, words: F.coalesce(n["label"], F.lit("")).rlike("(?i)" + words)
    tier1 = F.transform(F.filter("redaction_manifest", lambda m: m["tier"] == 1), lambda m: m["dom_path"])
    user = let(tier1, lambda t: F.filter("dom_summary", lambda n: n["role"].isin("textbox", "searchbox") & ~F.coalesce(F.array_contains(t, n["path"]), F.lit(False)) & hint(n, r"user|customer|login|account\s*id|email")))
    submit = F.filter("dom_summary", lambda n: (n["role"] == "button") & hint(n, r"sign\s*in|log\s*in|submit|continue|next"))
    secret = F.filter("redaction_manifest", lambda m: m["type"] == "password")
    first = lambda a, f: F.try_element_at(a, F.lit(1))[f]
    none = F.lit(None).cast("string")
    act = lambda verb, path, ref: F.when(F.coalesce(path, F.lit("")) != "", F.struct(F.lit(verb).alias("action"), path.alias("selector"), none.alias("value"), ref.alias("value_ref")).cast(ACTION))
    found = F.struct(first(user, "path").alias("user"), first(secret, "dom_path").alias("secret"), first(submit, "path").alias("submit"))
    return let(found, lambda x: F.array_compact(F.array(act("type", x["user"], F.lit("user_saved:username")), act("type", x["secret"], F.lit("user_saved:password")), act("click", x["submit"], none))))


def rule_planner(requests: DataFrame, session: str = "session_id") -> DataFrame:
    """A plan of `rule_actions` for each request."""
    return requests.select(session, rule_actions().alias("actions")).withColumn("requires_client_secret", F.exists("actions", lambda a: a["value_ref"].isNotNull()))


def user_message(requests: DataFrame) -> Column:
    """The planner's message: sections joined by a blank line, nulls left out, empty sections omitted. Its JSON is compact."""
    brief = F.transform("redaction_manifest", lambda m: F.struct(m["id"].alias("id"), m["type"].alias("type"), m["tier"].alias("tier"), m["dom_path"].alias("dom_path"), m["masking"].alias("masking")))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("## Task\n"), F.coalesce("task_instruction", F.lit(""))),
        F.concat(F.lit("## dom_summary\n"), F.to_json("dom_summary")),
        F.when(F.size("redaction_manifest") > 0, F.concat(F.lit("## redaction_manifest\n"), F.to_json(brief))),
        F.when(F.size("prior_actions") > 0, F.concat(F.lit("## prior_actions (already executed this session)\n"), F.to_json("prior_actions"))),
        F.lit("Plan the next actions."),
    )


def resolve_references(actions: DataFrame, vault: DataFrame) -> DataFrame:
    """Actions with `text`: the saved value of a reference, else the literal. A reference without its slot is an error
    when read. The vault is one user's slots; Spark broadcasts it by its size."""
    slot = F.regexp_replace("value_ref", "^user_saved:", "")
    saved = vault.select(F.col("slot").alias("v_slot"), F.col("value").alias("v_value"))
    joined = actions.join(saved, slot == F.col("v_slot"), "left")
    missing = F.raise_error(F.concat(F.lit("nothing is saved for "), F.col("value_ref")))
    return joined.withColumn("text", F.when(F.col("value_ref").isNull(), F.col("value")).when(F.col("v_value").isNull(), missing.cast("string")).otherwise(F.col("v_value"))).drop("v_slot", "v_value")


def valid_slot(name: Column) -> Column:
    """A name under which a value may be saved."""
    return F.coalesce(name.rlike(SLOT), F.lit(False))


def saved_values(changes: DataFrame, keys: list[str], slot: str, value: str, order: list[str]) -> DataFrame:
    """What is saved after all changes: each slot's newest value. A null value deletes its slot; changes of slots whose
    name isn't allowed don't count."""
    newest = changes.where(valid_slot(F.col(slot))).groupBy(*keys, slot).agg(F.max_by(F.struct(value), F.struct(*order)).alias("c"))
    return newest.select(*keys, slot, f"c.{value}").where(F.col(value).isNotNull())


def with_outcomes(actions: DataFrame, outcomes: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """Planned actions with what became of each: ok, failed, or not reached where there is no outcome."""
    return actions.join(outcomes.select(*keys, F.col(ok).alias("o_ok")), keys, "left").withColumn("outcome", F.when(F.col("o_ok"), "ok").when(~F.col("o_ok"), "failed").otherwise("not reached")).drop("o_ok")


def run_prefix(events: DataFrame, by: str, order: list[str], failed: Column) -> DataFrame:
    """Per group, events up to and with the first that failed."""
    return up_to_first(events, [by], order, failed)


def prior_actions(events: DataFrame, by: str, order: list[str], value: str, most: int) -> DataFrame:
    """Each event with the `most` events before it in its group, oldest first."""
    return with_prior(events, [by], order, value, most)


def find_one(selectors: DataFrame, nodes: DataFrame, selector: str, path: str) -> DataFrame:
    """Selectors with `lookup`: ok where one node has that path, else what to tell."""
    n = nodes.groupBy(F.col(path).alias("f_path")).agg(F.count(F.lit(1)).alias("f_n"))
    joined = selectors.join(n, F.col(selector) == F.col("f_path"), "left")
    many = F.format_string("%d elements match %s: refusing to guess", F.col("f_n"), F.col(selector))
    return joined.withColumn("lookup", F.when(F.col("f_n") == 1, "ok").when(F.col("f_n") > 1, many).otherwise(F.concat(F.lit("No element matches "), F.col(selector)))).drop("f_path", "f_n")


#: Planners by name, the choice that a deployment makes.
PLANNERS: dict[str, Planner] = {"rules": rule_planner}


def one_match(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Nodes with `lookup`: ok where the selector finds exactly one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return nodes.withColumn("lookup", F.when(n == 1, "ok").otherwise(F.format_string("selector matched %d elements", n)))
