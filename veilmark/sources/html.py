"""Raw HTML to page nodes: a row for each element that says something, in document order.

Parsing is the one step that built-in functions can't express; it is a generator over a small tree builder, run inside
Arrow batches. What hangs on the rest of a page (labels, siblings, ids that stand once, the cap) is settled there
as well, so a page never leaves its task; roles, names and paths of the nodes are Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clip, is_stable_id, let
from .tree import Node, TreeBuilder

#: Subtrees that hold no content, and tags that people act on.
SKIPPED = ("script", "style", "noscript", "template", "meta", "link", "head", "title", "br", "hr")
INTERACTIVE = ("input", "select", "textarea", "button", "a", "summary", "details", "option", "label")
#: Roles by tag and by input type, and input types that browsers know; any other is text.
ROLES = {"button": "button", "select": "combobox", "textarea": "textbox", "img": "img", "video": "video", "form": "form", "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "aside": "complementary", "table": "table", "ul": "list", "ol": "list", "li": "listitem", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "option": "option", "summary": "button", "dialog": "dialog"}
INPUT_ROLES = {"button": "button", "submit": "button", "reset": "button", "image": "button", "checkbox": "checkbox", "radio": "radio", "range": "slider", "number": "spinbutton", "search": "searchbox", "file": "button", "hidden": "none"}
INPUT_TYPES = ("button", "checkbox", "color", "date", "datetime-local", "email", "file", "hidden", "image", "month", "number", "password", "radio", "range", "reset", "search", "submit", "tel", "text", "time", "url", "week")
MEDIA = ("img", "video", "canvas", "svg", "picture")
LABELLING = ("dt", "th", "label", "strong", "b")
#: Roles that people act on, elements that a label can stand for, elements that their own text names.
ACTING_ROLES = ("button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "listbox", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "tab", "switch", "slider", "spinbutton")
LABELLED = ("button", "input", "meter", "output", "progress", "select", "textarea")
NAMED = ("button", "a", "label", "option", "h1", "h2", "h3", "h4", "h5", "h6")
FIELDS = ("input", "select", "textarea")
#: Nodes of a page, characters of a text, and of a name or value, at most.
MOST_NODES, MOST_TEXT, MOST_LABEL = 400, 600, 200
#: Rows, and characters of HTML, after which the nodes of a few pages are handed on.
ROWS_A_BATCH, TEXT_A_BATCH = 1000, 1_000_000
SCHEMA = (
    "page_id bigint, node_seq int, parent int, tag string, own_text string, full_text string, attrs map<string,string>, "
    "ancestors array<struct<tag:string,id:string,once:boolean,nth:int,of:int>>, sibling_text string, labelled_by string, labels string, held string, interactive boolean, truncated boolean"
)
_BLANK = "\\s\u00a0\ufeff"
_SPACES = re.compile("[\t\n\f\r ]+")


def _text(node: Node) -> str:
    """All text in an element, of hidden parts too, but for templates, whose content is no part of the page."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag != "template" or x is node:
            todo += reversed(x.kids)
    return "".join(out)


def _acts(n: dict) -> bool:
    a = n["attrs"]
    role = a.get("role", "").split()
    return n["tag"] in INTERACTIVE or "tabindex" in a or "contenteditable" in a or "onclick" in a or bool(role) and role[0] in ACTING_ROLES


def _inside(n: dict, nodes: list[dict], tag: str) -> Iterator[dict]:
    """The nodes of a tag inside a node, in order."""
    k = n["seq"] + 1
    while k < n["end"]:
        if nodes[k]["tag"] == tag:
            yield nodes[k]
        k += 1


def _held(n: dict, nodes: list[dict]) -> str | None:
    """What a control holds: the content of a text area, the value of the option that a select starts with."""
    if n["tag"] == "textarea":
        return n["own"]
    if n["tag"] != "select":
        return None
    options = [*_inside(n, nodes, "option")]
    chosen = [o for o in options if "selected" in o["attrs"]]
    if not chosen and "multiple" not in n["attrs"] and n["attrs"].get("size", "1").strip() in ("", "0", "1"):
        shut = {o["seq"] for g in _inside(n, nodes, "optgroup") if "disabled" in g["attrs"] for o in _inside(g, nodes, "option")}
        chosen = [o for o in options if "disabled" not in o["attrs"] and o["seq"] not in shut][:1]
    if not chosen:
        return ""
    one = chosen[0 if "multiple" in n["attrs"] else -1]
    return one["attrs"]["value"] if "value" in one["attrs"] else _SPACES.sub(" ", _text(one["node"])).strip(" ")


def elements(html: str) -> list[dict]:
    """The elements of a page in order, each with what hangs on others: its place among siblings of its tag, the text of
    labels and of the sibling before it, what it holds, whether its id stands once, and whether it is part of the page's content."""
    nodes: list[dict] = []
    todo: list[tuple[Node, int | None, bool, dict | None]] = [(TreeBuilder.tree(html), None, False, None)]
    while todo:
        node, parent, shown, ended = todo.pop()
        if ended is not None:
            ended["end"] = len(nodes)
            continue
        shown = (shown or node.tag == "body") and node.tag not in SKIPPED
        n = {"seq": len(nodes), "node": node, "parent": parent, "tag": node.tag, "attrs": node.attrs, "own": "".join(k for k in node.kids if isinstance(k, str)), "shown": shown}
        nodes.append(n)
        todo.append((node, None, False, n))
        if node.tag != "template":
            todo += [(k, n["seq"], shown, None) for k in reversed(node.kids) if isinstance(k, Node)]
    families, last, ids, labels = {}, {}, {}, {}
    for n in nodes:
        family = families.setdefault((n["parent"], n["tag"]), [])
        family.append(n["seq"])
        n["nth"] = len(family)
        n["before"], last[n["parent"]] = last.get(n["parent"]), n["seq"]
        if n["attrs"].get("id"):
            ids.setdefault(n["attrs"]["id"], []).append(n["seq"])
    labelled = lambda n: n["tag"] in LABELLED and n["attrs"].get("type", "").lower() != "hidden"
    for n in nodes:
        if n["tag"] == "label":
            if "for" in n["attrs"]:
                of = nodes[ids[n["attrs"]["for"]][0]] if n["attrs"]["for"] in ids else None
            else:
                of = next((nodes[k] for k in range(n["seq"] + 1, n["end"]) if labelled(nodes[k])), None)
            if of is not None and labelled(of):
                labels.setdefault(of["seq"], []).append(n["seq"])
    said = lambda seqs: " ".join(_text(nodes[k]["node"]) for k in seqs)
    for n in nodes:
        n["of"] = len(families[(n["parent"], n["tag"])])
        ident = n["attrs"].get("id")
        n["once"] = bool(ident) and len(ids[ident]) == 1
        n["acts"] = _acts(n)
        n["sibling"] = said([n["before"]]) if n["before"] is not None and nodes[n["before"]]["tag"] in LABELLING else None
        n["by"] = said(ids[x][0] for x in n["attrs"].get("aria-labelledby", "").split() if x in ids) or None
        n["labels"] = said(labels[n["seq"]]) if n["tag"] in FIELDS and n["seq"] in labels else None
        n["held"] = _held(n, nodes)
    return nodes


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int | None = None) -> DataFrame:
    """A row per element of a page's body: its number in the document, its parent's, tag, own and whole text, attributes, its path of
    ancestors, itself included, what labels it and what it holds. With `most`, only the first so many of a page that can be acted on,
    show media or have own text; `truncated` tells that so many were there. Null and empty HTML has no elements."""
    blank = re.compile(f"[{_BLANK}]*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes = elements(html) if html else []
                told = [n for n in nodes if n["shown"] and (most is None or n["acts"] or n["tag"] in MEDIA or not blank.fullmatch(n["own"]))]
                steps = [{"tag": x["tag"], "id": x["attrs"].get("id"), "once": x["once"], "nth": x["nth"], "of": x["of"]} for x in nodes]
                for n in told[:most]:
                    up, path = n["seq"], []
                    while up is not None:
                        path.append(steps[up])
                        up = nodes[up]["parent"]
                    rows.append({"page_id": page, "node_seq": n["seq"], "parent": n["parent"], "tag": n["tag"], "own_text": n["own"], "full_text": _text(n["node"]) if n["tag"] in NAMED else None, "attrs": list(n["attrs"].items()), "ancestors": path, "sibling_text": n["sibling"], "labelled_by": n["by"], "labels": n["labels"], "held": n["held"], "interactive": n["acts"], "truncated": most is not None and len(told) >= most})
                held += len(html or "")
                if rows and (len(rows) >= ROWS_A_BATCH or held >= TEXT_A_BATCH):
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    step = pa.struct([("tag", pa.string()), ("id", pa.string()), ("once", pa.bool_()), ("nth", pa.int32()), ("of", pa.int32())])
    text = [(n, pa.string()) for n in ("tag", "own_text", "full_text")]
    out = pa.schema([("page_id", pa.int64()), ("node_seq", pa.int32()), ("parent", pa.int32()), *text, ("attrs", pa.map_(pa.string(), pa.string())), ("ancestors", pa.list_(step)), *[(n, pa.string()) for n in ("sibling_text", "labelled_by", "labels", "held")], ("interactive", pa.bool_()), ("truncated", pa.bool_())])
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)


def attr(name: str) -> Column:
    return blank_to_null(F.try_element_at(F.col("attrs"), F.lit(name)))


def input_type() -> Column:
    """Of an input what a browser takes its type for, null elsewhere."""
    said = F.lower(attr("type"))
    return F.when(F.col("tag") == "input", let(said, lambda x: F.when(x.isin(*INPUT_TYPES), x).otherwise("text")))


def role() -> Column:
    """The explicit role's first word, else by `input_type`, link target or tag."""
    kinds = F.create_map(*[F.lit(x) for kv in INPUT_ROLES.items() for x in kv])
    tags = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    explicit = blank_to_null(F.element_at(F.split(F.trim(attr("role")), r"\s+"), 1))
    by_type = F.coalesce(F.try_element_at(kinds, F.col("input_type")), F.lit("textbox"))
    return F.coalesce(explicit, F.when(F.col("tag") == "input", by_type).when(F.col("tag") == "a", F.when(F.map_contains_key("attrs", F.lit("href")), "link")).otherwise(F.try_element_at(tags, F.col("tag"))))


def held_value() -> Column:
    """What a control holds when its page has been read: a text area its content, a select the option that it starts with, an
    input its value; boxes without one hold "on", files and numbers that are none hold nothing."""
    said, kind = F.try_element_at(F.col("attrs"), F.lit("value")), F.col("input_type")
    number = F.when(said.rlike(r"^-?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), said)
    own = F.when(kind.isin("checkbox", "radio"), F.coalesce(said, F.lit("on"))).when(kind == "file", F.lit(None)).when(kind == "number", number).otherwise(said)
    return F.when(F.col("tag") == "input", own).when(F.col("tag").isin(*FIELDS), F.col("held"))


def css_path(most: int = 8) -> Column:
    """Segments from the element up to the first ancestor with a stable id that stands once in its page, at most `most`,
    joined top down."""
    anchored = lambda x: F.coalesce(x["once"] & is_stable_id(x["id"]), F.lit(False))
    segment = lambda x: F.when(x["anchored"], F.concat(x["tag"], F.lit("#"), x["id"])).when(x["of"] > 1, F.concat(x["tag"], F.lit(":nth-of-type("), x["nth"].cast("string"), F.lit(")"))).otherwise(x["tag"])
    chain = F.transform(F.filter("ancestors", lambda x: x["tag"] != "html"), lambda x: F.struct(anchored(x).alias("anchored"), *[x[c].alias(c) for c in ("tag", "id", "nth", "of")]))

    def joined(steps: Column) -> Column:
        first = F.array_position(F.transform(steps, lambda x: x["anchored"]), F.lit(True)).cast("int")
        cut = F.when(first > 0, F.least(first, F.lit(most))).otherwise(F.lit(most))
        return F.array_join(F.reverse(F.transform(F.slice(steps, F.lit(1), cut), segment)), " > ")

    return let(chain, joined)


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = MOST_NODES) -> DataFrame:
    """Elements that can be acted on, show media or have own text, the first `most` of a page, with role, name, value,
    path and `truncated`. What can be acted on or shows media has no text of its own: its name says it. Without a layout
    there are no boxes. Passwords are never read, not as a name either."""
    rows = parse(pages, id_col, html_col, most).withColumn("input_type", input_type())
    password = F.coalesce(F.col("input_type") == "password", F.lit(False))
    field = F.col("tag").isin(*FIELDS)
    name = lambda c: clip(c, MOST_LABEL)
    label = F.coalesce(name("labelled_by"), name(attr("aria-label")), F.when(field, F.coalesce(name("labels"), name(attr("placeholder")))), name(attr("alt")), name(attr("title")), F.when((F.col("tag") == "input") & ~password, name(attr("value"))), name("full_text"))
    attrs = F.struct(*[attr(a).alias(a.replace("-", "_")) for a in ("id", "name", "autocomplete", "placeholder", "aria-label", "alt", "title", "inputmode", "maxlength")])
    media = F.when(F.col("tag").isin(*MEDIA), F.col("tag"))
    text = F.when(~F.col("interactive") & media.isNull(), clip("own_text", MOST_TEXT))
    return rows.select("page_id", "node_seq", css_path().alias("path"), "tag", role().alias("role"), label.alias("label"), text.alias("text"), name("sibling_text").alias("context_label"), F.when(~password, name(held_value())).alias("value"), F.when(password & attr("value").isNotNull(), "password").alias("value_omitted"), "input_type", attrs.alias("attrs"), "interactive", media.alias("media"), "truncated")


def snapshots(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The nodes in the form that detection and redaction take: a page is its snapshot and its session, without boxes."""
    ident = F.col("page_id").cast("string")
    return nodes(pages, id_col, html_col).withColumns({"snapshot_id": ident, "session_id": ident, "bbox": F.lit(None).cast("array<double>")}).drop("page_id", "truncated")
