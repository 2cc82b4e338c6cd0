"""Personal data by weak supervision, with DataFrame operations only.

Fixed patterns give the base spans. Looser patterns give further candidates, and labelers (patterns, gazetteers and
context words) vote on all of them: yes, no or abstain. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern is personal data; a logistic span classifier, fitted
to those likelihoods, decides on the looser candidates. Counts cover all candidates of all documents, and only the
table of distinct patterns comes to the driver: votes and length classes bound its size, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive loops and look-behinds only spare the matcher needless tries; a card's
#: look-arounds keep whole runs of 16 to 19 digits, the only ones that can be valid.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes of the same kinds.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,64}+ ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,12}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.)-])(?<!\+[0-9][\x20-])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: What a text must contain, one of them at least, before its matcher runs: every match holds one.
NEEDS = {"email": ("@",), "phone": ("+",)}
LOOSE_NEEDS = {"email": ("at",), "phone": ("-", "."), "card": ("3",)}

#: Gazetteers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "mx", "us", "ca")
CUES = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write"),
    "ip": ("ip", "server", "host", "address", "adresse", "login"),
    "card": ("card", "visa", "amex", "mastercard", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "appel", "anruf", "telefon", "llame"),
}
AGAINST = ("version", "isbn", "order", "invoice", "ref", "sku", "serial", "ticket", "part no")
LABELERS = ("pattern", "shape", "gazetteer", "cue", "counter_cue", "border")
AROUND = 40

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def located(text: Column, pattern: str, found: Column, kind: str) -> Column:
    """Spans of `found`, the pattern's matches in order: the pieces between them tell where they stand."""
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda piece, m: F.struct(F.length(piece).alias("gap"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """What a match must satisfy beyond its pattern."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["value"])


def votes(span: Column, before: Column, after: Column) -> Column:
    """1 yes, 0 no, -1 abstain, for each labeler; `before` and `after` are the span's surroundings."""
    kind, value = span["kind"], span["value"]
    lower = F.lower(before)
    yes, no, pass_ = F.lit(1), F.lit(0), F.lit(-1)
    digits = _digits(value)
    same = digits.rlike(r"^([0-9])\1*$")
    by_kind = lambda make: F.coalesce(*[F.when(kind == k, make(k)) for k in KINDS])
    gazetteer = F.coalesce(
        F.when(kind == "email", F.when(F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS), yes).otherwise(no)),
        F.when(kind == "card", F.when(F.substring(digits, 1, 1).between("3", "6"), yes).otherwise(no)),
        F.when(kind == "phone", F.when(F.substring(digits, 1, 1) == "0", no).otherwise(pass_)),
        F.when(value.rlike(r"^(?:0|127|255)\."), no).otherwise(pass_),
    )
    return F.array(
        F.when(by_kind(lambda k: value.rlike("^(?:" + BASE[k] + ")$") & valid(k, value)), yes).otherwise(pass_),
        F.when((kind != "email") & same, no).when((kind == "phone") & value.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}$"), yes).when((kind == "card") & F.call_function("luhn_check", digits), yes).when(kind == "card", no).otherwise(pass_),
        gazetteer,
        F.when(by_kind(lambda k: lower.rlike("(?:^|[^a-z])(?:" + "|".join(CUES[k]) + ")")), yes).otherwise(pass_),
        F.when(lower.rlike("(?:^|[^a-z])(?:" + "|".join(AGAINST) + ")[^a-z]"), no).otherwise(pass_),
        F.when(before.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]"), no).otherwise(yes),
    )


def candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with `v_base` and `v_loose`, arrays of spans; the looser ones with their votes, none on a base span."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    nothing = F.array().cast("array<string>")
    need = lambda k, table: reduce(Column.__or__, [text.contains(x) for x in table[k]]) if k in table else F.lit(True)
    out = docs.withColumns({f"v_m_{k}": F.when(need(k, NEEDS), F.regexp_extract_all(text, F.lit(BASE[k]), F.lit(0))).otherwise(nothing) for k in KINDS} | {f"v_l_{k}": F.when(need(k, LOOSE_NEEDS), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(nothing) for k, p in LOOSE.items()})
    base = F.concat(*[F.filter(located(text, BASE[k], F.col(f"v_m_{k}"), k), _valid(k)) for k in KINDS])
    out = out.withColumn("v_base", base)
    loose = F.filter(F.concat(*[located(text, p, F.col(f"v_l_{k}"), k) for k, p in LOOSE.items()]), lambda s: ~F.exists("v_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    surround = lambda s: (F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - AROUND), F.least(F.lit(AROUND), s["start"])), F.substring(text, s["end"] + 1, F.lit(AROUND)))
    judged = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), votes(s, *surround(s)).alias("votes")))
    out = out.withColumn("v_loose", loose).withColumns({"v_base": judged(F.col("v_base")), "v_loose": judged(F.col("v_loose"))})
    return out.drop(*[f"v_m_{k}" for k in KINDS], *[f"v_l_{k}" for k in LOOSE])


@dataclass
class Model:
    reliability: dict[str, tuple[float, float]]  # how often a labeler says yes where it votes: on personal data, and elsewhere
    prior: float
    weights: list[float]


def _features(kind: str, vote: list[int], size: int) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], *[float(v == 1) for v in vote], *[float(v == 0) for v in vote], float(size == 0), float(size == 2)]


def size_class(length: Column) -> Column:
    return F.when(length < 12, 0).when(length < 20, 1).otherwise(2)


def fit(counts: list[tuple[str, list[int], int, int]], rounds: int = 25, steps: int = 60) -> Model:
    """From (kind, votes, length class, how many): reliabilities and prior by EM, then the classifier by Newton steps."""
    yes = {"pattern": (0.95, 0.3), "shape": (0.8, 0.3), "gazetteer": (0.8, 0.4), "cue": (0.9, 0.3), "counter_cue": (0.05, 0.3), "border": (0.9, 0.5)}
    a = [yes[n][0] for n in LABELERS]
    b = [yes[n][1] for n in LABELERS]
    prior = 0.5
    total = sum(n for *_, n in counts)
    if not total:
        return Model(yes, prior, [0.0] * len(_features("", [-1] * len(LABELERS), 1)))
    likely = [0.5] * len(counts)
    for _ in range(rounds):
        for i, (_, vote, _, _) in enumerate(counts):
            s = math.log(prior / (1 - prior))
            for j, v in enumerate(vote):
                if v >= 0:
                    s += math.log((a[j] if v else 1 - a[j]) / (b[j] if v else 1 - b[j]))
            likely[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
        # a few made-up votes at the starting rates keep rarely heard labelers where they began
        for j, name in enumerate(LABELERS):
            up, ups, down, downs = 20 * yes[name][0], 20.0, 20 * yes[name][1], 20.0
            for p, (_, vote, _, n) in zip(likely, counts, strict=True):
                if vote[j] >= 0:
                    up, ups, down, downs = up + n * p * vote[j], ups + n * p, down + n * (1 - p) * vote[j], downs + n * (1 - p)
            a[j], b[j] = min(0.99, max(0.01, up / ups)), min(0.99, max(0.01, down / downs))
        prior = min(0.95, max(0.05, (10 + sum(n * p for p, (*_, n) in zip(likely, counts, strict=True))) / (20 + total)))
    rows = [(_features(k, v, c), n / total, p) for p, (k, v, c, n) in zip(likely, counts, strict=True)]
    w = [0.0] * len(rows[0][0])
    for _ in range(steps):  # gradient steps on the diagonal's scale; ridge 1e-3
        g, h = [1e-3 * x for x in w], [1e-3] * len(w)
        for x, n, p in rows:
            y = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(c * d for c, d in zip(w, x, strict=True))))))
            for i, c in enumerate(x):
                if c:
                    g[i] += n * (y - p) * c
                    h[i] += n * y * (1 - y) * c * c
        w = [x - 0.3 * c / d for x, c, d in zip(w, g, h, strict=True)]
    return Model(dict(zip(LABELERS, zip(a, b, strict=True), strict=True)), prior, w)


def score(span: Column, model: Model) -> Column:
    vote = span["votes"]
    size = size_class(span["end"] - span["start"])
    parts = [F.lit(1), *[span["kind"] == k for k in KINDS], *[vote[j] == 1 for j in range(len(LABELERS))], *[vote[j] == 0 for j in range(len(LABELERS))], size == 0, size == 2]
    total = F.lit(0.0)
    for x, w in zip(parts, model.weights, strict=True):
        total = total + x.cast("double") * F.lit(float(w))
    return 1 / (1 + F.exp(-total))


def vote_counts(found: DataFrame) -> list[tuple[str, list[int], int, int]]:
    """How often each (kind, votes, length class) occurs: at most 4 * 3^6 * 3 rows."""
    spans = found.select(F.explode(F.concat("v_base", "v_loose")).alias("s")).select("s.kind", "s.votes", size_class(F.col("s.end") - F.col("s.start")).alias("size"))
    rows = spans.groupBy("kind", "votes", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["kind"], list(r["votes"]), r["size"], r["n"]) for r in rows)


def kept_spans(model: Model, threshold: float) -> Column:
    """Base spans and the looser ones that the classifier keeps, by kind as listed, then start."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    kept = lambda c, base: F.transform(F.filter(c, lambda s: F.lit(base) | (score(s, model) >= threshold)), lambda s: F.struct(F.element_at(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(base).alias("base"), score(s, model).alias("score"), s["value"].alias("value")))
    return F.transform(F.array_sort(F.concat(kept("v_base", True), kept("v_loose", False))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score"), s["value"].alias("value")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs`: the id and `spans`, an array of (kind, start, end, base, score, value) by kind as
    listed, then start. Base spans always stay; a looser candidate stays where the classifier gives `threshold`.

    Offsets count code points, ends are exclusive. A null or empty text has an empty array, repeated rows each get
    their row, an empty table gives none, and further columns are not read.
    """
    found = written(candidates(docs.select(F.col(id_col).alias("v_id"), F.col(text_col).alias("v_text")), "v_text").select("v_id", "v_base", "v_loose"), "pii")
    return found.select(F.col("v_id").alias(id_col), kept_spans(fit(vote_counts(found)), threshold).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` with each span of personal data in the text replaced by its kind in brackets; of overlapping spans the
    one that starts first, then the longest, is replaced. A null text stays null, a text without spans unchanged."""
    docs, back = set_aside(docs, ("v_",), (text_col,))
    found = candidates(docs, text_col)
    model = fit(vote_counts(found.select("v_base", "v_loose")))
    text = F.col(text_col).cast("string")
    spans = F.array_sort(F.transform(kept_spans(model, threshold), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["back"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))
    out = F.aggregate("v_spans", begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn("v_spans", spans).withColumn(text_col, F.when(F.size("v_spans") == 0, text).otherwise(out)).select(*docs.columns).withColumnsRenamed(back)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the hash of their list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return found.select(id_col, *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
