"""Ordered folds over the arrays of one row: spans of matches, overlaps, splices, suppression, greedy matching.

Each works inside a row, on what one text, image or screen holds, so none of them moves data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import containment, iou
from .text import let

SPANS = "array<struct<start:int,end:int,value:string>>"


def match_spans(text: Column, pattern: str, found: Column | None = None) -> Column:
    """All matches with their code-point offsets, ends exclusive: the pieces between matches tell where they stand.
    `found`: the matches, where a column already has them, so that they are sought once."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if found is None else found
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    def spans(m: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("value")))
        return F.when(F.size(m) > 0, F.aggregate(pairs, begin, step, lambda a: a["out"])).otherwise(F.array().cast(SPANS))

    return let(found, spans)


def beats(a: Column, b: Column) -> Column:
    """Lower tier, then higher confidence, then the longer span; where all are equal the earlier one stays."""
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    return (a["tier"] < b["tier"]) | ((a["tier"] == b["tier"]) & ((a["confidence"] > b["confidence"]) | ((a["confidence"] == b["confidence"]) & (la > lb))))


def resolve_overlaps(spans: Column, kind: str) -> Column:
    """Spans in order of their start; each one meets only the first kept span that it overlaps, and the better stays."""
    nothing = F.array().cast(kind)

    def step(kept: Column, x: Column) -> Column:
        hits = F.transform(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        at = F.array_position(hits, F.lit(True)).cast("int")
        rival = F.try_element_at(kept, at)
        swapped = F.transform(kept, lambda k, i: F.when(i + 1 == at, x).otherwise(k))
        return F.when(at == 0, F.array_append(kept, x)).when(beats(x, rival), swapped).otherwise(kept)

    return F.aggregate(F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)), nothing, step)


def apply_spans(text: Column, spans: Column) -> Column:
    """Replaces spans (start, end, replacement) from the last to the first, so that earlier offsets stay true."""
    ordered = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))))
    return F.aggregate(ordered, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["replacement"], F.substring(t, s["end"] + 1, F.length(t))))


def suppress(boxes: Column, most: float = 0.3) -> Column:
    """Non-maximum suppression of (score, i, bbox): best first, a box stays if it overlaps no kept one by `most`."""
    kind = "array<struct<score:double,i:int,bbox:array<double>>>"
    ordered = F.array_sort(boxes, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["i"] < b["i"], -1).otherwise(1))
    return F.aggregate(ordered, F.array().cast(kind), lambda kept, x: F.when(F.forall(kept, lambda k: iou(k["bbox"], x["bbox"]) < most), F.array_append(kept, x)).otherwise(kept))


def greedy_match(predictions: Column, truth: Column, least: float = 0.5, rescue: float = 0.9) -> Column:
    """For each prediction (seq, confidence, type, bbox), most confident first, the best unclaimed truth (i, type, bbox)
    of its type: the score is their IoU, or just `least` where the truth lies `rescue` inside the prediction. Returns
    (seq, truth) pairs, truth null where none is left; of equal scores the first truth is taken."""
    kind = "struct<claimed:array<int>,out:array<struct<seq:int,truth:int>>>"
    ordered = F.array_sort(predictions, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["seq"] < b["seq"], -1).otherwise(1))

    def score(p: Column, t: Column) -> Column:
        x = iou(t["bbox"], p["bbox"])
        return F.when(x >= least, x).when(containment(t["bbox"], p["bbox"]) >= rescue, F.lit(least)).otherwise(F.lit(0.0))

    def step(a: Column, p: Column) -> Column:
        open_ = F.filter(truth, lambda t: (t["type"] == p["type"]) & ~F.array_contains(a["claimed"], t["i"]))
        best = F.try_element_at(F.array_sort(F.filter(F.transform(open_, lambda t: F.struct((-score(p, t)).alias("s"), t["i"].alias("i"))), lambda x: x["s"] <= -least)), F.lit(1))
        return F.struct(F.when(best.isNull(), a["claimed"]).otherwise(F.array_append(a["claimed"], best["i"])).alias("claimed"), F.array_append(a["out"], F.struct(p["seq"].alias("seq"), best["i"].alias("truth"))).alias("out")).cast(kind)

    begin = F.struct(F.array().cast("array<int>").alias("claimed"), F.array().cast("array<struct<seq:int,truth:int>>").alias("out")).cast(kind)
    return F.aggregate(ordered, begin, step, lambda a: a["out"])
