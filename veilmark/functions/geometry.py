"""Boxes as ARRAY<DOUBLE> [x1, y1, x2, y2]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up


def area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    """The share of `inner` that lies in `outer`."""
    return F.coalesce(F.try_divide(intersection(inner, outer), area(inner)), F.lit(0.0))


def rounded(b: Column) -> Column:
    return F.transform(b, lambda x: half_up(x))


def on_screen(b: Column, width: Column, height: Column) -> Column:
    return (b[2] > b[0]) & (b[3] > b[1]) & (b[2] > 0) & (b[3] > 0) & (b[0] < width) & (b[1] < height)


def shown(visibility: Column, display: Column, opacity: Column) -> Column:
    """By style: neither hidden nor taken out nor wholly transparent; a style that isn't given hides nothing."""
    return (F.coalesce(visibility, F.lit("")) != "hidden") & (F.coalesce(display, F.lit("")) != "none") & (F.coalesce(opacity, F.lit(1.0)) > 0)


def decoded(scores: Column, boxes: Column, least: Column, scale: tuple[float, float], offset: tuple[float, float]) -> Column:
    """A face model's flat output (two scores and four edges a box, in shares of the crop) as (i, score, bbox) structs."""
    n = F.floor(F.size(scores) / 2).cast("int")
    edge = lambda i, k: half_up(F.lit(float(offset[k % 2])) + F.get(boxes, i * 4 + k) * float(scale[k % 2]))
    every = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.get(scores, i * 2 + 1).alias("score"), F.array(*[edge(i, k) for k in range(4)]).alias("bbox")))
    return F.transform(F.filter(every, lambda f: f["score"] >= least), lambda f: F.struct(f["i"].alias("i"), half_up(f["score"], 3).alias("score"), f["bbox"].alias("bbox")))


def rescaled(b: Column, scale: Column, width: Column, height: Column) -> Column:
    """CSS to device pixels, rounded and held inside the image."""
    at = lambda x, most: F.least(F.greatest(half_up(x * scale), F.lit(0.0)), most.cast("double"))
    return F.array(at(b[0], width), at(b[1], height), at(b[2], width), at(b[3], height))


def wide_enough(b: Column, least: float = 32.0) -> Column:
    return (b[2] - b[0] >= least) & (b[3] - b[1] >= least)


def blur_region(b: Column, scale: Column, width: Column, height: Column, pad: float = 0.25) -> Column:
    """The padded region and radius of a blur; null where nothing is left inside the image."""
    w, h = b[2] - b[0], b[3] - b[1]
    x1, y1 = F.greatest(F.floor((b[0] - w * pad) * scale), F.lit(0)), F.greatest(F.floor((b[1] - h * pad) * scale), F.lit(0))
    x2, y2 = F.least(F.ceil((b[2] + w * pad) * scale), width), F.least(F.ceil((b[3] + h * pad) * scale), height)
    radius = F.greatest(F.lit(10.0), half_up(F.least(x2 - x1, y2 - y1) * 0.45))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"), radius.alias("radius")))
