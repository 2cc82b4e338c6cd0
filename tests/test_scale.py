"""Operators whose groups may be large: order within groups, quantiles, boxes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.operators import boxes, evaluate, ordered, perception, planning, quantiles


@pytest.fixture
def unmerged(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def user_rows(n=3000):
    r = random.Random(2)
    # half of all rows are one user's, some have none
    return [(None if r.random() < 0.05 else 0 if r.random() < 0.5 else r.randrange(1, 30), i, r.choice("abcd"), r.random() < 0.001) for i in r.sample(range(10 * n), n)]


USERS = "user BIGINT, at BIGINT, what STRING, failed BOOLEAN"


def by_user(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out


def test_numbered(spark, unmerged):
    rows = user_rows()
    got = ordered.numbered(spark.createDataFrame(rows, USERS), ["user"], ["at"], "n")
    want = {(u, row[1]): k for u, own in by_user(rows).items() for k, row in enumerate(own, 1)}
    assert {(r["user"], r["at"]): r["n"] for r in got.collect()} == want
    # the user with half of all rows is no single task's
    assert got.where("user = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_prior(spark):
    rows = user_rows()
    df = spark.createDataFrame(rows, USERS).repartition(20)
    for most in (1, 3, 40):
        got = {(r["user"], r["at"]): r["prior"] for r in planning.prior_actions(df, "user", ["at"], "what", most).collect()}
        assert got == {(u, row[1]): [x[2] for x in own[max(0, k - most) : k]] for u, own in by_user(rows).items() for k, row in enumerate(own)}


def test_prefix(spark, capsys):
    rows = user_rows()
    df = spark.createDataFrame(rows, USERS)
    got = planning.run_prefix(df, "user", ["at"], F.col("failed"))
    want = set()
    for own in by_user(rows).values():
        for row in own:
            want.add(row[:3])
            if row[3]:
                break
    assert {(r["user"], r["at"], r["what"]) for r in got.collect()} == want
    got.explain()
    assert "Window" not in capsys.readouterr().out


def test_order_of_nothing(spark):
    df = spark.createDataFrame([], USERS)
    assert ordered.numbered(df, ["user"], ["at"], "n").count() == planning.prior_actions(df, "user", ["at"], "what", 3).count() == planning.run_prefix(df, "user", ["at"], F.col("failed")).count() == 0


VALUES = {
    "one": [3.5],
    "two": [1.0, 2.0],
    "equal": [7.0] * 900,
    "normal": np.random.default_rng(1).normal(size=2001).tolist(),
    "wide": (np.random.default_rng(2).normal(size=1500) * 10.0 ** np.random.default_rng(3).integers(-300, 300, 1500)).tolist(),
    "near": [1 + k * 2.0**-52 for k in range(700)],
    "mixed": [0.0, -0.0, -1.0, 1e308, -1e308, 5e-324, 1e-323, 1.5e-323, None, float("nan"), 2.0, 2.0, 2.0],
    "tiny": [k * 5e-324 for k in range(1, 60)],
    "infinite": [float("inf"), 1.0, 2.0, 3.0, float("-inf")],
    "ties": [float(k % 5) for k in range(1234)],
    None: [4.0, 8.0],
}


@pytest.mark.parametrize("parts", [4096, 64])
def test_quantiles(spark, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rows = [(g, v) for g, vs in VALUES.items() for v in vs] + [("none", None), ("none", float("nan"))]
    random.Random(4).shuffle(rows)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in quantiles.quantiles(spark.createDataFrame(rows, "g STRING, v DOUBLE"), ["g"], "v", shares).collect()}
    assert len(got) == len(VALUES) * len(shares)
    for g, vs in VALUES.items():
        kept = sorted(v for v in vs if v is not None and v == v)
        for s in shares:
            place = s * (len(kept) - 1)
            a, b = kept[int(place)], kept[min(int(np.ceil(place)), len(kept) - 1)]
            assert got[(g, s)] == pytest.approx(a if a == b else (1 - place % 1) * a + place % 1 * b, rel=1e-12, abs=0)


def test_one_group_of_all_rows(spark, capsys):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("capture"))
    out = evaluate.percentiles(df, ["capture"])
    assert {r["stage"]: (r["p50"], round(r["p95"], 6)) for r in out.collect()} == {"capture": (24_999.5, 47_499.05), "total": (24_999.5, 47_499.05)}
    out.explain("extended")
    assert "percentile" not in capsys.readouterr().out
    nothing = evaluate.percentiles(df.limit(0), ["capture"])
    assert nothing.count() == 0
    odd = evaluate.percentiles(spark.createDataFrame([("x", None, 1.0), ("x", None, 3.0)], "g STRING, a DOUBLE, b DOUBLE"), ["a", "b"], ["g"])
    assert {r["stage"]: r["p50"] for r in odd.collect()} == {"a": None, "b": 2.0, "total": 2.0}


BOX = "screen_id BIGINT, seq BIGINT, confidence DOUBLE, type STRING, tier INT, bbox ARRAY<DOUBLE>"


def some_boxes(r, n, screen=1, wide=100.0):
    out = []
    for k in range(n):
        x, y, size = r.uniform(-wide, wide), r.uniform(-wide, wide), r.choice([0.5, 3, 10, 80, wide])
        out.append((screen, k, round(r.random(), 2), r.choice("ab"), k % 2 + 1, [x, y, x + r.uniform(0.3, 1) * size, y + r.uniform(0.3, 1) * size]))
    return out


def area(b):
    return max(b[2] - b[0], 0) * max(b[3] - b[1], 0)


def cut(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


def share(a, b):
    return cut(a, b) / (area(a) + area(b) - cut(a, b)) if cut(a, b) else 0.0


def test_meeting_boxes(spark):
    r = random.Random(6)
    left = [*some_boxes(r, 150), *some_boxes(r, 40, 2), (1, 900, 0.5, "a", 1, [0.0, 0.0, 64.0, 64.0]), (1, 901, 0.5, "a", 1, [0.0, 0.0, 0.0, 9.0]), (1, 902, 0.5, "a", 1, None), (None, 903, 0.5, "a", 1, [0.0, 0.0, 5.0, 5.0])]
    right = [*some_boxes(r, 150), *some_boxes(r, 40, 2), (1, 900, 0.5, "a", 1, [64.0, 0.0, 128.0, 64.0]), (1, 901, 0.5, "a", 1, [-1e6, -1e6, 1e6, 1e6]), (None, 903, 0.5, "a", 1, [1.0, 1.0, 2.0, 2.0])]
    a = spark.createDataFrame(left, BOX).select("screen_id", F.col("seq").alias("i"), F.col("bbox").alias("a_bbox"))
    b = spark.createDataFrame(right, BOX).select("screen_id", F.col("seq").alias("j"), F.col("bbox").alias("b_bbox"))
    got = [(x["screen_id"], x["i"], x["j"]) for x in boxes.meeting(a, b, ["screen_id"]).collect()]
    want = {(x[0], x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[5] and cut(x[5], y[5]) > 0}
    assert len(got) == len(set(got)) and set(got) == want


def greedy(p, t):
    claimed, out = set(), {}
    for x in sorted(p, key=lambda x: (-x[2], x[1])):
        best = None
        for y in t:
            s = share(y[5], x[5])
            s = s if s >= 0.5 else 0.5 if cut(y[5], x[5]) >= 0.9 * area(y[5]) else 0
            if y[3] == x[3] and y[1] not in claimed and s and (best is None or (-s, y[1]) < best):
                best = (-s, y[1])
        if best:
            claimed.add(best[1])
            out[x[1]] = best[1]
    return out


def test_matched_boxes(spark):
    r = random.Random(7)
    t = some_boxes(r, 200, wide=60)
    p = [(s, k, c, kind, tier, [v + r.uniform(-1, 1) for v in b]) for s, k, c, kind, tier, b in t] + some_boxes(r, 60, wide=60)
    p = [(s, k, *rest) for k, (s, _, *rest) in enumerate(p)]
    predictions, truth = spark.createDataFrame(p, BOX), spark.createDataFrame(t, BOX).withColumnRenamed("seq", "item_idx")
    assert {x["seq"]: x["truth"] for x in boxes.matched(predictions, truth).collect()} == greedy(p, t)
    other = truth.withColumn("screen_id", F.lit(9).cast("bigint"))
    assert boxes.matched(predictions, other).count() == 0 == evaluate.match_screens(predictions, other).count()
    assert boxes.matched(predictions.limit(0), truth).count() == 0


def outcomes(p, t):
    """(screen, outcome, tier, type) by brute force, of screens with both."""
    out = []
    for s in {x[0] for x in p} & {x[0] for x in t} - {None}:
        own, theirs = [x for x in p if x[0] == s], [x for x in t if x[0] == s]
        found = greedy([x for x in own if x[5]], [x for x in theirs if x[5]])
        out += [(s, "tp" if x[1] in found else "fp", x[4], x[3]) for x in own] + [(s, "fn", x[4], x[3]) for x in theirs if x[1] not in found.values()]
    return sorted(out)


def test_screens_of_few_and_many_boxes(spark):
    """Small screens are settled without rounds or intermediate tables of pairs, a large one beside them on the grid; batches end inside screens."""
    r = random.Random(9)
    t = [x for s in range(1, 60) for x in some_boxes(r, r.randrange(0, 12), s, 20)]
    t = [(s, k, *rest) for k, (s, _, *rest) in enumerate(t)]
    p = [(s, k, c, kind, tier, [v + r.uniform(-1, 1) for v in b]) for s, k, c, kind, tier, b in t if r.random() < 0.8] + [(s, 10_000 + s, 0.5, "a", 1, [0.0, 0.0, 9.0, 9.0]) for s in range(50, 70)]
    t, p = [*t, (3, 20_000, 0.5, "a", 1, None), (None, 20_001, 0.5, "a", 1, [0.0, 0.0, 9.0, 9.0])], [*p, (None, 20_001, 0.5, "a", 1, [0.0, 0.0, 9.0, 9.0])]
    big = some_boxes(r, 200, 99, 60)
    written, put = [], boxes.written
    boxes.written = lambda df, name: (written.append(name), put(df, name))[1]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for more in ([], big):
            got = evaluate.match_screens(spark.createDataFrame(p + more, BOX), spark.createDataFrame(t + more, BOX).withColumnRenamed("seq", "item_idx"))
            assert sorted((x["screen_id"], x["outcome"], x["tier"], x["type"]) for x in got.collect()) == outcomes(p + more, t + more)
            assert more or written == ["crowded"]
    finally:
        boxes.written = put
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_boxes_meet_without_a_grid(spark, capsys):
    """Each box of a small screen is sent once, not to every square that it touches."""
    df = spark.createDataFrame(some_boxes(random.Random(10), 50), BOX)
    boxes.meeting(df.select("screen_id", F.col("seq").alias("i"), F.col("bbox").alias("a_bbox")), df.select("screen_id", F.col("seq").alias("j"), F.col("bbox").alias("b_bbox")), ["screen_id"]).explain()
    assert "Generate" not in capsys.readouterr().out


def test_images_of_few_and_many_faces(spark):
    r = random.Random(11)
    faces = [(s, 1000 * s + k, round(r.random(), 2), b[5]) for s in range(40) for k, b in enumerate(some_boxes(r, 9 * s % 40, wide=15))] + [(None, 7, 0.5, [0.0, 0.0, 5.0, 5.0]), (None, 8, 0.4, [0.0, 0.0, 5.0, 5.0]), (1, 5, 0.9, None)]
    many = [(99, k, round(r.random(), 2), b[5]) for k, b in enumerate(some_boxes(r, 300, 99, 60))]
    for rows in (faces, faces + many):
        kept = []
        for f in sorted(rows, key=lambda x: (-x[2], x[1])):
            if all(f[0] != g[0] or not f[3] or not g[3] or share(f[3], g[3]) < 0.3 for g in kept):
                kept.append(f)
        got = boxes.suppressed(spark.createDataFrame(rows, "image_id BIGINT, i BIGINT, score DOUBLE, bbox ARRAY<DOUBLE>")).collect()
        assert sorted((x["image_id"] or -1, x["i"]) for x in got) == sorted((f[0] if f[0] else -1 if f[0] is None else -1, f[1]) for f in kept)


def test_suppressed_boxes(spark):
    r = random.Random(8)
    faces = [(1, k, round(r.random(), 2), b[5]) for k, b in enumerate(some_boxes(r, 250, wide=40))]
    kept = []
    for f in sorted(faces, key=lambda x: (-x[2], x[1])):
        if all(share(f[3], g[3]) < 0.3 for g in kept):
            kept.append(f)
    df = spark.createDataFrame(faces, "image_id BIGINT, i BIGINT, score DOUBLE, bbox ARRAY<DOUBLE>")
    assert {x["i"] for x in boxes.suppressed(df).collect()} == {f[1] for f in kept}
    numbered = perception.numbered_faces(boxes.suppressed(df)).collect()
    assert sorted(x["face"] for x in numbered) == [*range(len(kept))] and [x["score"] for x in sorted(numbered, key=lambda x: x["face"])] == sorted((f[2] for f in kept), reverse=True)


def test_passes_over_regions(spark):
    face = "image_id BIGINT, i BIGINT, score DOUBLE, bbox ARRAY<DOUBLE>"
    frame = spark.createDataFrame([(1, 0, 0.9, [10.0, 10.0, 20.0, 20.0]), (1, 1, 0.5, [50.0, 50.0, 60.0, 60.0])], face)
    regions = spark.createDataFrame([(1, 2, 0.95, [1.0, 1.0, 11.0, 11.0], [9.0, 9.0]), (1, 3, 0.7, [0.0, 0.0, 5.0, 5.0], [30.0, 40.0])], face + ", offset ARRAY<DOUBLE>")
    assert {(r["i"], tuple(r["bbox"])) for r in perception.merged(frame, regions).collect()} == {(2, (10.0, 10.0, 20.0, 20.0)), (3, (30.0, 40.0, 35.0, 45.0))}


def test_a_screen_of_many_boxes(spark):
    """100,000 boxes of all sizes on one screen: pairs stay near what overlaps, not what the screen holds."""
    side = F.pow(F.lit(2.0), F.pmod(F.xxhash64("id"), F.lit(6)).cast("double"))
    x, y = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40_000)).cast("double") for k in (1, 2))
    rows = spark.range(100_000).select(F.lit(1).alias("screen_id"), "id", F.array(x, y, x + side, y + side).alias("a_bbox"))
    other = rows.select("screen_id", F.col("id").alias("other"), F.transform("a_bbox", lambda v: v + 0.25).alias("b_bbox"))
    pairs = boxes.meeting(rows, other, ["screen_id"])
    assert 100_000 <= pairs.count() < 250_000 and pairs.where("id = other").count() == 100_000
