import re

import pytest
from pyspark.sql import functions as F

from veilmark.functions import geometry, text, validators
from veilmark.functions.folds import apply_spans, greedy_match, match_spans, resolve_overlaps, suppress
from veilmark.operators import detect, rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("number", "good"), [("4539148803436467", True), ("", False), ("4539 1488 0343 6467", False)])
def test_luhn(spark, number, good):
    assert one(spark, validators.luhn(F.lit(number))) is good


@pytest.mark.parametrize(("number", "good"), [("234567890124", True), ("398765432109", True), ("234567890125", False), ("12a", False), ("", False)])
def test_verhoeff(spark, number, good):
    assert one(spark, validators.verhoeff(F.lit(number))) is good


@pytest.mark.parametrize(("number", "good"), [("+91 98765 43210", True), ("9876543210", True), ("1234567890", False), ("+1234", False)])
def test_phone(spark, number, good):
    assert one(spark, validators.is_phone(F.lit(number))) is good


@pytest.mark.parametrize(("mail", "masked"), [("ada.lovelace@example.org", "a***@***.org"), ("@x.org", "[EMAIL]"), ("a@b", "a***@***"), ("a@b@c.de", "a***@***.de")])
def test_partial_email(spark, mail, masked):
    assert one(spark, text.partial_email(F.lit(mail))) == masked


def test_replacements(spark):
    assert one(spark, text.replacement_for(F.lit("pan"), F.lit(1), F.lit("PAN_1"), F.lit("x"))) == "[REDACTED:PAN]"
    assert one(spark, text.replacement_for(F.lit("email"), F.lit(2), F.lit("EMAIL_1"), F.lit(""))) == "[EMAIL_1]"
    assert one(spark, text.token_key(F.lit("phone"), F.lit("+91 987-65"), F.lit("p"))) == "phone:9198765"
    assert one(spark, text.token_key(F.lit("phone"), F.lit(""), F.lit("p"))) == "phone@p"


@pytest.mark.parametrize(("x", "want"), [(-2.5, -2.0), (2.5, 3.0), (0.4, 0.0)])
def test_half_up(spark, x, want):
    assert one(spark, text.half_up(F.lit(x))) == want


def test_clip(spark):
    assert one(spark, text.clip(F.lit(" a  b \n"), 10)) == "a b"
    assert one(spark, text.clip(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, text.clip(F.lit("  "), 3)) is None


@pytest.mark.parametrize("said", ["xABCDE1234F ABCDE1234F, FGHIJ5678K.", "😀 ABCDE1234F", "", "ABCDE1234F", "none"])
def test_match_spans(spark, said):
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\b[A-Z]{5}\d{4}[A-Z]\b", said)]
    assert [tuple(s) for s in one(spark, match_spans(F.lit(said), rules.PAN))] == want


def test_ascii_boundary(spark):
    assert len(one(spark, match_spans(F.lit("é1234 x"), rules.OPEN + "[0-9]{4}" + rules.CLOSE))) == 1


def spans(*rows):
    return F.array(*[F.lit(None).cast(detect.SPAN) if r is None else F.struct(*map(F.lit, r)).cast(detect.SPAN) for r in rows])


def test_resolve_overlaps(spark):
    a, b, c = (0, 4, "v", "email", 2, "d", 0.9, 0), (2, 6, "v", "pan", 1, "d", 0.9, 1), (7, 9, "v", "email", 2, "d", 0.9, 2)
    got = one(spark, resolve_overlaps(spans(c, a, b), f"array<{detect.SPAN}>"))
    assert [(s["start"], s["end"]) for s in got] == [(2, 6), (7, 9)]


def test_equal_spans_keep_the_first(spark):
    a, b = (0, 4, "v", "pan", 1, "first", 0.9, 0), (0, 4, "v", "ifsc", 1, "second", 0.9, 1)
    assert [s["detector"] for s in one(spark, resolve_overlaps(spans(a, b), f"array<{detect.SPAN}>"))] == ["first"]


def test_apply_spans(spark):
    done = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("[A]").alias("replacement")), F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("").alias("replacement")))
    assert one(spark, apply_spans(F.lit("😀bcde"), done)) == "[A]be"


def boxes(*rows):
    return F.array(*[F.struct(F.lit(float(s)).alias("score"), F.lit(i).alias("i"), F.array(*map(F.lit, map(float, b))).alias("bbox")) for s, i, b in rows])


def test_suppress(spark):
    got = one(spark, suppress(boxes((0.9, 0, (0, 0, 10, 10)), (0.95, 1, (1, 1, 11, 11)), (0.5, 2, (50, 0, 60, 10)), (0.5, 3, (30, 0, 40, 10)))))
    assert [r["i"] for r in got] == [1, 2, 3]


def test_greedy_match_takes_the_first_of_equals(spark):
    box = lambda *b: F.array(*map(F.lit, map(float, b))).alias("bbox")
    p = F.array(F.struct(F.lit(0).alias("seq"), F.lit(0.5).alias("confidence"), F.lit("x").alias("type"), box(0, 0, 10, 10)), F.struct(F.lit(1).alias("seq"), F.lit(0.9).alias("confidence"), F.lit("x").alias("type"), box(0, 0, 10, 10)))
    t = F.array(F.struct(F.lit(0).alias("i"), F.lit("x").alias("type"), box(0, 0, 10, 10)), F.struct(F.lit(1).alias("i"), F.lit("y").alias("type"), box(0, 0, 10, 10)))
    assert [tuple(r) for r in one(spark, greedy_match(p, t))] == [(1, 0), (0, None)]


def test_geometry(spark):
    box = lambda *b: F.array(*map(F.lit, map(float, b)))
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(0, 0, 10, 5))) == 0.5
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert one(spark, geometry.containment(box(0, 0, 5, 5), box(0, 0, 10, 10))) == 1.0
    assert one(spark, geometry.wide_enough(box(0, 0, 31, 40))) is False
    assert one(spark, geometry.rescaled(box(-3, 0, 7.3, 9), F.lit(2.0), F.lit(12), F.lit(100))) == [0.0, 0.0, 12.0, 18.0]


@pytest.mark.parametrize(("label", "kind", "complete", "want"), [
    ("OTP sent to your mobile", None, None, "otp"), ("Company panel", None, None, None), ("PAN card", None, None, "pan"), ("", "tel", None, "phone"), ("x", None, "section current-password", "password"), ("CVV", None, None, "cvv"),
    ("Valid thru", None, None, "card_expiry"), ("Aadhaar", None, None, "aadhaar"), ("Social security", None, None, "ssn"), ("Passport no", None, None, "passport"), ("A/C", None, None, "bank_account"), ("SWIFT", None, None, "ifsc"), ("E-mail", None, None, "email"), ("Postcode", None, None, "address"), ("Full name", None, None, "person_name"), ("DOB", None, None, "date_of_birth"), ("Card number", None, None, "card_number"),
])
def test_attribute_rules(spark, label, kind, complete, want):
    from veilmark.plans.fixtures import NODE

    row = ("s", "s", 0, "p", "input", None, label, None, None, "v", None, kind, (None, None, complete, None, None, None, None, None, None), None, True, None)
    got = detect.detect_nodes(spark.createDataFrame([row], NODE)).select("whole").first()["whole"]
    assert (got and got["type"]) == want


def test_structural_tags_are_not_claimed(spark):
    from veilmark.plans.fixtures import NODE

    row = ("s", "s", 0, "p", "dt", None, None, "Account number", None, None, None, None, (None,) * 9, None, True, None)
    assert detect.detect_nodes(spark.createDataFrame([row], NODE)).first()["whole"] is None


@pytest.mark.parametrize(("id_", "good"), [("main", True), ("a3f9c2e1b", False), (":r7:", False), ("x1234", False), ("", False), ("a" * 49, False), (None, False)])
def test_stable_ids(spark, id_, good):
    assert one(spark, text.is_stable_id(F.lit(id_).cast("string"))) is good


def test_a_false_positive_hides_no_missed_truth(spark):
    from veilmark.operators import evaluate

    truth = spark.createDataFrame([("a", 0, "email", 2, [0.0, 0.0, 10.0, 10.0])], "screen_id STRING, item_idx INT, type STRING, tier INT, bbox ARRAY<DOUBLE>")
    said = spark.createDataFrame([("a", 0, "pan", 1, 0.9, [0.0, 0.0, 10.0, 10.0])], "screen_id STRING, seq INT, type STRING, tier INT, confidence DOUBLE, bbox ARRAY<DOUBLE>")
    assert {(r.outcome, r.type) for r in evaluate.match_screens(said, truth).collect()} == {("fp", "pan"), ("fn", "email")}
