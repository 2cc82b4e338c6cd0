"""Small invented page, plan and scoring tables for queries whose inputs the synthetic tables don't have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODE = "snapshot_id STRING, session_id STRING, node_seq INT, path STRING, tag STRING, role STRING, label STRING, text STRING, context_label STRING, value STRING, value_omitted STRING, input_type STRING, attrs STRUCT<id:STRING,name:STRING,autocomplete:STRING,placeholder:STRING,aria_label:STRING,alt:STRING,title:STRING,inputmode:STRING,maxlength:STRING>, bbox ARRAY<DOUBLE>, interactive BOOLEAN, media STRING"


def _node(seq: int, path: str, tag: str, role: str | None = None, label: str | None = None, text: str | None = None, context: str | None = None, value: str | None = None, omitted: str | None = None, kind: str | None = None, complete: str | None = None, box: list[float] | None = None) -> tuple:
    ident = path.partition("#")[2] or None
    return ("bank", "s1", seq, path, tag, role, label, text, context, value, omitted, kind, (ident, None, complete, None, None, None, None, None, None), box, tag in ("input", "button"), None)


BANK = (
    _node(0, "h1", "h1", "heading", "Sign in", "Sign in"),
    _node(1, "input#login-id", "input", "textbox", "Customer ID", value="KT-88213", complete="username", box=[120.0, 213.0, 610.0, 252.0]),
    _node(2, "input#secret", "input", "textbox", "Password", omitted="password", kind="password", complete="current-password", box=[120.0, 293.0, 610.0, 332.0]),
    _node(3, "input#mail", "input", "textbox", "E-mail on file", value="noor.haddad@example.net", kind="email", complete="email", box=[120.0, 373.0, 360.0, 412.0]),
    _node(4, "input#mobile", "input", "textbox", "Mobile on file", value="+91 87654 32109", kind="tel", complete="tel", box=[380.0, 373.0, 610.0, 412.0]),
    _node(5, "input#tax-id", "input", "textbox", "PAN", value="QWRTP6789K", box=[120.0, 452.0, 610.0, 491.0]),
    _node(6, "button#enter", "button", "button", "Sign in", "Sign in"),
    _node(7, "dt:nth-of-type(1)", "dt", None, None, "Account holder"),
    _node(8, "dd#owner", "dd", None, None, "Noor Haddad", "Account holder", box=[700.0, 160.0, 980.0, 180.0]),
    _node(9, "dt:nth-of-type(2)", "dt", None, None, "Account number"),
    _node(10, "dd#acct", "dd", None, None, "30711590082264", "Account number", box=[700.0, 211.0, 980.0, 231.0]),
    _node(11, "dd#branch-code", "dd", None, None, "KOTN0004417", "IFSC", box=[700.0, 262.0, 980.0, 282.0]),
    _node(12, "dd#debit", "dd", None, None, "4012 8888 8888 1881", "Debit card", box=[700.0, 313.0, 980.0, 333.0]),
    _node(13, "p#note", "p", None, None, "Write to help@example.com or call 8123456789 about QWRTP6789K."),
)

LEAKS = (
    ("bank", "mustNotAppear", "email", "noor.haddad@example.net"),
    ("bank", "mustNotAppear", "card", "4012 8888 8888 1881"),
    ("bank", "mustNotAppear", "phone", "87654 32109"),
    ("bank", "mustNotAppear", "account", "30711590082264"),
    ("bank", "mustAppear", "label", "Account number"),
    ("bank", "redactedField", "password", "input#secret"),
    ("bank", "knownGap", "customer id", "KT-88213"),
)

PLANS = (
    ("s1", 0, "click", "button#enter", None, None),
    ("s1", 1, "type", "input#secret", "hunter2", None),
    ("s1", 2, "type", "input#secret", None, "user_saved:password"),
    ("s1", 3, "click", "input#ssn", None, None),
    ("s1", 4, "click", None, None, None),
    ("s1", 5, "type", "input#login-id", "[EMAIL_1]", None),
    ("s1", 6, "type", "input#login-id", None, "http://evil.example/x"),
    ("s1", 7, "type", "input#login-id", "a", "user_saved:x"),
    ("s1", 8, "type", "input#login-id", None, None),
    ("s1", 9, "navigate", None, None, None),
    ("s1", 10, "scroll", None, None, None),
    ("s1", 11, "type", "input#login-id", "plain", None),
)

TRUTH = (
    ("a", 0, "email", 2, [0.0, 0.0, 100.0, 20.0]),
    ("a", 1, "phone", 2, [0.0, 30.0, 100.0, 50.0]),
    ("a", 2, "card_number", 1, [0.0, 60.0, 100.0, 80.0]),
    ("b", 0, "email", 2, [10.0, 10.0, 50.0, 30.0]),
    ("b", 1, "email", 2, [10.0, 40.0, 50.0, 60.0]),
    ("c", 0, "pan", 1, [0.0, 0.0, 10.0, 10.0]),
)
PREDICTED = (
    ("a", 0, "email", 2, 0.95, [0.0, 0.0, 100.0, 22.0]),
    ("a", 1, "phone", 2, 0.75, [0.0, 25.0, 300.0, 60.0]),
    ("a", 2, "ssn", 1, 0.90, [0.0, 60.0, 100.0, 80.0]),
    ("b", 0, "email", 2, 0.80, [10.0, 10.0, 50.0, 30.0]),
    ("b", 1, "email", 2, 0.90, [10.0, 10.0, 50.0, 31.0]),
    ("b", 2, "phone", 2, 0.75, [0.0, 0.0, 5.0, 5.0]),
)
FACES = (("i1", 0, 0.95, [0.0, 0.0, 40.0, 40.0]), ("i1", 1, 0.90, [5.0, 5.0, 44.0, 44.0]), ("i1", 2, 0.70, [100.0, 0.0, 140.0, 40.0]), ("i1", 3, 0.70, [60.0, 0.0, 104.0, 40.0]), ("i2", 0, 0.65, [0.0, 0.0, 10.0, 10.0]))


#: Manifest entries of which some aren't whole, and the types that their captures should declare.
ENTRIES = (("m1", "EMAIL_1", "email", 2, "partial", "regex:email"), ("m1", "", "pan", 1, "blackbox", "regex:pan"), ("m1", "PAN_2", "pan", 3, "blackbox", "regex:pan"), ("m2", "SSN_1", "ssn", 1, "blackbox", None), ("m2", "OTP_1", "otp", 1, "blackbox", "regex:otp"))
EXPECTED = (("m1", "email"), ("m1", "phone"), ("m2", "otp"), ("m2", "face"), ("m3", "email"))
#: Labels set by hand on the page, with the text that they mean where it isn't the whole field.
HAND_LABELS = (("bank", 0, "input#mail", None), ("bank", 1, "p#note", "help@example.com"), ("bank", 2, "input#gone", None), ("bank", 3, "dd#debit", "1881"), ("bank", 4, "dd#debit", "9999"))
#: A face model's output for three boxes, in shares of a crop.
FACE_OUTPUT = (("f1", [0.1, 0.9, 0.6, 0.4, 0.2, 0.8125], [0.0, 0.0, 0.25, 0.5, 0.5, 0.5, 0.75, 0.75, 0.125, 0.25, 1.0, 1.0]), ("f2", [], []))


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*BANK], NODE)


def leak_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*LEAKS], "fixture STRING, kind STRING, name STRING, needle STRING")


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*TRUTH], "screen_id STRING, item_idx INT, type STRING, tier INT, bbox ARRAY<DOUBLE>")


def predicted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*PREDICTED], "screen_id STRING, seq INT, type STRING, tier INT, confidence DOUBLE, bbox ARRAY<DOUBLE>")


def faces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*FACES], "image_id STRING, i INT, score DOUBLE, bbox ARRAY<DOUBLE>")
