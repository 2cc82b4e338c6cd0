"""Streams over several batches: state that survives a restart, late rows, and a gate that writes each batch once."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.streaming import gate, sessions

ITEMS = "session STRING, seq BIGINT, type STRING, key STRING"


def items(n=120):
    r = random.Random(5)
    return [(f"s{r.randrange(3)}", k, "reset" if r.random() < 0.04 else r.choice(["email", "phone"]), f"k{r.randrange(9)}") for k in range(n)]


def numbered(rows):
    known, out = {}, set()
    for session, seq, kind, key in rows:
        own = known.setdefault(session, {})
        if kind == "reset":
            own.clear()
        else:
            own.setdefault((kind, key), 1 + sum(k == kind for k, _ in own))
            out.add((session, seq, kind, f"{kind.upper()}_{own[(kind, key)]}"))
    return out


def test_tokens_over_batches_and_a_restart(spark, tmp_path):
    rows, at = items(), str(tmp_path)
    stream = lambda: spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    for k, part in enumerate((rows[:40], rows[40:80], rows[80:])):
        spark.createDataFrame(part, ITEMS).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if k:  # two batches at first, then a run from the checkpoint
            sessions.run_available(sessions.session_tokens(stream()), f"{at}/out", f"{at}/state")
    got = spark.read.parquet(f"{at}/out")
    assert {(r["session"], r["seq"], r["type"], r["token"]) for r in got.collect()} == numbered(rows)
    assert got.select("number").distinct().count() == 3
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != sessions.STATE_STORE


def test_bursts_with_late_rows(spark, tmp_path):
    at, hour = str(tmp_path), 3600
    batches = [[("u", 0, 1), ("u", hour, 2)], [("u", 20 * hour, 3), ("u", 2 * hour, 4)], [("u", 21 * hour, 5), ("u", 100 * hour, 6)], [("u", 3 * hour, 7), ("u", 130 * hour, 8)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "user STRING, at BIGINT, event BIGINT").withColumn("ts", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        sessions.run_available(sessions.debounced(stream, "user", "ts", F.col("event"), "6 hours", late="1 day"), f"{at}/out", f"{at}/state")
    got = {(r["last"], r["events"]) for r in spark.read.parquet(f"{at}/out").collect()}
    # the row at 2 h was late but in time for its burst; the one at 3 h came after its day and doesn't count; 100 h is over at 130 h
    assert got == {(4, 3), (5, 2), (6, 1)}


def test_stale_over_batches(spark, tmp_path):
    at, schema = str(tmp_path), "session STRING, seq BIGINT, kind STRING, value STRING"
    for rows in ([("a", 1, "open", "x"), ("a", 2, "inspected", "x"), ("b", 1, "open", "p")], [("a", 3, "open", "y"), ("b", 2, "open", "q")], [("a", 4, "open", "x"), ("a", 5, "inspected", None), ("b", 3, "inspected", "p")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        sessions.run_available(sessions.stale_changes(spark.readStream.schema(schema).parquet(f"{at}/in")), f"{at}/out", f"{at}/state")
    got = {(r["session"], r["seq"]): r["stale"] for r in spark.read.parquet(f"{at}/out").collect()}
    assert got == {("a", 1): False, ("a", 2): False, ("b", 1): False, ("a", 3): True, ("b", 2): False, ("a", 4): False, ("a", 5): False, ("b", 3): True}


@pytest.mark.parametrize("policy", ["reject", "redact"])
def test_gate_writes_a_batch_once(spark, tmp_path, policy):
    at, schema = str(tmp_path), "id BIGINT, label STRING, value STRING"
    rows = [(1, "Name", "Ada"), (2, "Mail", "a.b@example.org"), (3, None, None), (4, "ABCDE1234F", "and 123-45-6789")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{at}/in")
    gate.run_gate(stream(), f"{at}/out", f"{at}/state", ["id"], ["label", "value"], policy)
    gate.run_gate(stream(), f"{at}/out", f"{at}/again", ["id"], ["label", "value"], policy)  # the same batch, as after a failure
    got = {r["id"]: (r["verdict"], r["label"], r["value"], r["patterns"]) for r in spark.read.parquet(f"{at}/out").collect()}
    mark = "[REDACTED:INGRESS]"
    clean = {1: ("clean", "Name", "Ada", []), 3: ("clean", None, None, [])}
    bad = {2: ("rejected", None, None, ["value: email"]), 4: ("rejected", None, None, ["label: pan", "value: ssn"])}
    if policy == "redact":
        bad = {2: ("scrubbed", "Mail", mark, ["value: email"]), 4: ("scrubbed", mark, mark, ["label: pan", "value: ssn"])}
    assert got == clean | bad and spark.read.parquet(f"{at}/out").count() == 4
