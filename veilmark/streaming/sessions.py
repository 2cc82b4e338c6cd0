"""Session state over streams: tokens, histories, the latest plan, stale captures, debounced events, and event-time windows.

State is kept by key, each value on its own: a batch reads and writes what its rows touch, never a session's whole state.
Token state holds hashes of keys with their session, never the values, since stream state is written to checkpoints. Windows and
watermarks are this library's own; the rest follows the batch forms in `operators`. Sources should bound a batch
(`maxFilesPerTrigger`), since a session's rows of one batch are put in order in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TOKENS = "session string, seq bigint, type string, token string"
HISTORY = "session string, seq bigint, value string, prior array<string>"
STALE = "session string, seq bigint, stale boolean"
#: State with a value for each key needs a store that isn't rewritten as a whole.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("seq", kind="stable")


class TokenRegistry(StatefulProcessor):
    """Numbers a session's keys by type as they first appear; a row of type `reset` forgets all. Numbers go by themselves
    `keep_ms` after they were given."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a list is read in large pieces and only grows by what is new; a map costs a round trip a key
        self.numbers = handle.getListState("numbers", "type string, name string, n bigint", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        items = _in_order(rows)[["seq", "type", "name"]]
        asked, known, counts, new, out, fresh = {*items["name"]}, {}, {}, [], [], False
        for kind, name, n in self.numbers.get():
            counts[kind] = max(counts.get(kind, 0), n)
            if name in asked:
                known[name] = n
        for seq, kind, name in items.itertuples(index=False):
            if kind == "reset":
                known, counts, new, fresh = {}, {}, [], True
                continue
            if name not in known:
                known[name] = counts[kind] = counts.get(kind, 0) + 1
                new.append((kind, name, known[name]))
            out.append((key[0], seq, kind, f"{kind.upper()}_{known[name]}"))
        if fresh:
            self.numbers.clear()
        if new:
            self.numbers.appendList(new)
        yield pd.DataFrame(out, columns=["session", "seq", "type", "token"])

    def close(self) -> None:
        pass


def session_tokens(items: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Streaming items (session, seq, type, key) with their tokens. Keys are hashed before they leave their task. With `keep_ms`
    the stream has to run on: a run over what is there would wait for time to pass."""
    name = F.sha2(F.concat_ws(":", F.length("session"), "session", F.length("type"), "type", "key"), 256)
    hashed = items.select("session", "seq", "type", name.alias("name"))
    return hashed.groupBy("session").transformWithStateInPandas(TokenRegistry(keep_ms), TOKENS, "Append", "ProcessingTime" if keep_ms else "None")


class History(StatefulProcessor):
    """Each value with the last `most` before it; older ones fall out of the state."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        kept = [v for (v,) in self.kept.get()]
        out = []
        for seq, value in _in_order(rows)[["seq", "value"]].itertuples(index=False):
            out.append((key[0], seq, value, list(kept)))
            kept = [*kept, value][-self.most :]
        self.kept.put([(v,) for v in kept])
        yield pd.DataFrame(out, columns=["session", "seq", "value", "prior"])

    def close(self) -> None:
        pass


def histories(items: DataFrame, most: int = 60) -> DataFrame:
    """Streaming items (session, seq, value) with what came before: the activity ring and prior actions."""
    return items.select("session", "seq", "value").groupBy("session").transformWithStateInPandas(History(most), HISTORY, "Append", "None")


class Staleness(StatefulProcessor):
    """Holds a session's inspected and its open page, and tells after each change whether they differ."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "kind string", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = {k: (self.pages.getValue((k,)) or (None,))[0] for k in ("inspected", "open")}
        out = []
        for seq, kind, value in _in_order(rows)[["seq", "kind", "value"]].itertuples(index=False):
            now[kind] = value
            out.append((key[0], seq, now["inspected"] is not None and now["inspected"] != now["open"]))
        for kind, value in now.items():
            if value is None:
                self.pages.removeKey((kind,))
            else:
                self.pages.updateValue((kind,), (value,))
        yield pd.DataFrame(out, columns=["session", "seq", "stale"])

    def close(self) -> None:
        pass


def stale_changes(items: DataFrame) -> DataFrame:
    """Streaming changes (session, seq, kind: inspected or open, value) with whether what was inspected last is no longer what
    is open. Nothing inspected is never stale; a null value means none."""
    return items.select("session", "seq", "kind", "value").groupBy("session").transformWithStateInPandas(Staleness(), STALE, "Append", "None")


def debounced(events: DataFrame, by: str, at: str, last: Column, gap: str, late: str | None = None) -> DataFrame:
    """The last event of each burst: events of a key closer than `gap`; of equal times the greater. Works on streams (with a watermark) and tables."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(by, F.session_window(at, gap).alias("burst")).agg(F.max_by(last, F.struct(F.col(at), last)).alias("last"), F.count(F.lit(1)).alias("events")).select(by, F.col("burst.start").alias("start"), "last", "events")


def windowed_counts(events: DataFrame, at: str, by: str, value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per tumbling or sliding window and key; partial sums meet in one shuffle."""
    rows = events.withWatermark(at, late) if late else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


@contextmanager
def state_by_key(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state by key; the session's own choice comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    former = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        if former is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, former)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and writes Parquet with the batch's number, so that of updates the last counts. A
    batch that runs again after a failure replaces what it wrote."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")

    with state_by_key(stream.sparkSession):
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def latest(updates: DataFrame, keys: list[str], order: str = "batch") -> DataFrame:
    """Of several rows of a key the newest: the last plan, the last capture, the last update of a window."""
    others = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def stale(inspected: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Whether what was inspected last is still what is open."""
    now = current.select(F.col(key).alias("k"), F.col(value).alias("now"))
    return inspected.join(now, F.col(key) == F.col("k"), "left").select(key, (~F.col(value).eqNullSafe(F.col("now"))).alias("stale"))
