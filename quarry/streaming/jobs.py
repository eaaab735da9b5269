"""Structured Streaming: event folding, incremental ingestion, progress and windows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quarry.operators import chunking, runs
from quarry.settings import DEFAULT, Settings

FOLD_OUT = "message_id long, content string, n_events long, last_retrieval string, done double, status string"
FOLD_BATCH = "events string, ms long"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and lists need, for streams that start inside; then the session's own again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Fold(StatefulProcessor):
    """A message's events so far, as a list that a batch only appends to: one entry for what is new in a batch, and its newest time.

    Events come and are kept as JSON, as each value that goes between the store, Spark and Python has a price of its own, and
    there is no other state, as each call to the store is a round trip for each message.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.batches = handle, handle.getListState("events", FOLD_BATCH)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {e["seq"]: e for events, _ in self.batches.get() for e in json.loads(events)}
        came = json.loads(f"[{','.join(r[1] for r in rows)}]")
        fresh: dict[int, dict] = {}
        for e in came:
            if e["seq"] not in held:
                fresh.setdefault(e["seq"], e)
        if not fresh:
            return
        ms = max(0, *(e.pop("ms", 0) for e in came))
        if not held:
            self.handle.registerTimer(ms + self.quiet_ms)
        self.batches.appendValue((json.dumps(list(fresh.values())), ms))
        every = [e for _, e in sorted((held | fresh).items())]
        last = {kind: e for e in every for kind in (e.get("kind"),)}
        content = "".join(e.get("props", "") for e in every if e.get("kind") == "delta")
        retrieval, done = last.get("retrieval"), last.get("done")
        value = done and done.get("value")  # a text if it is infinite
        yield Row(message_id=key[0], content=content, n_events=len(every), last_retrieval=retrieval and retrieval.get("props"), done=None if value is None else float(value), status="done" if done else "streaming")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A message that was quiet goes; one that was not is looked at again when it may have been."""
        due = max(ms for _, ms in self.batches.get()) + self.quiet_ms
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.batches.clear()
        yield from ()

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, quiet_minutes: int = 10) -> DataFrame:
    """As operators.trace.folded over a stream of (message_id, seq, kind, props, value, ts), in output mode update.

    A message's events are kept as a list of batches: a batch writes what is new to it, and reads the list once. A copy of a seen event
    changes nothing; an event without a seq is left out. A row is given whenever a message changed; a message quiet for
    `quiet_minutes` of event time is dropped from the state by a timer, and events later than that are left out. The stream
    has to start inside rocks().
    """
    value = F.when(~F.isnan("value"), F.col("value")).alias("value")
    event = F.to_json(F.struct(F.col("seq").cast("long").alias("seq"), "kind", "props", value, F.unix_millis("ts").alias("ms")), {"ignoreNullFields": "true"})
    marked = events.where("seq is not null").select("message_id", event.alias("event"), "ts").withWatermark("ts", f"{quiet_minutes} minutes")
    return marked.groupBy("message_id").transformWithState(Fold(quiet_minutes * 60_000), FOLD_OUT, "Update", "EventTime")


def documents_in(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(docs: DataFrame, store: str, checkpoint: str, settings: Settings = DEFAULT):
    """Chunk arriving documents (doc_id, title, text) and keep the newest version of each document's chunks in `store`.

    A batch is written as a version of its own; chunks() reads the newest version of each document, so that a batch that
    runs again writes the same rows again and a shorter document leaves no old tail.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = chunking.structure_chunks(batch, settings).withColumn("version", F.lit(number))
        out.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunks(spark: SparkSession, store: str) -> DataFrame:
    """Chunks of the newest version of each document."""
    every = spark.read.parquet(store)
    newest = every.groupBy("doc_id").agg(F.max("version").alias("newest"))
    return every.join(newest, "doc_id").where("version = newest").drop("newest", "batch")


def progress_stream(results: DataFrame) -> DataFrame:
    """Running counts by scenario, for output mode update."""
    return results.groupBy("scenario_id").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count("error").alias("errors"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; later events than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def joined_streams(left: DataFrame, right: DataFrame, key: str, within: str = "15 minutes", late: str = "30 minutes", how: str = "inner") -> DataFrame:
    """Pairs (a, b) of events with equal key whose right side follows within the interval.

    how: inner, or leftOuter, which also gives a left event without a follower, once no such can come any more. Events
    later than `late` behind the newest of both sides are left out; the interval bounds the state of both.
    """
    a, b = left.withWatermark("ts", late).alias("a"), right.withWatermark("ts", late).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} and b.ts >= a.ts and b.ts <= a.ts + interval {within}"), how)


def merged(store: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    return runs.upsert(store, batch, key)
