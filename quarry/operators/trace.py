"""Event traces: pacing, heartbeats, server-sent frames, folding events into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paced(requests: DataFrame, by: list[str], arrival: str, order: list[str], interval: float) -> DataFrame:
    """requests with slot and wait: slot i = max(arrival i, slot i-1 + interval), in closed form per lane.

    slot_i = i * interval + max over j <= i of (arrival_j - j * interval).
    """
    w = Window.partitionBy(*by).orderBy(*order)
    i = F.row_number().over(w)
    numbered = requests.withColumn("_i", i)
    slot = F.col("_i") * interval + F.max(F.col(arrival) - F.col("_i") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("slot", slot).withColumn("wait", F.col("slot") - F.col(arrival)).drop("_i")


def heartbeats(events: DataFrame, by: list[str], ts: str, order: list[str], seconds: float = 10.0) -> DataFrame:
    """by, ts, pings: pings that an idle queue would have sent before each event, one for each full interval of silence."""
    before = F.lag(ts).over(Window.partitionBy(*by).orderBy(*order))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.withColumn("pings", F.coalesce(F.floor(gap / (seconds * 1e6)), F.lit(0)).cast("long"))


def sse_frames(streams: DataFrame, raw: str, key: str) -> DataFrame:
    """key, n, data: the first data line of each frame of a stream that holds JSON; other frames are skipped."""
    frames = streams.select(key, F.posexplode(F.split(F.regexp_replace(raw, "\r\n", "\n"), "\n\n")).alias("n", "frame"))
    data = F.regexp_extract("frame", "(?m)^data: (.*)$", 1)
    return frames.select(key, "n", data.alias("data")).where((F.col("data") != "") & F.try_parse_json("data").isNotNull())


def last_of(kind: str, value: Column | str) -> Column:
    return F.max_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("seq")))


def folded(events: DataFrame) -> DataFrame:
    """message_id, content, n_events, last_retrieval, done, status: the state that events(message_id, seq, kind, props, value) lead to.

    Deltas are put together in order; of other kinds the last counts. A message's deltas come to one task, as its text
    has to; everything else is combined before the shuffle.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "props")))), lambda x: x["props"]), "")
    done = last_of("done", F.col("value"))
    return events.groupBy("message_id").agg(text.alias("content"), F.count("*").alias("n_events"), last_of("retrieval", F.col("props")).alias("last_retrieval"), done.alias("done"), F.when(done.isNotNull(), "done").otherwise("streaming").alias("status"))
