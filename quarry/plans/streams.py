"""Streams over copies of the tables that grow between runs, with the SQL of what stands at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import runs
from quarry.plans.registry import Tables, query
from quarry.sources.sinks import new_folder
from quarry.streaming import jobs


def grown(t: Tables, name: str, parts: list[dict[str, DataFrame]], run: Callable[[str, dict[str, DataFrame]], object]) -> str:
    """Add the rows of each part to the folders that they are named for, and run the stream over them to its end each time.

    run(top, streams) starts a stream that reads what is new to its checkpoint below `top`, which is given back.
    """
    top = new_folder(t.spark, name)
    for part in parts:
        for folder, rows in part.items():
            rows.write.mode("append").parquet(f"{top}/{folder}")
        run(top, {f: t.spark.readStream.schema(rows.schema).parquet(f"{top}/{f}") for f, rows in part.items()}).awaitTermination()
    return top


def by_batch(stream: DataFrame, top: str, mode: str):
    """Write what each batch gives as a partition of its number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()


@query("select message_id, coalesce(string_agg(props, '' order by seq) filter (kind = 'delta'), '') as content, count(*) as n_events, arg_max(props, seq) filter (kind = 'retrieval') as last_retrieval, round(arg_max(value, seq) filter (kind = 'done'), 6) as done, case when count_if(kind = 'done') > 0 then 'done' else 'streaming' end as status from {trace} group by message_id")
def x3_streamed_fold(t: Tables):
    """Events out of order and some of them twice, in two runs: the state goes on from the checkpoint."""
    e = t.trace.withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [e.where("seq % 3 <> 1"), e.where("seq % 3 = 1 or seq % 7 = 0")]

    def run(top, streams):
        with jobs.rocks(t.spark):
            return by_batch(jobs.fold_stream(streams["in"], quiet_minutes=100_000), top, "update")

    top = grown(t, "fold", [{"in": p} for p in parts], run)
    rows = t.spark.read.schema(jobs.FOLD_OUT).parquet(f"{top}/out")
    return runs.newest(rows, ["message_id"], [F.desc("n_events")]).withColumn("done", F.round("done", 6)).drop("batch")


@query("select scenario_id, count_if(error is null) as ok, count(error) as errors from {results} group by scenario_id")
def x5_streamed_progress(t: Tables):
    """Running counts by scenario after two runs."""
    r = t.results.select("scenario_id", "question_id", "mode", "error", "seq")
    top = grown(t, "progress", [{"in": r.where("seq % 2 = 0")}, {"in": r.where("seq % 2 = 1")}], lambda top, s: by_batch(jobs.progress_stream(s["in"]), top, "complete"))
    rows = t.spark.read.schema("scenario_id string, ok long, errors long, batch long").parquet(f"{top}/out")
    return runs.newest(rows, ["scenario_id"], [F.desc("batch")]).drop("batch")


@query("select doc_id::varchar as doc_id, case when doc_id % 10 = 0 then 1 else 0 end as version, max(length(case when doc_id % 10 = 0 then substr(text, 1, 40) else text end)) > 0 as any_text from {documents} where trim(case when doc_id % 10 = 0 then substr(text, 1, 40) else text end, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by doc_id")
def x6_incremental_ingest(t: Tables):
    """Chunks of the newest versions, after a run over all documents, one over shorter versions of some, and one over nothing new."""
    d = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("t").alias("title"), "text")
    again = d.where("doc_id % 10 = 0").withColumn("text", F.substring("text", 1, 40))
    top = grown(t, "ingest", [{"in": d}, {"in": again}, {"in": again.limit(0)}], lambda top, s: jobs.ingest_stream(s["in"], f"{top}/store", f"{top}/checkpoint"))
    return jobs.chunks(t.spark, f"{top}/store").groupBy("doc_id", F.least("version", F.lit(1)).alias("version")).agg((F.max("char_count") > 0).alias("any_text"))


_HALF, _VIEW = "timestamp '2024-01-16'", "select event_id, user_id, ts from {events} where event_type = 'view'"
_SIDES = f"v as ({_VIEW} and not (event_id % 40 = 0 and ts < {_HALF} - interval 6 day)), p as ({_VIEW.replace('view', 'purchase')}), w as (select least((select max(ts) from v), (select max(ts) from p)) - interval 1 day as w), j as (select v.event_id as view_id, p.event_id as purchase_id from v join p on v.user_id = p.user_id and p.ts >= v.ts and p.ts <= v.ts + interval 12 hour)"


def view_purchases(t: Tables, how: str) -> DataFrame:
    """Views and the user's purchases in the twelve hours after: the first half month, the second, and views that come too late."""
    e = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    side = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    v, p, half = side("view"), side("purchase"), F.lit("2024-01-16").cast("timestamp")
    late = (F.col("event_id") % 40 == 0) & (F.col("ts") < half - F.expr("interval 6 days"))
    parts = [{"v": v.where((F.col("ts") < half) & ~late), "p": p.where(F.col("ts") < half)}, {"v": v.where(F.col("ts") >= half), "p": p.where(F.col("ts") >= half)}, {"v": v.where(late), "p": p.limit(0)}]

    def run(top, streams):
        pairs = jobs.joined_streams(streams["v"], streams["p"], "user_id", "12 hours", "1 day", how)
        return by_batch(pairs.select(F.col("a.event_id").alias("view_id"), F.col("b.event_id").alias("purchase_id")), top, "append")

    return t.spark.read.schema("view_id long, purchase_id long").parquet(f"{grown(t, 'join', parts, run)}/out").select("view_id", "purchase_id")


@query(f"with {_SIDES} select view_id, purchase_id from j")
def x7_stream_join(t: Tables):
    return view_purchases(t, "inner")


@query(f"with {_SIDES} select view_id, purchase_id from j union all select event_id, null from v, w where ts + interval 12 hour < w and event_id not in (select view_id from j)")
def x7_stream_outer_join(t: Tables):
    """With the views that nothing followed, as far as the watermark has passed them."""
    return view_purchases(t, "leftOuter")
