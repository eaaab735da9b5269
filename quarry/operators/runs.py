"""Run bookkeeping: resume filters, merge validation, deduplication, status classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def upsert(store: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """store with the rows of batch in place of those of equal key. Keys that only the store has stay."""
    return newest(store.withColumn("_v", F.lit(0)).unionByName(batch.withColumn("_v", F.lit(1))), key, [F.desc("_v")]).drop("_v")


def replace_document(store: DataFrame, batch: DataFrame, document: str, key: list[str]) -> DataFrame:
    """As upsert, but all chunks of the batch's documents go first, so that no tail of an older version stays."""
    return upsert(store.join(batch.select(document).distinct(), document, "left_anti"), batch, key)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def open_work(plan: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows without an error-free result."""
    return plan.join(results.where("error is null").select(*key).distinct(), key, "left_anti")


def complete_questions(results: DataFrame, modes: list[str]) -> DataFrame:
    """Questions with an error-free result in every mode."""
    have = results.where("error is null").groupBy("scenario_id", "question_id").agg(F.collect_set("mode").alias("modes"))
    return have.where(F.size(F.array_except(F.array(*[F.lit(m) for m in modes]), "modes")) == 0).select("scenario_id", "question_id")


def ingested(expected: DataFrame, registry: DataFrame) -> DataFrame:
    """filename, present: whether a file has exactly one copy, and that ready."""
    have = registry.groupBy("filename").agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "ready").alias("ready"))
    return expected.join(have, "filename", "left").select("filename", F.coalesce((F.col("n") == 1) & F.col("ready"), F.lit(False)).alias("present"))


def reaped(runs: DataFrame) -> DataFrame:
    """Runs left alive by a crash count as failed."""
    live = F.col("status").isin("queued", "running", "cancelling")
    return runs.withColumn("error", F.when(live, "interrupted by a restart")).withColumn("status", F.when(live, "failed").otherwise(F.col("status")))


def picked_runs(runs: DataFrame) -> DataFrame:
    """A run per scenario: completed ones first, then more rows, then newer."""
    return newest(runs, ["scenario_id"], [(F.col("status") == "completed").cast("int").desc(), F.desc("n_rows"), F.desc("seq")])


def merged_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per (scenario, question, mode): rows of completed runs first, then the earliest."""
    done = runs.select("run_id", (F.col("status") == "completed").cast("int").alias("done"))
    return newest(results.join(done, "run_id", "left"), ["scenario_id", "question_id", "mode"], [F.coalesce("done", F.lit(0)).desc(), F.col("seq")])


def merge_counters(read: DataFrame, kept: DataFrame) -> DataFrame:
    """scenario_id, read, copied, deduped, errors."""
    a = read.groupBy("scenario_id").agg(F.count("*").alias("read"))
    b = kept.groupBy("scenario_id").agg(F.count("*").alias("copied"), F.count("error").alias("errors"))
    return a.join(b, "scenario_id", "left").select("scenario_id", "read", F.coalesce("copied", F.lit(0)).alias("copied"), (F.col("read") - F.coalesce("copied", F.lit(0))).alias("deduped"), F.coalesce("errors", F.lit(0)).alias("errors"))


def source_problems(plan: DataFrame, runs: DataFrame, results: DataFrame, arms: list[str]) -> DataFrame:
    """scenario_id, run_id, problem of planned sources that cannot be merged: unknown run, no rows, other arms."""
    seen = results.groupBy("run_id").agg(F.collect_set("mode").alias("modes"), F.count("*").alias("n"))
    known = runs.select("run_id", F.lit(True).alias("known"))
    want = F.array_sort(F.array(*[F.lit(a) for a in arms]))
    joined = plan.join(known, "run_id", "left").join(seen, "run_id", "left")
    problem = F.when(F.col("known").isNull(), "unknown run").when(F.coalesce("n", F.lit(0)) == 0, "no rows").when(F.array_sort("modes") != want, "arm mismatch")
    return joined.select("scenario_id", "run_id", problem.alias("problem")).where("problem is not null")


def worker_verdict(finished: Column, alive: Column, expected: Column, rows: Column) -> Column:
    return F.when(finished & (rows >= expected), "completed").when(alive, "running").otherwise("dead_incomplete")


def planned_total(questions: DataFrame, cap: int, arms: int) -> DataFrame:
    """total: questions of all scenarios, at most cap each (0: all), times arms."""
    n = questions.groupBy("scenario_id").agg(F.count("*").alias("n"))
    return n.agg((F.sum(F.when(F.lit(cap) == 0, F.col("n")).otherwise(F.least("n", F.lit(cap)))) * arms).alias("total"))


def with_overrides(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each arm's parameters: its override, else the base value."""
    return overrides.crossJoin(F.broadcast(base.limit(1))).select("arm", *[F.coalesce(F.col(f"o_{c}"), F.col(c)).alias(c) for c in base.columns])  # base is one row
