"""Measure retrieval arms on a question set: which documents each arm finds, and how many of the right ones.

    python -m jobs.retrieval_report --documents DIR --questions DIR --report DIR [--config jobs/retrieval_report.json]

Questions are passages (item_id, text); the right documents of a question are those that hold its passage. Every arm ranks all
documents for all questions; the report has a row for each question with its metrics and hits, and one for each arm with the
means and the interval of its first hits. A run overwrites the folders of the arms that it was asked for, and leaves those of
others, so that a rerun gives the same report.

    REPORT/arm=A/level=question|arm/     question_id, hits, n, metrics, hit1_lo, hit1_hi
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, main, read_back, small_batches
from quarry.operators import evaluation, search, statistics

DEFAULTS: dict[str, Any] = {"k": 10, "arms": ["bm25", "dense", "rrf"]}
METRICS = ("hit1", "hit4", "hit10", "mrr", "recall4", "recall10", "ndcg10")
REPORT = f"question_id long, hits array<long>, n long, {', '.join(f'{m} double' for m in METRICS)}, hit1_lo double, hit1_hi double, arm string, level string"


def lexical(questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return search.bm25(questions, docs, k, one_each=True)


def dense(questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return search.nearest(search.hashed_embedding(questions, "query_id"), search.hashed_embedding(docs, one_each=True), k)


#: Rankings that arms are made of; each gives query_id, id, rank of the best k documents of every question.
RANKINGS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {"bm25": lexical, "dense": dense}
#: The rankings that an arm needs.
ARMS = {"bm25": ["bm25"], "dense": ["dense"], "rrf": ["bm25", "dense"]}


def question_rows(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, hits, n, metrics of every question that has a right document; n is the number of them."""
    hits = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("hits"))  # k rows each
    named = ranked.select("query_id", "rank", F.col("id").cast("string").alias("filename"))
    right = gold.select("query_id", F.col("id").cast("string").alias("filename"))
    measured = evaluation.retrieval_metrics(named, right).join(right.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    rows = measured.join(hits, "query_id", "left")
    return rows.select(F.col("query_id").cast("long").alias("question_id"), F.coalesce("hits", F.array().cast("array<long>")).alias("hits"), "n", *[F.round(m, 6).cast("double").alias(m) for m in METRICS])


def arm_row(rows: DataFrame) -> DataFrame:
    """The same columns for all questions of an arm together: n is their number, metrics are means, with a Wilson interval of hit1."""
    lo, hi = statistics.wilson(F.col("found"), F.col("n"))
    one = rows.agg(F.count("*").alias("n"), F.sum("hit1").alias("found"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS]).where("n > 0")
    return one.select(F.lit(None).cast("long").alias("question_id"), F.lit(None).cast("array<long>").alias("hits"), "n", *METRICS, F.round(lo, 6).alias("hit1_lo"), F.round(hi, 6).alias("hit1_hi"))


def report(spark: SparkSession, documents: str, questions: str, out: str, config_path: str | None = None) -> dict[str, int]:
    """Write the report of the configured arms to `out`; the rows written for each arm.

    Documents without a doc_id or text, and questions without an item_id or text, take no part; of several rows with one
    id the one of the greatest text counts. Without questions or documents an arm has no rows.
    """
    how = config(spark, config_path, DEFAULTS)
    unknown = sorted(set(how["arms"]) - set(ARMS))
    if unknown or how["k"] < 1:
        raise ValueError(f"arms must be of {', '.join(ARMS)} and k at least 1, got {how['arms']} and {how['k']}")
    # Each ranking is made once, whatever arms need it.
    docs, together = one_row_each(spark.read.parquet(documents), "doc_id", "id")
    asked = one_row_each(spark.read.parquet(questions), "item_id", "query_id")[0].persist()
    needed = [r for r in RANKINGS if any(r in ARMS[arm] for arm in how["arms"])]
    kept = [asked]
    try:
        with small_batches(spark):
            if together:
                kept.append(docs.persist())
            log.info("read %d documents of %s and %d questions of %s", docs.count(), documents, asked.count(), questions)
            kept.append(gold := few_parts(search.containment(docs, asked)).persist())
            ranked = {r: few_parts(RANKINGS[r](asked, docs, how["k"])).persist() for r in needed}
            kept += ranked.values()
            found = {arm: ranked[arm] if arm in ranked else search.hybrid(*[ranked[r] for r in ARMS[arm]], how["k"]) for arm in how["arms"]}
            return {arm: written_arm(arm, found[arm], gold, out) for arm in how["arms"]}
    finally:
        for table in kept:
            table.unpersist()


def one_row_each(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, bool]:
    """One row of an id and its text, and whether rows had to be put together for that: texts of ids that differ stay where they are."""
    named = rows.where(F.col(key).isNotNull())
    whole = named.where(F.col("text").isNotNull()).select(F.col(key).alias(name), "text")
    if search.keys_differ(named, key):
        return whole, False
    return whole.groupBy(name).agg(F.max("text").alias("text")), True


def few_parts(rows: DataFrame) -> DataFrame:
    """Rows of questions in a partition for each core: a kept table stays in as many as the session has for shuffles of documents, each of them a task of all that read it."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def written_arm(arm: str, ranked: DataFrame, gold: DataFrame, out: str) -> int:
    """Write one arm's folder, partitioned by level; the rows in it."""
    none = [F.lit(None).cast("double").alias(c) for c in ("hit1_lo", "hit1_hi")]
    rows = few_parts(question_rows(ranked, gold)).persist()
    try:
        both = rows.select("*", *none, F.lit("question").alias("level")).unionByName(arm_row(rows).withColumn("level", F.lit("arm")))
        seen = Observation()
        both.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("level").parquet(f"{out}/arm={arm}")
    finally:
        rows.unpersist()
    log.info("arm %s: wrote %d rows to %s", arm, seen.get["n"], out)
    return seen.get["n"]


def report_rows(spark: SparkSession, out: str) -> DataFrame:
    """The report as it stands."""
    return read_back(spark, out, REPORT)


if __name__ == "__main__":
    main(__doc__, {"documents": "documents as Parquet", "questions": "questions as Parquet", "report": "folder of the report"}, report)
