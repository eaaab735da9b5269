"""Retrieval metrics, arm summaries and judgement aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("hit1", "hit4", "hit10", "mrr", "recall4", "recall10", "ndcg10")


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, by: str = "query_id") -> DataFrame:
    """by and METRICS of ranked(by, rank, filename) against gold(by, filename); queries with gold only.

    A file counts where it first comes up and keeps its later ranks as misses. The gain of rank r is 1 / log2(r + 1); the
    ideal has min(gold, 10) gains. Recall compares sets of files.
    """
    goal = gold.select(by, "filename").distinct()
    size = goal.groupBy(by).agg(F.count("*").alias("g"))
    first = ranked.withColumn("first", F.row_number().over(Window.partitionBy(by, "filename").orderBy("rank")) == 1).where("first and rank <= 10")
    rel = first.join(goal, [by, "filename"], "left_semi")
    per = rel.groupBy(by).agg(
        F.min("rank").alias("best"), F.count_if(F.col("rank") <= 4).alias("in4"), F.count("*").alias("in10"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("g", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    hit = lambda k: F.coalesce((F.col("best") <= k).cast("int"), F.lit(0))
    return size.join(per, by, "left").select(
        by, hit(1).alias("hit1"), hit(4).alias("hit4"), hit(10).alias("hit10"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("in4", F.lit(0)) / F.col("g")).alias("recall4"), (F.coalesce("in10", F.lit(0)) / F.col("g")).alias("recall10"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg10"),
    )


def mean_metrics(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    present = [F.avg(c).alias(c) for c in METRICS if c in per_query.columns]
    return per_query.groupBy(*(by or [])).agg(*present)


def percentile(c: Column | str, p: float) -> Column:
    """Inclusive linear interpolation; 0 for no values."""
    return F.coalesce(F.percentile(c, p / 100), F.lit(0.0))


def arm_columns() -> list[Column]:
    """Aggregates of one arm's result rows. A missing latency within timings counts as 0, rows without timings do not."""
    latency = F.when(F.col("has_timings"), F.coalesce("latency_ms", F.lit(0.0)))
    both = F.col("recall4").isNotNull() & F.col("naive_recall4").isNotNull()
    return [
        F.count("*").alias("n"), F.avg("correctness").alias("correctness"), F.avg("faithfulness").alias("faithfulness"),
        F.count_if(F.col("abstention") == "answered").alias("answered"), F.count_if(F.col("abstention") == "abstained").alias("abstained"), F.count_if(F.col("abstention") == "partial").alias("partial"),
        F.avg("hit1").alias("hit1"), F.avg("recall4").alias("recall4"), F.avg("mrr").alias("mrr"),
        F.avg(latency).alias("latency_mean"), percentile(latency, 50).alias("latency_p50"), percentile(latency, 95).alias("latency_p95"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("error").alias("errors"),
        F.avg("sufficiency_p").alias("sufficiency_mean"), F.avg("verification_p").alias("verification_mean"), (F.avg(F.when(both, F.col("recall4"))) - F.avg(F.when(both, F.col("naive_recall4")))).alias("rerank_lift"),
    ]


def arm_summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(*arm_columns())


def rolled_summary(results: DataFrame) -> DataFrame:
    """Every scenario and, as scenario 'overall', all of them, with distinct questions, in one rollup."""
    out = results.rollup("mode", "scenario_id").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("questions"), F.avg("correctness").alias("correctness"), F.grouping("scenario_id").alias("all_scenarios"), F.grouping("mode").alias("all_modes"))
    return out.where("all_modes = 0").select("mode", F.when(F.col("all_scenarios") == 1, "overall").otherwise(F.col("scenario_id")).alias("scenario_id"), "n", "questions", "correctness")


def pairwise_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Wins, losses and ties of the hybrid arm; judge errors are counted apart and are no ties."""
    ok = (F.col("winner") != "error") & ~F.col("judge_error")
    n = F.count_if(ok)
    count = lambda w: F.count_if(ok & (F.col("winner") == w))
    return results.where("winner is not null").groupBy(*by).agg(
        n.alias("n"), count("hybrid").alias("wins"), count("traditional").alias("losses"), count("tie").alias("ties"),
        ((count("hybrid") + 0.5 * count("tie")) / F.nullif(n, F.lit(0))).alias("win_rate"), (F.count_if(ok & F.col("position_consistent")) / F.nullif(n, F.lit(0))).alias("position_consistency"), F.count_if(~ok).alias("judge_errors"),
    )


def abstention_split(results: DataFrame) -> DataFrame:
    """Per mode: proper abstention and fabrication on unanswerable questions, over-abstention on answerable ones."""
    labelled = results.where("abstention is not null")
    yes, no = F.col("answerable"), ~F.col("answerable")
    rate = lambda on, what: F.count_if(on & what) / F.nullif(F.count_if(on), F.lit(0))
    return labelled.groupBy("mode").agg(
        F.count_if(yes).alias("answerable"), F.count_if(no).alias("unanswerable"), rate(no, F.col("abstention") == "abstained").alias("proper_abstention"),
        rate(no, F.col("abstention") == "answered").alias("fabrication"), rate(yes, F.col("abstention") == "abstained").alias("over_abstention"),
    )


def gate_quality(rows: DataFrame, p: str, truth: str, threshold: float) -> DataFrame:
    """accuracy at the threshold, Brier score, share of true, n."""
    y = F.col(truth).cast("double")
    return rows.where(F.col(p).isNotNull()).agg(F.avg(((F.col(p) >= threshold) == F.col(truth)).cast("double")).alias("accuracy"), F.avg(F.pow(F.col(p) - y, 2)).alias("brier"), F.avg(y).alias("true_rate"), F.count("*").alias("n"))


def nearest_rank(c: str, q: float, upper: bool) -> Column:
    """Client-side percentile of a column: sorted[floor(q n)], or sorted[ceil(q n) - 1] if upper."""
    return F.expr(f"percentile_disc({q}) within group (order by {c})" if upper else f"percentile_disc({1 - q}) within group (order by {c} desc)")


def live_summary(results: DataFrame) -> DataFrame:
    """The client's summary: a missing latency is 0, a missing abstention label 'pending', nearest-rank percentiles."""
    rows = results.withColumn("lat", F.coalesce("latency_ms", F.lit(0.0)))
    return rows.groupBy("scenario_id", "mode").agg(F.count("*").alias("n"), F.avg("lat").alias("mean"), nearest_rank("lat", 0.5, False).alias("p50"), nearest_rank("lat", 0.95, True).alias("p95"), F.count_if(F.coalesce("abstention", F.lit("pending")) == "pending").alias("pending"), F.count("error").alias("errors"))


def average_precision(verdicts: DataFrame, by: str) -> DataFrame:
    """Mean over relevant positions of the share relevant so far; 0 if none is relevant."""
    seen = verdicts.withColumn("hits", F.sum(F.col("relevant").cast("int")).over(Window.partitionBy(by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy("position")))
    return seen.groupBy(by).agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("hits") / F.col("at"))), F.lit(0.0)).alias("context_precision"))


def context_recall(claims: DataFrame, questions: DataFrame, by: str) -> DataFrame:
    """Supported share of a question's claims: 1 without a reference, else 0 without context or claims."""
    agg = claims.groupBy(by).agg(F.avg(F.col("supported").cast("double")).alias("share"))
    blank = F.trim(F.coalesce("reference", F.lit(""))) == ""
    return questions.join(agg, by, "left").select(by, F.when(blank, 1.0).when(~F.col("has_context"), 0.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("context_recall"))


def ensemble(scores: DataFrame, by: str) -> DataFrame:
    """Mean score, majority label (ties to the least), agreement 1 - stddev / mean within [0, 1], share of the label."""
    votes = scores.groupBy(by, "label").agg(F.count("*").alias("votes"))
    top = votes.groupBy(by).agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("m"), F.sum("votes").alias("all"))
    agg = scores.groupBy(by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    cv = F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.col("sd") / F.col("mean"))
    return agg.join(top, by).select(by, "mean", F.col("m.label").alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv)).alias("agreement"), (-F.col("m.v") / F.col("all")).alias("label_share"))


def stability(runs: DataFrame, by: str) -> DataFrame:
    """Whether all paraphrases of a question brought the same set of files, and the mean Jaccard overlap with the first one's."""
    sets = runs.withColumn("files", F.array_sort(F.array_distinct("files")))
    first = Window.partitionBy(by).orderBy("variant")
    base = sets.withColumn("base", F.first("files").over(first))
    union = F.size(F.array_union("files", "base"))
    jac = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("files", "base")) / union)
    return base.groupBy(by).agg(F.bool_and(F.col("files") == F.col("base")).alias("stable"), F.avg(jac).alias("overlap"))
