"""Replies of a decision model, read into typed answers and put together into the decisions of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import model_json
from quarry.operators.policy import citation_flags, composite_quality, passage_action
from quarry.operators.search import top
from quarry.settings import DEFAULT, Settings

# The names of a reply's answers, of one question or with the number or name of what they are about.
EFFORT, SUFFICIENCY, GROUNDED, ADDRESSES = "effort", "sufficiency", "grounded", "addresses"
PASSAGE_KINDS = {"c": "relevance", "e": "evidence", "x": "contradiction", "i": "injection"}
CITATION, CANDIDATE = "cite_", "cand_"
ANSWER = "struct<noul:double,choice:string,confidence:double,probabilities:map<string,double>>"


def answers(replies: DataFrame, key: str = "query_id", every: bool = False) -> DataFrame:
    """key, name, noul, choice, confidence, probabilities: one row for each answer of replies(key, reply).

    A reply is JSON with an object `answers`, also within a code fence or other text. A reply that is none, or has no
    answers, gives no rows; an answer of the wrong shape has nulls in its place. Equal names count once.
    every: copies stay, and a reply without answers gives one row of nulls.
    """
    found = F.from_json(F.try_variant_get(model_json("reply"), "$.answers", "string"), f"map<string,{ANSWER}>")
    rows = replies.select(key, (F.explode_outer if every else F.explode)(found).alias("name", "a"))
    rows = rows.select(key, "name", "a.noul", "a.choice", "a.confidence", "a.probabilities")
    return rows if every else rows.dropDuplicates([key, "name"])


def number_after(start: str) -> Column:
    """The number or name that an answer's name ends with, null if it begins otherwise."""
    return F.when(F.col("name").startswith(start), F.substring("name", F.lit(len(start) + 1), F.length("name")))


def screened(found: DataFrame, key: str = "query_id", settings: Settings = DEFAULT) -> DataFrame:
    """key, idx, relevance, evidence, contradiction, injection, action of each passage; what the model left out is 0."""
    kind, idx = F.substring("name", 1, 1), F.regexp_extract("name", "^[cexi](\\d+)$", 1)
    rows = found.withColumn("idx", idx).where("idx <> ''").groupBy(key, F.col("idx").cast("int").alias("idx"))
    scores = rows.agg(*[F.coalesce(F.max(F.when(kind == k, F.col("noul"))), F.lit(0.0)).alias(name) for k, name in PASSAGE_KINDS.items()])
    return scores.withColumn("action", passage_action(settings)[0])


def cited(found: DataFrame, key: str = "query_id") -> DataFrame:
    """key, label, verdict, confidence of each citation; without a choice it says nothing, with confidence 0."""
    rows = found.withColumn("label", number_after(CITATION)).where("label is not null")
    return rows.select(key, F.col("label").cast("int").alias("label"), F.coalesce("choice", F.lit("says_nothing")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def chosen(found: DataFrame, key: str = "query_id") -> DataFrame:
    """key, candidate, candidate_p: the candidate best supported, by its name where several are; no score counts as 0."""
    rows = found.withColumn("candidate", number_after(CANDIDATE)).where("candidate is not null").withColumn("candidate_p", F.coalesce("noul", F.lit(0.0)))
    return top(rows, [key], [F.desc("candidate_p"), F.col("candidate")], 1).select(key, "candidate", "candidate_p")


def decided(replies: DataFrame, key: str = "query_id", settings: Settings = DEFAULT) -> DataFrame:
    """One row for each key of replies(key, reply): what all its answers lead to.

    effort (single_pass unless chosen), no_retrieval (chosen, and likely enough), sufficiency (0 unless answered) and whether the
    gate is passed, grounded and addresses (null unless answered), the passages included, in conflict and dropped, the best
    candidate, the share of citations supported, whether one contradicts (a veto), and the composite quality, which is null
    without addresses; an answer without citations is not supported and not contradicted.
    """
    # One pass: the answers of a passage become one row, and each citation, candidate and choice of effort; all others of a
    # key are one more, and all rows then one of the key. Copies of an answer change none of these sums.
    found = answers(replies, key, every=True)
    idx, kind, name = F.regexp_extract("name", "^[cexi](\\d+)$", 1), F.substring("name", 1, 1), F.col("name")
    own = name.startswith(CITATION) | name.startswith(CANDIDATE)
    supports, contradicts = citation_flags(F.coalesce("choice", F.lit("says_nothing")), F.coalesce("confidence", F.lit(0.0)), settings)
    most = lambda c: F.max(F.when(name == c, F.col("noul")))
    parts = found.groupBy(key, F.when(own, name).alias("own"), F.when(idx != "", idx.cast("int")).alias("idx"), F.when(name == EFFORT, F.col("choice")).alias("chosen")).agg(
        F.max(F.when(name == EFFORT, F.element_at("probabilities", "no_retrieval"))).alias("p"), most(SUFFICIENCY).alias("s"), most(GROUNDED).alias("grounded"), most(ADDRESSES).alias("addresses"),
        F.max(supports.cast("int")).alias("supports"), F.max(contradicts.cast("int")).alias("contradicts"), F.max("noul").alias("noul"),
        *[F.coalesce(F.max(F.when(kind == k, F.col("noul"))), F.lit(0.0)).alias(n) for k, n in PASSAGE_KINDS.items()],
    )
    number = lambda start: F.when(F.col("own").startswith(start), F.substring("own", F.lit(len(start) + 1), F.length("own")))
    cite, cand, action = F.col("own").startswith(CITATION), number(CANDIDATE), F.when(F.col("idx").isNotNull(), passage_action(settings)[0])
    best = F.min(F.when(cand.isNotNull(), F.struct((-F.coalesce("noul", F.lit(0.0))).alias("p"), cand.alias("name"))))
    both = parts.groupBy(key).agg(
        *[F.max(c).alias(c) for c in ("chosen", "p", "s", "grounded", "addresses")], *[F.count_if(action == a).alias(n) for a, n in (("include", "included"), ("conflict", "conflicts"), ("drop", "dropped"))],
        F.avg(F.when(cite, F.col("supports"))).alias("supported"), F.max(F.when(cite, F.col("contradicts") == 1)).alias("contradicts"), best.alias("best"),
    ).select("*", F.col("best.name").alias("candidate"), (-F.col("best.p")).alias("candidate_p"))
    s, effort = F.coalesce("s", F.lit(0.0)), F.coalesce("chosen", F.lit("single_pass"))
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    full = both.select(key, effort.alias("effort"), ((effort == "no_retrieval") & (F.coalesce("p", F.lit(0.0)) >= settings.no_retrieval_threshold)).alias("no_retrieval"), s.alias("sufficiency"), (s >= settings.gate_model_threshold).alias("gate_passed"),
                       "grounded", "addresses", none("included", 0), none("conflicts", 0), none("dropped", 0), "candidate", "candidate_p", none("supported", 0.0), none("contradicts", False))
    return full.withColumn("quality", composite_quality(F.col("addresses"), F.col("supported"), F.col("contradicts")))
