"""Decisions on passages, citations, gates and judgements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import col
from quarry.settings import DEFAULT, Settings


def passage_action(settings: Settings = DEFAULT) -> tuple[Column, Column]:
    """(action, reason) of a row with injection, contradiction, evidence, relevance; missing values are 0. The order matters."""
    inj, con, evi, rel = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("injection", "contradiction", "evidence", "relevance"))
    two = lambda c: F.format_string("%.2f", c)
    weak = (evi < settings.evidence_drop) & (rel < 0.5)
    action = F.when(inj >= settings.injection_drop, "drop").when(con >= settings.contradiction_block, "conflict").when(weak, "drop").otherwise("include")
    reason = (
        F.when(inj >= settings.injection_drop, F.concat(F.lit("prompt injection "), two(inj)))
        .when(con >= settings.contradiction_block, F.concat(F.lit("premise contradiction "), two(con)))
        .when(weak, F.concat(F.lit("no evidence "), two(evi), F.lit(" and weak relevance "), two(rel)))
        .when(evi >= settings.evidence_drop, F.concat(F.lit("evidence "), two(evi)))
        .otherwise(F.concat(F.lit("relevance rescue "), two(rel)))
    )
    return action, reason


def citation_flags(verdict: Column, confidence: Column, settings: Settings = DEFAULT) -> tuple[Column, Column]:
    """(supports with enough confidence, contradicts) of a verdict; missing values do neither."""
    verified = (F.coalesce(verdict, F.lit("says_nothing")) == "supports") & (F.coalesce(confidence, F.lit(0.0)) >= settings.citation_confidence)
    return verified, F.coalesce(verdict == "contradicts", F.lit(False))


def citation_summary(verdicts: DataFrame, by: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """by, supported (share of verdicts that support with enough confidence), contradicts."""
    verified, contradicts = citation_flags(F.col("verdict"), F.col("confidence"), settings)
    return verdicts.groupBy(*by).agg(F.avg(verified.cast("double")).alias("supported"), F.bool_or(contradicts).alias("contradicts"))


def composite_quality(addresses: Column, supported: Column, contradicts: Column) -> Column:
    return F.round(0.4 * addresses + 0.4 * supported + 0.2 * F.when(contradicts, 0.0).otherwise(1.0), 3)


def swapped_verdict(first: Column, second: Column) -> Column:
    """Winner of two judgements in swapped order: any error is an error, agreement stands, disagreement is a tie."""
    return F.when((first == "error") | (second == "error"), "error").when(first == second, first).otherwise("tie")


def abstention_label(label: Column | str) -> Column:
    known = F.lower(F.trim(col(label)))
    return F.when(known.isin("answered", "abstained", "partial"), known).otherwise("answered")


def unit_score(text: Column | str) -> Column:
    """A score clamped to [0, 1]; null if it is no number."""
    x = col(text).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def no_retrieval(choice: Column, p: Column, settings: Settings = DEFAULT) -> Column:
    return F.coalesce((choice == "no_retrieval") & (p >= settings.no_retrieval_threshold), F.lit(False))


def best_of(enabled: Column, hard: Column, gate_ok: Column, effort: Column) -> Column:
    return F.coalesce(enabled & hard & (~gate_ok | (effort == "multi_step")), F.lit(False))


def escalated(answer_json: Column | str, threshold: float = 0.5) -> Column:
    """Gate answers of any kind: booleans as they are, numbers below the threshold, the word 'escalate'."""
    v = F.try_parse_json(col(answer_json))
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number < threshold)
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "string") == "escalate", F.lit(False)))
    )


def first_gate_score(answer_json: Column | str, top1: Column, mode: Column, fallback: Column) -> Column:
    """Number of the first gate reading: a model's numeric answer, else the features' top1; other kinds fall back."""
    v = F.try_parse_json(col(answer_json))
    number = F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    return F.when(mode == "model", F.coalesce(number, fallback)).otherwise(F.coalesce(top1, fallback))
