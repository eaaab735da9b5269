"""Places for models: embedders, scorers, decisions and judges as functions of DataFrames, off unless given one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.functions.text import model_json
from quarry.operators.policy import abstention_label, unit_score


class Embedder(Protocol):
    """rows(key, text) -> rows(key, embedding)."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    """hits(query_id, id, q_text, text) -> the same with rerank_score in (0, 1), or null where it has none."""

    def __call__(self, hits: DataFrame) -> DataFrame: ...


def batched_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], key: str = "id", batch: int = 16) -> Embedder:
    """An embedder from a function that loads a model; it is loaded once for each Python worker."""

    def run(rows: DataFrame) -> DataFrame:
        kind = dict(rows.dtypes)[key]

        def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for f in frames:
                texts = f["text"].tolist()
                vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
                yield pd.DataFrame({key: f[key], "embedding": vectors})

        return rows.select(key, "text").mapInPandas(embed, f"{key} {kind}, embedding array<double>")

    return run


def pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8) -> Scorer:
    """A scorer of (question, passage) pairs from a function that loads a model. Marked so that it is never run twice."""

    def run(hits: DataFrame) -> DataFrame:
        @F.pandas_udf(DoubleType())
        def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for q, t in parts:
                pairs = list(zip(q, t, strict=True))
                yield pd.Series([s for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])])

        return hits.withColumn("rerank_score", score.asNondeterministic()("q_text", "text"))

    return run


def with_fallback(hits: DataFrame, first: Scorer | None, second: Scorer) -> DataFrame:
    """Scores of the first scorer with those of the second where it gives none, and which it was."""
    if first is None:
        return second(hits).withColumn("scored_by", F.lit("fallback"))
    a = first(hits).withColumnRenamed("rerank_score", "first_score")
    b = second(a).withColumnRenamed("rerank_score", "second_score")
    return b.select("*", F.coalesce("first_score", "second_score").alias("rerank_score"), F.when(F.col("first_score").isNotNull(), "model").otherwise("fallback").alias("scored_by")).drop("first_score", "second_score")


def completions(prompts: DataFrame, client: Callable[[], Callable[[str], str]], key: str = "query_id", interval_s: float = 1.5, attempts: int = 2) -> DataFrame:
    """key, answer, error of a model called for each prompt, at most one call an interval in each task."""
    kind = dict(prompts.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, slot = client(), 0.0
        for f in frames:
            out = []
            for k, p in zip(f[key], f["prompt"], strict=True):
                answer, error = None, None
                for _ in range(attempts):
                    slot = max(time.monotonic(), slot + interval_s)
                    time.sleep(max(0.0, slot - time.monotonic()))
                    try:
                        answer, error = call(p), None
                        break
                    except Exception as e:  # noqa: BLE001 - the model's failure is a result here
                        error = str(e)
                out.append((k, answer, error))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string, error string")


def judged(answers: DataFrame) -> DataFrame:
    """answers(key..., answer) with correctness, faithfulness and abstention read from the judge's JSON."""
    v = model_json("answer")
    at = lambda p, t: F.try_variant_get(v, p, t)
    return answers.withColumn("correctness", unit_score(at("$.correctness", "string"))).withColumn("faithfulness", unit_score(at("$.faithfulness", "string"))).withColumn("abstention", abstention_label(F.coalesce(at("$.abstention", "string"), F.lit(""))))


def judge_agreement(cases: DataFrame) -> DataFrame:
    """Share of test cases (score, least, most) whose score lies where it has to."""
    return cases.agg(F.avg(F.col("score").between(F.col("least"), F.col("most")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def best_choice(options: DataFrame, by: str) -> DataFrame:
    """by, choice, confidence: the option of greatest probability, the first of equals."""
    return options.groupBy(by).agg(F.min(F.struct((-F.col("p")).alias("m"), "idx", "option")).alias("b")).select(by, F.col("b.option").alias("choice"), (-F.col("b.m")).alias("confidence"))


def paraphrase_lines(answers: DataFrame, n: int) -> DataFrame:
    """The first n non-empty lines of a model's answer, without list marks."""
    lines = F.filter(F.transform(F.split("answer", "\n"), lambda x: F.trim(F.regexp_replace(x, "^\\s*(?:[-*]|\\d+[.)])\\s*", ""))), lambda x: x != "")
    return answers.withColumn("paraphrases", F.slice(lines, 1, n))
