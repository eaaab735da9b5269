"""All reference-parity queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import evaluation, records, registry, retrieval, streams  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top BM25 hit of every benchmark item."""
    return retrieval.bm25_top(registry.Tables(spark, sf_dir), 1)


def queries() -> dict:
    return registry.queries()


def oracle_sql() -> dict:
    return registry.oracles()
