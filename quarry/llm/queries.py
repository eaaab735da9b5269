"""The registered queries of the training-data operators, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import audit, html, jaccard, lines, mixing, neardup, packing, repeats, scoring, sharding, sql, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=16)


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_bins(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, sf_dir, "documents"), width=3, pct=90)


def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_sets(table(spark, sf_dir, "documents"), width=3, pct=90)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_scoring, op3_repeats, op4_toxicity, op5_packing, op6_jaccard, op6_jaccard_links, op7_topk, op8_neardup, op9_mixing, op10_html, op11_filter_audit, op12_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_repeats": sql.REPEATS, "op6_jaccard": sql.JACCARD, "op6_jaccard_links": sql.JACCARD_LINKS, "op7_topk": sql.TOPK, "op8_neardup": sql.NEARDUP, "op11_filter_audit": sql.FILTER_AUDIT, "op12_line_dedup": sql.LINE_DEDUP}
