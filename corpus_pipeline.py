"""The corpus pipeline: documents without toxic ones, near-duplicates and repeated passages, mixed and packed into bins.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name; all but the last give the columns they got. Null and empty texts are never toxic by themselves, have no near
duplicates and nothing to cut (a null becomes empty there), size 0 in the mix, and a piece of size 0. A null doc_id comes
before all others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import jaccard, mixing, packing, repeats, toxicity
from quarry.llm.common import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, as often as they occur; equal texts score alike."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: that of the least doc_id; texts without words all stay."""
    return jaccard.one_of_each(docs, width=5, pct=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller doc_id has; rows of one doc_id take nothing from each other."""
    return repeats.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, some not at all; a null source is one of its own."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their texts and the bins that hold them."""
    return packing.packed_texts(docs)


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard_join", jaccard_stage), ("suffix_array_dedup", repeats_stage), ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage)]

#: The toxicity model and the rounding of copies are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over all documents, each written as Parquet and read again by the next; what a stage wrote goes when the next has."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}", *written)
            written = (docs,)
    return docs
