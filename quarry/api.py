"""Facades: retrieval over a chunk table, and evaluation of result rows. All methods return DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import index_tokens
from quarry.operators import chunking, evaluation, runs, search, statistics
from quarry.operators.models import Embedder, Scorer
from quarry.settings import DEFAULT, Settings
from quarry.sources.readers import context_blocks


class RetrievalEngine:
    """Chunks (id, doc_id, filename, text) searched by words, vectors or both. An embedder is a function of DataFrames."""

    def __init__(self, chunks: DataFrame, embedder: Embedder | None = None, scorer: Scorer | None = None, settings: Settings = DEFAULT):
        self.chunks, self.settings, self.scorer = chunks, settings, scorer
        self.embedder = embedder or (lambda rows: search.hashed_embedding(rows))

    @classmethod
    def from_documents(cls, docs: DataFrame, settings: Settings = DEFAULT, **options) -> RetrievalEngine:
        """Chunk docs(doc_id, title, text) and search the chunks."""
        c = chunking.structure_chunks(docs, settings)
        return cls(c.select(F.concat_ws(":", "doc_id", "chunk_index").alias("id"), "doc_id", F.col("doc_id").alias("filename"), "text"), settings=settings, **options)

    def scoped(self, documents: DataFrame) -> RetrievalEngine:
        """The same over some documents only; word statistics are those of the scope."""
        out = RetrievalEngine(self.chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi"), self.embedder, self.scorer, self.settings)
        return out

    def lexical(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        return search.bm25(queries, self.chunks, k or self.settings.retrieve_k, self.settings)

    def dense(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        q = self.embedder(queries.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id")
        return search.nearest(q, self.embedder(self.chunks.select("id", "text")), k or self.settings.retrieve_k)

    def retrieve(self, queries: DataFrame, mode: str = "hybrid", k: int | None = None) -> DataFrame:
        """query_id, id, rank, rrf_score, similarity with the chunk's doc_id, filename and text."""
        k = k or self.settings.retrieve_k
        if mode == "dense":
            hits = self.dense(queries, k).select("query_id", "id", "rank", F.lit(None).cast("double").alias("rrf_score"), "similarity")
        elif mode == "lexical":
            hits = self.lexical(queries, k).select("query_id", "id", "rank", F.lit(None).cast("double").alias("rrf_score"), F.lit(0.0).alias("similarity"))
        else:
            hits = search.hybrid(self.lexical(queries, k), self.dense(queries, k), k, self.settings)
        return hits.join(self.chunks, "id")

    def rerank(self, queries: DataFrame, hits: DataFrame, keep: int | None = None) -> DataFrame:
        both = hits.join(queries.select("query_id", F.col("text").alias("q_text")), "query_id")
        if self.scorer is not None:
            both = self.scorer(both)
            score: Column = F.coalesce("rerank_score", F.lit(0.0))
        else:
            score = search.overlap_score(index_tokens("q_text"), index_tokens("text"))
        return search.rerank(both, score).where(F.col("rank") <= (keep or self.settings.use_k))

    def gate(self, kept: DataFrame) -> DataFrame:
        """query_id, features and escalate."""
        f = search.gate_features(kept, self.settings)
        return f.withColumn("escalate", ~search.gate_passes(F.col("top1"), "features", self.settings))

    def context(self, kept: DataFrame) -> DataFrame:
        return context_blocks(kept)

    def upsert(self, chunks: DataFrame) -> RetrievalEngine:
        return RetrievalEngine(runs.replace_document(self.chunks, chunks, "doc_id", ["id"]), self.embedder, self.scorer, self.settings)

    def delete(self, documents: DataFrame) -> RetrievalEngine:
        return RetrievalEngine(runs.without(self.chunks, documents, ["doc_id"]), self.embedder, self.scorer, self.settings)

    def with_settings(self, **changes) -> RetrievalEngine:
        return RetrievalEngine(self.chunks, self.embedder, self.scorer, replace(self.settings, **changes))


class EvalSuite:
    """Reports over result rows."""

    def __init__(self, results: DataFrame):
        self.results = results

    def arms(self, *by: str) -> DataFrame:
        return evaluation.arm_summary(self.results, [*by] or ["mode"])

    def pairwise(self, *by: str) -> DataFrame:
        return evaluation.pairwise_summary(self.results, [*by] or ["mode"])

    def abstention(self) -> DataFrame:
        return evaluation.abstention_split(self.results)

    def gate(self, threshold: float = 0.6) -> DataFrame:
        return evaluation.gate_quality(self.results, "sufficiency_p", "answerable", threshold)

    def paired_tests(self, value: str = "correctness", arm: str = "hybrid", base: str = "traditional", by: str = "qtype") -> DataFrame:
        """Per group: won and lost pairs, McNemar p and its false-discovery q, mean difference."""
        p = statistics.paired(self.results, value, arm, base)
        d = p.groupBy(by).agg(F.avg("diff").alias("delta"))
        tests = statistics.discordant(p, [by]).join(d, by).withColumn("name", F.col(by).cast("string")).withColumn("grid", F.lit("all"))
        return statistics.false_discovery(tests, ["grid"]).drop("grid", "name")

    def markdown(self) -> DataFrame:
        """The arm table as lines of markdown."""
        from quarry.functions.text import percent, seconds

        a = self.arms("mode")
        return a.select(F.concat(F.lit("| "), F.concat_ws(" | ", "mode", F.col("n").cast("string"), percent("correctness"), percent("recall4"), seconds("latency_p50")), F.lit(" |")).alias("line"))
