"""Retrieval: inverted index, BM25, exact vector neighbours, rank fusion, reranking and gating, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import STOP, index_tokens
from quarry.operators.lexical import bm25_scores, pieces
from quarry.settings import DEFAULT, Settings

try:  # the same digests, without what OpenSSL sets up for each
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Buckets of corpus blocks that a set of vector queries is dealt to, at least; vectors of a block of the corpus and of queries.
BUCKETS, CORPUS_BLOCK, QUERY_BLOCK = 32, 4096, 512
#: Hits that are broadcast to the texts, at most (some 64 bytes each).
MOST_HITS = 1 << 18
#: Texts whose terms are counted at once.
TEXTS_AT_ONCE = 1024
#: Bytes of the terms of all queries, some for each row counted, up to which they are broadcast.
MOST_ASKED = 16 << 20
#: Characters of passages in one automaton (some 50 bytes of memory each), and of all passages that are broadcast; hits in a batch.
PART_PASSAGES, MOST_PASSAGES, HITS_AT_ONCE = 1 << 20, 1 << 22, 1 << 16


def postings(chunks: DataFrame, key: str = "id", text: str = "text", stop=...) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, term, tf, dl), (term, df), one row (n, avgdl). n counts chunks without tokens too."""
    toks = index_tokens(text) if stop is ... else index_tokens(text, stop)
    rows = chunks.select(F.col(key), toks.alias("tokens"))
    # An outer explode, as for an inner one Spark first asks for arrays that are not empty, and cuts all texts a second time.
    tf = rows.select(key, F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).groupBy(key, "term", "dl").agg(F.count("term").alias("tf")).where("tf > 0")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # Lengths add up to the term frequencies, whose exchange is used again; the texts are cut into tokens once.
    stats = chunks.agg(F.count("*").alias("n")).crossJoin(tf.agg(F.sum("tf").alias("all"))).select("n", (F.coalesce("all", F.lit(0)) / F.nullif("n", F.lit(0))).alias("avgdl"))
    return tf, df, stats


def keys_differ(chunks: DataFrame, key: str) -> bool:
    """Whether every row has a key of its own; only keys are read."""
    return chunks.groupBy(key).count().where("count > 1").isEmpty()


def counted_in_place(chunks: DataFrame, key: str, stop=...) -> DataFrame:
    """(key, term, tf, dl) as in postings(), of chunks whose keys differ: counted where the texts are, without a shuffle."""
    toks = index_tokens("text") if stop is ... else index_tokens("text", stop)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, TEXTS_AT_ONCE) for at in range(0, whole.num_rows, TEXTS_AT_ONCE)):
                dl = np.asarray(b.column(1).value_lengths().fill_null(0), np.int64)
                words = b.column(1).flatten().dictionary_encode()
                at, tf = np.unique(np.repeat(np.arange(b.num_rows), dl) * max(1, len(words.dictionary)) + np.asarray(words.indices, np.int64), return_counts=True)
                row, word = np.divmod(at, max(1, len(words.dictionary)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), words.dictionary.take(pa.array(word)), pa.array(dl[row].astype(np.int32)), pa.array(tf)], names=[key, "term", "dl", "tf"])

    return chunks.select(F.col(key), toks.alias("tokens")).mapInArrow(count, f"`{key}` {dict(chunks.dtypes)[key]}, term string, dl int, tf long")


def counted(chunks: DataFrame, key: str = "id", stop=...) -> DataFrame:
    """(key, term, tf, dl) as in postings(): in place where keys differ."""
    return counted_in_place(chunks, key, stop) if keys_differ(chunks, key) else postings(chunks, key, "text", stop)[0]


def vocabulary(chunks: DataFrame, key: str = "id", stop=...) -> tuple[DataFrame, DataFrame]:
    """(term, df, cf), one row (n, avgdl), as from postings(); terms add up before they are shuffled."""
    terms = counted(chunks, key, stop).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    # The sum names both columns, so that it reads the same exchange as the terms.
    return terms, lengths(chunks, terms.agg(F.sum(F.when(F.col("df") > 0, F.col("cf"))).alias("all")))


def lengths(chunks: DataFrame, total: DataFrame) -> DataFrame:
    """One row (n, avgdl) of the chunks and the sum of their lengths, `all`."""
    return chunks.agg(F.count("*").alias("n")).crossJoin(total).select("n", (F.coalesce("all", F.lit(0)) / F.nullif("n", F.lit(0))).alias("avgdl"))  # one row each


def top(ranked: DataFrame, by: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    out = ranked.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def numbered(rows: DataFrame, by: list[str], order: list[Column], parts: int, path: str, name: str = "rank") -> DataFrame:
    """As top() without k, for a few groups of any size: no task sorts a group.

    All rows are dealt into `parts` ranges of (by, order), sorted, and written below `path` with their places, as ranges are
    drawn anew in each run. A number is the place in the range after the rows of the group in ranges before. The firsts of
    groups in ranges are broadcast: one for each group and range at most.
    """
    keys = [F.col(c) for c in by]
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt.withColumn("#place", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path).withColumn("#range", F.shiftright("#place", 33))
    firsts = placed.groupBy(*by, "#range").agg(F.min("#place").alias("#first"), F.count("*").alias("#n"))
    before = F.sum("#n").over(Window.partitionBy(*by).orderBy("#range").rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.select(*[F.col(c).alias(f"#{c}") for c in by], F.col("#range").alias("#r"), (F.coalesce(before, F.lit(0)) - F.col("#first") + 1).alias("#add"))
    same = F.col("#range") == F.col("#r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"#{c}"))
    return placed.join(F.broadcast(firsts), same).select(*rows.columns, (F.col("#place") + F.col("#add")).alias(name))


def asked_postings(chunks: DataFrame, terms: DataFrame, key: str, stop=...) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As postings(), of the asked terms only, and all others as the empty term; the statistics are those of all chunks.

    terms(term) is broadcast, so its size has to be known. Tokens that nobody asks for become one term of their chunk
    before the shuffle: what is shuffled is a row for each chunk and each asked term in it, and no term is a key.
    """
    toks = index_tokens("text") if stop is ... else index_tokens("text", stop)
    every = chunks.select(F.col(key), toks.alias("tokens")).select(key, F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("t"))
    known = every.join(F.broadcast(terms.withColumn("asked", F.lit(True))), F.col("t") == F.col("term"), "left")
    # The empty term, which no token is, stands for all others. Frequencies, documents of a term and lengths come from one
    # exchange: each reads tf, and none has a filter that Spark could move below it.
    counted = known.groupBy(key, "dl", F.coalesce(F.when(F.col("asked"), F.col("t")), F.lit("")).alias("term")).agg(F.count("t").alias("tf"))
    df = counted.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    stats = chunks.agg(F.count("*").alias("n")).crossJoin(counted.agg(F.sum("tf").alias("all"))).select("n", (F.coalesce("all", F.lit(0)) / F.nullif("n", F.lit(0))).alias("avgdl"))  # one row each
    return counted, df, stats


def bm25(queries: DataFrame, chunks: DataFrame, k: int | None = None, settings: Settings = DEFAULT, query_key: str = "query_id", key: str = "id", stop=..., index: tuple[DataFrame, DataFrame, DataFrame] | None = None, one_each: bool = False) -> DataFrame:
    """query_key, key, score, rank of the chunks with a positive score; a query's repeated terms count repeatedly.

    index: postings() of the chunks, if they are there already. Without one, only postings of asked terms are made. The
    terms of the queries, once their size was checked, are broadcast to the chunks or postings; larger sets of queries meet all postings
    in an equi-join on the term, whose hot keys adaptive execution splits. one_each: keys of the chunks are known to differ,
    so that all terms of a key are in one text; a few questions then get their scores from blocks of chunks.

    Ties of scores rounded to nine digits go to the smaller key. Scope a search by filtering chunks before the call, as
    document frequencies and lengths belong to the scope.
    """
    toks = index_tokens("text") if stop is ... else index_tokens("text", stop)
    asked = queries.select(query_key, F.explode(toks).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    few = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0] <= MOST_ASKED
    if few and one_each and not index:
        scored = bm25_scores(asked, chunks, k, settings, query_key, key, STOP if stop is ... else stop)
        return top(scored, [query_key], [F.desc(F.round("score", 9)), F.col(key)], k)
    small = F.broadcast if few else (lambda rows: rows)
    terms = asked.select("term").distinct()
    tf, df, stats = index or (asked_postings(chunks, terms, key, stop) if few else postings(chunks, key, "text", stop))
    if index and few:  # postings stay where they are, and of the index's terms only those asked for are sent
        df = df.join(F.broadcast(terms), "term", "left_semi")
    if few and not index:  # all terms of a chunk come together, so that its pairs with queries, far more rows, add up where they are made
        tf = tf.repartition(key)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = settings.bm25_k1 * (1 - settings.bm25_b + settings.bm25_b * F.col("dl") / F.col("avgdl"))
    hits = tf.join(small(asked), "term").join(small(df), "term").crossJoin(stats)  # stats is one row; no more terms are found than asked
    scored = hits.groupBy(query_key, key).agg(F.sum(F.col("qtf") * idf * F.col("tf") * (settings.bm25_k1 + 1) / (F.col("tf") + norm)).alias("score")).where("score > 0")
    return top(scored, [query_key], [F.desc(F.round("score", 9)), F.col(key)], k)


def fuse(rankings: DataFrame, k: int | None = None, rrf_k: int = 60, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """Reciprocal rank fusion of rankings(query_key, key, rank): sum of 1 / (rrf_k + rank)."""
    fused = rankings.groupBy(query_key, key).agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("rrf_score"))
    return top(fused, [query_key], [F.desc(F.round("rrf_score", 9)), F.col(key)], k)


def _blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """block, keys, dim, values: up to `size` rows of one partition as one row; vectors of equal length in a block, null and zero ones in none."""
    kind = dict(rows.dtypes)[key]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pd.DataFrame:
            nonlocal seq
            keys, values = held.pop(dim)
            seq += 1
            return pd.DataFrame({"block": [(task << 32) | seq], "keys": [keys], "dim": [dim], "data": [np.stack(values).tobytes()]})

        for f in frames:
            for k, v in zip(f["k"], f["v"], strict=True):
                v = np.asarray(v, float)
                norm = np.sqrt(v @ v)
                if not norm > 0:
                    continue
                keys, values = held.setdefault(len(v), ([], []))
                keys.append(k)
                values.append(v / norm)
                if len(keys) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    v = F.col(vector).cast("array<double>")
    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return whole.select(F.col(key).alias("k"), v.alias("v")).mapInPandas(pack, f"block long, keys array<{kind}>, dim int, data binary")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "id", vector: str = "embedding") -> DataFrame:
    """query_key, key, similarity, rank of the k vectors of greatest cosine.

    Every query has to meet every vector, as blocks of both in one matrix product each. Blocks of the corpus are dealt to
    as many buckets as the session has partitions and the blocks of queries go to each; of a query only the best k leave a
    block. Vectors that are null, zero or hold nulls are near nothing, and vectors of another length than the query's.
    """
    spark = vectors.sparkSession
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    corpus = _blocks(vectors, key, vector, CORPUS_BLOCK).withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    asked = _blocks(queries, query_key, vector, QUERY_BLOCK).select(F.col("keys").alias("q_keys"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    met = corpus.join(asked, "bucket").where("dim = q_dim")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                keys, q_keys = np.asarray(r.keys), np.asarray(r.q_keys)
                sims = np.round(np.frombuffer(r.q_data).reshape(-1, r.dim) @ np.frombuffer(r.data).reshape(-1, r.dim).T, 9)
                order = np.argsort(keys, kind="stable")  # equal similarities in order of their keys
                keys, sims = keys[order], sims[:, order]
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({query_key: np.repeat(q_keys, best.shape[1]), key: keys[best].ravel(), "similarity": np.take_along_axis(sims, best, 1).ravel()})

    kinds = f"{query_key} {dict(queries.dtypes)[query_key]}, {key} {dict(vectors.dtypes)[key]}, similarity double"
    pairs = met.select("keys", "dim", "data", "q_keys", "q_data").mapInPandas(compare, kinds)
    return top(pairs, [query_key], [F.desc(F.round("similarity", 9)), F.col(key)], k)


def hashed_embedding(docs: DataFrame, key: str = "id", text: str = "text", bins: int = 64, one_each: bool = False) -> DataFrame:
    """key, embedding: words in lower case hashed by md5, 1 to the bin of its last byte and 0.5 to that of the one before, unit length.

    Bins are counted where the text is, for all texts of a block at once; what is shuffled is a row of counts for each text,
    as texts of one key count together. one_each: keys are known to differ, and nothing is shuffled.
    """

    def halves_of(texts: pa.LargeStringArray) -> np.ndarray:
        """Twice the weight of each bin."""
        words = pc.ascii_split_whitespace(texts)  # the white space of Spark's \\s; empty words before and after
        row, found = np.repeat(np.arange(len(texts)), np.asarray(words.value_lengths(), np.int64)), words.flatten().dictionary_encode()
        there = np.asarray(pc.binary_length(found.dictionary)) > 0
        letters, ends, digests = bytes(found.dictionary.buffers()[2] or b""), np.cumsum(pc.binary_length(found.dictionary)).tolist(), bytearray()
        for i, j in zip([0, *ends[:-1]], ends, strict=True):
            digests += md5(letters[i:j], usedforsecurity=False).digest()
        digests = np.frombuffer(digests, np.uint8).reshape(-1, 16)
        word = np.asarray(found.indices)
        row, word = row[there[word]], word[there[word]]
        last, before = (np.bincount(row * bins + digests[word, i] % bins, minlength=len(texts) * bins) for i in (15, 14))
        return (2 * last + before).reshape(-1, bins)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in pieces(batches):
            values = halves_of(texts)
            some = values.any(axis=1)
            values = values[some]
            if one_each:
                values = values / np.sqrt((values * values).sum(1).astype(float))[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bins, dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(some)), flat], names=[key, name])

    name, kind = ("embedding", "double") if one_each else ("halves", "bigint")
    whole = docs.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("_text"))
    counted = whole.mapInArrow(count, f"`{key}` {dict(docs.dtypes)[key]}, {name} array<{kind}>")
    if one_each:
        return counted
    counted = counted.groupBy(key).agg(F.collect_list("halves").alias("h"))
    added = F.when(F.size("h") == 1, F.element_at("h", 1)).otherwise(F.aggregate("h", F.array_repeat(F.lit(0).cast("long"), bins), lambda x, y: F.zip_with(x, y, lambda p, q: p + q)))
    norm = F.sqrt(F.aggregate("halves", F.lit(0).cast("long"), lambda x, y: x + y * y).cast("double"))
    # The norm is an array beside the counts: inside the function of an element it would be worked out for each element.
    return counted.select(key, added.alias("halves")).select(key, F.zip_with("halves", F.array_repeat(norm, bins), lambda x, n: x / n).alias("embedding"))


def hybrid(lexical: DataFrame, dense: DataFrame, k: int, settings: Settings = DEFAULT, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """query_key, key, rank, rrf_score, similarity: the k best of both; similarity is 0 where only words matched."""
    both = lexical.where(F.col("rank") <= k).select(query_key, key, "rank").unionByName(dense.where(F.col("rank") <= k).select(query_key, key, "rank"))
    fused = fuse(both, k, settings.rrf_k, query_key, key)
    near = dense.where(F.col("rank") <= k).select(query_key, key, "similarity")
    return fused.join(near, [query_key, key], "left").select(query_key, key, "rank", "rrf_score", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def multi_query(hits: DataFrame, pool: int = 12, per_query: int = 6) -> DataFrame:
    """Pool of hits(query_id, sub_idx, rank, id, score) of several sub-queries: the first occurrence of an id counts, not its best."""
    first = top(hits.where(F.col("rank") <= per_query), ["query_id", "id"], [F.col("sub_idx"), F.col("rank")], 1, "seen")
    return top(first, ["query_id"], [F.desc(F.round("score", 5)), F.col("sub_idx"), F.col("rank")], pool, "pool_rank").select("query_id", "id", "score", "pool_rank")


def overlap_score(query_tokens: str, passage_tokens: str) -> Column:
    """Stand-in for a cross-encoder: logistic of the share of the query's distinct tokens that the passage holds."""
    share = F.size(F.array_intersect(F.array_distinct(query_tokens), F.array_distinct(passage_tokens))) / F.greatest(F.size(F.array_distinct(query_tokens)), F.lit(1))
    return 1 / (1 + F.exp(-(share * 6 - 3)))


def rerank(hits: DataFrame, score: Column, by_rounded: bool = False, query_key: str = "query_id") -> DataFrame:
    """hits(query_key, rank, ...) in order of score, ties as they came; by_rounded sorts by four digits, as the helper does."""
    scored = hits.withColumn("rerank_score", score)
    order = F.round("rerank_score", 4) if by_rounded else F.round("rerank_score", 9)
    return top(scored.withColumnRenamed("rank", "retrieval_rank"), [query_key], [order.desc(), F.col("retrieval_rank")], None)


Scorer = Callable[[DataFrame], DataFrame]


def gate_features(kept: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, top1, top2, margin, mean, above: of kept(query_id, rank, rerank_score); missing scores count as 0."""
    s = F.coalesce("rerank_score", F.lit(0.0))
    rows = kept.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, s)).alias("a"), F.max(F.when(F.col("rank") == 2, s)).alias("b"), F.avg(s).alias("mean"),
        F.count_if(s >= settings.relevance_floor).alias("above"),
    )
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return rows.select("query_id", a.alias("top1"), b.alias("top2"), (a - b).alias("margin"), "mean", "above")


def gate_passes(p: Column, mode: str = "features", settings: Settings = DEFAULT) -> Column:
    """Null fails; features compare with the score threshold, a model with 0.5."""
    limit = settings.gate_score_threshold if mode == "features" else settings.gate_model_threshold
    return F.coalesce(p >= limit, F.lit(False))


def gate_escalates(override: Column, mode: Column, features_p: Column, model_p: Column, settings: Settings = DEFAULT) -> Column:
    """Injected decision, else never for mode none, else the model's or the features' gate."""
    return F.when(override.isNotNull(), override).when(mode == "none", F.lit(False)).when(mode == "model", ~gate_passes(model_p, "model", settings)).otherwise(~gate_passes(features_p, "features", settings))


def corrective(first: DataFrame, second: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, attempt, p: the first attempt where its gate passes, else the second; both are computed, no loop."""
    a, b = first.select("query_id", F.col("p").alias("p1")), second.select("query_id", F.col("p").alias("p2"))
    ok = gate_passes(F.col("p1"))
    return a.join(b, "query_id", "left").select("query_id", F.when(ok, 1).otherwise(2).alias("attempt"), F.when(ok, F.col("p1")).otherwise(F.col("p2")).alias("p"))


def contained_by_anchors(docs: DataFrame, passages: DataFrame, key: str = "id", passage_key: str = "query_id") -> DataFrame:
    """As containment, for any number of passages.

    A passage has an anchor that each such document has: of five words or more, words two to four, whole and next to each
    other; of three or four words, the second, whole; of fewer, its first characters, up to three. Hashes of the
    documents' anchors meet those of the passages in equi-joins, and only then, by key, the texts to be compared.
    """
    words = F.split(F.col("p_text"), "\\s+")
    asked = passages.select(F.col(passage_key), F.col("text").alias("p_text")).where("p_text <> ''").withColumn("w", words).withColumn("n", F.size("w"))
    asked = asked.withColumn("kind", F.when(F.col("n") >= 5, 4).when(F.col("n") >= 3, 0).otherwise(F.least(F.length("p_text"), F.lit(3))))
    anchor = F.when(F.col("kind") == 4, F.concat_ws(" ", F.slice("w", 2, 3))).when(F.col("kind") == 0, F.get("w", F.lit(1))).otherwise(F.substring("p_text", F.lit(1), F.col("kind")))
    asked = asked.select(passage_key, "p_text", "kind", F.xxhash64(anchor).alias("anchor"))

    def found(kind: int, anchors: Column) -> DataFrame:
        """Candidates whose anchors come from this array of strings of a document's text."""
        spread = docs.select(key, F.explode(F.array_distinct(F.transform(anchors, lambda x: F.xxhash64(x)))).alias("anchor"))
        return spread.join(asked.where(F.col("kind") == kind).select(passage_key, "anchor"), "anchor").select(passage_key, key)

    w = F.split(F.col("text"), "\\s+")
    later = lambda n: F.slice(w, n, F.size(w))
    triples = F.zip_with(F.zip_with(w, later(2), lambda x, y: F.concat_ws(" ", x, y)), later(3), lambda x, y: F.concat_ws(" ", x, y))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(n)))
    near = found(4, triples).unionByName(found(0, w))
    for n in (1, 2, 3):
        near = near.unionByName(found(n, cut(n)))
    met = near.distinct().join(asked.select(passage_key, "p_text"), passage_key)
    return docs.select(key, "text").join(met, key).where(F.expr("contains(text, p_text)")).select(passage_key, key).distinct()


def contained_by_automaton(docs: DataFrame, passages: DataFrame, key: str = "id", passage_key: str = "query_id") -> DataFrame:
    """As containment, for passages of MOST_PASSAGES characters together: texts are read once and give no rows but what is found.

    Tasks get the passages, put them into Aho-Corasick automata of PART_PASSAGES characters, and walk each text once through
    each.
    """
    spark, kinds = docs.sparkSession, f"{passage_key} {dict(passages.dtypes)[passage_key]}, {key} {dict(docs.dtypes)[key]}"
    asked = spark.sparkContext.broadcast([(r[0], r[1]) for r in passages.where("text <> ''").select(passage_key, "text").collect()])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted: dict[str, list] = {}
        for k, text in asked.value:
            wanted.setdefault(text, []).append(k)
        parts, held = [], PART_PASSAGES
        for text in wanted:
            if held >= PART_PASSAGES:
                parts.append(ahocorasick.Automaton())
                held = 0
            parts[-1].add_word(text, text)
            held += len(text)
        for part in parts:
            part.make_automaton()
        hits: list[tuple] = []
        for f in frames:
            for d, text in zip(f[key], f["text"], strict=True):
                hits += [(k, d) for part in (parts if text else ()) for p in {p for _, p in part.iter(text)} for k in wanted[p]]
                if len(hits) >= HITS_AT_ONCE:
                    yield pd.DataFrame(hits, columns=[passage_key, key], dtype=object)
                    hits = []
        yield pd.DataFrame(hits, columns=[passage_key, key], dtype=object)

    return docs.select(key, "text").mapInPandas(walk, kinds).distinct()


def containment(docs: DataFrame, passages: DataFrame, key: str = "id", passage_key: str = "query_id") -> DataFrame:
    """passage_key, key of the documents that contain a passage as a substring; empty and null passages are in none.

    Passages are broadcast only after their characters were counted, and meet texts by anchors where they are too many.
    """
    size = passages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return (contained_by_automaton if size <= MOST_PASSAGES else contained_by_anchors)(docs, passages, key, passage_key)


class IndexCache:
    """Inverted indexes kept for (revision of the corpus, scope), so that searches of one corpus share the tokens they cut.

    A scope is a list of document ids, in any order; an empty one, or none, is the whole corpus. The newest `most` indexes
    stay in the executors' memory and disk; older ones, and those of other revisions, are given back when a new one is
    built, and all of them by clear().
    """

    def __init__(self, most: int = 4):
        self.most, self.built = most, 0
        self.held: dict[tuple[int, str], tuple[DataFrame, DataFrame, DataFrame]] = {}

    @staticmethod
    def key(revision: int, scope: list | None) -> tuple[int, str]:
        return revision, ",".join(sorted(map(str, scope))) if scope else "*"

    def index(self, chunks: DataFrame, revision: int, scope: list | None = None, key: str = "id", doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
        """postings() of the chunks in the scope, built once for a revision."""
        at = self.key(revision, scope)
        if at not in self.held:
            for old in [x for x in self.held if x[0] != revision] + list(self.held)[: max(0, len(self.held) - self.most + 1)]:
                self.drop(old)
            rows = chunks.where(F.col(doc).isin(*scope)) if scope else chunks
            tf = counted(rows, key).persist()  # what follows reads it, and cuts no text
            df, stats = tf.groupBy("term").agg(F.count("*").alias("df")), lengths(rows, tf.agg(F.sum("tf").alias("all")))
            self.held[at] = (tf, df.persist(), stats.persist())
            self.built += 1
        return self.held[at]

    def drop(self, at: tuple[int, str]) -> None:
        for table in self.held.pop(at, ()):
            table.unpersist()

    def clear(self) -> None:
        for at in list(self.held):
            self.drop(at)
