"""Retrieval queries over documents, benchmark passages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import search as se
from quarry.operators.parts import parts_for
from quarry.operators.vectors import VectorIndex
from quarry.plans.registry import Tables, query
from quarry.sources.sinks import new_folder

# Text of the tokenizer and of BM25 for DuckDB.
_CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
_OTHER = r"0-9A-Za-z_\x{c0}-\x{303f}\x{3100}-\x{4dff}\x{a000}-\x{abff}\x{e000}-\x{ffff}"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP)


def toks(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '([{_CJK}]+|[{_OTHER}]+)'), lambda t: t not in ({_STOP}))"


def bm25_sql(queries: str, chunks: str, prefix: str = "") -> str:
    p = prefix
    return f"""{p}tk as (select id, {toks('text')} as t from {chunks}), {p}st as (select count(*) as n, avg(len(t)) as avgdl from {p}tk),
      {p}tf as (select id, dl, term, count(*) as tf from (select id, len(t) as dl, unnest(t) as term from {p}tk) group by all),
      {p}df as (select term, count(*) as df from {p}tf group by term),
      {p}qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({toks('text')}) as term from {queries}) group by all),
      {p}sc as (select query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
        from {p}qt join {p}tf using (term) join {p}df using (term), {p}st group by all),
      {p}rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from {p}sc where score > 0)"""


def items(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


_ITEMS = "items as (select item_id as query_id, text from {benchmark}), docs as (select doc_id as id, text from {documents})"


@query(f"select doc_id, array_to_string({toks('text')}, ' ') as tokens, len({toks('text')}) as n_tokens from {{documents}}")
def r1_r2_tokenizer(t: Tables):
    return t.documents.select("doc_id", F.concat_ws(" ", tx.index_tokens("text")).alias("tokens"), F.size(tx.index_tokens("text")).cast("long").alias("n_tokens"))


@query(f"with {_ITEMS}, tk as (select id, {toks('text')} as t from docs), tf as (select id, term, count(*) as tf from (select id, unnest(t) as term from tk) group by all), df as (select term, count(*) as df, sum(tf) as cf from tf group by term), n as (select count(*) as n, avg(len(t)) as avgdl from tk) select term, df, cast(cf as bigint) as cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf, round(avgdl, 6) as avgdl from df, n")
def r3_inverted_index(t: Tables):
    terms, st = se.vocabulary(docs(t))
    return terms.crossJoin(st).select("term", "df", "cf", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


_TOP10 = "select query_id, id, round(score, 6) as score, rank from rk where rank <= 10"


def bm25_top(t: Tables, k: int = 10):
    return se.bm25(items(t), docs(t), k)


@query(f"with {_ITEMS}, {bm25_sql('items', 'docs')} {_TOP10}")
def r4_bm25_top10(t: Tables):
    return bm25_top(t).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"with items as (select item_id as query_id, text from {{benchmark}}), docs as (select doc_id as id, text from {{documents}} where lang = 'en'), {bm25_sql('items', 'docs')} {_TOP10}")
def p1_bm25_in_scope(t: Tables):
    scope = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), "text")
    return se.bm25(items(t), scope, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def rankings(t: Tables, parts: int):
    """The fixture of that name, with pairs added up in as many partitions as told, and ranks numbered over ranges."""
    pairs = t.lineitem.select((F.col("l_suppkey") % 50).alias("query_id"), F.col("l_partkey").alias("id"), "l_quantity", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("double")).alias("number")).repartition(parts, "query_id", "id")
    sums = pairs.groupBy("query_id", "id").agg(F.sum("l_quantity").alias("lexical"), F.sum("number").alias("dense"))
    kinds = [F.struct(F.lit(c).alias("source"), F.col(c).alias("score")) for c in ("lexical", "dense")]
    scores = sums.select("query_id", "id", F.inline(F.array(*kinds))).where("source = 'lexical' or score is not null")
    return se.numbered(scores, ["source", "query_id"], [F.desc("score"), F.col("id")], parts, f"{new_folder(t.spark, 'rankings')}/placed").drop("score")


@query("with f as (select query_id, id, sum(1.0 / (60 + rank)) as rrf_score from {rankings} group by query_id, id), r as (select *, row_number() over (partition by query_id order by round(rrf_score, 9) desc, id) as rank from f) select query_id, id, round(rrf_score, 6) as rrf_score, rank from r where rank <= 10")
def r5_rrf_fusion(t: Tables):
    """Two rankings of 50 queries, which grow with the lines: no task sorts a ranking or holds more pairs than a partition's."""
    n = parts_for(t.lineitem, 2)
    return se.fuse(rankings(t, n).repartition(n, "query_id", "id"), 10).select("query_id", "id", F.round("rrf_score", 6).alias("rrf_score"), "rank")


_KNN = """qs as (select vec_id as query_id, cast(embedding as double[]) as q from {embeddings} where vec_id % 20 = 0), vs as (select vec_id as id, cast(embedding as double[]) as v, label from {embeddings}),
 kn as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, id) as rank from (select query_id, id, label, list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))) as similarity from qs, vs where query_id <> id))"""


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def knn(t: Tables, k: int, nearest=se.nearest):
    """The k best of every twentieth vector among all others; nearest(queries, vectors, k) searches."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = nearest(asked, vectors(t), k + 1).where("query_id <> id").drop("rank")
    return se.top(found, ["query_id"], [F.desc(F.round("similarity", 9)), F.col("id")], k)


def indexed(queries, vectors, k: int):
    """Neighbours from an index that is stored first, as one would keep it for many searches."""
    return VectorIndex.build(vectors, new_folder(vectors.sparkSession, "vectors")).nearest(queries, k)


@query(f"with {_KNN} select query_id, id, round(similarity, 6) as similarity, rank from kn where rank <= 10")
def r6_dense_knn(t: Tables):
    return knn(t, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


_HASHED = """emb as (select id, list_sum(list_transform(w, lambda x: x * x)) as s, w from (select id, list(coalesce(v, 0.0) order by b) as w from (
   select i.id, r.b, x.v from (select distinct id from cells) i cross join (select unnest(range(64)) as b) r left join (select id, bin, sum(w) as v from cells group by all) x on x.id = i.id and x.bin = r.b) group by id))"""


def hashed_sql(source: str) -> str:
    return f"""words as (select id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w from {source}),
      cells as (select id, cast(('0x' || substr(md5(w), 31, 2)) as int) % 64 as bin, 1.0::double as w from words union all select id, cast(('0x' || substr(md5(w), 29, 2)) as int) % 64, 0.5::double from words), {_HASHED}"""


@query(f"with docs as (select doc_id as id, text from {{documents}}), {hashed_sql('docs')} select id, round(w[1] / sqrt(s), 6) as first, round(w[64] / sqrt(s), 6) as last, round(list_max(w) / sqrt(s), 6) as largest from emb")
def r17_hashed_embedding(t: Tables):
    e = se.hashed_embedding(docs(t))
    return e.select("id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.element_at("embedding", 64), 6).alias("last"), F.round(F.array_max("embedding"), 6).alias("largest"))


_DENSE = """al as (select id, text from docs union all select -1 - query_id, text from items), """ + hashed_sql("al") + """,
  de as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, id) as rank from (select -1 - a.id as query_id, b.id as id, list_dot_product(a.w, b.w) / (sqrt(a.s) * sqrt(b.s)) as similarity from emb a, emb b where a.id < 0 and b.id >= 0))"""


def dense_top(t: Tables, k: int = 10):
    q = se.hashed_embedding(items(t), "query_id")
    return se.nearest(q, se.hashed_embedding(docs(t)), k)


def hybrid_top(t: Tables, k: int = 10):
    return se.hybrid(bm25_top(t, k), dense_top(t, k), k)


_FUSED = """fu as (select *, row_number() over (partition by query_id order by round(rrf_score, 9) desc, id) as rank from (select query_id, id, sum(1.0 / (60 + rank)) as rrf_score from (select query_id, id, rank from rk where rank <= 10 union all select query_id, id, rank from de where rank <= 10) group by all))"""
HYBRID_SQL = f"{_ITEMS}, {bm25_sql('items', 'docs')}, {_DENSE}, {_FUSED}"


@query(f"with {HYBRID_SQL} select f.query_id, f.id, f.rank, round(rrf_score, 6) as rrf_score, round(coalesce(d.similarity, 0), 6) as similarity from fu f left join (select * from de where rank <= 10) d on f.query_id = d.query_id and f.id = d.id where f.rank <= 10")
def r7_hybrid_retrieve(t: Tables):
    return hybrid_top(t).select("query_id", "id", "rank", F.round("rrf_score", 6).alias("rrf_score"), F.round("similarity", 6).alias("similarity"))


@query(f"with {_ITEMS}, {_DENSE} select query_id, id, rank, cast(null as double) as rrf_score, round(similarity, 6) as similarity from de where rank <= 10")
def r8_dense_only(t: Tables):
    return dense_top(t).select("query_id", "id", "rank", F.lit(None).cast("double").alias("rrf_score"), F.round("similarity", 6).alias("similarity"))


@query(f"with {_KNN} select query_id, id, round(similarity, 6) as similarity, rank from kn where rank <= 10")
def r6_indexed_knn(t: Tables):
    """r6_dense_knn from a stored index: cells around centroids, and only those that bounds cannot rule out."""
    return knn(t, 10, indexed).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"with {_ITEMS}, {_DENSE} select query_id, id, rank, round(similarity, 6) as similarity from de where rank <= 10")
def r8_indexed_dense(t: Tables):
    """r8_dense_only from a stored index of the documents' embeddings."""
    found = indexed(se.hashed_embedding(items(t), "query_id"), se.hashed_embedding(docs(t)), 10)
    return found.select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


_MULTI = "select query_id % 10 as query_id, cast(floor(query_id / 10) as int) as sub_idx, rank, id, round(1.0 / (60 + rank), 5) as score from {rankings} where source = 'lexical'"


@query(f"with h as ({_MULTI}), f as (select *, row_number() over (partition by query_id, id order by sub_idx, rank) as seen from h where rank <= 6), r as (select *, row_number() over (partition by query_id order by round(score, 5) desc, sub_idx, rank) as pool_rank from f where seen = 1) select query_id, id, cast(score as double) as score, pool_rank from r where pool_rank <= 12")
def r13_multi_query_pool(t: Tables):
    r = t.rankings.where("source = 'lexical'")
    hits = r.select((F.col("query_id") % 10).alias("query_id"), F.floor(F.col("query_id") / 10).cast("int").alias("sub_idx"), "rank", "id", F.round(1 / (60 + F.col("rank")), 5).alias("score"))
    return se.multi_query(hits)


_OVERLAP = f"1 / (1 + exp(-(len(list_intersect(list_distinct({toks('i.text')}), list_distinct({toks('d.text')})))::double / greatest(len(list_distinct({toks('i.text')})), 1) * 6 - 3)))"


def with_texts(t: Tables, hits):
    """Hits, ten of a question, with text and q_text. A few go to the texts, which then stay where they are."""
    few = t.benchmark.count() * 10 <= se.MOST_HITS
    return docs(t).join(F.broadcast(hits) if few else hits, "id").join(items(t).withColumnRenamed("text", "q_text"), "query_id")


def reranked(t: Tables, by_rounded: bool = False):
    hits = with_texts(t, hybrid_top(t))
    return se.rerank(hits, se.overlap_score(tx.index_tokens("q_text"), tx.index_tokens("text")), by_rounded)


_RERANK = f"{HYBRID_SQL}, rr as (select f.query_id, f.id, f.rank as retrieval_rank, {_OVERLAP} as rerank_score from fu f join docs d on d.id = f.id join items i on i.query_id = f.query_id where f.rank <= 10)"


@query(f"with {_RERANK} select query_id, id, retrieval_rank, round(rerank_score, 6) as rerank_score, row_number() over (partition by query_id order by round(rerank_score, 9) desc, retrieval_rank) as rank from rr")
def r10_r12_rerank(t: Tables):
    return reranked(t).select("query_id", "id", "retrieval_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(f"with {_RERANK} select query_id, id, retrieval_rank, round(rerank_score, 4) as rerank_score, row_number() over (partition by query_id order by round(rerank_score, 4) desc, retrieval_rank) as rank from rr")
def r11_rerank_by_rounded_score(t: Tables):
    return reranked(t, True).select("query_id", "id", "retrieval_rank", F.round("rerank_score", 4).alias("rerank_score"), "rank")


@query("""select query_id, coalesce(max(case when rank = 1 then coalesce(rerank_score, 0) end), 0) as top1, coalesce(max(case when rank = 2 then coalesce(rerank_score, 0) end), 0) as top2,
 round(coalesce(max(case when rank = 1 then coalesce(rerank_score, 0) end), 0) - coalesce(max(case when rank = 2 then coalesce(rerank_score, 0) end), 0), 6) as margin, round(avg(coalesce(rerank_score, 0)), 6) as mean, count_if(coalesce(rerank_score, 0) >= 0.5) as above from {kept} where rank <= 4 group by query_id""")
def r14_gate_features(t: Tables):
    f = se.gate_features(t.kept.where("rank <= 4"))
    return f.select("query_id", "top1", "top2", F.round("margin", 6).alias("margin"), F.round("mean", 6).alias("mean"), "above")


@query("with g as (select query_id, list_distinct(list(filename) filter (rank % 3 = 1)) as gold, list_distinct(list(filename) filter (rank <= 4)) as files from {kept} group by query_id) select query_id, len(list_filter(gold, lambda x: not list_contains(files, x))) > 0 as escalate from g")
def r15_oracle_gate(t: Tables):
    g = t.kept.groupBy("query_id").agg(F.collect_set(F.when(F.col("rank") % 3 == 1, F.col("filename"))).alias("gold"), F.collect_set(F.when(F.col("rank") <= 4, F.col("filename"))).alias("files"))
    return g.select("query_id", (F.size(F.array_except("gold", "files")) > 0).alias("escalate"))


@query(f"with {HYBRID_SQL} select 'bm25' as arm, query_id, id, rank from rk where rank <= 10 union all select 'dense', query_id, id, rank from de where rank <= 10 union all select 'rrf', query_id, id, rank from fu where rank <= 10")
def r16_ablation_arms(t: Tables):
    cut = lambda d, arm: d.select(F.lit(arm).alias("arm"), "query_id", "id", "rank")
    return cut(bm25_top(t), "bm25").unionByName(cut(dense_top(t), "dense")).unionByName(cut(hybrid_top(t), "rrf"))


@query("with a as (select query_id, max(rerank_score) as p1 from {kept} where rank <= 2 group by query_id), b as (select query_id, max(rerank_score) as p2 from {kept} where rank between 3 and 6 group by query_id) select a.query_id, case when coalesce(p1 >= 0.6, false) then 1 else 2 end as attempt, case when coalesce(p1 >= 0.6, false) then p1 else p2 end as p from a left join b on a.query_id = b.query_id")
def r20_corrective_retrieval(t: Tables):
    best = lambda c: t.kept.where(c).groupBy("query_id").agg(F.max("rerank_score").alias("p"))
    return se.corrective(best("rank <= 2"), best("rank between 3 and 6"))


@query("select item_id as query_id, doc_id as id from {benchmark} b join {documents} d on contains(d.text, b.text)")
def j9_answer_in_evidence(t: Tables):
    return se.containment(docs(t), items(t))


@query(f"with {_ITEMS}, {bm25_sql('items', 'docs')} select r.query_id, r.rank, r.id, d.lang, d.source, d.n_chars from rk r join {{documents}} d on d.doc_id = r.id where rank <= 4")
def j5_hydrate_hits(t: Tables):
    meta = t.documents.select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return bm25_top(t, 4).join(meta, "id").select("query_id", "rank", "id", "lang", "source", "n_chars")


@query("select doc_id as id, text, 0.0::double as similarity from {documents} where doc_id in (select vec_id from {embeddings} where label = 3)")
def s5_point_lookup(t: Tables):
    ids = t.embeddings.where("label = 3").select(F.col("vec_id").alias("id"))
    return docs(t).join(ids, "id", "left_semi").select("id", "text", F.lit(0.0).alias("similarity"))


@query(f"with {_ITEMS}, {bm25_sql('items', 'docs')} {_TOP10}")
def r9_cached_index(t: Tables):
    """Two searches of one revision of the corpus share one index; the halves of the questions come out as one search."""
    cache, chunks = se.IndexCache(), t.documents.select(F.col("doc_id").alias("id"), "doc_id", "text")
    half = lambda k: se.bm25(items(t).where(F.col("query_id") % 2 == k), chunks, 10, index=cache.index(chunks, 1))
    return half(0).unionByName(half(1)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _ablated(t: Tables, hits, scorer):
    """The best ten of the hits by a scorer of (question tokens, passage tokens), ties as they came."""
    both = with_texts(t, hits)
    return se.rerank(both, scorer(tx.index_tokens("q_text"), tx.index_tokens("text"))).select("query_id", "id", "rank")


def _ablated_sql(arm: str, hits: str, score: str) -> str:
    return f"select '{arm}' as arm, query_id, id, row_number() over (partition by query_id order by round(s, 9) desc, hit) as rank from (select h.query_id, h.id, h.rank as hit, {score} as s from {hits} h join docs d on d.id = h.id join items i on i.query_id = h.query_id where h.rank <= 10)"


_SHARED = f"len(list_intersect(list_distinct({toks('i.text')}), list_distinct({toks('d.text')})))::double / greatest(len(list_distinct(list_concat({toks('i.text')}, {toks('d.text')}))), 1)"


@query(f"with {HYBRID_SQL} {_ablated_sql('rrf-cross', 'fu', _OVERLAP)} union all {_ablated_sql('dense-cross', 'de', _OVERLAP)} union all {_ablated_sql('rrf-jaccard', 'fu', _SHARED)} union all {_ablated_sql('bm25-cross', 'rk', _OVERLAP)}")
def r16_reranked_arms(t: Tables):
    """The arms with a reranker: each retriever with a stand-in for its scorer."""

    def shared(q, p):
        return F.size(F.array_intersect(F.array_distinct(q), F.array_distinct(p))) / F.greatest(F.size(F.array_union(q, p)), F.lit(1))

    arms = [("rrf-cross", hybrid_top(t), se.overlap_score), ("dense-cross", dense_top(t), se.overlap_score), ("rrf-jaccard", hybrid_top(t), shared), ("bm25-cross", bm25_top(t), se.overlap_score)]
    out = [_ablated(t, hits, scorer).select(F.lit(arm).alias("arm"), "query_id", "id", "rank") for arm, hits, scorer in arms]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
