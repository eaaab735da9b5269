"""The jobs as queries over the whole tables, with DuckDB SQL: run twice into one new folder, and what stands there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import ingest_documents, retrieval_report
from quarry.plans.evaluation import METRICS_SQL, WILSON_SQL
from quarry.plans.registry import oracle
from quarry.plans.retrieval import HYBRID_SQL, toks
from quarry.sources.sinks import new_folder


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's status and its chunks; the second run finds no new files."""
    top = new_folder(spark, "job1", keep=True)
    for _ in range(2):
        ingest_documents.ingest(spark, f"{sf_dir}/documents.parquet", f"{top}/store", f"{top}/checkpoint")
    registry, chunks = ingest_documents.current(spark, f"{top}/store")
    return registry.join(chunks.select("doc_id", "chunk_index", "text", "n_tokens"), "doc_id", "left").select("doc_id", "source", "lang", "status", "error", "chunk_count", "n_chars", "batch", "chunk_index", "text", "n_tokens")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all arms, after a second run has overwritten the first."""
    top = new_folder(spark, "job2", keep=True)
    for _ in range(2):
        retrieval_report.report(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{top}/report")
    return retrieval_report.report_rows(spark, f"{top}/report")


_INGEST = f"""with d as (select doc_id, source, lang, text, trim(coalesce(text, '')) = '' as blank from documents),
 c as (select doc_id, (i // 760)::int as chunk_index, substr(text, i + 1, 900) as text from d, lateral (select unnest(range(0, greatest(length(text), 1), 760)) as i) where not blank),
 n as (select doc_id, count(*) as chunk_count from c group by doc_id)
 select d.doc_id, source, lang, case when blank then 'error' else 'ready' end as status, case when blank then 'no text' end as error, coalesce(chunk_count, 0) as chunk_count, coalesce(length(d.text), 0) as n_chars, 0::bigint as batch,
  chunk_index, c.text, len({toks("c.text")})::bigint as n_tokens from d left join n using (doc_id) left join c using (doc_id)"""

_M = ("hit1", "hit4", "hit10", "mrr", "recall4", "recall10", "ndcg10")
_REPORT = f"""with {HYBRID_SQL}, al_ranked as (select 'bm25' as arm, query_id, id, rank from rk where rank <= 10 union all select 'dense', query_id, id, rank from de where rank <= 10 union all select 'rrf', query_id, id, rank from fu where rank <= 10),
 arms as (select unnest(['bm25', 'dense', 'rrf']) as arm), right_ones as (select i.query_id, d.id from items i join docs d on contains(d.text, i.text) where i.text <> ''),
 ranked as (select arm || '/' || query_id as query_id, id as filename, rank from al_ranked), gold as (select arm || '/' || query_id as query_id, id as filename from arms, right_ones), {METRICS_SQL},
 q as (select split_part(query_id, '/', 1) as arm, split_part(query_id, '/', 2)::bigint as question_id, coalesce((select list(filename order by rank) from ranked r where r.query_id = me.query_id), []) as hits, (select count(*) from gold g where g.query_id = me.query_id) as n, {", ".join(f"{m}::double as {m}" for m in _M)} from me),
 a as (select arm, count(*) as n, avg(hit1) as p, {", ".join(f"round(avg({m}), 6) as {m}" for m in _M)}, 1.959963985 * 1.959963985 as z2 from q group by arm)
 select question_id, hits, n, {", ".join(_M)}, null::double as hit1_lo, null::double as hit1_hi, arm, 'question' as level from q
 union all select null, null, n, {", ".join(_M)}, round(lo, 6), round(hi, 6), arm, 'arm' from (select *, {WILSON_SQL} from a)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_ingest_documents, job2_retrieval_report)}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest_documents": _INGEST, "job2_retrieval_report": oracle(_REPORT)}
