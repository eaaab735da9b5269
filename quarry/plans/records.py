"""Filters, projections, run records, dataset builders, traces and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunking as ch
from quarry.operators import datasets as da
from quarry.operators import policy as po
from quarry.operators import runs as ru
from quarry.operators import search as se
from quarry.operators import trace as tr
from quarry.plans.registry import Tables, query
from quarry.settings import PRICES
from quarry.sources import readers
from quarry.sources.sinks import new_folder

_TEXT = "case item % 8 when 0 then 'A [2] then B [1].' when 1 then '[1, 2] and [3][1]' when 2 then 'none' when 3 then '[12a] x [4]' when 4 then '[ 7 ]' when 5 then 'see [10,11 , 12]' when 6 then '' else '[2] [2] [2]' end"


# Scans


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) as text from {pages}")
def s2_html_text(t: Tables):
    return t.pages.select("page_id", readers.html_text("html").alias("text"))


@query("select regexp_extract(lower(name), '\\.[^./]+$', 0) as ext, count(*) as n, count_if(regexp_extract(lower(name), '\\.[^./]+$', 0) in ('.pdf', '.docx', '.xlsx', '.md', '.txt', '.html', '.htm', '.csv', '.json', '.xml', '.log', '')) as supported from (select case doc_id % 6 when 0 then 'A.PDF' when 1 then 'b.tar.gz' when 2 then 'notes.md' when 3 then 'README' when 4 then 'x.Log' else 'y.exe' end as name from {documents}) group by 1")
def s1_type_gate(t: Tables):
    names = t.sql("select case doc_id % 6 when 0 then 'A.PDF' when 1 then 'b.tar.gz' when 2 then 'notes.md' when 3 then 'README' when 4 then 'x.Log' else 'y.exe' end as name from {documents}")
    ext = readers.extension("name")
    return names.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.count_if(readers.supported("name")).alias("supported"))


@query("with r as (select *, row_number() over (partition by source order by doc_id) as nth, octet_length(encode(text)) as size from {documents}) select source, doc_id, case when nth > 10 then 'too many files' when size = 0 then 'empty file' when size > 4000 then 'file too large' else 'accepted' end as status from r")
def s3_upload_limits(t: Tables):
    return readers.upload_status(t.documents, "source", "doc_id", F.octet_length("text"), most_bytes=4000).select("source", "doc_id", "status")


@query("select doc_id, text from {documents} where doc_id in (select doc_id from {labels} where toxic = 0)")
def s4_corpus_scan(t: Tables):
    return t.documents.join(t.labels.where("toxic = 0").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")


@query("select (select count(*) from {documents}) as documents, (select count(*) from {embeddings}) as vectors, (select count(*) from {events} where user_id < 0) as nothing")
def s6_row_count(t: Tables):
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(t.documents, "documents").crossJoin(one(t.embeddings, "vectors")).crossJoin(one(t.events.where("user_id < 0"), "nothing"))  # one row each


@query("select scenario_id, question_id, mode, correctness from {results} where run_id = 'run1'")
def s7_rows_of_run(t: Tables):
    return t.results.where("run_id = 'run1'").orderBy("scenario_id", "question_id", "mode").select("scenario_id", "question_id", "mode", "correctness")


_MANIFEST = """select '{"scenarios":[{"id":"s' || cast(r_regionkey as varchar(3)) || '","questions":[{"id":"q1","question":"a?","answerable":false},{"id":"q2","question":"b?","qtype":"multi"}]}' || case when r_regionkey % 2 = 0 then ',{"name":"no id"}' else '' end || ']}' as raw from {region}"""


@query("select 's' || cast(r_regionkey as varchar) as scenario_id, q.id as question_id, q.question, q.answerable, q.qtype from {region}, (values ('q1', 'a?', false, 'lookup'), ('q2', 'b?', true, 'multi')) q(id, question, answerable, qtype)")
def s8_manifest_scan(t: Tables):
    return readers.manifest_questions(t.sql(_MANIFEST), "raw")


@query("select p_brand, count(*) as n, max(p_retailprice) as top from {part} where p_size between 10 and 20 group by p_brand")
def s9_parquet_scan(t: Tables):
    return t.part.where("p_size between 10 and 20").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))


_ARTICLES = """select '{"title":"' || n_name || '","paragraphs":[{"context":"c1","qas":[{"id":"a' || cast(n_nationkey as varchar(3)) || '","question":"x"},{"id":"b' || cast(n_nationkey as varchar(3)) || '","question":"y"}]},{"context":"c2","qas":[]}]}' as raw from {nation}"""


@query("select n_name as title, 'c1' as context, q.p || cast(n_nationkey as varchar) as question_id, q.t as question from {nation}, (values ('a', 'x'), ('b', 'y')) q(p, t)")
def s10_nested_articles(t: Tables):
    return readers.article_questions(t.sql(_ARTICLES), "raw")


_SSE = "select event_id, 'event: x' || chr(10) || 'data: {\"k\": ' || cast(event_id as varchar(12)) || '}' || chr(10) || chr(10) || 'data: not json' || chr(10) || chr(10) || ': ping' as raw from {events}"


@query("select event_id, 0::int as n, '{\"k\": ' || cast(event_id as varchar) || '}' as data from {events}")
def s12_sse_frames(t: Tables):
    return tr.sse_frames(t.sql(_SSE), "raw", "event_id")


# Sinks


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'new' else 'old' end as text from {orders} where o_orderkey % 6 <> 0 or o_orderkey % 3 = 0")
def k1_upsert(t: Tables):
    old = t.orders.where("o_orderkey % 6 <> 0").select("o_orderkey", F.lit("old").alias("text"))
    new = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("text"))
    return ru.upsert(old, new, ["o_orderkey"])


@query("select l_orderkey, l_linenumber, l_partkey from {lineitem} where l_orderkey not in (select o_orderkey from {orders} where o_orderstatus = 'F')")
def k2_delete_document(t: Tables):
    return ru.without(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("select c_custkey, (select count(*) from {orders} where o_custkey = c_custkey) as chunks from {customer} where c_custkey % 5 <> 0")
def k3_delete_with_registry(t: Tables):
    gone = t.customer.where("c_custkey % 5 = 0").select("c_custkey")
    chunks = ru.without(t.orders, gone.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return ru.without(t.customer.select("c_custkey"), gone, ["c_custkey"]).join(chunks, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("chunks"))


@query("select question_id, mode, 'judge down' as error from {results} where error is not null union all select question_id, mode, cast(null as varchar) from {results} where error is null and run_id = 'run2'")
def k4_k5_result_and_error_rows(t: Tables):
    bad = t.results.where("error is not null").select("question_id", "mode", F.lit("judge down").alias("error"))
    return bad.unionByName(t.results.where("error is null and run_id = 'run2'").select("question_id", "mode", F.lit(None).cast("string").alias("error")))


@query("select '| ' || concat_ws(' | ', scenario_id, question_id, mode, coalesce(cast(cast(round(correctness * 100, 1) as decimal(20,1)) as varchar) || '%', 'n/a')) || ' |' as line from {results} where run_id = 'run3'")
def k6_markdown_rows(t: Tables):
    r = t.results.where("run_id = 'run3'")
    return r.select(F.concat(F.lit("| "), F.concat_ws(" | ", "scenario_id", "question_id", "mode", tx.percent("correctness")), F.lit(" |")).alias("line"))


@query("select mode as arm, scenario_id as scenario, question_id, correctness, true as partial from {results} where run_id = 'run0'")
def k7_partial_dump(t: Tables):
    return t.results.where("run_id = 'run0'").select(F.col("mode").alias("arm"), F.col("scenario_id").alias("scenario"), "question_id", "correctness", F.lit(True).alias("partial"))


@query("select item_id, '# item ' || cast(item_id as varchar) || chr(10) || chr(10) || text || chr(10) as file from {benchmark}")
def k8_document_file(t: Tables):
    return t.benchmark.select("item_id", F.concat(F.lit("# item "), F.col("item_id").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("file"))


@query("select query_id, string_agg('Passage [' || cast(rank as varchar) || '] (source: ' || filename || ')' || chr(10) || 'chunk ' || cast(chunk as varchar), chr(10) || chr(10) order by rank) as context from {kept} where rank <= 4 group by query_id")
def k9_context_block(t: Tables):
    return readers.context_blocks(t.kept.where("rank <= 4").withColumn("text", F.concat(F.lit("chunk "), F.col("chunk").cast("string"))))


# Projections and predicates


@query("select seq, mode, scenario_id from {results} where mode in ('hybrid') and scenario_id = 'sc2'")
def p2_p3_mode_and_scenario_filter(t: Tables):
    return readers.filtered(t.results, modes=["hybrid"], scenarios=["sc2"]).select("seq", "mode", "scenario_id")


_ACT = "case when coalesce(injection, 0) >= 0.9 then 'drop' when coalesce(contradiction, 0) >= 0.5 then 'conflict' when coalesce(evidence, 0) < 0.1 and coalesce(relevance, 0) < 0.5 then 'drop' else 'include' end"


@query(f"select query_id, idx, injection, contradiction, evidence, relevance, {_ACT} as action from {{passages}}")
def p4_passage_policy(t: Tables):
    return t.passages.select("query_id", "idx", "injection", "contradiction", "evidence", "relevance", po.passage_action()[0].alias("action"))


@query("select query_id, rank, coalesce(rerank_score >= 0.6, false) as features, coalesce(rerank_score >= 0.5, false) as model from {kept}")
def p5_gate_predicate(t: Tables):
    return t.kept.select("query_id", "rank", se.gate_passes(F.col("rerank_score")).alias("features"), se.gate_passes(F.col("rerank_score"), "model").alias("model"))


_GATE = "select query_id, rank, rerank_score, case when chunk % 11 = 0 then chunk % 2 = 0 end as override, case chunk % 3 when 0 then 'none' when 1 then 'model' else 'features' end as mode from {kept}"


@query(f"select query_id, rank, case when override is not null then override when mode = 'none' then false when mode = 'model' then not coalesce(rerank_score >= 0.5, false) else not coalesce(rerank_score >= 0.6, false) end as escalate from ({_GATE})")
def p6_gate_dispatch(t: Tables):
    g = t.sql(f"select * from ({_GATE.replace('{kept}', '(' + _kept() + ')')}) g")
    return g.select("query_id", "rank", se.gate_escalates(F.col("override"), F.col("mode"), F.col("rerank_score"), F.col("rerank_score")).alias("escalate"))


def _kept() -> str:
    from quarry.plans.registry import FIXTURES

    return FIXTURES["kept"]


_ANSWER = "case o_orderkey % 5 when 0 then 'true' when 1 then '0.3' when 2 then '0.7' when 3 then '\"escalate\"' else '\"easy\"' end"


@query("select o_orderkey, o_orderkey % 5 in (0, 1, 3) as escalated from {orders}")
def p7_gate_readback(t: Tables):
    return t.sql(f"select o_orderkey, {_ANSWER} as a from {{orders}}").select("o_orderkey", po.escalated("a").alias("escalated"))


@query("select o_orderkey, (o_orderstatus = 'F' and o_orderkey % 100 >= 90) as skip, (o_orderkey % 2 = 0 and o_orderkey % 3 = 0 and (o_orderkey % 5 <> 0 or o_orderstatus = 'O')) as best_of from {orders}")
def p8_p9_fast_path_and_best_of(t: Tables):
    k = F.col("o_orderkey")
    choice = F.when(F.col("o_orderstatus") == "F", "no_retrieval").otherwise("retrieve")
    effort = F.when(F.col("o_orderstatus") == "O", "multi_step").otherwise("single")
    return t.orders.select(k, po.no_retrieval(choice, (k % 100) / 100.0).alias("skip"), po.best_of(k % 2 == 0, k % 3 == 0, k % 5 == 0, effort).alias("best_of"))


@query("select question_id, mode from {results} where error is not null or run_id <> 'run1' except select question_id, mode from {results} where error is null and run_id = 'run1'")
def p10_j12_open_work(t: Tables):
    return ru.open_work(t.results.select("question_id", "mode"), t.results.where("run_id = 'run1'"), ["question_id", "mode"])


@query("select scenario_id, question_id from {results} where error is null group by all having count(distinct mode) = 2")
def p11_complete_questions(t: Tables):
    return ru.complete_questions(t.results, ["traditional", "hybrid"])


@query("with r as (select c_mktsegment || cast(c_custkey % 50 as varchar) as filename, count(*) as n, bool_and(c_acctbal > 0) as ready from {customer} group by 1), e as (select distinct c_mktsegment || cast(c_custkey % 60 as varchar) as filename from {customer}) select filename, coalesce(n = 1 and ready, false) as present from e left join r using (filename)")
def p12_ingested_already(t: Tables):
    name = lambda m: F.concat("c_mktsegment", (F.col("c_custkey") % m).cast("string")).alias("filename")
    return ru.ingested(t.customer.select(name(60)).distinct(), t.customer.select(name(50), F.when(F.col("c_acctbal") > 0, "ready").otherwise("error").alias("status")))


@query("select run_id, case when status in ('queued', 'running', 'cancelling') then 'failed' else status end as status, case when status in ('queued', 'running', 'cancelling') then 'interrupted by a restart' end as error from {runs}")
def p13_orphan_reap(t: Tables):
    return ru.reaped(t.runs).select("run_id", "status", "error")


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"select doc_id, case when length({_FLAT}) > 240 then substr({_FLAT}, 1, 240) || '…' else {_FLAT} end as snippet, case when length({_FLAT}) > 60 then substr({_FLAT}, 1, 60) || '…' else {_FLAT} end as title from {{documents}}")
def p14_snippet_and_title(t: Tables):
    return t.documents.select("doc_id", tx.snippet("text").alias("snippet"), tx.snippet("text", 60).alias("title"))


@query("select query_id, row_number() over (partition by query_id order by rank) as label, filename, round(coalesce(rerank_score, 0), 4) as score from {kept} where rank between 2 and 5")
def p15_labels(t: Tables):
    k = t.kept.where("rank between 2 and 5")
    return se.top(k, ["query_id"], [F.col("rank")], None, "label").select("query_id", "label", "filename", F.round(F.coalesce("rerank_score", F.lit(0.0)), 4).alias("score"))


_RAW = "select o_orderkey, case o_orderkey % 4 when 0 then ' Abstained' when 1 then 'PARTIAL' when 2 then 'whatever' else 'answered' end as label, case o_orderkey % 4 when 0 then '1.7' when 1 then '-2' when 2 then 'high' else '0.25' end as score from {orders}"


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'abstained' when 1 then 'partial' else 'answered' end as label, case o_orderkey % 4 when 0 then 1.0::double when 1 then 0.0::double when 2 then null else 0.25::double end as score from {orders}")
def p16_judge_normalisation(t: Tables):
    return t.sql(_RAW).select("o_orderkey", po.abstention_label("label").alias("label"), po.unit_score("score").alias("score"))


@query("select scenario_id, list_sort(list_distinct(list(qtype))) as qtypes, count_if(answerable) as answerable, count_if(not answerable) as unanswerable from {results} group by scenario_id")
def p17_scenario_meta(t: Tables):
    return t.results.groupBy("scenario_id").agg(F.array_sort(F.collect_set("qtype")).alias("qtypes"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"))


_WORKER = "case when status = 'completed' and n_rows >= 100 then 'completed' when status in ('running', 'queued') then 'running' else 'dead_incomplete' end"


@query(f"select run_id, {_WORKER} as verdict from {{runs}}")
def p18_worker_verdict(t: Tables):
    return t.runs.select("run_id", ru.worker_verdict(F.col("status") == "completed", F.col("status").isin("running", "queued"), F.lit(100), F.col("n_rows")).alias("verdict"))


# Chunks


@query("select doc_id, (i // 760)::int as chunk_index, substr(text, i + 1, 900) as text from {documents}, lateral (select unnest(range(0, greatest(length(text), 1), 760)) as i) where length(text) > 0")
def c8_fixed_chunks(t: Tables):
    return ch.fixed_chunks(t.documents)


@query("select doc_id, case when trim(text) = '' then 'error' else 'ready' end as status, (floor((length(text) - 1) / 760) + 1)::bigint as chunk_count from {documents}")
def c9_ingest_status(t: Tables):
    return ch.ingest_status(t.documents.select("doc_id", "text"), ch.fixed_chunks(t.documents)).select("doc_id", "status", "chunk_count")


def titled(t: Tables):
    return t.documents.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), "text")


@query()
def c1_c5_structure_chunks(t: Tables):
    return ch.structure_chunks(titled(t))


@query()
def c6_c7_plain_chunks(t: Tables):
    return ch.structure_chunks(titled(t), prefixed=False)


# Joins


@query("select conv_id, count(turn) as n from (select conv_id, turn from {conversations} union all select 100000 + n_nationkey, null from {nation}) group by conv_id order by conv_id desc limit 100")
def j1_conversation_counts(t: Tables):
    heads = t.conversations.select("conv_id").distinct().unionByName(t.nation.select((F.col("n_nationkey") + 100000).cast("long").alias("conv_id")))
    n = t.conversations.groupBy("conv_id").agg(F.count("turn").alias("n"))
    return heads.join(n, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("conv_id")).limit(100)


@query("select r.run_id, count(x.seq) as n from {runs} r left join {results} x on x.run_id = r.run_id and x.error is not null group by r.run_id having count(x.seq) = 0 or count(x.seq) > 5")
def j2_filtered_left_join(t: Tables):
    n = t.results.where("error is not null").groupBy("run_id").agg(F.count("*").alias("n"))
    return t.runs.join(n, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n")).where("n = 0 or n > 5")


@query("select a.answer_id, a.label, coalesce(k.filename, '') as filename from {verdicts} a left join (select distinct chunk, filename from {kept} where rank < 3) k on k.chunk = a.answer_id")
def j10_citation_lookup(t: Tables):
    k = t.kept.where("rank < 3").select(F.col("chunk").alias("answer_id"), "filename").distinct()
    return t.verdicts.join(k, "answer_id", "left").select("answer_id", "label", F.coalesce("filename", F.lit("")).alias("filename"))


_COST = "floor((tokens_in * round(p.pin * 10000)::bigint + tokens_out * round(p.pout * 10000)::bigint + 5000) / 10000) / 1e6"
_PRICES = ", ".join(f"('{m}', {a}::double, {b}::double)" for m, (a, b) in PRICES.items())


@query(f"select r.seq, r.mode, r.model, {_COST} as cost_usd from {{results}} r left join (values {_PRICES}) p(model, pin, pout) on p.model = r.model")
def j11_cost_by_model(t: Tables):
    prices = t.spark.createDataFrame([(m, a, b) for m, (a, b) in PRICES.items()], "model string, pin double, pout double")
    return t.results.join(prices, "model", "left").select("seq", "mode", "model", tx.cost("tokens_in", "tokens_out", "pin", "pout").alias("cost_usd"))


@query("select scenario_id, run_id from (select *, row_number() over (partition by scenario_id order by (status = 'completed')::int desc, n_rows desc, seq desc) as nth from {runs}) where nth = 1")
def j13_run_pick(t: Tables):
    return ru.picked_runs(t.runs).select("scenario_id", "run_id")


# Windows and limits


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as nth from {conversations} where length(trim(text)) > 0) where nth <= 8")
def w4_last_eight(t: Tables):
    return readers.history(t.conversations, 8).select("conv_id", "turn", "role")


@query("with recursive r as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as i, epoch_us(ts) / 1e6 as a from {events}), p as (select user_id, i, a, a as slot from r where i = 1 union all select r.user_id, r.i, r.a, greatest(r.a, p.slot + 1.5) from p join r on r.user_id = p.user_id and r.i = p.i + 1) select user_id, i, round(slot - a, 3) as wait from p")
def w9_request_pacer(t: Tables):
    from pyspark.sql import Window

    e = t.events.withColumn("a", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return tr.paced(e, ["user_id"], "a", ["i"], 1.5).select("user_id", "i", F.round("wait", 3).alias("wait"))


@query("select run_id, created_at from {runs} order by created_at desc, run_id limit 50")
def w10_newest_runs(t: Tables):
    return t.runs.orderBy(F.desc("created_at"), "run_id").limit(50).select("run_id", "created_at")


@query("select scenario_id, arg_max(run_id, seq) as run_id from {runs} where starts_with(run_id, 'run1') group by scenario_id")
def w11_latest_by_prefix(t: Tables):
    return t.runs.where(F.col("run_id").startswith("run1")).groupBy("scenario_id").agg(F.max_by("run_id", "seq").alias("run_id"))


_DUP = "select seq, run_id, scenario_id, 'q' || cast(seq % 500 as varchar(9)) as question_id, mode, error from {results}"


@query(f"with d as ({_DUP}), r as (select d.*, row_number() over (partition by d.scenario_id, question_id, mode order by coalesce((u.status = 'completed')::int, 0) desc, d.seq) as nth from d left join {{runs}} u on u.run_id = d.run_id) select scenario_id, question_id, mode, run_id, seq from r where nth = 1")
def w12_merge_dedupe(t: Tables):
    return ru.merged_results(_duplicated(t), t.runs.select("run_id", "status")).select("scenario_id", "question_id", "mode", "run_id", "seq")


def _duplicated(t: Tables):
    return t.results.select("seq", "run_id", "scenario_id", F.concat(F.lit("q"), (F.col("seq") % 500).cast("string")).alias("question_id"), "mode", "error")


# Dataset builders


@query("select doc_id from (select doc_id, row_number() over (partition by source order by md5('7|' || cast(doc_id as varchar)), doc_id) as nth, md5('7|' || cast(doc_id as varchar)) as o from {documents} where n_chars >= 80) where nth = 1 order by o, doc_id limit 12")
def d1_first_valid(t: Tables):
    return da.first_valid(t.documents, F.col("n_chars") >= 80, "source", "doc_id", 7, 12).select("doc_id")


@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5('11|' || cast(doc_id as varchar)), doc_id) as nth from {documents}) where nth <= case lang when 'en' then 18 when 'fr' then 7 when 'de' then 4 else 0 end")
def d2_stratified_sample(t: Tables):
    return da.stratified(t.documents, "lang", "doc_id", {"en": 18, "fr": 7, "de": 4}, 11).select("lang", "doc_id")


@query("with o as (select doc_id, trim(text) as title from {documents}), f as (select title, min(doc_id) as doc_id from o group by title) select title, doc_id, row_number() over (order by doc_id) as number from f")
def d3_interned_corpus(t: Tables):
    d = t.documents.select("doc_id", F.col("text").alias("title"))
    return da.interned(d, "title", "doc_id").select(F.col("t").alias("title"), "doc_id", F.col("number").cast("long").alias("number"))


@query("select doc_id from {documents} where length(text) >= 80 or doc_id % 10 = 0")
def d4_stub_filter(t: Tables):
    return da.without_stubs(t.documents, "text", F.col("doc_id") % 10 == 0).select("doc_id")


@query("select doc_id, left(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 48) as slug from {documents}")
def d5_slugs(t: Tables):
    return t.documents.select("doc_id", tx.slug("text").alias("slug"))


@query("select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as norm from {documents}")
def d6_normalised_text(t: Tables):
    return t.documents.select("doc_id", tx.normalized("text").alias("norm"))


@query("select l_orderkey, array_to_string(list_distinct_ordered[1:3], ' / ') as aliases from (select l_orderkey, list(v order by f, v) as list_distinct_ordered from (select l_orderkey, l_shipdate::date::varchar as v, min(l_linenumber * 1000000 + l_partkey) as f from {lineitem} group by all) group by l_orderkey)")
def d7_alias_line(t: Tables):
    pos = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.to_date("l_shipdate").cast("string").alias("v")))), lambda x: x["v"])
    return t.lineitem.groupBy("l_orderkey").agg(da.alias_line(listed).alias("aliases"))


@query("with g as (select doc_id from {documents} where doc_id % 50 = 0), e as (select doc_id, row_number() over (order by md5('3|' || cast(doc_id as varchar)), doc_id) as nth from {documents} where doc_id % 50 <> 0) select doc_id from g union all select doc_id from e where nth <= 64 - (select count(*) from g)")
def d8_padded_corpus(t: Tables):
    return da.padded(t.documents.select("doc_id"), F.col("doc_id") % 50 == 0, "doc_id", 3, 64)


@query("select o_orderkey, case when o_orderkey % 4 < 3 then cast(o_orderkey % 4 + 2 as varchar) || 'hop' else 'other' end as hop from {orders}")
def d9_hop_class(t: Tables):
    return t.sql("select o_orderkey, case when o_orderkey % 4 < 3 then cast(o_orderkey % 4 + 2 as varchar(3)) || 'hop1__x_' || cast(o_orderkey as varchar(9)) else 'single__y' end as id from {orders}").select("o_orderkey", da.hop_class(F.col("id")).alias("hop"))


# Merging


@query("select s.scenario_id, coalesce(case when s.no % 3 = 0 then 'cli' end, case when s.no % 2 = 0 then 'meta' end, 'runs/' || s.scenario_id) as source from (select distinct scenario_id, substr(scenario_id, 3)::int as no from {results}) s")
def l1_source_plan(t: Tables):
    s = t.results.select("scenario_id").distinct().withColumn("no", F.substring("scenario_id", 3, 9).cast("int"))
    cli, meta = s.where("no % 3 = 0").select("scenario_id", F.lit("cli").alias("cli")), s.where("no % 2 = 0").select("scenario_id", F.lit("meta").alias("meta"))
    return s.join(cli, "scenario_id", "left").join(meta, "scenario_id", "left").select("scenario_id", F.coalesce("cli", "meta", F.concat(F.lit("runs/"), "scenario_id")).alias("source"))


@query("select 'sc' || cast(n_nationkey as varchar) as scenario_id, 'run' || cast(n_nationkey as varchar) as run_id, case when n_nationkey < 4 then 'arm mismatch' else 'no rows' end as problem from {nation} where n_nationkey <> 2 and n_nationkey < 97")
def l2_source_problems(t: Tables):
    plan = t.nation.select(F.concat(F.lit("sc"), F.col("n_nationkey").cast("string")).alias("scenario_id"), F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("run_id"))
    rows = t.results.where("run_id = 'run2' or mode = 'hybrid'")
    return ru.source_problems(plan, t.runs, rows, ["hybrid", "traditional"])


@query("select 'merged' as run_id, 'completed' as status, count(*) as total, min(created_at) as started_at, max(created_at) as finished_at, list_sort(list_distinct(list(run_id))) as lineage, count(error) > 0 as partial from {results}")
def l3_unified_run(t: Tables):
    return t.results.agg(F.count("*").alias("total"), F.min("created_at").alias("started_at"), F.max("created_at").alias("finished_at"), F.array_sort(F.collect_set("run_id")).alias("lineage"), (F.count("error") > 0).alias("partial")).select(F.lit("merged").alias("run_id"), F.lit("completed").alias("status"), "*")


@query(f"with d as ({_DUP}), r as (select d.*, row_number() over (partition by d.scenario_id, question_id, mode order by coalesce((u.status = 'completed')::int, 0) desc, d.seq) as nth from d left join {{runs}} u on u.run_id = d.run_id) select scenario_id, count(*) as read, count_if(nth = 1) as copied, count_if(nth > 1) as deduped, count(case when nth = 1 then error end) as errors from r group by scenario_id")
def l4_merge_counters(t: Tables):
    d = _duplicated(t)
    return ru.merge_counters(d, ru.merged_results(d, t.runs.select("run_id", "status")))


@query("select run_id, list(mode order by seq, mode) as arms from (select run_id, mode, min(seq) as seq from {results} group by all) group by run_id")
def l5_arms_observed(t: Tables):
    first = t.results.groupBy("run_id", "mode").agg(F.min("seq").alias("seq"))
    return first.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "mode"))), lambda x: x["mode"]).alias("arms"))


@query("select (sum(least(n, 900)) * 2)::bigint as total from (select scenario_id, count(distinct question_id) as n from {results} group by 1)")
def l6_planned_total(t: Tables):
    return ru.planned_total(t.results.select("scenario_id", "question_id").distinct(), 900, 2)


@query("select mode, scenario_id, count(error) = 0 as complete from {results} group by all")
def l7_completeness(t: Tables):
    r = t.results
    every = r.groupBy("mode", "scenario_id").agg(F.collect_set("question_id").alias("q"), F.collect_set(F.when(F.col("error").isNull(), F.col("question_id"))).alias("done"))
    return every.select("mode", "scenario_id", (F.size(F.array_except("q", "done")) == 0).alias("complete"))


_ARMS = "select n_name as arm, case when n_nationkey % 3 = 0 then 'none' end as o_rerank, case when n_nationkey % 4 = 1 then cast(n_nationkey as double) / 50 end as o_threshold, case when n_nationkey % 5 = 2 then n_regionkey + 10 end as o_k from {nation}"
_BASE = "select max(case when winner = 'hybrid' then 'cross' else 'none' end) as rerank, round(avg(sufficiency_p), 6) as threshold, count(distinct scenario_id) as k from {results}"


@query(f"with a as ({_ARMS}), b as ({_BASE}) select arm, coalesce(o_rerank, 'cross') as rerank, coalesce(o_threshold, threshold) as threshold, coalesce(o_k, k) as k from a, b")
def l8_arm_overrides(t: Tables):
    """The parameters of an arm for each nation: its own where it has them, else those of the recorded results."""
    base = t.results.agg(F.lit("cross").alias("rerank"), F.round(F.avg("sufficiency_p"), 6).alias("threshold"), F.count_distinct("scenario_id").alias("k"))
    return ru.with_overrides(base, t.sql(_ARMS))


@query("select scenario_id, arg_max(mode, seq) as mode from {results} where run_id = 'run1' group by scenario_id")
def l9_adopted_arms(t: Tables):
    recorded = t.results.where("run_id = 'run1'").groupBy("scenario_id").agg(F.max_by("mode", F.struct("seq", "mode")).alias("recorded"))
    return recorded.select("scenario_id", F.coalesce(F.lit(None).cast("string"), "recorded").alias("mode"))


# Traces


@query("with g as (select event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap from {events}) select event_id, user_id, coalesce(floor(gap / 1e7), 0)::bigint as pings from g")
def x2_heartbeats(t: Tables):
    return tr.heartbeats(t.events, ["user_id"], "ts", ["ts", "event_id"]).select("event_id", "user_id", "pings")


@query("select message_id, coalesce(string_agg(props, '' order by seq) filter (kind = 'delta'), '') as content, count(*) as n_events, arg_max(props, seq) filter (kind = 'retrieval') as last_retrieval, round(arg_max(value, seq) filter (kind = 'done'), 6) as done, case when count_if(kind = 'done') > 0 then 'done' else 'streaming' end as status from {trace} group by message_id")
def x3_folded_messages(t: Tables):
    return tr.folded(t.trace).withColumn("done", F.round("done", 6))


@query("select cast(date_trunc('hour', ts) as timestamp) as hour, event_type, count(*) as n, round(sum(value), 4) as total from {events} group by all")
def x7_tumbling_window(t: Tables):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from {events}), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as no from g) select user_id, min(ts) as started, count(*) as n from s group by user_id, no")
def x7_session_window(t: Tables):
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


# Scalars


@query(f"with c as (select o_orderkey as item, {_TEXT.replace('item', 'o_orderkey')} as a from {{orders}}), p as (select item, flatten(list_transform(regexp_extract_all(a, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda x: list_transform(string_split(x, ','), lambda y: trim(y)::int))) as ns from c) select item, list_filter(ns, lambda n, i: list_position(ns, n) = i) as cited from p")
def f1_citations(t: Tables):
    return t.sql(f"select o_orderkey as item, {_TEXT.replace('item', 'o_orderkey')} as a from {{orders}}").select("item", tx.citations("a").alias("cited"))


_JUDGE = "case o_orderkey % 4 when 0 then '{\"score\": 0.5}' when 1 then '```json' || chr(10) || '{\"score\": 0.25}' || chr(10) || '```' when 2 then 'Sure: {\"score\": 1.0} done' else 'broken {' end"


@query("select o_orderkey, case o_orderkey % 4 when 0 then 0.5::double when 1 then 0.25 when 2 then 1.0 end as score from {orders}")
def f2_model_json(t: Tables):
    r = t.sql(f"select o_orderkey, {_JUDGE} as raw from {{orders}}")
    return r.select("o_orderkey", F.try_variant_get(tx.model_json("raw"), "$.score", "double").alias("score"))


_CONF = "case o_orderkey % 4 when 0 then '{\"base\": {\"gate\": 0.0}, \"gate\": 0.9}' when 1 then '{\"gate\": 0.7}' when 2 then '{\"base\": {}}' else null end"


@query("select o_orderkey, case o_orderkey % 4 when 0 then 0.0::double when 1 then 0.7 else 0.6 end as threshold from {orders}")
def f3_config_path(t: Tables):
    return t.sql(f"select o_orderkey, {_CONF} as c from {{orders}}").select("o_orderkey", tx.json_path("c", "$.base.gate", "$.gate", 0.6).alias("threshold"))


@query("select o_orderkey, 'x' || cast(o_orderkey % 7 as varchar) as a, case when o_orderkey % 2 = 0 then '2' else '1' end as b from {orders}")
def f4_key_value_list(t: Tables):
    raw = t.sql("select o_orderkey, 'a:x' || cast(o_orderkey % 7 as varchar(3)) || ', b:1 ,junk' || case when o_orderkey % 2 = 0 then ',b:2' else '' end as raw from {orders}")
    m = raw.select("o_orderkey", tx.pairs("raw").alias("m"))
    return m.select("o_orderkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("select p_partkey, regexp_replace(regexp_replace(n, '^\\d+[-_]', ''), '\\.[A-Za-z0-9]+$', '') as name from (select p_partkey, cast(p_partkey as varchar) || case when p_partkey % 2 = 0 then '-' else '_' end || replace(p_name, ' ', '.') || '.md' as n from {part})")
def f5_short_filename(t: Tables):
    raw = t.sql("select p_partkey, cast(p_partkey as varchar(9)) || case when p_partkey % 2 = 0 then '-' else '_' end || replace(p_name, ' ', '.') || '.md' as n from {part}")
    return raw.select("p_partkey", tx.short_filename("n").alias("name"))


_SUB = "case o_orderkey % 4 when 0 then '[\" a? \", \"\", \"b?\"]' when 1 then '```json' || chr(10) || '[\"1\",\"2\",\"3\",\"4\",\"5\"]' || chr(10) || '```' when 2 then 'no list' else '[]' end"


@query("select o_orderkey, case o_orderkey % 4 when 0 then ['a?', 'b?'] when 1 then ['1', '2', '3', '4'] else ['question'] end as parts from {orders}")
def r18_sub_queries(t: Tables):
    return t.sql(f"select o_orderkey, {_SUB} as a, 'question' as q from {{orders}}").select("o_orderkey", tx.sub_queries("a", "q").alias("parts"))


_REW = "case o_orderkey % 4 when 0 then ' \"better question\" ' when 1 then 'first' || chr(10) || 'second' when 2 then '  ' else null end"


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'better question' when 1 then 'first' else 'question' end as rewritten from {orders}")
def r19_rewrite(t: Tables):
    return t.sql(f"select o_orderkey, {_REW} as a, 'question' as q from {{orders}}").select("o_orderkey", tx.rewritten("a", "q").alias("rewritten"))


@query("select seq, mode, coalesce(cast(cast(round(correctness * 100, 1) as decimal(20,1)) as varchar) || '%', 'n/a') as pct, coalesce(cast(cast(round(latency_ms / 1000, 1) as decimal(20,1)) as varchar) || ' s', 'n/a') as sec from {results}")
def f6_formats(t: Tables):
    return t.results.select("seq", "mode", tx.percent("correctness").alias("pct"), tx.seconds("latency_ms").alias("sec"))


_GATES = "select o_orderkey, case o_orderkey % 4 when 0 then '0.42' when 1 then 'true' when 2 then '\"escalate\"' else '1' end as a, case when o_orderkey % 3 = 0 then 0.9 end as top1, case when o_orderkey % 2 = 0 then 'model' else 'features' end as mode from {orders}"


@query("select o_orderkey, case when o_orderkey % 2 = 0 then case o_orderkey % 4 when 0 then 0.42 else 0.5 end else case when o_orderkey % 3 = 0 then 0.9 else 0.5 end end::double as p from {orders}")
def t12_first_gate_score(t: Tables):
    g = t.sql(_GATES).withColumn("top1", F.col("top1").cast("double"))
    return g.select("o_orderkey", po.first_gate_score("a", F.col("top1"), F.col("mode"), F.lit(0.5)).alias("p"))


@query("select run_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as started, round((epoch_us(finished_at) - epoch_us(created_at)) / 6e7, 3) as minutes from {runs}")
def f7_run_durations(t: Tables):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.runs.select("run_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("started"), F.round((micros("finished_at") - micros("created_at")) / 6e7, 3).alias("minutes"))


@query("select l_orderkey, first(l_returnflag order by l_discount desc, l_linenumber * 1000000 + l_partkey) as choice, max(l_discount) as confidence from {lineitem} group by l_orderkey")
def u4_best_choice(t: Tables):
    from quarry.operators.models import best_choice

    options = t.lineitem.select("l_orderkey", F.col("l_discount").alias("p"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("idx"), F.col("l_returnflag").alias("option"))
    return best_choice(options, "l_orderkey")


_LINES = "'1. first ' || cast(o_orderkey as varchar(12)) || chr(10) || chr(10) || '- second' || chr(10) || '  third' || chr(10) || '4) fourth'"


@query("select o_orderkey, ['first ' || cast(o_orderkey as varchar), 'second', 'third'] as paraphrases from {orders}")
def u8_paraphrase_lines(t: Tables):
    from quarry.operators.models import paraphrase_lines

    return paraphrase_lines(t.sql(f"select o_orderkey, {_LINES} as answer from {{orders}}"), 3).select("o_orderkey", "paraphrases")


@query("select avg((c between 0.2 and 0.9)::int) as agreement, count(*) as n from (select coalesce(correctness, 0) as c from {results})")
def u7_judge_self_test(t: Tables):
    from quarry.operators.models import judge_agreement

    return judge_agreement(t.results.select(F.coalesce("correctness", F.lit(0.0)).alias("score"), F.lit(0.2).alias("least"), F.lit(0.9).alias("most")))


@query("select k.query_id, k.rank, k.filename, list_contains(g.gold, k.filename) as is_gold from {kept} k join (select query_id, list(filename) as gold from {kept} where chunk % 3 = 0 group by query_id) g on g.query_id = k.query_id")
def j8_gold_membership(t: Tables):
    gold = t.kept.where("chunk % 3 = 0").groupBy("query_id").agg(F.collect_set("filename").alias("gold"))
    return t.kept.join(gold, "query_id").select("query_id", "rank", "filename", F.array_contains("gold", F.col("filename")).alias("is_gold"))


@query("select query_id, rank, filename, row_number() over (partition by query_id, filename order by rank) = 1 as first from {kept}")
def w5_first_occurrence(t: Tables):
    return se.top(t.kept.select("query_id", "rank", "filename"), ["query_id", "filename"], [F.col("rank")], None, "nth").select("query_id", "rank", "filename", (F.col("nth") == 1).alias("first"))


@query("select l_suppkey, l_partkey, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as average_rank from {lineitem}")
def w6_average_ranks(t: Tables):
    from quarry.operators.statistics import average_ranks

    return average_ranks(t.lineitem.select("l_suppkey", "l_partkey", "l_quantity"), "l_quantity", ["l_suppkey"], "average_rank").select("l_suppkey", "l_partkey", "average_rank")


@query("select conv_id, turn, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as id from (select conv_id, turn, md5(conv_id || chr(31) || turn || chr(31) || coalesce(role, '')) as h from {conversations})")
def f8_hash_ids(t: Tables):
    return t.conversations.select("conv_id", "turn", tx.hash_id("conv_id", "turn", "role").alias("id"))


#: A section for each turn: its role and number as heading, and its words, without the marks that make headings and fences.
_MARKS = "[\\s#=`~-]+"
_TURNS = f"select conv_id, turn, coalesce(role, '') || ' ' || turn as head, coalesce(nullif(trim(regexp_replace(coalesce(text, ''), '{_MARKS}', ' ', 'g')), ''), 'none') as body from {{conversations}}"


def spoken(t: Tables):
    """Every conversation as a document in Markdown: doc_id, title, text."""
    body = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _MARKS, " ")), F.lit("")), F.lit("none"))
    section = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), body)
    parts = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))).alias("s"))
    return parts.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("title"), F.concat(F.lit("# Talk\n"), F.array_join(F.transform("s", lambda x: x["s"]), "\n")).alias("text"))


@query(f"with p as (select conv_id::varchar as doc_id, 'Talk > ' || head as section, body, 'c' || conv_id || ' | Talk | ' || head || ' :: ' as prefix from ({_TURNS})) select doc_id, section, length(body) <= greatest(200, 900 - length(prefix)) as one, case when length(body) <= greatest(200, 900 - length(prefix)) then prefix || body end as text from p")
def c1_c5_known_chunks(t: Tables):
    """A section of each turn of a conversation, and its chunk where it has room for one."""
    chunks = ch.structure_chunks(spoken(t)).groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    return chunks.select("doc_id", "section", (F.col("n") == 1).alias("one"), F.when(F.col("n") == 1, F.col("text")).alias("text"))


@query(f"with d as (select conv_id::varchar as doc_id, '# Talk' || chr(10) || string_agg('## ' || head || chr(10) || chr(10) || body, chr(10) order by turn) as text from ({_TURNS}) group by conv_id) select doc_id, length(text) <= 900 as one, case when length(text) <= 900 then text end as text from d")
def c6_c7_known_chunks(t: Tables):
    """Plain chunks of conversations, and the text of those that have one."""
    chunks = ch.structure_chunks(spoken(t), prefixed=False).groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    return chunks.select("doc_id", (F.col("n") == 1).alias("one"), F.when(F.col("n") == 1, F.col("text")).alias("text"))


@query("select mode, mode as worker, count(*) as n, count(distinct scenario_id) as scenarios from {results} group by mode")
def s11_worker_rows(t: Tables):
    """Result rows read from the folders of two workers, each of which has the rows of one mode."""
    top = new_folder(t.spark, "workers")
    rows = t.results.select("run_id", "scenario_id", "question_id", "mode")
    for mode in ("traditional", "hybrid"):
        rows.where(F.col("mode") == mode).write.parquet(f"{top}/{mode}")
    read = readers.worker_rows(t.spark, [f"{top}/traditional", f"{top}/hybrid"])
    return read.groupBy("mode", F.element_at(F.split("src", "/"), -1).alias("worker")).agg(F.count("*").alias("n"), F.count_distinct("scenario_id").alias("scenarios"))


@query("select path, case path % 5 when 0 then '| id | lang |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || path || ' | a\\|b, ' || lang || ' |' when 1 then '{\"id\": ' || path || '}' when 2 then '<d>' || lang || '</d>' when 3 then 'T ' || lang end as text from (select doc_id as path, lang from {documents})")
def s2_file_text(t: Tables):
    """Files of five types as text: CSV, JSON, XML, HTML, and one that has no parser."""
    d, five = t.documents, F.col("doc_id") % 5
    body = F.when(five == 0, F.concat(F.lit('id,lang\n'), F.col("doc_id").cast("string"), F.lit(',"a|b, '), "lang", F.lit('"\n')))
    body = body.when(five == 1, F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit("}"))).when(five == 2, F.concat(F.lit("<d>"), "lang", F.lit("</d>"))).otherwise(F.concat(F.lit("<h1>T</h1>\n<p>"), "lang", F.lit("</p>")))
    ext = F.when(five == 0, ".csv").when(five == 1, ".json").when(five == 2, ".xml").when(five == 3, ".html").otherwise(".pdf")
    return readers.file_text(d.select(F.col("doc_id").alias("path"), ext.alias("ext"), F.encode(body, "UTF-8").alias("content")))


#: What a decision model says of each order: on it, and on each of its lines as passage, citation and candidate. The text runs on Spark and on DuckDB.
_SAID = """select o_orderkey as id, case o_orderkey % 4 when 0 then 'no_retrieval' when 1 then 'single_pass' when 2 then 'multi_step' end as effort, case when o_orderkey % 4 = 0 then 0.85 + (o_custkey % 10) / 100.0 else 0.1 end as skip_p,
  (o_orderkey * 2833) % 1001 / 1000.0 as sufficiency, case when o_orderkey % 7 <> 0 then (o_custkey * 3907) % 1001 / 1000.0 end as grounded, case when o_orderkey % 11 <> 0 then (o_orderkey * 3571) % 1001 / 1000.0 end as addresses from {orders}"""
_SAID_OF = """select id, n, cast(k % 10 as double) / 10 as relevance, case when k % 9 <> 0 then cast(k % 11 as double) / 10 end as evidence, cast(k % 9 as double) / 10 as contradiction, case when k % 40 = 0 then 0.95 else 0.2 end as injection,
  case when k % 13 <> 0 then case when k % 5 = 0 then 'contradicts' when k % 5 < 4 then 'supports' else 'says_nothing' end end as verdict, cast(k % 100 as double) / 100 as confidence, (k % 97) / 100.0 as supported
  from (select distinct l_orderkey as id, l_linenumber as n, l_orderkey * 31 + l_linenumber * 17 as k from {lineitem}) x"""
_DROP = "case when injection >= 0.9 then 'drop' when contradiction >= 0.5 then 'conflict' when coalesce(evidence, 0) < 0.1 and relevance < 0.5 then 'drop' else 'include' end"


@query(f"""with o as ({_SAID}), l as ({_SAID_OF}), p as (select id, count(*) filter (where {_DROP} = 'include') as included, count(*) filter (where {_DROP} = 'conflict') as conflicts, count(*) filter (where {_DROP} = 'drop') as dropped,
  avg((coalesce(verdict, '') = 'supports' and confidence >= 0.8)::int) as supported, bool_or(coalesce(verdict, '') = 'contradicts') as contradicts, first(n::varchar order by supported desc, n) as candidate, max(supported) as candidate_p from l group by id),
 a as (select o.*, coalesce(included, 0) as included, coalesce(conflicts, 0) as conflicts, coalesce(dropped, 0) as dropped, candidate, candidate_p, coalesce(p.supported, 0) as supported, coalesce(contradicts, false) as contradicts from o left join p on p.id = o.id)
 select id, coalesce(effort, 'single_pass') as effort, coalesce(effort, '') = 'no_retrieval' and skip_p >= 0.9 as no_retrieval, round(sufficiency, 6) as sufficiency, sufficiency >= 0.5 as gate_passed, round(grounded, 6) as grounded, round(addresses, 6) as addresses, included, conflicts, dropped,
  candidate, round(candidate_p, 6) as candidate_p, round(supported, 6) as supported, contradicts, round(0.4 * addresses + 0.4 * supported + 0.2 * case when contradicts then 0 else 1 end, 3) as quality from a""")
def u4_decisions(t: Tables):
    """Every decision of a question from one recorded reply: effort, screening, sufficiency, citations, groundedness, best of several."""
    from quarry.operators.decisions import decided

    value = lambda c: F.struct(F.col(c).cast("double").alias("noul"), F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("map<string,double>").alias("probabilities"))
    choice = lambda c, p, names: F.struct(F.lit(None).cast("double").alias("noul"), F.col(c).alias("choice"), F.col(p).cast("double").alias("confidence"), names.alias("probabilities"))
    none = F.lit(None).cast("map<string,double>")
    entry = lambda name, answer: F.struct(name.alias("key"), answer.alias("value"))
    of = lambda start: F.concat(F.lit(start), F.col("n").cast("string"))
    lines = t.sql(_SAID_OF).select("id", F.explode(F.array(
        entry(of("c"), value("relevance")), entry(of("e"), value("evidence")), entry(of("x"), value("contradiction")), entry(of("i"), value("injection")),
        entry(of("cite_"), choice("verdict", "confidence", none)), entry(of("cand_"), value("supported")),
    )).alias("e"))
    orders = t.sql(_SAID).select("id", F.explode(F.array(
        entry(F.lit("effort"), choice("effort", "skip_p", F.create_map(F.lit("no_retrieval"), F.col("skip_p").cast("double")))),
        *[entry(F.lit(x), value(x)) for x in ("sufficiency", "grounded", "addresses")],
    )).alias("e"))
    whole = orders.unionByName(lines).groupBy("id").agg(F.map_from_entries(F.collect_list("e")).alias("answers"))
    fence = F.when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct("answers")), F.lit("\n```"))).otherwise(F.to_json(F.struct("answers")))
    d = decided(whole.select("id", fence.alias("reply")), "id")
    return d.select(*[F.round(c, 6).alias(c) if kind == "double" and c != "quality" else F.col(c) for c, kind in d.dtypes])
