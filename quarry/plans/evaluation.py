"""Metrics, summaries and statistics over the evaluation fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluation as ev
from quarry.operators import policy as po
from quarry.operators import statistics as st
from quarry.operators.parts import parts_for
from quarry.plans.registry import Tables, query
from quarry.plans.retrieval import HYBRID_SQL, _ITEMS, bm25_sql, bm25_top, docs, hybrid_top, items
from quarry.operators.search import containment


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


METRICS_SQL = """go as (select query_id, filename, count(*) over (partition by query_id) as g from gold), fi as (select *, row_number() over (partition by query_id, filename order by rank) as nth from ranked),
 re as (select f.query_id, f.rank from fi f semi join go using (query_id, filename) where nth = 1 and rank <= 10),
 pe as (select g.query_id, any_value(g) as g, min(r.rank) as best, count(distinct case when r.rank <= 4 then r.rank end) as in4, count(distinct r.rank) as in10 from go g left join re r on r.query_id = g.query_id group by g.query_id),
 dc as (select query_id, sum(1 / log2(rank + 1)) as dcg from re group by query_id),
 me as (select p.query_id, coalesce((best <= 1)::int, 0) as hit1, coalesce((best <= 4)::int, 0) as hit4, coalesce((best <= 10)::int, 0) as hit10, round(coalesce(1 / best, 0), 6) as mrr, round(in4 / g, 6) as recall4, round(in10 / g, 6) as recall10,
   round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(g, 10) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg10 from pe p left join dc using (query_id))"""
_KEPT = "ranked as (select query_id, rank, filename from {kept}), gold as (select distinct query_id, filename from {kept} where chunk % 3 = 0)"


def kept_metrics(t: Tables) -> DataFrame:
    return ev.retrieval_metrics(t.kept.select("query_id", "rank", "filename"), t.kept.where("chunk % 3 = 0"))


@query(f"with {_KEPT}, {METRICS_SQL} select * from me")
def a1_retrieval_metrics(t: Tables):
    return rounded(kept_metrics(t))


@query(f"with {_KEPT}, {METRICS_SQL} select round(avg(hit1), 4) as hit1, round(avg(hit4), 4) as hit4, round(avg(hit10), 4) as hit10, round(avg(mrr), 4) as mrr, round(avg(recall4), 4) as recall4, round(avg(recall10), 4) as recall10, round(avg(ndcg10), 4) as ndcg10 from me")
def a2_mean_metrics(t: Tables):
    return rounded(ev.mean_metrics(kept_metrics(t)), 4)


@query(f"with {_ITEMS}, {bm25_sql('items', 'docs')}, ranked as (select query_id, id as filename, rank from rk where rank <= 10), gold as (select i.query_id, d.id as filename from items i join docs d on contains(d.text, i.text)), {METRICS_SQL} select * from me")
def a1_bm25_against_gold(t: Tables):
    ranked = bm25_top(t, 10).select("query_id", "rank", F.col("id").alias("filename"))
    gold = containment(docs(t), items(t)).select("query_id", F.col("id").alias("filename"))
    return rounded(ev.retrieval_metrics(ranked, gold))


@query(f"with {HYBRID_SQL}, ranked as (select query_id, id as filename, rank from fu where rank <= 10), gold as (select i.query_id, d.id as filename from items i join docs d on contains(d.text, i.text)), {METRICS_SQL} select 'rrf' as arm, round(avg(hit1), 4) as hit1, round(avg(mrr), 4) as mrr, round(avg(recall4), 4) as recall4, round(avg(ndcg10), 4) as ndcg10 from me")
def r16_ablation_metrics(t: Tables):
    gold = containment(docs(t), items(t)).select("query_id", F.col("id").alias("filename"))
    ranked = hybrid_top(t).select("query_id", "rank", F.col("id").alias("filename"))
    return rounded(ev.mean_metrics(ev.retrieval_metrics(ranked, gold)).select(F.lit("rrf").alias("arm"), "hit1", "mrr", "recall4", "ndcg10"), 4)


@query("select l_returnflag, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.95) as p95 from {lineitem} group by l_returnflag")
def a3_percentile(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(ev.percentile("l_extendedprice", 50).alias("p50"), ev.percentile("l_extendedprice", 95).alias("p95"))


_LAT = "case when has_timings then coalesce(latency_ms, 0) end"
_ARM = f"""count(*) as n, round(avg(correctness), 6) as correctness, round(avg(faithfulness), 6) as faithfulness, count_if(abstention = 'answered') as answered, count_if(abstention = 'abstained') as abstained, count_if(abstention = 'partial') as partial,
 round(avg(hit1), 6) as hit1, round(avg(recall4), 6) as recall4, round(avg(mrr), 6) as mrr, round(avg({_LAT}), 6) as latency_mean, round(coalesce(quantile_cont({_LAT}, 0.5), 0), 6) as latency_p50, round(coalesce(quantile_cont({_LAT}, 0.95), 0), 6) as latency_p95,
 cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, count(error) as errors, round(avg(sufficiency_p), 6) as sufficiency_mean, round(avg(verification_p), 6) as verification_mean,
 round(avg(case when naive_recall4 is not null then recall4 end) - avg(case when recall4 is not null then naive_recall4 end), 6) as rerank_lift"""


@query(f"select mode, {_ARM} from {{results}} group by mode")
def a5_arm_summary(t: Tables):
    return rounded(ev.arm_summary(t.results, ["mode"]))


@query(f"select scenario_id, mode, {_ARM} from {{results}} group by scenario_id, mode")
def a5_arm_summary_by_scenario(t: Tables):
    return rounded(ev.arm_summary(t.results, ["scenario_id", "mode"]))


_PAIR = "count_if(ok) as n, count_if(ok and winner = 'hybrid') as wins, count_if(ok and winner = 'traditional') as losses, count_if(ok and winner = 'tie') as ties, round((count_if(ok and winner = 'hybrid') + 0.5 * count_if(ok and winner = 'tie')) / nullif(count_if(ok), 0), 6) as win_rate, round(count_if(ok and position_consistent) / nullif(count_if(ok), 0), 6) as position_consistency, count_if(not ok) as judge_errors"


@query(f"select scenario_id, {_PAIR} from (select *, winner <> 'error' and not judge_error as ok from {{results}} where winner is not null) group by scenario_id")
def a6_pairwise_summary(t: Tables):
    return rounded(ev.pairwise_summary(t.results, ["scenario_id"]))


@query("select mode, coalesce(scenario_id, 'overall') as scenario_id, count(*) as n, count(distinct question_id) as questions, round(avg(correctness), 6) as correctness from {results} group by grouping sets ((mode, scenario_id), (mode))")
def a7_rolled_summary(t: Tables):
    return rounded(ev.rolled_summary(t.results))


@query("select mode, count_if(answerable) as answerable, count_if(not answerable) as unanswerable, round(count_if(not answerable and abstention = 'abstained') / nullif(count_if(not answerable), 0), 6) as proper_abstention, round(count_if(not answerable and abstention = 'answered') / nullif(count_if(not answerable), 0), 6) as fabrication, round(count_if(answerable and abstention = 'abstained') / nullif(count_if(answerable), 0), 6) as over_abstention from {results} where abstention is not null group by mode")
def a8_abstention_split(t: Tables):
    return rounded(ev.abstention_split(t.results))


@query("select round(avg(((sufficiency_p >= 0.6) = answerable)::int), 6) as accuracy, round(avg(pow(sufficiency_p - answerable::int, 2)), 6) as brier, round(avg(answerable::int), 6) as true_rate, count(*) as n from {results} where sufficiency_p is not null")
def a9_gate_vs_answerable(t: Tables):
    return rounded(ev.gate_quality(t.results, "sufficiency_p", "answerable", 0.6))


@query("select round(avg(((sufficiency_p >= 0.6) = (recall4 >= 1))::int), 6) as accuracy, round(avg(pow(sufficiency_p - (recall4 >= 1)::int, 2)), 6) as brier, round(avg((recall4 >= 1)::int), 6) as true_rate, count(*) as n from {results} where sufficiency_p is not null and recall4 is not null")
def a10_gate_vs_coverage(t: Tables):
    return rounded(ev.gate_quality(t.results.where("recall4 is not null").withColumn("covered", F.col("recall4") >= 1), "sufficiency_p", "covered", 0.6))


WILSON_SQL = "greatest(0, (p + z2 / (2 * n)) / (1 + z2 / n) - 1.959963985 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)) as lo, least(1, (p + z2 / (2 * n)) / (1 + z2 / n) + 1.959963985 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)) as hi"


@query(f"with a as (select mode, scenario_id, avg(correctness) as p, count(correctness) as n, 1.959963985 * 1.959963985 as z2, avg((sufficiency_p < 0.6)::int) as escalation, count_if(answerable and sufficiency_p < 0.6) / nullif(count_if(answerable and sufficiency_p is not null), 0) as false_negative, count_if(not answerable and sufficiency_p >= 0.6) / nullif(count_if(not answerable and sufficiency_p is not null), 0) as false_positive from {{results}} group by all) select mode, scenario_id, round(p, 6) as mean, round(lo, 6) as lo, round(hi, 6) as hi, round(escalation, 6) as escalation, round(false_negative, 6) as false_negative, round(false_positive, 6) as false_positive from (select *, {WILSON_SQL} from a)")
def a11_arm_intervals(t: Tables):
    s, ok = F.col("sufficiency_p"), F.col("answerable")
    a = t.results.groupBy("mode", "scenario_id").agg(
        F.avg("correctness").alias("mean"), F.sum("correctness").alias("k"), F.count("correctness").alias("n"), F.avg((s < 0.6).cast("int")).alias("escalation"),
        (F.count_if(ok & (s < 0.6)) / F.nullif(F.count_if(ok & s.isNotNull()), F.lit(0))).alias("false_negative"), (F.count_if(~ok & (s >= 0.6)) / F.nullif(F.count_if(~ok & s.isNotNull()), F.lit(0))).alias("false_positive"),
    )
    lo, hi = st.wilson(F.col("k"), F.col("n"))
    return rounded(a.select("mode", "scenario_id", "mean", lo.alias("lo"), hi.alias("hi"), "escalation", "false_negative", "false_positive"))


@query("select scenario_id, mode, count(*) as n, round(avg((correctness >= 0.5)::int), 6) as binary_share, round(avg(correctness), 6) as correctness, round(avg(recall4), 6) as recall4, median(case when latency_ms > 0 then latency_ms end) as latency_median, count_if(winner = 'hybrid') as wins, count_if(winner = 'tie') as ties from {results} group by all")
def a12_scenario_report(t: Tables):
    return rounded(t.results.groupBy("scenario_id", "mode").agg(F.count("*").alias("n"), F.avg((F.col("correctness") >= 0.5).cast("int")).alias("binary_share"), F.avg("correctness").alias("correctness"), F.avg("recall4").alias("recall4"), F.median(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("latency_median"), F.count_if(F.col("winner") == "hybrid").alias("wins"), F.count_if(F.col("winner") == "tie").alias("ties")))


@query("with l as (select scenario_id, mode, list(coalesce(latency_ms, 0) order by coalesce(latency_ms, 0)) as x, count_if(abstention is null) as pending, count(error) as errors, avg(coalesce(latency_ms, 0)) as mean from {results} group by all) select scenario_id, mode, len(x) as n, round(mean, 6) as mean, x[(floor(len(x) / 2) + 1)::int] as p50, x[least(len(x), greatest(1, ceil(len(x) * 0.95)))::int] as p95, pending, errors from l")
def a13_live_summary(t: Tables):
    return rounded(ev.live_summary(t.results).withColumn("n", F.col("n").cast("long")))


@query("select scenario_id, count_if(error is null and mode = 'traditional') as traditional, count_if(error is null and mode = 'hybrid') as hybrid, count(error) as errors, count(*) as n_rows from {results} group by scenario_id")
def a14_progress(t: Tables):
    ok = lambda m: F.count_if(F.col("error").isNull() & (F.col("mode") == m))
    return t.results.groupBy("scenario_id").agg(ok("traditional").alias("traditional"), ok("hybrid").alias("hybrid"), F.count("error").alias("errors"), F.count("*").alias("n_rows"))


_JUDGES = "select o_orderkey as id, o_orderkey % 4 + l_linenumber % 2 as score, case when l_linenumber % 3 = 0 then 'abstained' when l_partkey % 2 = 0 then 'answered' else 'partial' end as label from {lineitem} join {orders} on l_orderkey = o_orderkey"


@query(f"with j as ({_JUDGES}), v as (select id, label, count(*) as c from j group by all), m as (select id, first(label order by c desc, label) as label, max(c) / sum(c) as label_share from v group by id) select j.id, round(avg(score), 6) as mean, any_value(m.label) as label, round(greatest(0, least(1, 1 - case when avg(score) = 0 then 0 else stddev_pop(score) / avg(score) end)), 6) as agreement, round(any_value(label_share), 6) as label_share from j join m on j.id = m.id group by j.id")
def a15_judge_ensemble(t: Tables):
    return rounded(ev.ensemble(t.sql(_JUDGES, t.by_order()), "id"))


_WORDS = "case {0} % 5 when 0 then 'error' when 1 then 'tie' when 2 then 'traditional' else 'hybrid' end"


@query(f"select o_orderkey, case when a = 'error' or b = 'error' then 'error' when a = b then a else 'tie' end as winner from (select o_orderkey, {_WORDS.format('o_orderkey')} as a, {_WORDS.format('o_custkey')} as b from {{orders}})")
def a16_position_swap(t: Tables):
    o = t.sql(f"select o_orderkey, {_WORDS.format('o_orderkey')} as a, {_WORDS.format('o_custkey')} as b from {{orders}}")
    return o.select("o_orderkey", po.swapped_verdict(F.col("a"), F.col("b")).alias("winner"))


@query("with v as (select l_orderkey, l_linenumber, l_partkey % 3 = 0 as rel, sum((l_partkey % 3 = 0)::int) over (partition by l_orderkey order by l_linenumber * 1000000 + l_partkey rows unbounded preceding) as hits, row_number() over (partition by l_orderkey order by l_linenumber * 1000000 + l_partkey) as pos from {lineitem}) select l_orderkey, round(coalesce(avg(case when rel then hits / pos end), 0), 6) as context_precision from v group by l_orderkey")
def a17_context_precision(t: Tables):
    return rounded(ev.average_precision(t.lineitem.select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"), (F.col("l_partkey") % 3 == 0).alias("relevant")), "l_orderkey"))


@query("with c as (select l_orderkey as id, avg((l_partkey % 3 <> 0)::int) as share from {lineitem} where l_quantity > 10 group by 1) select o_orderkey as id, round(case when o_orderkey % 17 = 0 then 1 when o_custkey % 19 = 0 then 0 else coalesce(share, 0) end, 6) as context_recall from {orders} left join c on id = o_orderkey")
def a18_context_recall(t: Tables):
    claims = t.lineitem.where("l_quantity > 10").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 3 != 0).alias("supported"))
    asked = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 == 0, " ").otherwise("text").alias("reference"), (F.col("o_custkey") % 19 != 0).alias("has_context"))
    return rounded(ev.context_recall(claims, asked, "id"))


@query("select answer_id, round(avg((verdict = 'supports' and confidence >= 0.8)::int), 6) as supported, bool_or(verdict = 'contradicts') as contradicts from {verdicts} group by answer_id")
def a19_citation_summary(t: Tables):
    return rounded(po.citation_summary(t.verdicts, ["answer_id"]))


@query("with s as (select answer_id, avg((verdict = 'supports' and confidence >= 0.8)::int) as s, bool_or(verdict = 'contradicts') as c from {verdicts} group by answer_id) select answer_id, round(0.4 * 0.7 + 0.4 * s + 0.2 * case when c then 0 else 1 end, 3) as quality from s")
def a20_composite_quality(t: Tables):
    s = po.citation_summary(t.verdicts, ["answer_id"])
    return s.select("answer_id", po.composite_quality(F.lit(0.7), F.col("supported"), F.col("contradicts")).alias("quality"))


@query("with d as (select l_orderkey as id, list(l_quantity::bigint order by l_linenumber) as u from {lineitem} group by 1) select o_orderkey as id, o_orderkey % 900 + coalesce(list_sum(list_filter(u, lambda x: x is not null)), 0)::bigint as prompt_tokens from {orders} left join d on id = o_orderkey")
def a21_token_accounting(t: Tables):
    d = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.lit("step").alias("name"), F.create_map(F.lit("prompt_tokens"), F.col("l_quantity").cast("long")).alias("usage"))).alias("decisions"))
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("prompt_tokens"), F.col("o_orderkey") % 900).alias("usage"))
    spent = F.aggregate(F.coalesce("decisions", F.array().cast("array<struct<name:string,usage:map<string,bigint>>>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["usage"]["prompt_tokens"], F.lit(0)))
    return o.join(d, "id", "left").select("id", (F.coalesce(F.col("usage")["prompt_tokens"], F.lit(0)) + spent).alias("prompt_tokens"))


_BOTH = "select h.scenario_id, h.question_id, h.qtype, a.correctness as trad, h.correctness as hyb, a.abstention as trad_abstention, h.abstention as hyb_abstention, coalesce(h.sufficiency_p < 0.6, false) as retried, h.seq from {results} h join {results} a on a.scenario_id = h.scenario_id and a.question_id = h.question_id and a.mode = 'traditional' and h.mode = 'hybrid' where a.error is null and h.error is null and a.correctness is not null and h.correctness is not null"


def _both(t: Tables) -> DataFrame:
    ok = t.results.where("error is null and correctness is not null")
    a = ok.where("mode = 'traditional'").select("scenario_id", "question_id", F.col("correctness").alias("trad"), F.col("abstention").alias("trad_abstention"))
    h = ok.where("mode = 'hybrid'").select("scenario_id", "question_id", "qtype", F.col("correctness").alias("hyb"), F.col("abstention").alias("hyb_abstention"), F.coalesce(F.col("sufficiency_p") < 0.6, F.lit(False)).alias("retried"), "seq")
    return h.join(a, ["scenario_id", "question_id"])


@query(f"select scenario_id, question_id, qtype, case when hyb < trad then 'loss' else 'win' end as outcome, trad, hyb, trad_abstention, hyb_abstention, retried, seq % 6 = 1 as conflict_flagged from ({_BOTH}) where hyb <> trad")
def a22_loss_taxonomy(t: Tables):
    """Every question that one arm wins, with its details."""
    b = _both(t).where("hyb <> trad")
    return b.select("scenario_id", "question_id", "qtype", F.when(F.col("hyb") < F.col("trad"), "loss").otherwise("win").alias("outcome"), "trad", "hyb", "trad_abstention", "hyb_abstention", "retried", (F.col("seq") % 6 == 1).alias("conflict_flagged"))


_STEPS = "select o_orderkey as id, case l_linenumber % 4 when 0 then 'battery' when 1 then 'citations' when 2 then 'effort' else 'select_best' end as name, case when l_linenumber % 4 = 0 then case l_partkey % 4 when 0 then 'drop_injection' when 1 then 'drop_evidence' when 2 then 'conflict' else 'keep' end when l_linenumber % 4 = 1 then case l_partkey % 3 when 0 then 'supports' when 1 then 'contradicts' else 'says_nothing' end when l_linenumber % 4 = 2 then case when l_partkey % 2 = 0 then 'low' else 'high' end else 'a' end as answer from {lineitem} join {orders} on l_orderkey = o_orderkey"
_KINDS = "case when name = 'battery' then case when contains(answer, 'drop') then case when contains(answer, 'injection') then 'injection_drop' else 'evidence_drop' end when contains(answer, 'conflict') then 'conflict_flag' end else answer end"


@query(f"with s as ({_STEPS}), b as ({_BOTH}), m as (select qtype, case when hyb < trad then 'loss' when hyb > trad then 'win' else 'tie' end as outcome, name, {_KINDS} as kind, retried, s.id from b join s on s.id = b.seq) select qtype, outcome, name, kind, count(*) as n, count(distinct id) as questions, count(distinct case when retried then id end) as retried from m where kind is not null group by all")
def a22_decision_totals(t: Tables):
    """Battery drops and conflicts, citation verdicts, efforts and best-of picks of the questions, by outcome."""
    by_order = t.by_order()
    b = _both(t).withColumn("outcome", F.when(F.col("hyb") < F.col("trad"), "loss").when(F.col("hyb") > F.col("trad"), "win").otherwise("tie"))
    b = b.select("seq", "qtype", "outcome", "retried").repartition(parts_for(t.lineitem), "seq")
    m = b.join(t.sql(_STEPS, by_order), F.col("seq") == F.col("id")).withColumn("kind", F.expr(_KINDS)).where("kind is not null")
    # A question's rows of a kind are counted first, where its steps are, so that distinct questions are rows.
    each = m.groupBy("id", "qtype", "outcome", "name", "kind").agg(F.count("*").alias("c"), F.max(F.col("retried").cast("int")).alias("r"))
    return each.groupBy("qtype", "outcome", "name", "kind").agg(F.sum("c").alias("n"), F.count("*").alias("questions"), F.sum("r").cast("long").alias("retried"))


_STABLE = "select l_orderkey as id, l_linenumber % 3 as variant, list_sort(list_distinct(list(l_suppkey % 4))) as files from {lineitem} group by 1, 2"


@query(f"with s as ({_STABLE}), b as (select *, first_value(files) over (partition by id order by variant) as base from s) select id, bool_and(files = base) as stable, round(avg(len(list_intersect(files, base)) / len(list_distinct(list_concat(files, base)))), 6) as overlap from b group by id")
def a23_retrieval_stability(t: Tables):
    runs = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).alias("variant")).agg(F.collect_set(F.col("l_suppkey") % 4).alias("files"))
    return rounded(ev.stability(runs, "id"))


@query("with c as (select conv_id, lower(trim(text)) as a, first_value(lower(trim(text))) over (partition by conv_id order by turn) as f, length(text) as len from {conversations}) select conv_id, round(avg((a = f)::int), 6) as consistency, round(avg(len), 6) as mean_len, round(coalesce(stddev_samp(len), 0), 6) as sd_len from c group by conv_id")
def a24_answer_consistency(t: Tables):
    w = st.Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.withColumn("a", F.lower(F.trim("text"))).withColumn("f", F.first("a").over(w))
    return rounded(c.groupBy("conv_id").agg(F.avg((F.col("a") == F.col("f")).cast("int")).alias("consistency"), F.avg(F.length("text")).alias("mean_len"), F.coalesce(F.stddev_samp(F.length("text")), F.lit(0.0)).alias("sd_len")))


@query("select (select count(*) from {documents}) as documents, (select count_if(length(trim(text)) > 0) from {documents}) as ready, (select count(distinct conv_id) from {conversations}) as conversations")
def a25_status_counts(t: Tables):
    d = t.documents.agg(F.count("*").alias("documents"), F.count_if(F.length(F.trim("text")) > 0).alias("ready"))
    return d.crossJoin(t.conversations.agg(F.count_distinct("conv_id").alias("conversations")))  # one row each


@query("select scenario_id, min(created_at) as created_at, max(finished_at) as finished_at, cast(sum(n_rows) as bigint) as n_rows from {runs} group by scenario_id")
def a26_merge_timestamps(t: Tables):
    return t.runs.groupBy("scenario_id").agg(F.min("created_at").alias("created_at"), F.max("finished_at").alias("finished_at"), F.sum("n_rows").alias("n_rows"))


_ROC = """g as (select score as threshold, count_if(label = 1) as p, count_if(label <> 1) as q from {scored} group by 1), t as (select sum(p) as np, sum(q) as nq from g),
 r as (select threshold, sum(p) over (order by threshold desc) as tp, sum(q) over (order by threshold desc) as fp from g union all select '-inf'::double, np, nq from t),
 ro as (select threshold, coalesce(tp / nullif(np, 0), 0) as tpr, coalesce(fp / nullif(nq, 0), 0) as fpr, coalesce(tp / nullif(np, 0), 0) - coalesce(fp / nullif(nq, 0), 0) as j from r, t)"""
_ECE = "select sum(c * abs(s - y)) / sum(c) as ece, sum(e) / sum(c) as brier, sum(c)::bigint as n from (select greatest(0, least(9, trunc(score * 10)::int)) as b, count(*) as c, avg(score) as s, avg(label) as y, sum(pow(score - label, 2)) as e from {scored} group by 1)"


@query(f"select round(ece, 6) as ece, round(brier, 6) as brier, n from ({_ECE})")
def t8_t9_calibration(t: Tables):
    return rounded(st.calibration_error(t.scored, "score", "label"))


@query(f"with {_ROC} select threshold, round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(j, 6) as j from ro where isfinite(threshold)")
def t10_roc_sweep(t: Tables):
    return rounded(st.roc(t.scored, "score", "label").drop("np", "nq")).where("threshold > -1e300")


@query(f"with {_ROC} select threshold, round(j, 6) as j from ro order by round(j, 9) desc, threshold desc limit 1")
def t11_best_threshold(t: Tables):
    return rounded(st.best_threshold(st.roc(t.scored, "score", "label")))


@query(f"with {_ROC}, b as (select threshold, j from ro order by round(j, 9) desc, threshold desc limit 1) select threshold, round(j, 6) as j, round((select avg(((score >= threshold) = (label = 1))::int) from {{scored}}), 6) as accuracy, round(ece, 6) as ece, round(brier, 6) as brier from b, ({_ECE})")
def a27_gate_calibration(t: Tables):
    best = st.best_threshold(st.roc(t.scored, "score", "label"))
    acc = t.scored.crossJoin(best).groupBy("threshold", "j").agg(F.avg(((F.col("score") >= F.col("threshold")) == (F.col("label") == 1)).cast("int")).alias("accuracy"))
    return rounded(acc.crossJoin(st.calibration_error(t.scored, "score", "label").drop("n")))  # one row each


_PAIRED = "select a.scenario_id, a.question_id, a.qtype, a.correctness as arm, b.correctness as base, a.correctness - b.correctness as diff from {results} a join {results} b on a.scenario_id = b.scenario_id and a.question_id = b.question_id and a.mode = 'hybrid' and b.mode = 'traditional' where a.correctness is not null and b.correctness is not null"


def pairs(t: Tables) -> DataFrame:
    return st.paired(t.results, "correctness", "hybrid", "traditional")


@query(f"select scenario_id, question_id, round(arm, 6) as arm, round(base, 6) as base, round(diff, 6) as diff from ({_PAIRED})")
def j3_paired_self_join(t: Tables):
    return rounded(pairs(t).drop("qtype"))


@query("select scenario_id, question_id, max(case when mode = 'traditional' then correctness end) as traditional, max(case when mode = 'hybrid' then correctness end) as hybrid from {results} where error is null group by all having count(distinct mode) = 2")
def j4_mode_pivot(t: Tables):
    return t.results.where("error is null").groupBy("scenario_id", "question_id").pivot("mode", ["traditional", "hybrid"]).agg(F.first("correctness")).where("traditional is not null and hybrid is not null")


_MCN = "case when b = c then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))) end"


@query(f"select scenario_id, b, c, round({_MCN}, 6) as p from (select scenario_id, count_if(arm > base) as b, count_if(arm < base) as c from ({_PAIRED}) group by 1)")
def t1_mcnemar_exact(t: Tables):
    return rounded(st.discordant(pairs(t), ["scenario_id"]))


@query(f"select nation, round(p, 6) as p, round(lo, 6) as lo, round(hi, 6) as hi from (select *, {WILSON_SQL} from (select c_nationkey as nation, avg((c_acctbal > 0)::int) as p, count(*) as n, 1.959963985 * 1.959963985 as z2 from {{customer}} group by 1))")
def t2_wilson_interval(t: Tables):
    c = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg((F.col("c_acctbal") > 0).cast("int")).alias("p"), F.count_if(F.col("c_acctbal") > 0).alias("k"), F.count("*").alias("n"))
    lo, hi = st.wilson(F.col("k"), F.col("n"))
    return rounded(c.select("nation", "p", lo.alias("lo"), hi.alias("hi")))


#: Rounds of a resampled interval, and parts of its deviation by which they may miss an end of the one that they tend to
#: (five deviations of that end).
_ROUNDS, _MISS = 10_000, 0.15


def mixed_sql(numbers: str) -> str:
    """statistics.mixed of a list of ubigint."""
    low, a, b = "4294967295::ubigint", f"{st.MIX_A}::ubigint", f"{st.MIX_B}::ubigint"
    return f"list_transform(list_transform(list_transform({numbers}, lambda x: (xor(x, x >> 16) * {a}) & {low}), lambda x: (xor(x, x >> 15) * {b}) & {low}), lambda x: xor(x, x >> 16))"


def moments_sql(pairs: str, by: str, end: str = "bo") -> str:
    """CTEs that end in bo(by, n, point, se, step, lo, hi): statistics.normal_interval over pairs(by, diff)."""
    return f"""bm as (select {by}, count(*) as n, round(sum(diff), 9) / count(*) as point, stddev_pop(diff) as sd, (max(diff) - min(diff)) / count(*) as step from ({pairs}) where diff is not null group by {by}),
 bs as (select p.{by}, avg(pow(p.diff - m.point, 3)) as third from ({pairs}) p join bm m on p.{by} = m.{by} where p.diff is not null group by p.{by}),
 {end} as (select {by}, n, point, sd / sqrt(n) as se, step, point + sd / sqrt(n) * (-1.959963985 + (pow(1.959963985, 2) - 1) * sk / 6) as lo, point + sd / sqrt(n) * (1.959963985 + (pow(1.959963985, 2) - 1) * sk / 6) as hi
  from (select *, case when sd > 0 then third / pow(sd, 3) else 0 end / sqrt(n) as sk from bm join bs using ({by})))"""


def boot_sql(pairs: str, by: str) -> str:
    """CTEs that end in bo(by, n, point, se, lo, hi, near): the resamples of statistics.drawn_interval over pairs(by, diff), every round drawn."""
    ubig = lambda x: f"{x}::ubigint"
    low = ubig(0xFFFFFFFF)
    h = f"list_transform(list_transform(own, lambda x: (xor(x, key) * {ubig(st.MIX_A)}) & {low}), lambda x: (xor(x, x >> 15) * {ubig(st.MIX_B)}) & {low})"
    return f"""{moments_sql(pairs, by, "mo")},
 bv as (select {by}, len(v)::ubigint as k, v, {mixed_sql(f"list_transform(range(len(v)), lambda i: (i::ubigint * {ubig(st.MIX_STEP)} + 1) & {low})")} as own from (select {by}, list(diff order by diff) as v from ({pairs}) where diff is not null group by {by})),
 br as (select {mixed_sql(f"[(r::ubigint * {ubig(st.MIX_ROUND)} + 42) & {low}]")}[1] as key from (select unnest(range({_ROUNDS})) as r)),
 bx as (select {by}, round(list_sum(list_transform({h}, lambda h: v[((h * k) >> 32)::bigint + 1])), 9) / k as m from bv, br),
 bq as (select {by}, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from bx group by {by}),
 bo as (select mo.{by}, n, point, se, bq.lo as lo, bq.hi as hi, greatest(abs(bq.lo - mo.lo), abs(bq.hi - mo.hi)) <= {_MISS} * se + step + 1e-9 as near from mo join bq on mo.{by} = bq.{by})"""


def bootstrap_drawn(diffs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, point, se, lo, hi of the interval of 10,000 drawn rounds, and `near`: whether it is where such an interval tends to."""
    tends = st.normal_interval(diffs, by).withColumnsRenamed({"lo": "t_lo", "hi": "t_hi"})
    drawn = st.drawn_interval(diffs, by, _ROUNDS)
    both = tends.join(drawn, by) if by else tends.crossJoin(drawn)  # one row each
    miss = F.greatest(F.abs(F.col("lo") - F.col("t_lo")), F.abs(F.col("hi") - F.col("t_hi")))
    return both.select(*by, "n", "point", "se", "lo", "hi", (miss <= _MISS * F.col("se") + F.col("step") + 1e-9).alias("near"))


_BY_SCENARIO = f"select scenario_id, diff from ({_PAIRED})"


@query(f"with {boot_sql(_BY_SCENARIO, 'scenario_id')} select scenario_id, n, round(point, 6) as point, round(se, 6) as se, round(lo, 6) as lo, round(hi, 6) as hi, near from bo")
def t4_paired_bootstrap(t: Tables):
    return rounded(bootstrap_drawn(pairs(t).select("scenario_id", "diff"), ["scenario_id"]))


@query("with d as (select o_orderpriority as grp, o_totalprice % 997 - 498 as diff from {orders}) select grp, count(*) as n, round(median(diff), 6) as point, true as near from d group by grp")
def t4_median_bootstrap(t: Tables):
    """The median over all orders; of the rows, shares of (1 - 1.96 / sqrt n) / 2 and its complement lie below the ends."""
    d = t.orders.select(F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") % 997 - 498).alias("diff"))
    below = d.join(st.bootstrap(d, ["grp"], "median"), "grp").groupBy("grp", "point").agg(F.count("*").alias("n"), F.count_if(F.col("diff") <= F.col("lo")).alias("l"), F.count_if(F.col("diff") <= F.col("hi")).alias("h"))
    off = lambda c, z: F.abs(F.col(c) / F.col("n") - 0.5 - z / (2 * F.sqrt("n")))
    return rounded(below.select("grp", "n", "point", (F.greatest(off("l", -st.Z), off("h", st.Z)) <= _MISS / (2 * F.sqrt("n")) + 2 / F.col("n")).alias("near")))


_WIL = f"""d as (select scenario_id, diff, round(abs(diff), 12) as a from ({_PAIRED}) where diff <> 0), r as (select *, rank() over (partition by scenario_id order by a) + (count(*) over (partition by scenario_id, a) - 1) / 2 as rk, count(*) over (partition by scenario_id, a) as t from d),
 s as (select scenario_id, count(*) as n, sum(case when diff > 0 then rk else 0 end) as plus, sum(case when diff < 0 then rk else 0 end) as minus, sum(t * t - 1) as ties from r group by 1)"""


@query(f"with {_WIL} select scenario_id, n, round(least(plus, minus), 6) as w, round(least(0, least(plus, minus) - n * (n + 1) / 4 + 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) as z, round((plus - minus) / (plus + minus), 6) as rank_biserial from s")
def t5_wilcoxon(t: Tables):
    return rounded(st.wilcoxon(pairs(t), ["scenario_id"]))


_TESTS = "select 'g' || cast(l_suppkey % 4 as varchar(4)) as grid, 'h' || cast(l_suppkey as varchar(9)) as name, (l_suppkey * 7919 % 997) / 2000.0 as p from {lineitem} group by l_suppkey"


@query(f"with t as ({_TESTS}), r as (select *, row_number() over (partition by grid order by p, name) as k, count(*) over (partition by grid) as m from t) select grid, name, round(p, 6) as p, round(least(1, min(p * m / k) over (partition by grid order by k rows between current row and unbounded following)), 6) as q from r")
def t6_false_discovery(t: Tables):
    tests = t.sql(_TESTS).withColumn("p", F.col("p").cast("double"))
    return rounded(st.false_discovery(tests, ["grid"]))


@query(f"with t as ({_TESTS}), r as (select *, row_number() over (partition by grid order by p, name) as k, count(*) over (partition by grid) as m from t), q as (select *, least(1, min(p * m / k) over (partition by grid order by k rows between current row and unbounded following)) as q from r) select grid, count(*) as n, count_if(p < 0.05) as raw, count_if(q < 0.05) as adjusted from q group by grid")
def t7_hypothesis_grid(t: Tables):
    q = st.false_discovery(t.sql(_TESTS).withColumn("p", F.col("p").cast("double")), ["grid"])
    return q.groupBy("grid").agg(F.count("*").alias("n"), F.count_if(F.col("p") < 0.05).alias("raw"), F.count_if(F.col("q") < 0.05).alias("adjusted"))


#: Two-sided normal tail in DuckDB: erfc(z / sqrt 2) by its series below 3, by its continued fraction from there.
_FRACTION = "{z}"
for _k in range(24, 0, -1):
    _FRACTION = f"({{z}} + {_k} / {_FRACTION})"
_TAIL = "(case when {z} < 3 then 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda k: pow(-1, k) * pow({z} / sqrt(2), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) else 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) / " + _FRACTION + " end)"
@query(f"with {_WIL}, z as (select scenario_id, n, least(plus, minus) as w, round((plus - minus) / (plus + minus), 6) as rank_biserial, case when n >= 5 then -least(0, least(plus, minus) - n * (n + 1) / 4 + 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) end as z from s) select scenario_id, n, w, rank_biserial, round(coalesce({_TAIL.format(z='z')}, 1.0), 6) as p from z")
def t5_wilcoxon_p(t: Tables):
    return rounded(st.wilcoxon(pairs(t), ["scenario_id"]).withColumn("p", F.coalesce(st.normal_tail("z"), F.lit(1.0))).drop("z"))


_SWITCHED = f"case when b + c > 0 then case when b + c < 25 then {_MCN} else {_TAIL.format(z='z')} end end"
_QTYPE_BOOT = boot_sql(f"select qtype, diff from ({_PAIRED})", "qtype")


@query(f"with {_QTYPE_BOOT}, k as (select qtype, cut, count_if(arm >= cut and base < cut) as b, count_if(arm < cut and base >= cut) as c, count_if(arm > base) as w, count_if(arm = base) as ties, count(*) as n from ({_PAIRED}), (values (0.5), (0.75)) v(cut) group by all), z as (select qtype, cut, b, c, w, ties, n as n_pairs, greatest(0, abs(b - c) - 1) / sqrt(b + c) as z from k) select qtype, cut::double as cut, b, c, round({_SWITCHED}, 6) as p, w, ties, round((w + 0.5 * ties) / n_pairs, 6) as win_rate, round(point, 6) as delta, round(lo, 6) as lo, round(hi, 6) as hi, near from z join bo using (qtype)")
def t13_binary_tests(t: Tables):
    p = pairs(t)
    wins = p.groupBy("qtype").agg(F.count_if(F.col("arm") > F.col("base")).alias("w"), F.count_if(F.col("arm") == F.col("base")).alias("ties"), F.count("*").alias("n"))
    boot = bootstrap_drawn(p.select("qtype", "diff"), ["qtype"]).withColumnRenamed("point", "delta").drop("n", "se")
    cuts = [st.discordant(p, ["qtype"], x, st.mcnemar_switched).withColumn("cut", F.lit(x)) for x in (0.5, 0.75)]
    both = cuts[0].unionByName(cuts[1]).join(wins, "qtype").join(boot, "qtype")
    return rounded(both.select("qtype", "cut", "b", "c", "p", "w", "ties", ((F.col("w") + 0.5 * F.col("ties")) / F.col("n")).alias("win_rate"), "delta", "lo", "hi", "near"))


@query("with r as (select mode, rank() over (partition by mode order by tokens_out) + (count(*) over (partition by mode, tokens_out) - 1) / 2 as rx, rank() over (partition by mode order by correctness) + (count(*) over (partition by mode, correctness) - 1) / 2 as ry from {results} where correctness is not null) select mode, round(corr(rx, ry), 6) as rho from r group by mode")
def t14_verbosity_probe(t: Tables):
    return rounded(st.spearman(t.results, "tokens_out", "correctness", ["mode"]))


_GROUP_BOOT = boot_sql(f"select scenario_id || '/' || qtype as grp, diff from ({_PAIRED})", "grp")


@query(f"with {_GROUP_BOOT}, c as (select scenario_id, qtype, count_if(arm > base) as b, count_if(arm < base) as c from ({_PAIRED}) group by all), p as (select *, {_MCN} as p from c), r as (select *, row_number() over (partition by qtype order by p, scenario_id) as k, count(*) over (partition by qtype) as m from p) select scenario_id, qtype, b, c, round(p, 6) as p, round(least(1, min(p * m / k) over (partition by qtype order by k rows between current row and unbounded following)), 6) as q, round(point, 6) as delta, round(lo, 6) as lo, round(hi, 6) as hi, near from r join bo on grp = scenario_id || '/' || qtype")
def t15_paired_tests(t: Tables):
    p = pairs(t)
    boot = bootstrap_drawn(p.select("scenario_id", "qtype", "diff"), ["scenario_id", "qtype"]).withColumnRenamed("point", "delta").drop("n", "se")
    tests = st.discordant(p, ["scenario_id", "qtype"]).withColumn("name", F.col("scenario_id"))
    return rounded(st.false_discovery(tests, ["qtype"]).drop("name").join(boot, ["scenario_id", "qtype"]))


@query(f"""with gold as (select distinct query_id, filename from {{kept}} where chunk % 3 = 0), g as (select query_id, count(*) as g from gold group by 1),
 r as (select query_id, filename, rank, row_number() over (partition by query_id order by rerank_score desc nulls last, rank) as rank2 from {{kept}}),
 h as (select query_id, count(distinct case when rank <= 4 then filename end) as base, count(distinct case when rank2 <= 4 then filename end) as arm from r semi join gold using (query_id, filename) group by 1),
 m as (select query_id, coalesce(base, 0) / g as base, coalesce(arm, 0) / g as arm from g left join h using (query_id)),
 {boot_sql("select 'all' as grp, arm - base as diff from m", "grp")},
 k as (select count_if(arm >= 1 and base < 1) as b, count_if(arm < 1 and base >= 1) as c from m) select 'all' as "group", b, c, round({_MCN}, 6) as p, round(point, 6) as delta, round(lo, 6) as lo, round(hi, 6) as hi, near from k, bo""")
def t16_layer_comparison(t: Tables):
    gold = t.kept.where("chunk % 3 = 0")
    base = ev.retrieval_metrics(t.kept.select("query_id", "rank", "filename"), gold).select("query_id", F.col("recall4").alias("base"))
    by_score = st.Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    arm = ev.retrieval_metrics(t.kept.select("query_id", F.row_number().over(by_score).alias("rank"), "filename"), gold).select("query_id", F.col("recall4").alias("arm"))
    both = arm.join(base, "query_id").withColumn("group", F.lit("all"))
    boot = bootstrap_drawn(both.select((F.col("arm") - F.col("base")).alias("diff")), []).withColumnRenamed("point", "delta").drop("n", "se")
    return rounded(st.discordant(both, ["group"], 1.0).crossJoin(boot))  # one row each


@query()
def t17_power_table(t: Tables):
    return st.power_table(pairs(t), ["scenario_id"])


@query(f"select scenario_id, round(p1, 6) as p1, round(p2, 6) as p2, round(p1 - p2, 6) as observed, round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)), 6) as h, round(greatest(0, least(1, coalesce(r, 0))), 6) as rho from (select scenario_id, avg((arm >= 0.5)::int) as p1, avg((base >= 0.5)::int) as p2, corr((arm >= 0.5)::int, (base >= 0.5)::int) as r from ({_PAIRED}) group by 1)")
def t18_power_report(t: Tables):
    one = lambda c: (F.col(c) >= 0.5).cast("int")
    a = pairs(t).groupBy("scenario_id").agg(F.avg(one("arm")).alias("p1"), F.avg(one("base")).alias("p2"), F.corr(one("arm"), one("base")).alias("r"))
    return rounded(a.select("scenario_id", "p1", "p2", (F.col("p1") - F.col("p2")).alias("observed"), st.cohen_h(F.col("p1"), F.col("p2")).alias("h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r", F.lit(0.0)))).alias("rho")))


_NEEDED = "2 * pow((1.959963985 + 0.841621234) / (2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2))), 2) / (1 - rho)"


@query(f"with a as (select scenario_id, count(*) as n, avg((arm >= 0.5)::int) as p1, avg((base >= 0.5)::int) as p2, greatest(0, least(1, coalesce(corr((arm >= 0.5)::int, (base >= 0.5)::int), 0))) as rho from ({_PAIRED}) group by 1) select scenario_id, n, round({_NEEDED}, 4) as needed, round(abs(p2 - p1) * n / ({_NEEDED}), 6) as mde from a")
def t17_mde_proportions(t: Tables):
    one = lambda c: (F.col(c) >= 0.5).cast("int")
    a = pairs(t).groupBy("scenario_id").agg(F.count("*").alias("n"), F.avg(one("arm")).alias("p1"), F.avg(one("base")).alias("p2"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.corr(one("arm"), one("base")), F.lit(0.0)))).alias("rho"))
    needed = st.pairs_needed(F.col("p1"), F.col("p2"), F.col("rho"))
    return a.select("scenario_id", "n", F.round(needed, 4).alias("needed"), F.round(F.abs(F.col("p2") - F.col("p1")) * F.col("n") / needed, 6).alias("mde"))


@query("with a as (select mode, count(*) as n, avg(correctness) as c, quantile_cont(case when has_timings then coalesce(latency_ms, 0) end, 0.5) as l from {results} group by mode) select mode, '| ' || mode || ' | ' || n || ' | ' || cast(round(c * 100, 1)::decimal(20,1) as varchar) || ' % | ' || cast(round(l / 1000, 1)::decimal(20,1) as varchar) || ' s |' as line from a")
def l10_arm_table(t: Tables):
    """The arm table as lines of markdown."""
    a = ev.arm_summary(t.results, ["mode"])
    cells = F.concat_ws(" | ", "mode", F.col("n").cast("string"), F.concat(F.round(F.col("correctness") * 100, 1).cast("decimal(20,1)").cast("string"), F.lit(" %")), F.concat(F.round(F.col("latency_p50") / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit(" s")))
    return a.select("mode", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
