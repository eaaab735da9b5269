"""Tables by name, portable fixtures, and the list of registered queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.parts import parts_for

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Inputs shaped like the evaluation tables, derived from the supplied ones. The text runs on Spark and on DuckDB.
FIXTURES = {
    "results": """
        select o_orderkey as seq, 'run' || cast(o_orderkey % 4 as varchar(9)) as run_id, 'sc' || cast(o_custkey % 6 as varchar(9)) as scenario_id,
          'q' || cast(o_orderkey as varchar(12)) as question_id, m.mode as mode,
          case when o_orderkey % 5 = 0 then 'multi' else 'single' end as qtype, o_orderkey % 7 <> 0 as answerable,
          case when (o_orderkey + m.no) % 23 = 0 then cast(null as double) else cast((o_orderkey * 7919 + m.no * 104729) % 1001 as double) / 1000 end as correctness,
          case when (o_orderkey + m.no) % 23 = 0 then cast(null as double) else cast((o_orderkey * 6271 + m.no * 15485863) % 1001 as double) / 1000 end as faithfulness,
          case when (o_orderkey + m.no) % 23 = 0 then cast(null as varchar(20)) when (o_orderkey + m.no) % 9 = 0 then 'abstained' when (o_orderkey + m.no) % 9 = 1 then 'partial' else 'answered' end as abstention,
          case when (o_orderkey + m.no) % 29 = 0 then cast(null as double) else cast((o_orderkey * 3571 + m.no * 7907) % 60000 as double) end as latency_ms,
          (o_orderkey + m.no) % 31 <> 0 as has_timings, (o_orderkey * 17 + m.no) % 3000 as tokens_in, (o_orderkey * 13 + m.no) % 900 as tokens_out,
          case when o_orderkey % 3 = 0 then 'large' when o_orderkey % 3 = 1 then 'small' else 'unknown' end as model,
          case when m.mode = 'hybrid' and o_orderkey % 4 <> 0 then cast((o_orderkey * 2833) % 1001 as double) / 1000 end as sufficiency_p,
          case when m.mode = 'hybrid' then cast((o_orderkey * 3907) % 1001 as double) / 1000 end as verification_p,
          case when o_orderkey % 11 <> 0 then cast((o_orderkey * 31 + m.no) % 2 as int) end as hit1, case when o_orderkey % 11 <> 0 then cast(((o_orderkey * 37 + m.no) % 5) as double) / 4 end as recall4,
          case when o_orderkey % 11 <> 0 then cast(((o_orderkey * 41 + m.no) % 11) as double) / 10 end as mrr, case when o_orderkey % 11 <> 0 then cast(((o_orderkey * 43) % 5) as double) / 4 end as naive_recall4,
          case when (o_orderkey + m.no) % 23 = 0 then 'timeout' end as error,
          case when m.mode = 'hybrid' then case o_orderkey % 8 when 0 then 'error' when 1 then 'traditional' when 2 then 'traditional' when 3 then 'tie' when 4 then 'tie' else 'hybrid' end end as winner,
          o_orderkey % 6 <> 1 as position_consistent, o_orderkey % 37 = 0 as judge_error, o_orderdate as created_at
        from {orders} cross join (values ('traditional', 0), ('hybrid', 1)) as m(mode, no)""",
    "runs": """
        select 'run' || cast(o_orderkey % 97 as varchar(9)) as run_id, min(o_orderkey) as seq, min(o_orderdate) as created_at, max(o_orderdate) as finished_at,
          case when o_orderkey % 97 % 5 = 0 then 'running' when o_orderkey % 97 % 5 = 1 then 'failed' when o_orderkey % 97 % 5 = 2 then 'queued' else 'completed' end as status,
          'sc' || cast(o_orderkey % 97 % 6 as varchar(9)) as scenario_id, count(*) as n_rows from {orders} group by o_orderkey % 97""",
    "rankings": """
        select source, query_id, id, row_number() over (partition by source, query_id order by score desc, id) as rank from (
          select 'lexical' as source, l_suppkey % 50 as query_id, l_partkey as id, sum(l_quantity) as score from {lineitem} group by l_suppkey % 50, l_partkey
          union all select 'dense' as source, l_suppkey % 50 as query_id, l_partkey as id, sum(l_linenumber * 1.0) as score from {lineitem} where l_linenumber > 2 group by l_suppkey % 50, l_partkey) x""",
    "kept": """
        select o_custkey as query_id, row_number() over (partition by o_custkey order by o_orderkey) as rank, o_orderkey as chunk, 'f' || cast(o_orderkey % 13 as varchar(9)) as filename,
          case when o_orderkey % 10 = 0 then cast(null as double) else cast((o_orderkey * 7919) % 1000 as double) / 1000 end as rerank_score from {orders}""",
    "passages": """
        select o_orderkey as query_id, l_linenumber as idx, case when l_orderkey % 9 = 0 then cast(null as double) else l_discount * 10 end as evidence, l_tax * 10 as contradiction,
          case when l_partkey % 40 = 0 then 0.95 else 0.2 end as injection, cast(l_suppkey % 10 as double) / 10 as relevance from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "verdicts": """
        select l_orderkey as answer_id, l_linenumber as label, case when l_partkey % 5 = 0 then 'contradicts' when l_partkey % 5 < 4 then 'supports' else 'says_nothing' end as verdict,
          cast(l_suppkey % 100 as double) / 100 as confidence from {lineitem}""",
    "scored": """
        select doc_id, cast((doc_id * 7919) % 1000 as double) / 1000 as score, cast((doc_id * 104729 + 17) % 1000 as double) / 1000 as other, quality as label, toxic as toxic from {labels}""",
    "trace": """
        select user_id as message_id, event_id as seq, case event_type when 'click' then 'delta' when 'view' then 'retrieval' when 'purchase' then 'done' else 'status' end as kind, props, value, ts from {events}""",
}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one directory, and the fixtures over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        raise AttributeError(name)

    def by_order(self) -> dict[str, DataFrame]:
        """Orders and lines dealt out alike by order, in as many partitions as their rows ask for."""
        n = parts_for(self.lineitem)
        return {"orders": self.orders.repartition(n, "o_orderkey"), "lineitem": self.lineitem.repartition(n, "l_orderkey")}

    def sql(self, text: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
        """The text over the tables, or over those given in their place."""
        used = {n for n in re.findall(r"\{(\w+)\}", text) if n in TABLES}
        for n in used:
            (given or {}).get(n, getattr(self, n)).createOrReplaceTempView(f"quarry_{n}")
        return self.spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"quarry_{m[1]}" if m[1] in used else m[0], text))


def oracle(text: str) -> str:
    """DuckDB text: {table} and {fixture} become names, with a CTE for each fixture used."""
    used = [n for n in FIXTURES if f"{{{n}}}" in text]
    ctes = [f"{n} as ({FIXTURES[n]})" for n in used]
    body = text
    if ctes:
        stripped = text.lstrip()
        body = f"with {', '.join(ctes)}, {stripped[5:]}" if stripped.lower().startswith("with ") else f"with {', '.join(ctes)} {text}"
        if stripped.lower().startswith("with recursive"):
            body = f"with recursive {', '.join(ctes)}, {stripped[14:]}"
    body = body.replace("count_if(", "count(*) filter (where ")  # a bigint, and 0 for no rows
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES or m[1] in FIXTURES else m[0], body)


def query(sql: str | None = None):
    """Register f(tables) under its name, with DuckDB SQL if it can be said so."""

    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
