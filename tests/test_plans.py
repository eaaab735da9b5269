"""Physical plans: what reaches the scan, and what must not be in them."""

import pytest

from quarry.operators import parts
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in {"r3_inverted_index"}])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(catalog.queries()[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalog.queries()["p1_bm25_in_scope"](spark, SF))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p and "n_chars" not in p
    p = plan(catalog.queries()["s9_parquet_scan"](spark, SF))
    assert "GreaterThanOrEqual(p_size,10)" in p and "p_name" not in p


@pytest.mark.parametrize("name", ["a5_arm_summary", "a6_pairwise_summary", "a14_progress", "t8_t9_calibration"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    p = plan(catalog.queries()[name](spark, SF))
    assert "partial_" in p


@pytest.mark.parametrize("name", ["r4_bm25_top10", "r5_rrf_fusion", "a1_retrieval_metrics", "w12_merge_dedupe", "x3_folded_messages", "c8_fixed_chunks"])
def test_no_python_on_built_in_paths(spark, name):
    p = plan(catalog.queries()[name](spark, SF))
    assert "Python" not in p and "Pandas" not in p


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.queries()["r4_bm25_top10"](spark, SF))


@pytest.mark.parametrize("name", ["j9_answer_in_evidence", "r6_dense_knn"])
def test_no_nested_loops_over_texts_or_vectors(spark, name):
    assert "NestedLoopJoin" not in plan(catalog.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["a15_judge_ensemble", "a22_decision_totals"])
def test_partitions_follow_the_rows(spark, name, monkeypatch):
    monkeypatch.setattr(parts, "PART_ROWS", 100)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    p = plan(catalog.queries()[name](spark, SF))
    assert f", {-(-rows // 100)}), REPARTITION_BY_NUM" in p


def test_no_task_sorts_a_whole_ranking(spark, monkeypatch):
    monkeypatch.setattr(parts, "PART_ROWS", 100)
    n = -(-2 * spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    p = plan(catalog.queries()["r5_rrf_fusion"](spark, SF))
    assert f", {n}), REPARTITION_BY_NUM" in p and "row_number() windowspecdefinition(source" not in p and "row_number() windowspecdefinition(query_id" in p


@pytest.mark.parametrize("name", ["r10_r12_rerank", "r11_rerank_by_rounded_score", "r16_reranked_arms"])
def test_texts_are_not_shuffled_for_a_few_hits(spark, name):
    from quarry.operators import search

    df = catalog.queries()[name](spark, SF)
    for line in plan(df).split("\n"):
        assert not ("Exchange hashpartitioning(id#" in line and "text" in line)
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin [id#" in x]
    assert not joins and search.MOST_HITS >= 2000
