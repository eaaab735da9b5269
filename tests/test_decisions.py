"""Replies of a decision model: what they lead to, and what broken ones do."""

import json

from quarry.operators import decisions as de


def reply(**answers):
    return json.dumps({"answers": answers, "usage": {"tokens": 9}})


def test_all_decisions_of_one_reply(spark):
    whole = reply(
        effort={"choice": "no_retrieval", "probabilities": {"no_retrieval": 0.95}, "confidence": 0.9}, sufficiency={"noul": 0.5}, grounded={"noul": 0.25}, addresses={"noul": 0.5},
        c1={"noul": 0.9}, e1={"noul": 0.8}, x1={"noul": 0.1}, i1={"noul": 0.0}, c2={"noul": 0.9}, x2={"noul": 0.5}, i3={"noul": 0.99}, c4={"noul": 0.2},
        cite_1={"choice": "supports", "confidence": 0.8}, cite_2={"confidence": 1.0}, cand_b={"noul": 0.7}, cand_a={"noul": 0.7}, cand_c={},
    )
    df = spark.createDataFrame([(1, whole), (2, f"Here it is:\n```json\n{reply(cite_7={'choice': 'contradicts'})}\n```")], "query_id int, reply string")
    one, two = de.decided(df).orderBy("query_id").collect()
    assert (one.effort, one.no_retrieval, one.sufficiency, one.gate_passed, one.grounded, one.addresses) == ("no_retrieval", True, 0.5, True, 0.25, 0.5)
    assert (one.included, one.conflicts, one.dropped, one.candidate, one.candidate_p) == (1, 1, 2, "a", 0.7)
    assert (one.supported, one.contradicts, one.quality) == (0.5, False, 0.6)
    assert (two.effort, two.no_retrieval, two.sufficiency, two.gate_passed, two.grounded, two.quality, two.candidate) == ("single_pass", False, 0.0, False, None, None, None)
    assert (two.supported, two.contradicts, two.included) == (0.0, True, 0)
    passages = {r.idx: r.action for r in de.screened(de.answers(df)).where("query_id = 1").collect()}
    assert passages == {1: "include", 2: "conflict", 3: "drop", 4: "drop"}


def test_broken_replies_decide_nothing(spark):
    rows = [(1, None), (2, ""), (3, "no JSON"), (4, "{}"), (5, '{"answers": 3}'), (6, '{"answers": {"sufficiency": "high", "cand_a": {"noul": "x"}}}'), (7, reply()), (7, reply())]
    got = {r.query_id: r for r in de.decided(spark.createDataFrame(rows, "query_id int, reply string")).collect()}
    assert set(got) == set(range(1, 8))
    assert all((r.effort, r.sufficiency, r.gate_passed, r.included, r.supported, r.contradicts, r.quality) == ("single_pass", 0.0, False, 0, 0.0, False, None) for r in got.values())
    assert de.decided(spark.createDataFrame([], "query_id int, reply string")).count() == 0


def test_replies_are_read_once(spark):
    df = spark.createDataFrame([(1, reply(cite_1={"choice": "supports", "confidence": 1.0}))], "query_id int, reply string")
    p = de.decided(df)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("from_json") + p.count("jsontostructs") == 1 and "Join" not in p


def test_copies_of_a_reply_count_once(spark):
    one = reply(c1={"noul": 0.9}, e1={"noul": 0.9}, cite_1={"choice": "supports", "confidence": 1.0}, cite_2={"choice": "contradicts"}, cand_b={"noul": 0.7})
    got = de.decided(spark.createDataFrame([(1, one), (1, one)], "query_id int, reply string")).collect()
    assert [(r.included, r.supported, r.contradicts, r.candidate) for r in got] == [(1, 0.5, True, "b")]
