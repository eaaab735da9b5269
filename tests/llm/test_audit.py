"""The filter audit against brute force over documents and orders."""

import re
from itertools import permutations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.llm import audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    fails = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        fails.append((s or "", {x for x in f if f[x]}, d in good, d in toxic))
    out, parts = [], {s for s, *_ in fails}
    orders = ["".join(p) for p in permutations("ABCDE")]
    removed_in_all = {}
    for o in orders:
        for part in parts:
            for k, x in enumerate(o):
                here = [r for r in fails if r[0] == part and not r[1] & set(o[:k]) and x in r[1]]
                removed_in_all[part, x] = removed_in_all.get((part, x), 0) + len(here)
    for o in orders:
        for part in parts:
            mine = [r for r in fails if r[0] == part]
            for k, x in enumerate(o):
                live = [r for r in mine if not r[1] & set(o[:k])]
                here = [r for r in live if x in r[1]]
                out.append((part, o, k + 1, len(live) - len(here), len(here), sum(x in r[1] for r in mine) - len(here), sum(r[1] == {x} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here), removed_in_all[part, x]))
    return sorted(out)


def found(spark, docs, labels):
    got = audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return sorted(tuple(r) for r in got.collect())


WIDE = " ".join(f"w{i}" for i in range(250))
CASES = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", "b"), (4, WIDE, "a"), (5, WIDE, "b"), (6, WIDE, None), (6, WIDE, None), (7, "x " * 400, "a"), (8, WIDE + " #", "a"), (9, WIDE.upper(), "a"), (None, WIDE, "a"), (None, None, None),
    (4, WIDE, "a"), (4, WIDE, "c"), (-1, "é" * 98 + "AB", "c"), (10, "é" * 97 + "ABC", "c"), (11, "x", ""), (12, "x" * 300_000 + " A", "a"), (13, " ".join(["y"] * 300), "a"),
]
MARKED = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 1), (7, 0, None), (99, 1, 1), (9, 1, 0)]


def test_edge_rows_as_brute_force(spark):
    assert found(spark, CASES, MARKED) == brute(CASES, MARKED)


texts = st.sampled_from([None, "", "a", "A", "a a a", "a #", WIDE, WIDE + " &", WIDE.upper(), "b b " * 120, "B * " * 120])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 8)), texts, st.sampled_from(["p", "q", None])), min_size=1, max_size=25), st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1), st.integers(0, 1)), max_size=8))
def test_random_documents_as_brute_force(spark, docs, labels):
    assert found(spark, docs, labels) == brute(docs, labels)


def test_transform_inverts_exactly(spark):
    """Cells of one mask each come back, large counts too."""
    rows = [("p", m, 10**15 + m, m, 0) for m in range(32)]
    sets = spark.createDataFrame(rows, "part string, mask int, n long, good long, toxic long")
    got = {r.label: r.cells for r in audit.cells(audit.parity_sums(sets)).collect()}
    assert got == {"n": [10**15 + m for m in range(32)], "good": list(range(32)), "toxic": [0] * 32}


def test_shapley_adds_up_to_what_all_filters_remove(spark):
    got = found(spark, CASES, MARKED)
    for part in {r[0] for r in got}:
        first = [r for r in got if r[0] == part and r[1] == "ABCDE"]
        assert sum(r[9] for r in first) == 120 * sum(r[4] for r in first)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], []) == []
    docs = spark.createDataFrame([(1, "x", "s", 7, "t")], DOCS + ", n int, mask string")
    labels = spark.createDataFrame([(1, 1, 0, "s")], LABELS + ", text string")
    got = [r for r in audit.filter_audit(docs, labels).collect() if r.filter_order == "ABCDE"]
    assert len(got) == 5 and got[0].removed == 1 and got[0].good_lost == 1
