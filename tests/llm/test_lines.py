"""Line dedup against brute force, and what its bitmaps say."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.llm import lines, queries

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least=20, docs_least=3):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key_of(line)) >= least:
                holders.setdefault(key_of(line), set()).add(d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        keep = [x for x in every if d is None or len(key_of(x)) < least or len(holders[key_of(x)]) < docs_least or d == max(holders[key_of(x)])]
        out.append((d, len(every), len(every) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    got = lines.line_dedup(spark.createDataFrame(rows, SCHEMA), **how)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), key=repr)


LONG = "This line is long enough to count"
CASES = [
    (1, None), (2, ""), (3, "\n\n"), (4, f"{LONG}\nown"), (5, f"  {LONG.upper()}\t\nrest\n{LONG}"), (6, f"x\n{LONG}"), (7, f"{LONG}\r\n{LONG}"), (7, f"{LONG}\r\n{LONG}"), (7, f"other row\n{LONG}\n"),
    (8, "é" * 20), (9, "é" * 20), (10, "é" * 20), (11, "é" * 19), (12, "é" * 19), (13, "é" * 19), (14, " " + "a" * 20), (15, "a" * 20), (16, "a" * 20),
    (None, LONG), (None, None), (-3, LONG), (20, "twice in two documents only\ntwice in two documents only"), (21, "twice in two documents only"),
]


@pytest.mark.parametrize("heavy", [512, 2])
def test_edge_rows_as_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(lines, "HEAVY_LEAST", heavy)
    assert found(spark, CASES) == brute(CASES)


def test_frequent_keys_are_settled_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY_LEAST", 4)
    rows = [(i, f"{LONG}\nthis one is only in the document number {i}\n{LONG}") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    table = lines.stored(lines.keyed_lines(docs, 20), "t")
    heavy = lines.heavy_keys(table).collect()
    assert [(r.keeper, r.n_docs) for r in heavy] == [(39, 40)]
    assert found(spark, rows) == brute(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.lists(st.sampled_from(["abc", "ABC ", " abc", "", "\t", "aé", "b" * 3, "B" * 3]), max_size=200).map("\n".join)), min_size=1, max_size=12))
def test_random_documents_as_brute_force(spark, rows):
    assert found(spark, rows, least=3, docs_least=2) == brute(rows, 3, 2)


def test_bitmaps_hold_only_words_with_dropped_lines(spark):
    many = "\n".join(["own line"] * 100 + [LONG] + ["own line"] * 100)
    rows = [(1, many), (2, LONG), (3, LONG)]
    maps = {r.doc_id: r for r in lines.line_bitmaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(maps) == {1, 2} and maps[1].n_dropped == 1
    assert [(w.word, w.keep) for w in maps[1].bitmap] == [(100 // lines.WORD, ((1 << lines.WORD) - 1) & ~(1 << 100 % lines.WORD))]


def test_very_long_text(spark):
    long = "\n".join(f"{LONG} {i % 5}" for i in range(200_000))
    rows = [(1, long), (2, f"{LONG} 1"), (3, f"{LONG} 1"), (4, f"{LONG} 2")]
    assert found(spark, rows) == brute(rows)


def test_columns_stay_and_may_clash(spark):
    docs = spark.createDataFrame([(i, f"{LONG}\nkept", i, "x") for i in range(4)], "doc_id long, text string, k1 int, bitmap string")
    got = lines.without_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.k1) for r in got.collect()) == [(0, "kept", 0), (1, "kept", 1), (2, "kept", 2), (3, f"{LONG}\nkept", 3)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_no_python_and_hashes_by_range(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    table = lines.stored(lines.keyed_lines(docs, 20), "t")
    plan = lines.repeated_lines(table, lines.heavy_keys(table), 3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(k1" in plan and "hashpartitioning" not in plan and "Python" not in plan
    whole = queries.op12_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in whole and "Pandas" not in whole and "Arrow" not in whole
