"""Hand-computed values and properties."""

import math
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.plans import catalog
from quarry.plans import evaluation as ev_plans
from quarry.plans.registry import Tables
from quarry.functions import text as tx
from quarry.operators import chunking as ch
from quarry.operators import evaluation as ev
from quarry.operators import lexical as lx
from quarry.operators import policy as po
from quarry.operators import runs as ru
from quarry.operators import search as se
from quarry.operators import vectors
from quarry.operators import statistics as st
from quarry.operators import trace as tr


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [("CNN报道机器学习", ["cnn", "报道", "道机", "机器", "器学", "学习"]), ("学", ["学"]), ("Crème brûlée", ["crème", "brûlée"]), ("a_b c-d 12", ["a_b", "c", "d", "12"]), ("", []), ("カナ x", ["カナ", "x"])],
)
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens("t"), t=text) == want


def test_stop_words(spark):
    assert one(spark, tx.index_tokens("t"), t="The cat and the hat") == ["cat", "hat"]
    assert one(spark, tx.index_tokens("t", None), t="The cat") == ["the", "cat"]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([("d1", "cat cat dog"), ("d2", "cat fish"), ("d3", "bird")], "id string, text string")


def test_bm25_by_hand(spark, toy):
    q = spark.createDataFrame([(1, "cat"), (2, "cat cat"), (3, "zebra"), (4, "the")], "query_id int, text string")
    got = {(r.query_id, r.id): r.score for r in se.bm25(q, toy).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    d1, d2 = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)), idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2))
    assert set(got) == {(1, "d1"), (1, "d2"), (2, "d1"), (2, "d2")}
    assert math.isclose(got[1, "d1"], d1) and math.isclose(got[1, "d2"], d2) and math.isclose(got[2, "d1"], 2 * d1)


def test_bm25_does_not_depend_on_partitions(spark, toy):
    q = spark.createDataFrame([(1, "cat dog bird")], "query_id int, text string")
    a = [tuple(r) for r in se.bm25(q, toy).orderBy("rank").collect()]
    assert a == [tuple(r) for r in se.bm25(q, toy.repartition(3)).orderBy("rank").collect()]


def test_fusion_order(spark):
    r = [("x", 1, "a", 1), ("x", 1, "c", 2), ("x", 1, "d", 3), ("y", 1, "b", 1), ("y", 1, "c", 2), ("y", 1, "e", 3)]
    df = spark.createDataFrame(r, "source string, query_id int, id string, rank int")
    assert [x.id for x in se.fuse(df).orderBy("rank").collect()] == ["c", "a", "b", "d", "e"]


def test_metrics_keep_duplicates_in_their_ranks(spark):
    ranked = spark.createDataFrame([(1, i + 1, f) for i, f in enumerate("aazzbx")], "query_id int, rank int, filename string")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, filename string")
    m = ev.retrieval_metrics(ranked, gold).first()
    assert (m.hit1, m.recall4, m.recall10, m.mrr) == (1, 0.5, 1.0, 1.0)
    assert math.isclose(m.ndcg10, (1 + 1 / math.log2(6)) / (1 + 1 / math.log2(3)))


def test_citations(spark):
    for text, want in [("A [2] then B [1].", [2, 1]), ("[2][3]", [2, 3]), ("[1, 2]", [1, 2]), ("[12a]", []), ("none", [])]:
        assert one(spark, tx.citations("t"), t=text) == want


def test_passage_policy_order(spark):
    rows = [(0.95, 0.9, 0.9, 0.9, "drop"), (0.0, 0.6, 0.0, 0.0, "conflict"), (0.0, 0.0, 0.05, 0.4, "drop"), (0.0, 0.0, 0.05, 0.5, "include"), (None, None, None, None, "drop")]
    df = spark.createDataFrame(rows, "injection double, contradiction double, evidence double, relevance double, want string")
    assert all(r.action == r.want for r in df.select(po.passage_action()[0].alias("action"), "want").collect())


def test_verdict_swap(spark):
    for a, b, want in [("hybrid", "hybrid", "hybrid"), ("hybrid", "traditional", "tie"), ("error", "tie", "error")]:
        assert one(spark, po.swapped_verdict(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("b", "c", "p"), [(8, 1, 0.0390625), (0, 0, 1.0), (5, 5, 1.0), (0, 5, 0.0625), (600, 500, None)])
def test_mcnemar(spark, b, c, p):
    got = one(spark, st.mcnemar(F.col("b"), F.col("c")), b=b, c=c)
    want = p if p is not None else min(1.0, 2 * sum(math.exp(math.lgamma(b + c + 1) - math.lgamma(k + 1) - math.lgamma(b + c - k + 1) - (b + c) * math.log(2)) for k in range(min(b, c) + 1)))
    assert math.isclose(got, want, rel_tol=1e-8)


def test_wilcoxon_all_positive(spark):
    d = spark.createDataFrame([("g", i, float(i)) for i in range(1, 9)], "g string, id int, diff double")
    r = st.wilcoxon(d, ["g"]).first()
    assert r.w == 0 and r.rank_biserial == 1 and r.n == 8


def test_false_discovery_textbook(spark):
    df = spark.createDataFrame([("g", n, p) for n, p in zip("abcd", [0.01, 0.04, 0.03, 0.005], strict=True)], "grid string, name string, p double")
    q = {r.name: round(r.q, 6) for r in st.false_discovery(df, ["grid"]).collect()}
    assert q == {"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02}
    ordered = [r.q for r in st.false_discovery(df, ["grid"]).orderBy("p").collect()]
    assert all(a <= b for a, b in pairwise(ordered))


def test_bootstrap_is_repeatable(spark):
    d = spark.createDataFrame([("g", i, float(i % 5) - 1) for i in range(40)], "g string, id int, diff double")
    a = st.bootstrap(d, ["g"], rounds=500).first()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = st.bootstrap(d.repartition(5), ["g"], rounds=500).first()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (a.lo, a.hi) == (b.lo, b.hi) and a.lo <= a.point <= a.hi


def test_bootstrap_rounds_are_independent_and_as_brute_force(spark, monkeypatch):
    """Quantiles of many rounds against a plain bootstrap, for one cell and for many, odd and even sizes, null groups."""
    rng = np.random.default_rng(8)
    for cells, n in ((1024, 301), (7, 300)):
        monkeypatch.setattr(st, "CELL_VALUES", cells)
        v = np.round(rng.gamma(1.0, 2.0, n), 2)
        d = spark.createDataFrame([(None, float(x), 1) for x in v], "n string, diff double, cell int")
        draws = v[rng.integers(0, n, (20_000, n))]
        for stat, of in (("mean", draws.mean(1)), ("median", np.median(draws, axis=1))):
            b = st.bootstrap(d, ["n", "cell"], stat).first()
            assert b.n is None and b.cell == 1 and abs(b.point - {"mean": v.mean(), "median": np.median(v)}[stat]) < 1e-9
            assert max(abs(b.lo - np.quantile(of, 0.025)), abs(b.hi - np.quantile(of, 0.975))) < 0.1 * of.std()
    wide = [[st.generator(1, 5, b, c).random(4).tolist() for c in range(3)] for b in range(3)]
    assert len({tuple(x) for row in wide for x in row}) == 9


def test_drawn_interval_is_a_bootstrap_in_any_cut(spark, monkeypatch):
    """Bounds as of a plain bootstrap; the same however values, stretches and rounds are dealt; few values are counted."""
    rng = np.random.default_rng(8)
    for v in (np.round(rng.gamma(1.0, 2.0, 700), 2), rng.integers(0, 4, 501).astype(float)):
        d = spark.createDataFrame([(None, float(x)) for x in v] + [("one", 2.5), (None, None)], "n string, diff double")
        first = {r.by: (r.lo, r.hi) for r in st.drawn_interval(d.withColumnRenamed("n", "by"), ["by"], 4000).collect()}
        means = v[rng.integers(0, len(v), (20_000, len(v)))].mean(1)
        assert first["one"] == (2.5, 2.5) and max(abs(first[None][0] - np.quantile(means, 0.025)), abs(first[None][1] - np.quantile(means, 0.975))) < 0.15 * means.std()
        for name, x in (("DRAWN_VALUES", 50), ("DRAWN_STRETCH", 100), ("DRAWS_AT_ONCE", 64), ("FEW_VALUES", 0)):
            monkeypatch.setattr(st, name, x)
        again = {r.by: (r.lo, r.hi) for r in st.drawn_interval(d.withColumnRenamed("n", "by").repartition(3), ["by"], 4000).collect()}
        assert again == first
        monkeypatch.undo()
    with pytest.raises(ValueError):
        st.drawn_interval(d, ["n"], 0)


def test_intervals_of_the_queries_are_drawn(spark):
    """Not the formula that they tend to: each bound misses it a little, and its SQL draws the same."""
    for name in ("t4_paired_bootstrap", "t13_binary_tests", "t15_paired_tests", "t16_layer_comparison"):
        assert f"range({ev_plans._ROUNDS})" in catalog.oracle_sql()[name]
    got = {r.scenario_id: r for r in catalog.queries()["t4_paired_bootstrap"](spark, "/root/testdata/sf0.001").collect()}
    t = st.normal_interval(ev_plans.pairs(Tables(spark, "/root/testdata/sf0.001")), ["scenario_id"]).collect()
    assert all(got[r.scenario_id].near for r in t) and any(abs(got[r.scenario_id].lo - r.lo) > 1e-5 for r in t)


def test_bootstrap_of_many_rows_works_by_values(spark):
    """Two values in two million rows: counts, not draws."""
    d = spark.range(2_000_000).select(F.lit("g").alias("g"), (F.col("id") % 2).cast("double").alias("diff"))
    b = st.bootstrap(d, ["g"], rounds=2000).first()
    assert b.point == 0.5 and abs(b.lo - (0.5 - 1.96 * 0.5 / 2e6**0.5)) < 1e-4 and b.lo < 0.5 < b.hi


def test_bootstrap_agrees_with_theory(spark):
    """The interval of a mean is near the normal one; other statistics and levels are taken; bad ones are refused."""
    rng = np.random.default_rng(3)
    v = rng.normal(0.3, 1, 400)
    d = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)], "g string, id int, diff double")
    a = st.bootstrap(d, ["g"], rounds=4000).first()
    half = 1.96 * v.std() / 20
    assert abs(a.point - v.mean()) < 1e-9 and abs(a.lo - (v.mean() - half)) < 0.01 and abs(a.hi - (v.mean() + half)) < 0.01
    m = st.bootstrap(d, ["g"], "median", 1000, 0.5).first()
    assert m.point == np.median(v) and a.lo < m.lo < m.hi < a.hi
    top = st.bootstrap(d, ["g"], lambda x: float(x.max()), 200).first()
    assert top.point == top.hi == v.max()
    empty = st.bootstrap(d.where("id < 0"), [], rounds=10).first()
    assert (empty.point, empty.lo, empty.hi) == (0, 0, 0)
    with pytest.raises(ValueError):
        st.bootstrap(d, ["g"], "mode")


def test_mcnemar_switches(spark):
    got = [one(spark, st.mcnemar_switched(F.col("b"), F.col("c")), b=b, c=c) for b, c in ((0, 0), (8, 1), (20, 10))]
    assert got[0] is None and abs(got[1] - 0.0390625) < 1e-12 and abs(got[2] - math.erfc(9 / math.sqrt(30) / math.sqrt(2))) < 1e-12


def test_roc_and_threshold(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.3, 0)], "score double, label int")
    sweep = st.roc(df, "score", "label")
    assert [(r.tpr, r.fpr) for r in sweep.orderBy(F.desc("threshold")).collect()] == [(0.5, 0.0), (0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (1.0, 1.0)]
    assert st.best_threshold(sweep).first().threshold == 0.9
    assert st.best_threshold(st.roc(df.where("label = 1"), "score", "label")).count() == 0


def test_calibration_bins(spark):
    df = spark.createDataFrame([(1.0, 1), (-0.5, 0), (0.55, 1)], "score double, label int")
    assert math.isclose(st.calibration_error(df, "score", "label").first().ece, (0.0 + 0.5 + 0.45) / 3)


def test_pacer_against_the_loop(spark):
    arrivals = [0.0, 0.2, 0.3, 9.0, 9.1, 9.1, 20.0]
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(arrivals)], "lane int, i int, a double")
    got = [r.slot for r in tr.paced(df, ["lane"], "a", ["i"], 1.5).orderBy("i").collect()]
    slot = -math.inf
    for a, g in zip(arrivals, got, strict=True):
        slot = max(a, slot + 1.5)
        assert math.isclose(slot, g, abs_tol=1e-9)


def test_upsert_and_document_replacement(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "doc string, i int, t string")
    new = spark.createDataFrame([("a", 0, "n")], "doc string, i int, t string")
    assert sorted(tuple(r) for r in ru.upsert(old, new, ["doc", "i"]).collect()) == [("a", 0, "n"), ("a", 1, "y"), ("b", 0, "z")]
    assert sorted(tuple(r) for r in ru.replace_document(old, new, "doc", ["doc", "i"]).collect()) == [("a", 0, "n"), ("b", 0, "z")]


# Chunks


def test_sections_fences_and_setext():
    text = "intro\n\n# One #\nbody\n```\n# not a heading\n```\nTwo\n---\nmore\n### Deep\n### Sibling\nend\n# Last"
    got = ch.filled(ch.sections(text))
    assert [p for p, _ in got] == [(), ("One",), ("One", "Two"), ("Deep", "Sibling")]
    assert "# not a heading" in got[1][1]


def test_chunks_have_prefix_and_size():
    text = "# Guide\n\n## Setup\n" + "word " * 600
    got = ch.chunked(text, "Manual")
    assert all(t.startswith("Manual | Guide | Setup :: ") and n <= 900 - len("Manual | Guide | Setup") - 4 for t, _, _, n in got)
    assert got[0][1] == "Guide > Setup" and ch.chunked("  \n", "t") == [] and ch.chunked(None, "t") == []


def test_fences_are_closed():
    assert ch.closed_fences(["a\n```", "code\n```", "b"]) == ["a\n```\n\ncode\n```", "b"]
    assert ch.closed_fences(["a\n```"]) == ["a\n```\n```"]


def test_pieces_cover_the_text():
    text = " ".join(f"w{i}" for i in range(500))
    got = ch.pieces(text, 100, 20)
    assert all(len(p) <= 100 for p in got) and set(" ".join(got).split()) == set(text.split())
    assert ch.pieces("short", 100, 20) == ["short"]


@pytest.mark.parametrize("most, part", [(1 << 22, 1 << 20), (1 << 22, 5), (0, 1 << 20)])
def test_containment_of_short_passages(spark, monkeypatch, most, part):
    """By one automaton, by several, and by anchors."""
    monkeypatch.setattr(se, "MOST_PASSAGES", most)
    monkeypatch.setattr(se, "PART_PASSAGES", part)
    monkeypatch.setattr(se, "HITS_AT_ONCE", 2)
    docs = spark.createDataFrame([(1, "the banana bread is good to eat today"), (2, "an old house"), (3, ""), (4, "x y"), (5, None)], "id int, text string")
    asked = ["banana bread is good to", "anana", "n old h", "an", "y", "he banana b", "bread is good", "zzz", "", "an"]
    got = {(r.query_id, r.id) for r in se.containment(docs, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")).collect()}
    assert got == {(i, r.id) for i, p in enumerate(asked) for r in docs.collect() if p and r.text and p in r.text}


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [1.0, 2.0]), (302, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = {}
    for r in se.nearest(df.where("id % 50 = 1").withColumnRenamed("id", "query_id"), df, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    norm = np.linalg.norm(v, axis=1)
    for q in range(1, 300, 50):
        if norm[q]:
            sims = np.where(norm > 0, np.round(v @ v[q] / np.maximum(norm * norm[q], 1e-9), 9), -9)
            want = np.lexsort((np.arange(300), -sims))[:5]
            assert [got[q][k] for k in range(1, 6)] == want.tolist()
    assert got[301] == {1: 301}


def test_index_cache(spark):
    chunks = spark.createDataFrame([("a", "d1", "red fox"), ("b", "d2", "red dog"), ("c", "d2", "cat")], "id string, doc_id string, text string")
    cache = se.IndexCache(most=2)
    first = cache.index(chunks, 1)
    assert cache.index(chunks, 1, []) is first and cache.built == 1
    assert cache.index(chunks, 1, ["d2", "d1"]) is cache.index(chunks, 1, ["d1", "d2"]) and cache.built == 2
    asked = spark.createDataFrame([(1, "red dog")], "query_id int, text string")
    assert se.bm25(asked, chunks, index=first).collect() == se.bm25(asked, chunks).collect()
    cache.index(chunks, 2)
    assert [k[0] for k in cache.held] == [2] and cache.built == 3
    cache.clear()
    assert not cache.held


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    return centers[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.05


def test_vector_index_as_the_full_scan(spark, tmp_path, monkeypatch):
    """Clusters, ties, copies, vectors of another length, null, zero and broken ones; the index stays right when opened again."""
    monkeypatch.setattr(vectors, "CELL_BLOCK", 50)
    v = np.concatenate([clustered(900, 8, 1), np.repeat(clustered(3, 8, 2), 20, 0), np.random.default_rng(3).integers(-2, 3, (200, 8)).astype(float)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [1.0, 2.0]), (2002, [None, 1.0]), (2003, [0.0] * 8), (2004, [2.0, 4.0]), (2005, [float("nan")] * 8), (2006, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>").repartition(3, "id")
    asked = df.where("id % 9 = 0 or id > 2000").withColumnRenamed("id", "query_id")
    index = vectors.VectorIndex.build(df, str(tmp_path))
    want = [tuple(r) for r in se.nearest(asked, df.where("id not in (2005, 2006)"), 7).orderBy("query_id", "rank").collect() if r.query_id not in (2005, 2006)]
    for x in (index, vectors.VectorIndex.open(spark, str(tmp_path))):
        got = [tuple(r) for r in x.nearest(asked, 7).orderBy("query_id", "rank").collect()]
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    unit = vectors.unit_vectors(asked, "query_id", "embedding")
    first = index.routed(unit, 7, False)
    rest = index.routed(unit.withColumn("floor", F.lit(0.99)), 7, True)
    size = {c: int(n) for c, n in index.cells["n"].items()}
    met = sum(size[r.cell] for r in first.unionByName(rest).collect())
    assert met < 0.5 * unit.count() * sum(size.values())


def test_vector_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id int, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert vectors.VectorIndex.build(none, str(tmp_path)).nearest(one, 3).count() == 0
    assert vectors.VectorIndex.build(one.withColumnRenamed("query_id", "id"), f"{tmp_path}/x").nearest(none.withColumnRenamed("id", "query_id"), 3).count() == 0


def test_chunks_worked_out_by_hand(spark):
    """Bare headings, a fence with a mark in it, an underlined heading, a text without any; plain chunks with their overlap."""
    text = "# Guide\n\n## Setup\n### First\nInstall it.\n\n```\n# no heading\n```\nUse\n===\nRun it."
    docs = spark.createDataFrame([("a", "Manual", text), ("b", "Plain", "One line."), ("c", "Blank", " \n ")], "doc_id string, title string, text string")
    got = [(r.doc_id, r.chunk_index, r.text, r.section) for r in ch.structure_chunks(docs).orderBy("doc_id", "chunk_index").collect()]
    assert got == [
        ("a", 0, "Manual | Guide | Setup | First :: Install it.\n\n```\n# no heading\n```", "Guide > Setup > First"), ("a", 1, "Manual | Use :: Run it.", "Use"), ("b", 0, "Plain :: One line.", ""),
    ]
    plain = ch.chunked("word " * 200 + "word", None, prefixed=False)
    assert [(c[0], c[3]) for c in plain] == [("word " * 179 + "word", 899), ("word " * 48 + "word", 244)]


def test_ranks_and_q_values_over_cells(spark, monkeypatch):
    """As one sort of each group gives them: ties, nulls, one value, null groups, few and many cells."""
    rng = np.random.default_rng(4)
    rows = [(g, float(x), i) for g, n in (("a", 300), ("b", 1), (None, 40)) for i, x in enumerate(np.round(rng.gamma(1, 1, n), 1))] + [("a", None, 900), ("a", None, 901), ("c", None, 902)]
    df = spark.createDataFrame(rows, "g string, v double, x int")
    for cells in (1, 8, 1024):
        monkeypatch.setattr(st, "MOST_CELLS", cells)
        got = {(r.g, r.x): r.rank for r in st.average_ranks(df, "v", ["g"], "rank").collect()}
        for g, v, x in rows:
            mine = [-1.0 if w is None else w for h, w, _ in rows if h == g]
            at = -1.0 if v is None else v
            assert got[g, x] == sum(w < at for w in mine) + (sum(w == at for w in mine) + 1) / 2
        p = df.where("v is not null").select("g", F.least(F.col("v"), F.lit(1.0)).alias("p"), F.col("x").cast("string").alias("name"))
        for r in st.false_discovery(p, ["g"]).collect():
            ps = sorted(min(v, 1.0) for h, v, _ in rows if h == r.g and v is not None)
            assert abs(r.q - min(1.0, min(y * len(ps) / (k + 1) for k, y in enumerate(ps) if y >= r.p))) < 1e-12


def test_hashed_embedding_shuffles_counts_not_words(spark):
    """Strange texts against plain counting; keys that are null or come twice; one exchange, of a row for each text."""
    from hashlib import md5

    texts = [(1, "A b\u00a0c\tb  a"), (2, ""), (3, None), (None, "x \x1f\u2003 y"), (4, " \n "), (1, "B \u00c9t\u00e9"), (5, "w " * 5000)]
    d = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: r.embedding for r in se.hashed_embedding(d).collect()}
    assert set(got) == {1, None, 5}
    for k, whole in ((1, "a b\u00a0c b a b \u00e9t\u00e9"), (None, "x \x1f\u2003 y"), (5, "w " * 5000)):
        v = np.zeros(64)
        for w in whole.strip(" ").split(" "):
            h = md5(w.encode()).digest()
            v[h[15] % 64] += 1
            v[h[14] % 64] += 0.5
        assert np.allclose(got[k], v / np.sqrt(v @ v), atol=1e-12)
    p = se.hashed_embedding(d)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in p


def test_terms_are_counted_where_the_texts_are(spark):
    df = spark.createDataFrame([(1, "b a b the"), (2, ""), (3, None), (4, "a 学校 a")], "id int, text string")
    rows = lambda d: sorted(map(tuple, d.select("id", "term", "tf", "dl").collect()))
    assert rows(se.counted(df)) == rows(se.postings(df)[0]) == [(1, "b", 2, 2), (4, "学校", 1, 1)]
    assert "Exchange" not in se.counted(df)._jdf.queryExecution().executedPlan().toString()
    twice = df.unionByName(df)
    assert rows(se.counted(twice)) == rows(se.postings(twice)[0])


def test_an_index_is_not_shuffled_for_a_few_questions(spark):
    chunks = spark.createDataFrame([(1, "b a b"), (2, "a")], "id int, text string").withColumn("doc_id", F.col("id"))
    asked = spark.createDataFrame([(7, "b")], "query_id int, text string")
    cache = se.IndexCache()
    found = se.bm25(asked, chunks, 10, index=cache.index(chunks, 1))
    p = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert found.select("id", "rank").collect() == se.bm25(asked, chunks, 10).select("id", "rank").collect() != []
    cache.clear()


def test_pairs_of_queries_and_chunks_add_up_in_place(spark):
    chunks = spark.createDataFrame([(1, "b c b"), (2, "c")], "id int, text string")
    p = se.bm25(spark.createDataFrame([(7, "b c")], "query_id int, text string"), chunks, 10)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning(query_id" in x and "id#" in x.split("hashpartitioning(query_id")[1].split(",")[1] for x in p.split("\n"))


def test_chunks_leave_before_a_batch_ends(monkeypatch):
    monkeypatch.setattr(ch, "CHARS_AT_ONCE", 500)
    docs = ch.pd.DataFrame({"doc_id": [str(i) for i in range(40)], "title": "t", "text": ["word " * 50] * 40})
    made = list(ch.chunk_frames(iter([docs]), prefixed=False))
    assert [len(f) for f in made] == [2] * 20 + [0] and [d for f in made for d in f["doc_id"]] == docs["doc_id"].tolist()


def test_median_rounds_are_dealt_only_where_a_middle_is(spark, monkeypatch):
    assert st.with_middle(np.array([0, 3, 4, 5, 6]), np.array([3, 1, 1, 1, 4]), 10).tolist() == [False, False, True, True, False]
    monkeypatch.setattr(st, "CELL_VALUES", 8)
    r = st.bootstrap(spark.range(400).select(F.col("id").cast("double").alias("diff")), [], "median", rounds=500).first()
    assert r.point == 199.5 and abs(r.lo - 179.9) < 6 and abs(r.hi - 219.1) < 6


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_over_ranges_are_row_numbers(spark, tmp_path, parts):
    """Ties, nulls and groups that fill several ranges, or share one."""
    rows = spark.range(500).select(F.when(F.col("id") < 450, "a").when(F.col("id") < 460, "b").alias("g"), F.when(F.col("id") % 50 != 0, F.col("id") % 4).alias("score"), "id")
    order = [F.desc("score"), F.col("id")]
    want = {(r.g, r.id): r["rank"] for r in se.top(rows, ["g"], order, None).collect()}
    got = se.numbered(rows, ["g"], order, parts, f"{tmp_path}/placed")
    assert {(r.g, r.id): r["rank"] for r in got.collect()} == want and len(want) == got.count() == 500
    assert spark.read.parquet(f"{tmp_path}/placed").select(F.shiftright("#place", 33)).distinct().count() == parts
    assert se.numbered(rows.limit(0), ["g"], order, parts, f"{tmp_path}/none").count() == 0


def test_an_index_holds_and_sends_bounded_batches(spark, tmp_path, monkeypatch):
    """Blocks leave before a task holds all its rows, queries in frames of a few pairs, and the neighbours stay."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "id long, embedding array<double>").coalesce(1)
    asked = rows.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    want = sorted(tuple(r) for r in se.nearest(asked, rows, 4).select("query_id", "id", "rank").collect())
    whole = vectors.VectorIndex.build(rows, f"{tmp_path}/whole")
    monkeypatch.setattr(vectors, "HELD", 8 * 100)
    monkeypatch.setattr(vectors, "SENT", 8 * 5)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)
    try:
        index = vectors.VectorIndex.build(rows, f"{tmp_path}/parts")
        got = sorted(tuple(r) for r in index.nearest(asked, 4).select("query_id", "id", "rank").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert index.blocks().count() > whole.blocks().count()
    assert sorted(k for r in index.blocks().collect() for k in r["keys"]) == list(range(300))


ODD = ["CNN报道机器学习, a学b", "学", "Crème brûlée¿Qué? «x»", "a_b c-d 12", "", "カナ x", "\u00bf\u00c0\u0080z", "x\U0001f600y \U0001f600", "q\u2014r\u3000s\u303ft", "한국어 text", "ﬀ \ue000 \uffff.", "the\x1fcat\u0085a\tİI ẞ", " of ", "\n\r"]


def test_blocks_cut_texts_as_the_tokenizer(spark):
    texts = [*ODD, "".join(ODD), *map("".join, zip(ODD, reversed(ODD), strict=True))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.lower("text").alias("low"), tx.tokens("text").alias("t"))
    rows = df.orderBy("id").collect()
    low = lx.pa.array([None, "", *[r.low for r in rows]], lx.pa.large_string()).fill_null("").slice(1)  # as a part of a batch
    at, words = lx.cut(low)
    got = [[] for _ in low]
    for i, w in zip(at.tolist(), words.to_pylist(), strict=True):
        got[i] += [w] * (w != "")
    assert got == [[], *[r.t for r in rows]]


def test_pieces_of_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(lx, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(lx, "BLOCK_BYTES", 10)
    texts = ["a" * 30, "b", "c" * 9, "d", None, "", "e", "f"]
    batch = lx.pa.RecordBatch.from_arrays([lx.pa.array(range(8)), lx.pa.array(texts)], names=["k", "t"])
    found = [(k.to_pylist(), t.to_pylist()) for k, t in lx.pieces(iter([batch, batch.slice(5)]))]
    assert found == [([0], ["a" * 30]), ([1, 2], ["b", "c" * 9]), ([3, 4, 5], ["d", "", ""]), ([6, 7], ["e", "f"]), ([5, 6, 7], ["", "e", "f"])]


def test_scores_of_blocks_whatever_is_added_at_once(monkeypatch):
    """The best k, ties to the first key, and all pairs, for chunks one by one and together."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 6))) for _ in range(60)]
    asked = lx.Asked.of([(7, "a", 1), (7, "b", 2), (3, "b", 1), (9, "h", 1), (4, "zz", 1)])
    block = lx.block_of(0, lx.pa.array(range(60)), lx.pa.array(texts, lx.pa.large_string()), asked, [])
    each, codes, tf = (np.frombuffer(block.column(c)[0].as_py(), np.int32) for c in ("terms", "codes", "tfs"))
    keys, weights = block.column("keys")[0].as_py(), tf.astype(float)
    place = np.arange(len(keys))[::-1]
    want = {(d, q): s for d, t in enumerate(texts) for q, s in ((7, t.count("a") + 2 * t.count("b")), (3, t.count("b")), (9, t.count("h"))) if s}
    best = {(d, q): s for n in (7, 3, 9) for (d, q), s in sorted((x for x in want.items() if x[0][1] == n), key=lambda x: (-x[1], -x[0][0]))[:4]}
    for hits, cells in ((1 << 20, 1 << 21), (1, 1), (20, 1 << 21), (1 << 20, 40)):
        monkeypatch.setattr(lx, "HITS_AT_ONCE", hits)
        monkeypatch.setattr(lx, "CELLS_AT_ONCE", cells)
        for k, right in ((None, want), (4, best)):
            d, q, s = lx.scores_of(weights, codes, each, place, asked, k, np.full(4, -np.inf))
            assert {(keys[i], asked.queries[j]): x for i, j, x in zip(d, q, s, strict=True)} == right and len(d) == len(right)


def test_chunks_of_differing_keys_are_searched_in_blocks(spark):
    """The same hits and scores as from postings: ties, repeated terms, null keys and texts, keys of both kinds."""
    rows = [(f"k{i % 97:02}", " ".join("abcdefghij"[(i * j) % 10] for j in range(1, 2 + i % 7)) + " 学校 the") for i in range(90)] + [("x", None), ("y", ""), (None, "a b")]
    chunks = spark.createDataFrame(rows, "id string, text string").repartition(5)
    asked = spark.createDataFrame([(1, "a b"), (2, "the"), (3, "zebra"), (None, "学校 c c"), (5, None)], "query_id int, text string")
    for docs in (chunks, chunks.select(F.xxhash64("id").alias("id"), "text"), chunks.limit(0)):
        for k in (None, 7):
            rank = lambda how: sorted(((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in se.bm25(asked, docs, k, **how).collect()), key=repr)  # noqa: E731, B023
            assert rank({"one_each": True}) == rank({})
    found = se.bm25(asked, chunks, 7, one_each=True)
    assert found.count() == 7 * 2  # of a b and of c c
    p = found._jdf.queryExecution()
    found.collect()
    plan = p.executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("pack(") == 1  # texts are cut once


def test_embeddings_of_differing_keys_are_not_shuffled(spark):
    rows = [(1, "A b\u00a0c\tb  a"), (2, ""), (3, None), (None, "x \x1f\u2003 y"), (4, " \n "), (5, "w " * 5000), (6, "\u00c9t\u00e9 学 X")]
    d = spark.createDataFrame(rows, "id long, text string")
    of = lambda x: sorted((r.id or 0, r.embedding) for r in x.collect())
    found = se.hashed_embedding(d, one_each=True)
    assert of(found) == of(se.hashed_embedding(d)) != []
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert se.hashed_embedding(d.where("id in (2, 4)"), one_each=True).count() == 0


def test_the_norm_of_an_embedding_is_worked_out_once(spark):
    """Not inside the function that divides each element by it."""
    p = se.hashed_embedding(spark.createDataFrame([(1, "a")], "id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat(SQRT(" in p and "/ SQRT(" not in p
