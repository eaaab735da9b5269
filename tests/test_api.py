import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quarry.api import EvalSuite, RetrievalEngine
from quarry.operators import models
from quarry.plans import catalog
from quarry.plans.registry import Tables
from quarry.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_engine(spark):
    docs = spark.createDataFrame([("z", "Zebra", "Zebra finch genome sequence data"), ("c", "Cooking", "Slow cooked beans and rice"), ("e", "Empty", " ")], "doc_id string, title string, text string")
    engine = RetrievalEngine.from_documents(docs)
    q = spark.createDataFrame([(1, "finch genome"), (2, "beans")], "query_id int, text string")
    hits = engine.retrieve(q, k=2)
    best = {r.query_id: r.doc_id for r in hits.where("rank = 1").collect()}
    assert best == {1: "z", 2: "c"}
    kept = engine.rerank(q, hits)
    assert {r.query_id for r in engine.gate(kept).collect()} == {1, 2}
    assert "Passage [1] (source: z)" in engine.context(kept).where("query_id = 1").first().context
    assert engine.delete(docs.where("doc_id = 'z'")).lexical(q).where("query_id = 1").count() == 0
    assert engine.scoped(docs.where("doc_id = 'c'")).retrieve(q, "lexical").select("doc_id").distinct().count() == 1


def test_suite(spark):
    s = EvalSuite(Tables(spark, SF).results)
    assert s.arms().count() == 2 and s.paired_tests().count() == 2 and s.markdown().count() == 2
    assert s.pairwise("scenario_id").count() > 1 and s.abstention().count() == 2 and s.gate().first().n > 0


def test_model_hooks(spark):
    hits = spark.createDataFrame([(1, "a", "q", "text one"), (1, "b", "q", "")], "query_id int, id string, q_text string, text string")
    score = models.pair_scorer(lambda: lambda pairs: [float(len(t)) for _, t in pairs])
    assert sorted(r.rerank_score for r in score(hits).collect()) == [0.0, 8.0]
    both = models.with_fallback(hits, None, score).collect()
    assert {r.scored_by for r in both} == {"fallback"}
    e = models.batched_embedder(lambda: lambda texts: [[float(len(t))] for t in texts])
    assert sorted(r.embedding for r in e(hits).collect()) == [[0.0], [8.0]]
    out = models.completions(spark.createDataFrame([(1, "p"), (2, "bad")], "query_id int, prompt string"), lambda: lambda p: p.upper() if p != "bad" else 1 / 0, interval_s=0.0).collect()
    assert {(r.query_id, r.answer, r.error) for r in out} == {(1, "P", None), (2, None, "division by zero")}


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.HTML").write_text("<p>x</p><script>no</script>")
    (tmp_path / "c.exe").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.file_text(readers.files(spark, str(tmp_path))).collect()}
    assert got == {"a.md": "# hi", "b.HTML": "x"}
    assert readers.manifest(spark, f"{tmp_path}/none.json").count() == 0
    r = Tables(spark, SF).results
    sinks.append_results(r, f"{tmp_path}/out")
    assert readers.worker_rows(spark, [f"{tmp_path}/out/run_id=run1"]).count() == r.where("run_id = 'run1'").count()
    assert sinks.partial_dump(r.limit(2)).count() == 2
    assert sinks.error_rows(r.limit(1).select("question_id"), ["a", "b"], "x").count() == 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture
def bare(tmp_path):
    """A copy of the repository without the optional folders."""
    top = Path(entry.__file__).resolve().parent
    for part in ("quarry", "jobs"):
        if (top / part).exists():
            shutil.copytree(top / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for part in top.glob("*.py"):
        shutil.copy(part, tmp_path)
    return tmp_path


def imported(folder, code="print(len(e.queries()), len(e.oracle_sql()))"):
    return subprocess.run([sys.executable, "-c", f"import __spark_entry__ as e; {code}"], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_folders(bare, pipeline):
    if not pipeline:
        (bare / "corpus_pipeline.py").unlink(missing_ok=True)
    out = imported(bare)
    assert out.returncode == 0, out.stderr
    others = [n for n in entry.queries() if n.startswith("job")]
    assert out.stdout.split()[0] == str(len(catalog.queries()) + len(others))


def test_entry_does_not_hide_a_failing_import(bare):
    (bare / "quarry" / "llm").mkdir()
    (bare / "quarry" / "llm" / "__init__.py").write_text("")
    (bare / "quarry" / "llm" / "queries.py").write_text("import no_such_module")
    out = imported(bare)
    assert out.returncode and "no_such_module" in out.stderr
