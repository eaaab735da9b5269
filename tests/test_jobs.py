"""The jobs over growing copies of their inputs, and reruns."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import ingest_documents, retrieval_report
from jobs.common import BATCH, config, read_back, small_batches

TOP = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, source string"


def put(spark, folder, rows, name, schema=DOCS):
    """One more file of rows in the folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-tmp-{name}")
    os.makedirs(folder, exist_ok=True)
    (part,) = Path(f"{folder}-tmp-{name}").glob("part-*.parquet")
    part.rename(f"{folder}/{name}.parquet")


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def stored(spark, store):
    registry, chunks = ingest_documents.current(spark, store)
    return {r.doc_id: (r.status, r.chunk_count, r.batch) for r in registry.collect()}, sorted((r.doc_id, r.chunk_index, r.text) for r in chunks.collect())


def test_second_run_takes_only_new_files(spark, tmp_path, caplog):
    docs, store, state = f"{tmp_path}/docs", f"{tmp_path}/store", f"{tmp_path}/state"
    long = "word " * 400
    put(spark, docs, [(1, long, "en", "a"), (2, "", "en", "a"), (3, None, None, None), (None, "lost", "en", "a")], "one")
    with caplog.at_level(logging.INFO, "quarry.jobs"):
        assert ingest_documents.ingest(spark, docs, store, state) == [{"read": 4, "batch": 0, "documents": 3, "chunks": 3}]
    assert "read 4 rows (1 without doc_id), wrote 3 documents and 3 chunks" in caplog.text
    before = files(store)
    registry, chunks = stored(spark, store)
    assert registry == {1: ("ready", 3, 0), 2: ("error", 0, 0), 3: ("error", 0, 0)}
    assert ingest_documents.ingest(spark, docs, store, state) == [] and files(store) == before

    put(spark, docs, [(1, "short now", "fr", "a"), (4, "new", "en", "b")], "two")
    assert ingest_documents.ingest(spark, docs, store, state) == [{"read": 2, "batch": 1, "documents": 2, "chunks": 2}]
    assert before.items() <= files(store).items()  # what stood there is not written again
    registry, chunks = stored(spark, store)
    assert registry == {1: ("ready", 1, 1), 2: ("error", 0, 0), 3: ("error", 0, 0), 4: ("ready", 1, 1)}
    assert chunks == [(1, 0, "short now"), (4, 0, "new")]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    """As after a crash between the writes of a batch and its commit."""
    docs, store, state = f"{tmp_path}/docs", f"{tmp_path}/store", f"{tmp_path}/state"
    put(spark, docs, [(i, f"text {i} " * 300, "en", "a") for i in range(9)], "one")
    ingest_documents.ingest(spark, docs, store, state)
    before = stored(spark, store)
    (commit,) = Path(f"{state}/commits").glob("0")
    commit.unlink()
    (Path(f"{state}/commits") / ".0.crc").unlink(missing_ok=True)
    assert [b["batch"] for b in ingest_documents.ingest(spark, docs, store, state)] == [0]
    assert stored(spark, store) == before
    assert spark.read.parquet(f"{store}/chunks").count() == len(before[1])


def test_one_file_many_batches_and_copies_of_a_document(spark, tmp_path):
    docs, store = f"{tmp_path}/docs", f"{tmp_path}/store"
    for k in range(3):
        put(spark, docs, [(7, f"version {k}", "en", "a"), (7, f"version {k}", "en", "a"), (10 + k, "x", "12", "a")], f"f{k}")
        os.utime(f"{docs}/f{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    (tmp_path / "few.json").write_text(json.dumps({"files_per_batch": 1}))
    done = ingest_documents.ingest(spark, docs, store, f"{tmp_path}/state", f"{tmp_path}/few.json")
    assert [b["batch"] for b in done] == [0, 1, 2]
    registry, chunks = stored(spark, store)
    assert registry[7] == ("ready", 1, 2) and (7, 0, "version 2") in chunks and len(chunks) == 4
    assert {r.lang for r in ingest_documents.current(spark, store)[1].collect()} == {"en", "12"}
    one = ingest_documents.ingest(spark, f"{docs}/f1.parquet", f"{tmp_path}/single", f"{tmp_path}/state1")
    assert one == [{"read": 3, "batch": 0, "documents": 2, "chunks": 2}]


def test_empty_folder_and_bad_settings(spark, tmp_path):
    os.makedirs(f"{tmp_path}/docs")
    assert ingest_documents.ingest(spark, f"{tmp_path}/docs", f"{tmp_path}/store", f"{tmp_path}/state") == []
    assert stored(spark, f"{tmp_path}/store") == ({}, [])
    (tmp_path / "bad.json").write_text('{"chunk_size": 10, "chunk_overlap": 10}')
    with pytest.raises(ValueError, match="chunk_overlap"):
        ingest_documents.ingest(spark, f"{tmp_path}/docs", f"{tmp_path}/store", f"{tmp_path}/state", f"{tmp_path}/bad.json")
    (tmp_path / "odd.json").write_text('{"chunks": 10}')
    with pytest.raises(ValueError, match="unknown settings"):
        config(spark, f"{tmp_path}/odd.json", ingest_documents.DEFAULTS)


@pytest.fixture
def asked(spark, tmp_path):
    texts = ["red fox runs over the hill", "the dog sleeps all day long", "a red fox and a dog", "nothing here"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "red fox"), (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, "red fox"), (2, "dog"), (3, "no such passage"), (4, None), (None, "dog")], "item_id long, text string").write.parquet(f"{tmp_path}/asked")
    return tmp_path


def test_report_and_rerun(spark, asked):
    run = lambda *how: retrieval_report.report(spark, f"{asked}/docs", f"{asked}/asked", f"{asked}/out", *how)
    assert run() == {"bm25": 3, "dense": 3, "rrf": 3}
    rows = {(r.arm, r.question_id): r for r in retrieval_report.report_rows(spark, f"{asked}/out").collect()}
    assert set(rows) == {(a, q) for a in ("bm25", "dense", "rrf") for q in (1, 2, None)}
    assert set(rows["bm25", 1].hits) == {0, 2} and rows["bm25", 1].n == 2 and rows["bm25", 1].recall4 == 1.0
    whole = rows["bm25", None]
    assert (whole.n, whole.hit1, whole.level) == (2, 1.0, "arm") and 0 < whole.hit1_lo < whole.hit1_hi == 1.0
    (asked / "one.json").write_text('{"arms": ["bm25"], "k": 1}')
    before = {p: t for p, t in files(asked / "out").items() if "arm=bm25" not in p}
    assert run(f"{asked}/one.json") == {"bm25": 3}
    assert before.items() <= files(asked / "out").items()
    again = {(r.arm, r.question_id): r for r in retrieval_report.report_rows(spark, f"{asked}/out").collect()}
    assert len(again) == 9 and len(again["bm25", 1].hits) == 1 and again["rrf", 1] == rows["rrf", 1]
    with pytest.raises(ValueError, match="arms must be of"):
        (asked / "bad.json").write_text('{"arms": ["best"]}')
        run(f"{asked}/bad.json")


def test_report_of_nothing(spark, tmp_path):
    for name, key in (("docs", "doc_id"), ("asked", "item_id")):
        spark.createDataFrame([], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}")
    assert retrieval_report.report(spark, f"{tmp_path}/docs", f"{tmp_path}/asked", f"{tmp_path}/out") == {"bm25": 0, "dense": 0, "rrf": 0}
    assert retrieval_report.report_rows(spark, f"{tmp_path}/out").count() == 0
    assert read_back(spark, f"{tmp_path}/none", "a int").count() == 0


def test_command_line(tmp_path):
    """The shipped config and the given table, as a user runs it."""
    at = ["--documents", "/root/testdata/sf0.001/documents.parquet", "--store", f"{tmp_path}/store", "--checkpoint", f"{tmp_path}/state", "--config", "jobs/ingest_documents.json"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}
    out = subprocess.run([sys.executable, "-m", "jobs.ingest_documents", *at], cwd=TOP, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "1 new batches written" in out.stderr and files(f"{tmp_path}/store/chunks")


def test_report_makes_each_ranking_once(spark, tmp_path, monkeypatch):
    """Fused ranks come from the rankings of the other arms, which are not made again."""
    spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "other words here")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(7, "beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/asked")
    made = []
    for name, of in list(retrieval_report.RANKINGS.items()):
        monkeypatch.setitem(retrieval_report.RANKINGS, name, lambda q, d, k, name=name, of=of: made.append(name) or of(q, d, k))
    assert retrieval_report.report(spark, f"{tmp_path}/docs", f"{tmp_path}/asked", f"{tmp_path}/out") == {"bm25": 2, "dense": 2, "rrf": 2}
    assert sorted(made) == ["bm25", "dense"]


def test_report_shuffles_no_texts_of_differing_ids(spark, tmp_path):
    """Rows are put together only where an id comes twice; the greatest text of an id counts."""
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "red fox"), (2, "dog"), (None, "red"), (3, None)], schema).write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(1, "blue fox"), (2, None)], schema).union(spark.read.parquet(f"{tmp_path}/one")).write.parquet(f"{tmp_path}/two")
    for name, together in (("one", False), ("two", True)):
        rows, how = retrieval_report.one_row_each(spark.read.parquet(f"{tmp_path}/{name}"), "doc_id", "id")
        assert how is together and ("Exchange" in rows._jdf.queryExecution().executedPlan().toString()) is together
        assert sorted(map(tuple, rows.collect())) == [(1, "red fox"), (2, "dog")]
    spark.createDataFrame([(7, "fox")], "item_id long, text string").write.parquet(f"{tmp_path}/asked")
    read = {}
    for name in ("one", "two"):
        retrieval_report.report(spark, f"{tmp_path}/{name}", f"{tmp_path}/asked", f"{tmp_path}/{name}-out")
        read[name] = sorted(map(repr, retrieval_report.report_rows(spark, f"{tmp_path}/{name}-out").collect()))
    assert read["one"] == read["two"] and len(read["one"]) == 6


def test_batches_are_small_while_a_report_is_made(spark):
    for before in (None, "1234567"):
        spark.conf.unset(BATCH[0]) if before is None else spark.conf.set(BATCH[0], before)
        with pytest.raises(ZeroDivisionError), small_batches(spark):
            assert spark.conf.get(BATCH[0]) == BATCH[1]
            1 / 0  # noqa: B018
        assert spark.conf.get(BATCH[0], None) == before
    spark.conf.unset(BATCH[0])
