import random
from pathlib import Path

import corpus_pipeline as cp
from quarry.llm.common import shared_dir


def shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(20)
    docs, labels = [], []
    for i in range(400):
        t = say(rng.randint(30, 80))
        if i % 10 == 0:
            t += " villain scoundrel wretch"
        elif i % 10 == 1:
            t += " " + passage
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 10 == 0)))
    docs += [(1000 + i, docs[i][1] + " tail", "en", "s1", 0) for i in range(2, 50, 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    clean = cp.toxicity_stage(spark, at, str(tmp_path)).cache()
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == at.columns and not ids & set(range(0, 400, 10)) and ids >= {d for d, *_ in docs if d % 10 and d < 400}
    single = cp.jaccard_stage(spark, clean, str(tmp_path)).cache()
    kept = {r.doc_id: r.text for r in single.collect()}
    assert set(kept) == {d for d in ids if d < 1000}
    cut = {r.doc_id: r for r in cp.repeats_stage(spark, single, str(tmp_path)).collect()}
    for d, t in kept.items():
        want = t if d % 10 != 1 or d == 1 else None
        if want is not None:
            assert cut[d].text == want
        else:
            assert passage not in cut[d].text and len(t) - len(passage) - 6 <= cut[d].n_chars <= len(t) - len(passage)
    out = cp.run(spark, str(tmp_path))
    got = out.collect()
    pieces = {}
    for r in sorted(got, key=lambda r: r.piece):
        pieces.setdefault((r.doc_id, r.piece), r.text)
    assert all(pieces[r.doc_id, 0] == cut[r.doc_id].text for r in got if (r.doc_id, 1) not in pieces)
    assert {r.doc_id for r in got} <= set(kept) and all(sum(x["size"] for x in got if (x.cell, x.bin) == (r.cell, r.bin)) <= 2048 for r in got[:50])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, k int, rows int, copies int, part int, score double, `group` string, cell int, `a.b` string"


def strange_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, with names that operators use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    one = (1, "some words that stand alone here", "en", "s", 30, "r", 1, 1, 1, 1, 0.5, "g", 1, "x")
    rows = [one, one, (1, "SOME words that stand alone here", *one[2:]), (2, None, *one[2:]), (3, "", *one[2:]), (4, " \n\t ", *one[2:]), (5, long, *one[2:]), (6, "x" * 100_000, *one[2:])]
    rows += [(None, "a text without an id", *one[2:]), (7, "only text", *[None] * 12), tuple([None] * 14), tuple([None] * 14)]
    return rows


def test_strange_rows(spark, tmp_path):
    """Every stage takes them: rows without words stay, of equal texts one stays, texts are whole, columns are kept."""
    rows = strange_rows()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, None, None), (None, 1, 1), (7, 1, 0), (7, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.schema == docs.schema, name
            path = f"{tmp_path}/{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            kept.append(sorted((r.doc_id or 0, r.text) for r in docs.collect() if (r.text or "").strip()))
    ids = [[d for d, _ in k] for k in kept]
    assert ids[0] == [0, 1, 1, 1, 5, 6, 7] and ids[1] == [0, 1, 5, 6, 7] and ids[2] == ids[1]
    assert [t for _, t in kept[2]] == [t for _, t in kept[1]]
    assert set(ids[3]) <= set(ids[2]) and sum(r["size"] for r in out.collect()) == sum(len(t.split()) for _, t in kept[3])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_whole_run_over_strange_rows(spark, tmp_path):
    """Every text that stays is in bins, whole; of the tables between the stages only the last is left."""
    rows = strange_rows()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (None, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    top = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in top.glob("pipeline-*")}
    got = cp.run(spark, str(tmp_path)).collect()
    assert {p.name.rsplit("-", 1)[0] for p in top.glob("pipeline-*") if p.name not in before} == {"pipeline-source_mixing"}
    texts = {r[1] for r in rows if r[1]}
    for doc in {r.doc_id for r in got}:
        for copy in {(r.doc_id, r.text) for r in got if r.doc_id == doc and r.piece == 0}:
            assert not copy[1] or any(t.startswith(copy[1]) for t in texts)
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(r.size <= 2048 for r in got)
