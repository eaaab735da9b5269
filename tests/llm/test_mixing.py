import random
from collections import defaultdict

from quarry.llm import mixing as mx


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Deal by weight, cap, deal the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        give = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if give[s] > most * sizes[s]}
        if not full:
            return out | give
        for s in full:
            out[s] = most * sizes[s]
        open_ -= full
        left -= sum(most * sizes[s] for s in full)
    return out


def rows_for(seed, n=1500):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "ä", "Z", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "zero"), (n + 2, "w\x0bw w " * 3000, "b"), (5, "same words", "b"), (5, "same words", "b"), (None, "no id", "b")]


def test_targets_and_rounding(spark):
    rows = rows_for(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.mixed_copies(df).collect()
    assert len(got) == len(rows)
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    by_key = {}
    for d, t, s in rows:
        by_key.setdefault(d, s)
        sizes[s] += len((t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).replace(" ", " ").split(" ")) - (t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ").count("")
    want = targets(sizes)
    for r in got:
        s = by_key[r.doc_id]
        taken[s] += r.taken
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * sizes[s] + 60
    again = mx.mixed_copies(df.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)


def test_copies_keep_their_mass(spark):
    """Over a source the number of copies is the mass rounded up or down."""
    rows = [(i, "one two three", "only") for i in range(1001)]
    r = mx.mixed_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.4).collect()
    assert sum(x.copies for x in r) in (400, 401)


def test_mix_repeats_rows(spark):
    rows = [(1, "a b", "s", 9), (2, None, "s", 8), (3, "c d", None, 7), (3, "c d", None, 7)]
    out = mx.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, copies int"), share=2.0).collect()
    assert sorted(tuple(r) for r in out if r.text) == sorted([rows[0]] * 2 + [rows[2]] * 4)
    assert out[0].__fields__ == ["doc_id", "text", "source", "copies"]
    assert mx.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_many_equal_rows(spark, monkeypatch):
    """Equal rows decide among themselves: their copies are their mass, up to one; other columns stay with their rows."""
    monkeypatch.setattr("quarry.llm.common.AT_ONCE", 7)
    rows = [(1, "a b c", "only", k) for k in range(250)] + [(i, "one two three", "only", 0) for i in range(2, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rows int")
    r = mx.mixed_copies(df, share=1.3).collect()
    same = [x.copies for x in r if x.doc_id == 1]
    assert len(r) == 328 and abs(sum(x.copies for x in r) - 1.3 * 328) <= 1 and len(same) == 250 and abs(sum(same) - 325) <= 1 and set(same) == {1, 2}
    path = f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/mix-rows"
    df.repartition(5).write.mode("overwrite").parquet(path)
    out = [x for x in mx.mix(spark.read.parquet(path), share=1.3).collect() if x.doc_id == 1]
    assert len(out) == sum(same) and {x.rows for x in out} == set(range(250))
