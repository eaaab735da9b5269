import numpy as np
import pytest

from quarry.llm import neardup as nd
from quarry.llm import topk as tk

NAN, INF = float("nan"), float("inf")


def vectors(seed=1, n=400, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(0, n, 5):
        base[i : i + 3] = base[i] + rng.normal(size=(3, dim)) * rng.choice([0.0, 0.02, 0.12])
    rows = [(int(i), [float(x) for x in v], int(i % 10 // 5)) for i, v in enumerate(base)]
    bad = [(1000, None, 0), (1100, [NAN] * dim, 0), (1200, [INF] + [0.0] * (dim - 1), 1), (1300, [], 1), (1400, [0.0] * dim, 1), (1500, [1.0, None] + [0.0] * (dim - 2), 1), (1600, rows[5][1], None), (5, rows[5][1], rows[5][2]), (None, rows[6][1], 1)]
    return rows, bad


@pytest.mark.parametrize("slab_rows", [11, 8192])
def test_top_k(spark, slab_rows):
    rows, bad = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, score string").repartition(3)
    got = {}
    for r in tk.top_k(df, every=20, k=7, slab_rows=slab_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v, _ in rows + [b for b in bad if b[0] in (1400, 1600, 5)]]
    for q, v in usable:
        if q % 20:
            continue
        best = sorted((-int(v @ w), i) for i, w in usable if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert tk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in tk.top_k(df).orderBy("rank").collect()] == [(0, 1, 2, 512 * 1024 + 512 * 2048), (0, 2, 1, 1024 * 1024)]


@pytest.mark.parametrize(("block_rows", "kind"), [(7, "string"), (2048, "int")])
def test_near_duplicates(spark, block_rows, kind):
    """With blocks of a few rows and of all, and labels of any type."""
    rows, bad = vectors(2)
    every = rows + bad
    df = spark.createDataFrame([(*r, 1) for r in every], "vec_id long, embedding array<double>, label int, kept int").repartition(3)
    df = df.withColumn("label", df["label"].cast(kind))
    got = sorted((tuple(r) for r in nd.near_duplicates(df, block_rows=block_rows).collect()), key=str)
    ok = [i for i, (d, v, lab) in enumerate(every) if d is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(every[i][1]) / np.linalg.norm(every[i][1]) for i in ok}
    comp = {i: i for i in ok}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = dict.fromkeys(ok, 0)
    for i in ok:
        for j in ok:
            if i < j and every[i][2] == every[j][2] and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    low = {}
    for i in ok:
        low[find(i)] = min(low.get(find(i), 10**9), every[i][0])
    want = []
    for i, (d, *_) in enumerate(every):
        c = low[find(i)] if i in links else d
        want.append((d, links.get(i, 0), c, d is None or d == c))
    assert got == sorted(want, key=str)
    assert nd.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
