import random
import re

import numpy as np
import pytest

from quarry.llm import jaccard as jc


def shingles(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, pct):
    ids = [d for d, _ in rows]
    sets = [shingles(t, k) for _, t in rows]
    comp = {i: i for i in range(len(rows))}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= pct * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[a] = b
    low = {}
    for i in range(len(rows)):
        r = find(i)
        low[r] = min(low.get(r, ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), low[find(i)]) for i in range(len(rows)))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choice(words) for _ in range(15))
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        if i % 2:
            base += line.split()
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["Zed", "yak", *words[:9]])
            rows.append(" ".join(w) if rng.random() < 0.7 else "  ".join(w).upper())
    hub = [rng.choice(words) for _ in range(150)]
    for _ in range(40):
        w = list(hub)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = rng.choice(words)
        rows.append(" ".join(w))
    rows += [None, "", " \n", "a", "A", "a b", "b a", "a b c", "é É", "é é", "x " * 4000, "x " * 50]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("k", "pct", "block"), [(3, 90, 3000), (5, 80, 1 << 20)])
def test_against_brute_force(spark, k, pct, block):
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jc.similar_sets(df, k, pct, block_bytes=block, range_bytes=2000).collect())
    assert got == brute(rows, k, pct)


@pytest.mark.parametrize("heap", [0, 512])
def test_divide_skip(monkeypatch, heap):
    monkeypatch.setattr(jc, "HEAP_SIZE", heap)
    rng = random.Random(2)
    for _ in range(200):
        sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 30))), np.uint64) for _ in range(rng.randint(1, 12))]
        query = np.array(sorted(rng.sample(range(40), rng.randint(1, 30))), np.uint64)
        need = np.array([rng.randint(1, 15) for _ in sets])
        want = [i for i, x in enumerate(sets) if len(np.intersect1d(x, query)) >= need[i]]
        assert jc.Lists(sets).reaching(query, need).tolist() == want


def test_slices(spark, monkeypatch):
    """Families larger than a slice: the plan is made here, so the limit set here holds."""
    monkeypatch.setattr(jc, "SLICE", 5)
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in jc.similar_sets(df).collect()) == brute(rows, 3, 90)


def test_edges(spark):
    assert jc.similar_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d", 1), (7, "A b  c d", 2), (7, "A b  c d", 2), (8, None, 3), (9, None, 3)], "doc_id long, text string, n_shingles int")
    got = sorted((tuple(r) for r in jc.similar_sets(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (7, 2, None), (7, 2, None), (8, 0, 8), (9, 0, 9)], key=str)


def test_one_of_each(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t, "x"), (2, t + " end", "y"), (2, t + " end", "y"), (2, "other words here now", "z"), (9, None, "n"), (9, None, "n"), (None, "only one", "q")]
    got = jc.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6]], key=str)


@pytest.mark.parametrize("size", [5, 1024])
def test_every_link_is_counted(spark, monkeypatch, size):
    """Also those between rows that are connected already, over slices, and with copies."""
    monkeypatch.setattr(jc, "SLICE", size)
    rows = corpus(11)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[::3])]
    sets = [shingles(t) for _, t in rows]
    want = [sum(i != j and bool(a) and bool(b) and 100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    low = {d: c for d, _, c in brute(rows, 3, 90)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jc.linked_sets(df, block_bytes=3000, range_bytes=2000).collect())
    assert got == sorted((d, len(s), n, low[d]) for (d, _), s, n in zip(rows, sets, want, strict=True))
    assert jc.linked_sets(df.limit(0)).count() == 0
