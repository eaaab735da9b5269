import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarry.llm import repeats as rp
from quarry.llm import sql


def brute(rows):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in texts:
        cov = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                cov[i : i + 50] = True
        kept = bytes(x for x, c in zip(b, cov, strict=True) if not c)
        spans = int((cov & ~np.concatenate(([False], cov[:-1]))).sum()) if len(b) else 0
        out.append((d, len(b), int(cov.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [say(12) for _ in range(6)]
    rows = []
    for i in range(160):
        t = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, len(t))
            t = t[:cut] + rng.choice(lines) + t[cut:]
        rows.append((i, t))
    rows += [(200 + i, rows[i][1]) for i in range(12)]
    rows += [(230 + i, rows[i][1][:-7] + "xyz") for i in range(12)]
    rows += [(300, None), (301, ""), (302, "In. " * 300), (303, "In. " * 200), (304, "a" * 49), (305, "a" * 50), (306, "a" * 51), (3, rows[5][1]), (3, rows[5][1])]
    rng.shuffle(rows)
    return rows


def test_suffix_array_and_merge():
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 4, rng.integers(0, 40)).astype(np.uint16) for _ in range(60)]
    shards = []
    for part in (strings[:20], strings[20:45], strings[45:]):
        sym = np.concatenate([np.append(s, np.uint16(0)) for s in part])
        ends = np.flatnonzero(sym == 0)
        order = rp.suffix_array(sym, ends)
        tails = [(tuple(sym[i : ends[np.searchsorted(ends, i)]]), i) for i in range(len(sym))]
        assert [tails[i] for i in order] == sorted(tails)
        shards.append((sym, order))
    classes = rp.merged_classes(shards, 5)
    seen = {}
    for j, (sym, _) in enumerate(shards):
        for i, c in enumerate(classes[j]):
            w = tuple(sym[i : i + 5])
            k = w if len(w) == 5 and 0 not in w else (j, i)
            assert seen.setdefault(k, c) == c
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("hot", [1024, 3])
def test_against_brute_force(spark, hot):
    rows = corpus(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in rp.repeats(df, block_bytes=4000, hot=hot).collect())
    assert got == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rp.repeats(empty).count() == 0
    t = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(None, t, 1), (4, t, 2), (5, None, 3)], "doc_id long, text string, kept long")
    got = {r.doc_id: r for r in rp.repeats(df, with_text=True).collect()}
    assert got[None].n_removed == 0 and got[4].n_removed == len(t) and got[5].n_bytes == 0
    assert got[None].kept == t and got[4].kept == ""
    cut = {r.doc_id: r for r in rp.without_repeats(df).collect()}
    assert cut[None].text == t and cut[4].text == "" and cut[4].kept == 2 and cut[5].text == ""


def test_sql_says_what_brute_force_finds():
    rows = [*corpus(5), (900, None), (901, ""), (902, "é" * 60), (903, "é" * 70), (904, "x" * 49), (905, "x" * 49), (906, "y" * 50), (907, "y" * 50)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(con.execute(sql.REPEATS).fetchall()) == brute(rows)


@pytest.mark.parametrize("bits", [3, 40, 63])
def test_ordered_is_a_stable_argsort(bits):
    keys = np.random.default_rng(bits).integers(0, 2**bits, 3000).astype(np.uint64)
    keys[1000:] = keys[:2000]
    order, new = rp.ordered(keys)
    assert (order == np.argsort(keys, kind="stable")).all()
    assert np.flatnonzero(new).tolist() == [0, *(np.flatnonzero(np.diff(np.sort(keys))) + 1)]


def test_windows_of_a_range_merge_in_few_rounds(monkeypatch):
    """The least document of every window, over several shards, in a round for every five bytes of a window."""
    rng, depths, merged = np.random.default_rng(2), [], rp.merged_classes
    monkeypatch.setattr(rp, "merged_classes", lambda shards, depth: depths.append((len(shards), depth)) or merged(shards, depth))
    base = rng.integers(0, 256, 90).astype(np.uint8)
    strings = [base[a : a + n] for a, n in zip(rng.integers(0, 40, 30), rng.integers(50, 57, 30), strict=True)] + [rng.integers(0, 2, 300).astype(np.uint8) for _ in range(3)] + [np.full(400, 255, np.uint8)]
    docs = rng.permutation(len(strings)).astype(np.int64)
    low, want = {}, []
    for s, d in zip(strings, docs, strict=True):
        for i in range(len(s) - 49):
            w = s[i : i + 50].tobytes()
            low[w] = min(low.get(w, d), d)
            want.append(w)
    got = rp.least_docs(np.concatenate(strings), np.array([len(s) for s in strings]), docs, shard_symbols=500)
    assert got.tolist() == [low[w] for w in want]
    assert depths[0][0] > 2 and depths[0][1] <= 10
