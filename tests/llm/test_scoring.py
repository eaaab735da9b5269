import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quarry.llm import common, scoring


def tokens(t):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(d):
    return zlib.crc32(str(d).encode()) % 10 == 0


def corpus():
    rng = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(2, 60)]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    return rows + [(500, None), (501, ""), (502, " \t\n\x0b\x0c\r "), (503, "  lead\xa0ing  trail "), (503, "again " * 500), (504, "x" * 3000)]


@pytest.mark.parametrize(("order", "stretch"), [(1, 256), (2, 256), (3, 7), (3, 256), (4, 5)])
def test_against_counts_by_hand(spark, order, stretch):
    """The walk of the automaton gives the interpolated probabilities, wherever the texts are cut into stretches."""
    rows = corpus()
    got = {(r.doc_id, r.n_tokens): r for r in scoring.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order, stretch=stretch, block_bytes=2000).collect()}
    assert len(got) == len(rows)
    counts = [Counter() for _ in range(order + 1)]
    for d, t in rows:
        if not held(d):
            seq = ["<s>", *tokens(t)]
            for n in range(1, order + 1):
                for i in range(max(1, n - 1), len(seq)):
                    counts[n][tuple(seq[i - n + 1 : i + 1])] += 1
    n_all, v = sum(counts[1].values()), len(counts[1])
    stats = {}
    for n in range(1, order + 1):
        c = np.array(list(counts[n].values()))
        s = np.zeros(4 + scoring.CLASSES)
        s[:4] = len(c), c.sum(), (c == 1).sum(), (c == 2).sum()
        for x in c:
            s[4 + math.frexp(x)[1] - 1] += x
        stats[n] = s
    model = scoring.fitted(stats, order)
    starts = sum(not held(d) for d, _ in rows)

    def prob(h, w):
        if not h:
            c = counts[1][(w,)]
            return (c - model["discount"]) / n_all if c else model["discount"] * v / n_all
        c = starts if h == ("<s>",) else counts[len(h)][h]
        low = prob(h[1:], w)
        if not c:
            return low
        mu = model["mu"][len(h) + 1]
        return (counts[len(h) + 1][(*h, w)] + mu * low) / (c + mu)

    for d, t in rows:
        toks = tokens(t)
        r = got[(d, len(toks))]
        seq = ["<s>", *toks]
        want = sum(math.log10(prob(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        base = sum(math.log10((counts[1][(w,)] + 0.1) / (n_all + 0.1 * (v + 1))) for w in toks)
        assert r.held_out == held(d) and r.train_tokens == n_all and r.n_known == sum(counts[1][(w,)] > 0 for w in toks)
        assert math.isclose(r.score, want, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
    vocabulary = [w for (w,) in counts[1]]
    for h in [(), ("w1",), ("<s>",), ("w1", "w2"), ("<s>", "w1")][: (0, 1, 3, 5, 5)[order]]:
        known = sum(prob(h, w) for w in vocabulary)
        assert math.isclose(known + prob(h, "never seen"), 1.0, rel_tol=1e-9)


def test_edges(spark):
    assert scoring.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = scoring.scores(spark.createDataFrame([(None, "a b", "x")], "doc_id long, text string, score string")).collect()[0]
    assert one.doc_id is None and one.held_out and one.n_tokens == 3 and one.n_known == 0 and one.train_tokens == 0 and one.score == 0 and one.base_score == 0


def test_totals_above_four_bytes():
    """Counts of a corpus of 100 TB come back as they were sent, and add up."""
    big = np.array([5_000_000_000, 0, 1, 2**40 + 3, 10**11], np.int64)
    assert common.unpacked_totals(common.packed_totals(big), 5).tolist() == big.tolist()
    keys, half = np.array([3, 9], np.uint64), np.array([2**32 - 1, 7], np.int64)
    rows = [(0, b, 1, 2, common.packed_keys(keys), common.packed_counts(half)) for b in range(3)]
    got = scoring._add_up(pd.DataFrame(rows, columns=["r", "block", "level", "n", "keys", "counts"]))
    assert common.unpacked_totals(got["counts"].iloc[0], 2).tolist() == [3 * (2**32 - 1), 21]
