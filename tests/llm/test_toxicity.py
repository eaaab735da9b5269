import random
import zlib

import numpy as np
import pyarrow as pa

from quarry.llm import toxicity as tx

BAD = ["wretch", "scoundrel", "villain", "knave"]


def costs(entry, word):
    """By definition: what turns the entry into each beginning of the word; 2 for an edit or a swap of neighbours, 1 for a masked letter."""
    d = [[2 * j for j in range(len(word) + 1)]] + [[2 * i] + [0] * len(word) for i in range(1, len(entry) + 1)]
    for i, x in enumerate(entry, 1):
        for j, y in enumerate(word, 1):
            d[i][j] = min(d[i - 1][j] + 2, d[i][j - 1] + 2, d[i - 1][j - 1] + (0 if x == y else 2 if y.isalpha() else 1))
            if i > 1 and j > 1 and x == word[j - 2] and entry[i - 2] == y and x != y:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 2)
    return d[-1]


def test_automaton_against_distances():
    rng = random.Random(1)
    entries = [("".join(rng.choice("abcde") for _ in range(rng.randint(4, 10))), rng.random() < 0.6, rng.random() + 1) for _ in range(40)]
    entries = list({t: (t, whole, x) for t, whole, x in entries if whole or len(t) <= 8}.values())
    trie = tx.Trie(entries)
    words = []
    for _ in range(600):
        w = list(rng.choice(entries)[0]) + [rng.choice("abcde") for _ in range(rng.choice([0, 0, 3, 50]))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            if rng.random() < 0.3 and k:
                w[k - 1 : k + 1] = w[k - 1 : k + 1][::-1]
            else:
                w[k] = rng.choice(["", "a", "x", "bd", "*", "4"])
            w = list("".join(w)) or ["a"]
        words.append("".join(w))
    near = trie.with_near_letters([w[: trie.reach] for w in words])
    for w, ok in zip(words, near, strict=True):
        odd = not w[: trie.reach].isalpha()
        want = 0.0
        for t, whole, x in entries:
            c = costs(t, w[: trie.reach])
            if (c[-1] if whole else min(c)) <= tx.allowed(len(t), whole, odd):
                want = max(want, x)
        assert trie.misspelled(w[: trie.reach]) == want
        assert (ok and trie.may_be_misspelled(w[: trie.reach], ok)) or want == 0


def test_quotation_is_a_degree():
    q = lambda t: tx.quotation(*(lambda w, i: (w[:i], w[i], w[i + 1 :]))(t.split(), t.split().index("X")))
    assert q("a X b") == 0 and q('"a X b"') == 1 and 0 < q('"a X b') < 1
    assert q("said X") == 1 > q("said the X") > q("said that the X") > 0 == q("said a b c d X")


def test_quotes_and_windows():
    trie = tx.Trie([(w, True, 3.0) for w in BAD])
    names = list(tx.FEATURES)
    x = tx.features(pa.array(['You are a wretch, a Villain!', 'He wrote: "you wretch" in a letter', "a scoundrrel and a kn4ve", None, ""], pa.string()), trie, {})
    hits, quoted, near = (x[:, names.index(n)] for n in ("hits", "quoted", "near"))
    assert hits[0] > 0 and quoted[0] == 0
    assert hits[1] == 0 and quoted[1] > 0
    assert near[2] > 0 and (x[3] == x[4]).all() and not x[3].any()


def table(spark, n=1200):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                t = rng.choice(BAD)
                w.insert(rng.randrange(len(w)), t if rng.random() < 0.8 else t[:2] + "*" + t[3:])
        docs.append((i, " ".join(w), "src", "score"))
        labels.append((i, None if i % 50 == 1 else int(toxic)))
    docs += [(n, None, None, ""), (n + 1, "", None, ""), (None, "a wretch and knave, scoundrel", None, ""), (3, docs[3][1], "src", "")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(spark):
    docs, labels = table(spark)
    got = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    for d, r in got.items():
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    right = [r.predicted == int(d % 4 == 0) for d, r in got.items() if d is not None and d < 1200 and r.held_out]
    assert sum(right) >= 0.97 * len(right) and got[None].predicted == 1 and got[1200].score == got[1201].score < 0.7
    kept = tx.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_nothing_to_learn(spark):
    docs, labels = table(spark, 20)
    assert {round(r.score, 6) for r in tx.toxicity(docs, labels.where("toxic = 0")).collect()} and tx.toxicity(docs.limit(0), labels).count() == 0
    assert tx.toxicity(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()


def test_ten_toxic_rows_teach_words(spark):
    """The lexicon does not wait for a number of rows."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(100):
        w = [rng.choice(plain) for _ in range(30)]
        if i % 10 == 0:
            w[5], w[15] = "wretch", "knave"
        rows.append((i, " ".join(w), int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = {t for t, whole, _ in tx.learned_lexicon(df.where("doc_id < 60").select("text", "toxic")) if whole}
    assert found >= {"wretch", "knave"} and not found & set(plain)
    got = {r.doc_id: r.predicted for r in tx.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert got == {i: t for i, _, t in rows}


def swapped(a, b):
    """Least number of edits and swaps of neighbours."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_swaps_masks_and_stems():
    trie = tx.Trie([("pathetic", True, 3.0), ("worthless", True, 2.5), ("idiot", True, 2.0), ("achlichk", False, 1.5)])
    for word, want in [("pahtetic", 3.0), ("paXhetyc".lower(), 3.0), ("w*rthl*ss", 2.5), ("i**ot", 2.0), ("idoit", 2.0), ("a*hlichkeit", 1.5), ("ahclichkeit", 1.5), ("poetic", 0.0), ("idaho", 0.0), ("riot", 0.0)]:
        assert (trie.misspelled(word) if trie.may_be_misspelled(word, *trie.with_near_letters([word])) else 0.0) == want, word
    x = tx.features(pa.array(["what a pahtetic w*rthl*ss i**ot"]), trie, {})
    assert x[0, tx.FEATURES.index("kinds")] == np.log1p(3)


def test_misspellings_against_distances():
    rng = random.Random(7)
    entries = [("".join(rng.choice("abcde") for _ in range(rng.randint(5, 9))), rng.random() < 0.7, rng.random() + 1) for _ in range(40)]
    entries = [(w[:8] if not whole else w, whole, x) for w, whole, x in entries]
    trie = tx.Trie(entries)
    for _ in range(400):
        w = list(rng.choice(entries)[0])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["", "a", "x", "bd"])
        w = "".join(w) + rng.choice(["", "", "xyz"])
        if len(w) < 4 or len(w) > trie.reach:
            continue
        near = [x for t, whole, x in entries if (swapped(t, w) <= (2 if len(t) >= 8 else 1) if whole else len(t) >= 8 and min(swapped(t, w[:n]) for n in range(len(w) + 1)) <= 1)]
        assert trie.misspelled(w) == max(near, default=0.0)
        assert trie.may_be_misspelled(w, *trie.with_near_letters([w])) or not near
