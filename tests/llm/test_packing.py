import random

from quarry.llm import packing as pk


def brute(rows, capacity):
    """Try every open bin and take the tightest compatible one, the oldest of equals."""
    left, held, out = [], [], []
    for size, s, c in rows:
        fits = [(left[b], b) for b in range(len(left)) if left[b] >= size and left[b] > 0 and not any((s >= 0 and s == x) or (c >= 0 and c == y) for x, y in held[b])]
        b = min(fits)[1] if fits else len(left)
        if b == len(left):
            left.append(capacity)
            held.append([])
        left[b] -= size
        held[b].append((s, c))
        out.append(b)
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        rows = sorted(((rng.randint(0, 20), rng.randint(-1, 4), rng.randint(-1, 6)) for _ in range(40)), reverse=True)
        assert pk.best_fit(rows, 20) == brute(rows, 20)


def test_every_word_once(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), f"s{i % 3}", 1) for i in range(200)]
    rows += [(300, "v " * 1000, "s1", 1), (301, None, None, 1), (302, "", "s0", 1), (303, "A  b", "s0", 1), (304, "a B", "s1", 1), (303, "A  b", "s0", 1), (None, "q", None, 1)]
    got = pk.packed_bins(spark.createDataFrame(rows, "doc_id long, text string, source string, bin int"), capacity=100, cell_rows=60).collect()
    words, bins = {}, {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r["size"]
        bins.setdefault((r.cell, r.bin), []).append(r)
    want = {}
    for d, t, *_ in rows:
        want[d] = want.get(d, 0) + len((t or "").split())
    assert words == want
    for b in bins.values():
        assert sum(r["size"] for r in b) <= 100
        assert len({r.cluster for r in b}) == len(b)
        known = [r.source for r in b if r.source is not None]
        assert len(set(known)) == len(known)
    assert pk.packed_bins(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_pieces_are_the_texts(spark):
    rng = random.Random(6)
    gap = lambda: rng.choice([" ", "  ", "\t", "\n", " \x0b\x0c\r "])
    rows = [(i, gap() * rng.randint(0, 1) + "".join(f"wé{k}{gap()}" for k in range(rng.randint(0, 90))), f"s{i % 4}") for i in range(60)]
    rows += [(100, None, "s"), (101, "", None), (102, "x" * 5000, "s"), (103, " \n ", "s"), (None, "no id here", "s"), (5, rows[5][1], "s1"), (5, rows[5][1], "other"), (5, "another text", "s1")]
    got = pk.packed_texts(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=17, cell_rows=30).collect()
    texts = {}
    for r in sorted(got, key=lambda r: r.piece):
        texts.setdefault((r.doc_id, r.source, r.cluster), []).append((r.piece, r["size"], r.text))
    whole = {}
    for (d, s, _), pieces in texts.items():
        n = sum(p == 0 for p, _, _ in pieces)
        assert len(pieces) % n == 0 and all(size == len(t.split()) if "\x1c" not in t else True for _, size, t in pieces)
        whole[d, s, "".join(t for _, _, t in pieces[::n])] = n
    want = {}
    for d, t, s in rows:
        want[d, s, t or ""] = want.get((d, s, t or ""), 0) + 1
    assert whole == want


def test_many_equal_rows(spark, monkeypatch):
    """Equal rows are spread over cells and packed once each, whatever number a task makes at once."""
    monkeypatch.setattr("quarry.llm.common.AT_ONCE", 7)
    df = spark.createDataFrame([(1, "a b c", "s")] * 300 + [(i, "d e", "t") for i in range(2, 40)], "doc_id long, text string, source string")
    got = pk.packed_bins(df, capacity=100, cell_rows=40).collect()
    same = [r for r in got if r.doc_id == 1]
    assert len(got) == 338 and len(same) == 300 and len({(r.cell, r.bin) for r in same}) == 300
    assert max(sum(r.cell == c for r in same) for c in {r.cell for r in same}) < 100
