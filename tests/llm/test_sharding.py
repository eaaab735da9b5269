import random
import zlib

import pytest

from quarry.llm import sharding as sh


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        for s in sizes:
            if room + s > mid:
                used, room = used + 1, 0
            room += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("cells", "fetch"), [(1 << 16, 1 << 17), (16, 8), (64, 16)])
def test_capacity_is_minimal(spark, cells, fetch):
    rng = random.Random(cells)
    for top in (3, 40, 4000):
        sizes = [rng.choice([1, 2, rng.randint(1, top)]) for _ in range(300)]
        starts = [sum(sizes[:i]) for i in range(len(sizes))]
        groups = spark.createDataFrame(list(zip(starts, sizes, strict=True)), "start long, size long").cache()
        cuts = sh.minimax_cuts(groups, 16, cells, fetch)
        assert cuts[-1] == sum(sizes) and len(cuts) <= 16
        assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == brute_capacity(sizes, 16)
        assert all(c in {s + z for s, z in zip(starts, sizes, strict=True)} for c in cuts)


def test_rows(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 50) for _ in range(80)] + [None, None, "é" * 9, "hot"] + ["hot"] * 100
    rows = [(i, t, "extra", 5) for i, t in enumerate(texts)] + [(None, "z", "e", 1), (7, texts[7], "e", 1), (7, texts[7], "e", 1)]
    got = sh.sharded(spark.createDataFrame(rows, "doc_id long, text string, shard string, size int"), 4).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows if d is not None)
    by_text = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(v) == 1 for k, v in by_text.items() if k)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_empty(spark):
    assert sh.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.shard for r in sh.sharded(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [0]


def test_many_equal_rows(spark, monkeypatch):
    """Equal rows get slots of their own, whatever number a task makes at once."""
    monkeypatch.setattr("quarry.llm.common.AT_ONCE", 7)
    rows = [(1, "same")] * 300 + [(None, None)] * 40 + [(i, "t" * i) for i in range(2, 90)] + [(i, "same") for i in range(500, 520)]
    got = sh.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((d or 0, len(t or "") + 1) for d, t in rows)
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same")}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
