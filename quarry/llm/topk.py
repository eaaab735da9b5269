"""Exact top-k inner products with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: Rows that the pivots are fitted on, at most; pivots, at most; vectors in a slab; queries in a block; quantiles that slots are cut by.
FIT_ROWS, MAX_PIVOTS, SLAB_ROWS, QUERY_ROWS, GRID = 20_000, 1024, 8192, 256, 64
SLAB = ["pivot", "slot", "sub"]
HITS = "query_id long, vec_id long, score long"


def finite_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty and holds only finite numbers, as array<double>."""
    v = F.col(vec).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(vec).isNotNull()).where(F.size(vec) > 0).where(~bad).withColumn(vec, v)


def fitted_pivots(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of k-means over points."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        for j in range(k):
            if (near == j).any():
                centres[j] = points[near == j].mean(0)
    return centres


def stacked(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every sum stays below 2^53, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    return (q @ v.T).astype(np.int64) if top < 2**53 else q.astype(np.int64) @ v.astype(np.int64).T


def best(ids: np.ndarray, sc: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -sc))[:k]


def slotted(rows: DataFrame, keys: list[str], value: str, most: int, *ids: str) -> DataFrame:
    """rows with slot and sub: the rows of equal keys cut into stretches of `value` of about `most` rows.

    Slots are cut by GRID quantiles; a slot that holds more, as many rows may have one value, is dealt over subs by hash.
    """
    quantiles = F.percentile_approx(value, [i / GRID for i in range(1, GRID)], F.lit(1000)).alias("q")
    cuts = rows.groupBy(*keys).agg(F.least(F.ceil(F.count("*") / most), F.lit(GRID)).cast("int").alias("wanted"), quantiles)
    below = F.size(F.filter("q", lambda x: x < F.col(value)))
    cut = rows.join(cuts, keys).withColumn("slot", F.floor(below * F.col("wanted") / GRID).cast("int")).drop("wanted", "q")
    subs = cut.groupBy(*keys, "slot").agg(F.ceil(F.count("*") / most).cast("int").alias("subs"))
    return cut.join(subs, [*keys, "slot"]).withColumn("sub", F.pmod(F.xxhash64(*ids), F.col("subs")).cast("int")).drop("subs")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors(vec_id, embedding) for each row with vec_id % every = 0.

    Components become floor(scale * x). Inner products become distances by one more coordinate, sqrt(M^2 - |v|^2) with M
    the largest norm, which is 0 in queries. Every vector is kept under its nearest pivot, in order of its distance to
    it, in slabs that each hold a stretch of distances. A first pass over the slabs of a query's own pivot gives its k-th
    distance so far; from it and the slabs' least and greatest distances, blocks of queries that lie near each other are
    sent only to slabs that can hold a better row. There the annulus around the query's pivot distance is expanded outward
    and stops where | d(q,p) - d(v,p) | exceeds the k-th distance (the triangle inequality), so no better row is missed.
    Pivots are fitted on at most FIT_ROWS rows and all rows are indexed. Vectors that are null, empty or hold null or non-finite components
    take no part; shorter vectors count as padded with zeros; rows with a null vec_id are neither. Equal scores go to the
    smaller vec_id; a repeated vec_id is a candidate of its own, and a row is left out only from queries of its own id.
    """
    rows = finite_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null"))
    ints = stored(rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v")), "topk-rows")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stat = ints.agg(F.count("*").alias("n"), F.max(norm2).alias("m2"), F.max(F.size("v")).alias("dim")).first()
    spark = vectors.sparkSession
    if not stat.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, m2, dim = int(stat.n), float(stat.m2), int(stat.dim)
    pivots_wanted = int(min(MAX_PIVOTS, max(4, n**0.5 / 4)))
    sample = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()
    flat = stacked(sample["v"], dim)
    pivots = fitted_pivots(np.hstack((flat, np.sqrt(np.maximum(0, m2 - (flat**2).sum(1)))[:, None])), pivots_wanted)
    slack = 1e-6 * (1 + m2**0.5)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = stacked(f["v"], dim)
            x = np.hstack((v, np.sqrt(np.maximum(0, m2 - (v**2).sum(1)))[:, None]))
            d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T))
            near = d.argmin(1)
            yield pd.DataFrame({"vec_id": f["vec_id"], "pivot": near, "dist": d[np.arange(len(f)), near], "v": f["v"]})

    keyed_rows = stored(ints.mapInPandas(keyed, "vec_id long, pivot int, dist double, v array<double>"), "topk-keyed")
    def pack_slab(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["dist", "vec_id"])
        at = {c: int(f[c].iloc[0]) for c in SLAB}
        return pd.DataFrame([{**at, "least": f["dist"].iloc[0], "most": f["dist"].iloc[-1], "ids": f["vec_id"].to_numpy(np.int64).tobytes(), "dists": f["dist"].to_numpy(float).tobytes(), "vs": stacked(f["v"], dim).tobytes()}])

    cut = slotted(keyed_rows, ["pivot"], "dist", slab_rows, "vec_id", "dist")
    slabs = stored(cut.groupBy(*SLAB).applyInPandas(pack_slab, "pivot int, slot int, sub int, least double, most double, ids binary, dists binary, vs binary"), "topk-slabs")
    reaches = slabs.groupBy("pivot").agg(F.min("least").alias("least"), F.max("most").alias("most")).toPandas()  # at most MAX_PIVOTS rows
    asked = keyed_rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.col("pivot").alias("home"), F.lit(None).cast("double").alias("kth")).dropDuplicates(["vec_id", "v"])
    # Rows that repeat a query's id with another vector ask for themselves as well, under the same id.

    def pack_queries(f: pd.DataFrame) -> pd.DataFrame:
        """A block, and the distances from each pivot at which its queries can still find better rows."""
        v, kth = stacked(f["v"], dim), f["kth"].to_numpy(float)
        d = np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * v @ pivots[:, :dim].T))
        reach = np.where(np.isnan(kth), np.inf, kth)[:, None] + slack
        low, high = (d - reach).min(0), (d + reach).max(0)
        at = [(p, max(low[p], 0.0), min(high[p], most)) for p, least, most in reaches.itertuples(index=False) if low[p] <= most and high[p] >= least]
        return pd.DataFrame([{"block": f"{f['home'].iloc[0]}-{f['part'].iloc[0]}", "home": int(f["home"].iloc[0]), "qids": f["vec_id"].to_numpy(np.int64).tobytes(), "kth": kth.tobytes(), "qs": v.tobytes(), "pivots": [int(p) for p, _, _ in at], "low": [x for _, x, _ in at], "high": [x for _, _, x in at]}])

    def in_blocks(queries: DataFrame) -> DataFrame:
        """Blocks of queries with one home, which lie at like distances from the pivots."""
        sizes = queries.groupBy("home").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))  # at most MAX_PIVOTS rows
        dealt = queries.join(F.broadcast(sizes), "home").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        return dealt.groupBy("home", "part").applyInPandas(pack_queries, "block string, home int, qids binary, kth binary, qs binary, pivots array<int>, low array<double>, high array<double>")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ids, dists = np.frombuffer(r.ids, np.int64), np.frombuffer(r.dists, float)
                vs = np.frombuffer(r.vs, float).reshape(len(ids), dim)
                qids = np.frombuffer(r.qids, np.int64)
                qs, kth = np.frombuffer(r.qs, float).reshape(len(qids), dim), np.frombuffer(r.kth, float)
                p = pivots[r.pivot]
                q2 = (qs**2).sum(1)
                dq = np.sqrt(np.maximum(0, q2 + (p**2).sum() - 2 * qs @ p[:dim]))
                got_q, got_v, got_s = [], [], []
                for i in range(len(qids)):
                    at = int(np.searchsorted(dists, dq[i]))
                    lo = hi = at
                    reach = kth[i] if kth[i] == kth[i] else np.inf
                    have_ids, have_sc = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    step = 64
                    while True:
                        a, b = max(0, lo - step), min(len(ids), hi + step)
                        if reach < np.inf:
                            a = max(a, int(np.searchsorted(dists, dq[i] - reach - slack)))
                            b = min(b, int(np.searchsorted(dists, dq[i] + reach + slack, side="right")))
                        span = np.r_[a:lo, hi:b] if a < lo or hi < b else None
                        if span is None or not len(span):
                            break
                        sc = scores(qs[i : i + 1], vs[span])[0]
                        own = ids[span] != qids[i]
                        have_ids, have_sc = np.concatenate((have_ids, ids[span][own])), np.concatenate((have_sc, sc[own]))
                        keep = best(have_ids, have_sc, k)
                        have_ids, have_sc = have_ids[keep], have_sc[keep]
                        if len(have_sc) == k:
                            reach = min(reach, float(np.sqrt(max(0.0, q2[i] + m2 - 2.0 * have_sc[-1]))))
                        lo, hi = min(lo, a), max(hi, b)
                        step *= 4
                    got_q.append(np.full(len(have_ids), qids[i]))
                    got_v.append(have_ids)
                    got_s.append(have_sc)
                yield pd.DataFrame({"query_id": np.concatenate(got_q), "vec_id": np.concatenate(got_v), "score": np.concatenate(got_s)})

    near = in_blocks(asked).drop("pivots", "low", "high").join(slabs, F.col("home") == F.col("pivot")).mapInPandas(search, HITS)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("r", F.row_number().over(by_query)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("s"))
    q2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bounded = stored(asked.drop("kth").join(kth, "vec_id", "left").withColumn("kth", F.when(F.col("s").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), q2 + F.lit(m2) - 2 * F.col("s"))))).drop("s"), "topk-queries")
    blocks = stored(in_blocks(bounded), "topk-blocks", bounded)
    wanted = blocks.select("block", F.explode(F.arrays_zip("pivots", "low", "high")).alias("w")).select("block", F.col("w.pivots").alias("pivot"), "w.low", "w.high")
    pairs = wanted.join(slabs.select(*SLAB, "least", "most"), "pivot").where("least <= high and most >= low").select("block", *SLAB)
    hits = pairs.join(slabs, SLAB).join(blocks.drop("pivots", "low", "high"), "block").mapInPandas(search, HITS)
    best_hits = hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    return stored(best_hits, "topk-rows", ints, keyed_rows, slabs, blocks)
