"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, stored
from quarry.llm.components import connected_components, forest
from quarry.llm.topk import finite_vectors, slotted, stacked

#: Vectors that the centres are fitted on, at most; rows of the largest label in a cell, on average; rows of one side
#: of a block; cells, at least and at most; rows handed on at once.
FIT_ROWS, CELL_ROWS, BLOCK_ROWS, LEAST_CELLS, MAX_CELLS, SENT_ROWS = 20_000, 4096, 2048, 4, 4096, 2048
BLOCK = ["label", "cell", "slot", "sub"]
PAIR = [*BLOCK, "slot2", "sub2"]


def spherical_centres(points: np.ndarray, k: int, rounds: int = 8, seed: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                c = points[near == j].sum(0)
                centres[j] = c / max(np.linalg.norm(c), 1e-12)
    return centres


def near_duplicates(vectors: DataFrame, least: float = 0.98, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine in double precision is at least `least`.
    Equal vectors of a label are one row with a count until the end, so copies are never paired. Every distinct vector
    has a home cell (its nearest centre) and is a guest in each cell before it that a vector linked to it could call home:
    chord(x, y) <= sqrt(2 - 2 least) bounds how far the two can lie on both sides of the plane between two centres. So
    every link is seen once, in the home cell of one of its ends, and none is missed. Cells are cut into blocks by the
    angle to their centre, and blocks meet only if their angles come within arccos(least): the angles of linked vectors
    differ by no more. A pair of blocks hands on counts and a forest of its links, never its pairs. Centres are fitted on at most FIT_ROWS rows.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
    nothing: n_links 0, component_id = vec_id, kept. Shorter vectors count as padded with zeros. Rows repeating a vec_id
    are counted as rows. An empty table gives no rows.
    """
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label")), "near-rows")
    usable = finite_vectors(rows.where("label is not null and vec_id is not null")).where(F.exists("embedding", lambda x: x != 0))
    key = F.xxhash64("label", "embedding")
    distinct = stored(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("key", key), "near-distinct")
    stat = distinct.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).agg(F.max("n").alias("n"), F.max("dim").alias("dim")).first()
    own = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not stat.n:
        discard(distinct)
        return own
    n, dim = int(stat.n), int(stat.dim)
    sample = stacked(distinct.orderBy("key", "rep").limit(FIT_ROWS).toPandas()["embedding"], dim)
    sample /= np.abs(sample).max(1, keepdims=True)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centres = spherical_centres(sample, int(min(MAX_CELLS, max(LEAST_CELLS, n // CELL_ROWS))))
    chord = float(np.sqrt(2 - 2 * least)) + 1e-9
    gaps = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)
    turn = float(np.arccos(least)) + 1e-6
    numbers = np.arange(len(centres))

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = stacked(f["embedding"], dim)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            dots = x @ centres.T
            home = dots.argmax(1)
            back = dots[np.arange(len(x)), home][:, None] - dots
            # In the home cell, and as a guest in cells before it.
            i, c = np.nonzero((back <= chord * gaps[home] + 1e-9) & (numbers <= home[:, None]))
            angle = np.arccos(np.clip(dots[i, c], -1, 1))
            raw = [v.tobytes() for v in x]
            for a in range(0, len(i), SENT_ROWS):
                j, cell = i[a : a + SENT_ROWS], c[a : a + SENT_ROWS]
                yield pd.DataFrame({"rep": f["rep"].to_numpy()[j], "copies": f["copies"].to_numpy()[j], "label": f["label"].to_numpy()[j], "cell": cell, "home": cell == home[j], "angle": angle[a : a + SENT_ROWS], "x": [raw[k] for k in j]})

    kind = distinct.schema["label"].dataType.simpleString()
    placed = stored(distinct.mapInPandas(homes, f"rep long, copies long, label {kind}, cell int, home boolean, angle double, x binary"), "near-placed")
    cut = stored(slotted(placed, ["label", "cell"], "angle", block_rows, "rep"), "near-cut", placed)
    blocks = cut.groupBy(*BLOCK).agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    other = blocks.select("label", "cell", F.col("slot").alias("slot2"), F.col("sub").alias("sub2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = (F.struct("slot", "sub") <= F.struct("slot2", "sub2")) & (F.col("low2") <= F.col("high") + turn) & (F.col("low") <= F.col("high2") + turn)
    pairs = stored(blocks.join(other, ["label", "cell"]).where(near).select(*PAIR), "near-pairs")
    # A block that meets itself is sent once.
    left = cut.join(pairs, BLOCK).select(*PAIR, F.lit(True).alias("lhs"), "home", "rep", "copies", "x")
    second = cut.withColumnsRenamed({"slot": "slot2", "sub": "sub2"}).join(pairs.where("slot <> slot2 or sub <> sub2"), ["label", "cell", "slot2", "sub2"])
    right = second.select(*PAIR, F.lit(False).alias("lhs"), "home", "rep", "copies", "x")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["lhs"]], f[~f["lhs"]]
        own = not len(b)
        b = a if own else b
        close = np.frombuffer(b"".join(a["x"]), float).reshape(-1, dim) @ np.frombuffer(b"".join(b["x"]), float).reshape(-1, dim).T >= least
        ra, rb = a["rep"].to_numpy(), b["rep"].to_numpy()
        # Two guests meet in the home of one of them.
        close &= (ra[:, None] != rb[None, :]) & (a["home"].to_numpy()[:, None] | b["home"].to_numpy()[None, :])
        links = [(ra, close @ b["copies"].to_numpy())] + ([] if own else [(rb, close.T @ a["copies"].to_numpy())])
        i, j = np.nonzero(close)
        node, root = forest(ra[i], rb[j])
        counts = [(r[n > 0], n[n > 0]) for r, n in links]
        empty = lambda n: np.zeros(n, np.int64)
        return pd.DataFrame({"a": np.concatenate((node, *(r for r, _ in counts))), "b": np.concatenate((root, *(r for r, _ in counts))), "links": np.concatenate((empty(len(node)), *(n for _, n in counts)))})

    found = stored(left.unionByName(right).groupBy(*PAIR).applyInPandas(compare, "a long, b long, links long"), "near-links", cut, pairs)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    comps = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    whole = distinct.join(counts, "rep", "left").join(comps, "rep", "left").select("key", F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    whole = stored(whole, "near-classes", distinct, found)
    linked = usable.withColumn("key", key).join(whole, "key").where((F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    return stored(rows_with(rows, linked), "near-result", rows, whole)


def rows_with(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """The linked rows and, as they are, the rows that take no part."""
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0) & (F.size("embedding") > 0)
    out = rows.where(~F.coalesce(ok & whole, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(out).select("vec_id", F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
