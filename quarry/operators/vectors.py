"""A stored index of vectors: cells around centroids, searched exactly through bounds on angles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import top

#: Rows that centroids are fitted on at most, cells at most, rounds of fitting; vectors in a block of a cell, and queries in one.
FIT_ROWS, MOST_CELLS, FIT_ROUNDS, CELL_BLOCK, QUERY_BLOCK = 20_000, 1024, 8, 2048, 512
#: Numbers of the vectors that leave a task together when queries are sent to cells, and that a task holds while it packs blocks, about.
SENT, HELD = 1 << 20, 1 << 25
#: Angle by which bounds are taken too wide, against rounding.
SLACK = 1e-6
BLOCK_ROWS = "cell int, keys array<{kind}>, dim int, data binary, radius double"


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """k, v, dim: the vectors at unit length; those that are null, zero or hold nulls or numbers that are not finite go."""
    v = F.col(vector).cast("array<double>")
    whole = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), v.alias("v")).where(~F.exists("v", lambda x: x.isNull() | x.isin(float("inf"), float("-inf")) | F.isnan(x)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sized = whole.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return sized.select("k", F.transform("v", lambda x: x / F.col("norm")).alias("v"), F.size("v").alias("dim"))


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of the sample: rows spread over it to begin with, then the directions of their nearest rows' sums."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        nearest = np.concatenate([(sample[i : i + 2048] @ centroids.T).argmax(1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


@dataclass
class VectorIndex:
    """An index below `path`: blocks of vectors by cell, and the cells.

    centroids are of the most frequent length of a vector; vectors of other lengths are in cell -1, which every query of
    such a length meets. cells: for each its number of vectors and the greatest angle to its centroid.
    """

    spark: SparkSession
    path: str
    kind: str
    dim: int
    centroids: np.ndarray
    cells: pd.DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> VectorIndex:
        """Fit centroids on at most FIT_ROWS vectors, chosen by a hash of the key, and write every vector to its cell.

        Each task writes the blocks of its own rows; nothing is shuffled but the sample, and no task holds a cell.
        """
        spark, kind = vectors.sparkSession, dict(vectors.dtypes)[key]
        unit_vectors(vectors, key, vector).write.mode("overwrite").parquet(f"{path}/vectors")
        unit = spark.read.parquet(f"{path}/vectors")
        sizes = unit.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        dim, n = (sizes.dim, sizes.n) if sizes else (0, 0)
        share = unit.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("k"), F.lit(max(1, n // (2 * FIT_ROWS)))) == 0))
        sample = [r.v for r in share.orderBy(F.xxhash64("k", F.lit(1)), "k").limit(FIT_ROWS).select("v").collect()]
        centroids = fitted(np.array(sample), min(MOST_CELLS, max(1, isqrt(n) // 2), len(sample))) if sample else np.zeros((0, dim))

        def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], tuple[list, list]] = {}
            numbers = 0

            def block(at: tuple[int, int]) -> pd.DataFrame:
                keys, values = held.pop(at)
                data = np.stack(values)
                radius = float(angles(data, centroids[at[0]][None]).max()) if at[0] >= 0 else np.pi
                return pd.DataFrame({"cell": [at[0]], "keys": [keys], "dim": [at[1]], "data": [data.tobytes()], "radius": [radius]})

            for f in frames:
                for d, part in f.groupby("dim"):
                    values = stacked(part["v"])
                    cells = (values @ centroids.T).argmax(1) if d == dim and len(centroids) else np.full(len(values), -1)
                    for c, k, v in zip(cells.tolist(), part["k"], values, strict=True):
                        keys, rows = held.setdefault((c, int(d)), ([], []))
                        keys.append(k)
                        rows.append(v)
                        if len(keys) == CELL_BLOCK:
                            yield block((c, int(d)))
                            numbers -= CELL_BLOCK * int(d)
                    numbers += values.size
                    if numbers > HELD:
                        for at in list(held):
                            yield block(at)
                        numbers = 0
            for at in list(held):
                yield block(at)

        unit.select("k", "v", "dim").mapInPandas(packed, BLOCK_ROWS.format(kind=kind)).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
        spark.createDataFrame([(dim, c.tolist()) for c in centroids], "dim int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        """An index that was built before."""
        rows = spark.read.parquet(f"{path}/centroids").collect()  # MOST_CELLS at most
        kind = dict(spark.read.parquet(f"{path}/vectors").dtypes)["k"]
        blocks = cls(spark, path, kind, 0, np.zeros((0, 0)), pd.DataFrame()).blocks()
        cells = blocks.groupBy("cell").agg(F.sum(F.size("keys")).cast("long").alias("n"), F.max("radius").alias("radius")).toPandas()
        return cls(spark, path, kind, rows[0].dim if rows else 0, np.array([r.centroid for r in rows]), cells.set_index("cell").sort_index())

    def blocks(self) -> DataFrame:
        schema = BLOCK_ROWS.format(kind=self.kind).removeprefix("cell int, ")
        return self.spark.read.schema(f"{schema}, cell int").parquet(f"{self.path}/blocks")

    def routed(self, queries: DataFrame, k: int, floors: bool) -> DataFrame:
        """q, v, dim, cell: the cells that each query has to meet.

        queries(k, v, dim), or with the least similarity of k vectors already found (floor) and the cells met (near). First
        those nearest to it that hold k vectors together; then, with floors, all others that can hold one as similar: no
        vector of a cell is nearer to a query than the angle to its centroid less the cell's radius.
        """
        centroids, cells, home = self.centroids, self.cells, self.dim
        numbers = cells.index.to_numpy()
        own = numbers[numbers >= 0]
        sizes, radii = cells.loc[own, "n"].to_numpy(), cells.loc[own, "radius"].to_numpy()

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for d, group in f.groupby("dim"):
                    for at in range(0, len(group), QUERY_BLOCK):
                        part = group.iloc[at : at + QUERY_BLOCK]
                        if d != home or not len(own):
                            pairs = np.array([(i, -1) for i in range(len(part))] if not floors and -1 in numbers else [], int).reshape(-1, 2)
                        else:
                            to = angles(stacked(part["v"]), centroids[own])
                            order = np.argsort(to, axis=1, kind="stable")
                            first = np.cumsum(sizes[order], axis=1) - sizes[order] < k
                            near = np.zeros_like(first)
                            np.put_along_axis(near, order, first, axis=1)
                            if floors:
                                bound = np.cos(np.maximum(0.0, to - radii - SLACK))
                                near = ~near & (bound >= part["floor"].to_numpy()[:, None] - SLACK)
                            pairs = np.argwhere(near)
                            pairs[:, 1] = own[pairs[:, 1]]
                        # A query's vector goes to each of its cells, so a batch of queries can be a thousand times itself.
                        step = max(1, SENT // max(1, int(d)))
                        for some in (pairs[i : i + step] for i in range(0, len(pairs), step)):
                            rows = part.iloc[some[:, 0]]
                            yield pd.DataFrame({"q": rows["k"].to_numpy(), "v": rows["v"].to_numpy(), "dim": d, "cell": some[:, 1]})

        return queries.mapInPandas(route, f"q {dict(queries.dtypes)['k']}, v array<double>, dim int, cell int")

    def met(self, routed: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
        """query_key, key, similarity: the k best of each query and block of its cells. Only folders of asked cells are read."""
        asked = [r.cell for r in routed.select("cell").distinct().collect()]  # MOST_CELLS + 1 at most
        q_kind = dict(routed.dtypes)["q"]

        def grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for (c, d), part in f.groupby(["cell", "dim"]):
                    for at in range(0, len(part), QUERY_BLOCK):
                        some = part.iloc[at : at + QUERY_BLOCK]
                        yield pd.DataFrame({"cell": [c], "q_dim": [d], "q_keys": [some["q"].tolist()], "q_data": [stacked(some["v"]).tobytes()]})

        together = routed.repartition("cell", F.pmod(F.xxhash64("q"), F.lit(16))).mapInPandas(grouped, f"cell int, q_dim int, q_keys array<{q_kind}>, q_data binary")
        pairs = self.blocks().where(F.col("cell").isin(asked)).join(together, "cell").where("dim = q_dim")

        def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples():
                    keys, q_keys = np.asarray(r.keys), np.asarray(r.q_keys)
                    sims = np.round(np.frombuffer(r.q_data).reshape(-1, r.dim) @ np.frombuffer(r.data).reshape(-1, r.dim).T, 9)
                    order = np.argsort(keys, kind="stable")  # equal similarities in order of their keys
                    keys, sims = keys[order], sims[:, order]
                    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({query_key: np.repeat(q_keys, best.shape[1]), key: keys[best].ravel(), "similarity": np.take_along_axis(sims, best, 1).ravel()})

        return pairs.select("keys", "dim", "data", "q_keys", "q_data").mapInPandas(compare, f"{query_key} {q_kind}, {key} {self.kind}, similarity double")

    def nearest(self, queries: DataFrame, k: int, query_key: str = "query_id", key: str = "id", vector: str = "embedding") -> DataFrame:
        """query_key, key, similarity, rank of the k vectors of greatest cosine, as search.nearest gives them.

        The first cells of a query give k candidates; the least of these bounds which other cells have to be met. Hits of the
        first part are written, so that nothing is compared twice. A key of the queries that repeats counts as one query.
        """
        asked = unit_vectors(queries, query_key, vector).dropDuplicates(["k"])
        by, order = [query_key], [F.desc("similarity"), F.col(key)]
        first = f"{self.path}/searches/{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        top(self.met(self.routed(asked, k, False), k, query_key, key), by, order, k).drop("rank").write.parquet(first)
        found = self.spark.read.parquet(first)
        floor = found.groupBy(F.col(query_key).alias("k")).agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(-1.0).alias("floor"))
        rest = self.routed(asked.join(floor, "k", "left").fillna(-1.0, ["floor"]), k, True)
        return top(found.unionByName(self.met(rest, k, query_key, key)), by, order, k)
