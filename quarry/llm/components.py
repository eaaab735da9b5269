"""Connected components of a link table, by forests in each partition and rounds of least-label exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the links a-b, roots left out."""
    nodes, idx = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = 0
    for batch in batches:
        a = np.concatenate((a, batch.column(0).to_numpy()))
        b = np.concatenate((b, batch.column(1).to_numpy()))
        held += batch.num_rows
        if held > 1 << 20:  # what is kept never exceeds the nodes seen
            a, b = forest(a, b)
            held = 0
    if len(a):
        a, b = forest(a, b)
        for i in range(0, len(a), 1 << 16):
            yield pa.record_batch([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its least reachable node) for every node of links(a long, b long) that has a link to another.

    Each partition first shrinks its links to a forest. Then every node takes the least label among its neighbours and
    labels jump to their labels' labels, until nothing changes; each round is written to the shared folder.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = stored(edges.mapInArrow(_local_forest, "a long, b long").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node")
    labels = last = stored(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").groupBy("a").agg(F.min("other").alias("low"))
        met = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "low").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        new = stored(met.join(hop, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("component"), (F.least("low", F.coalesce("jump", "low")) < F.col("component")).alias("moved")), "labels")
        discard(last)
        labels, last = new.select("node", "component"), new
        if not new.where("moved").limit(1).count():
            discard(edges)
            return labels
