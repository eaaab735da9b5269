"""Conflict-constrained best-fit packing of documents into fixed-size bins."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD_PATTERN, repeated, stored

#: Rows that one cell packs by itself, on average: enough for tight bins, little enough for one task's memory.
CELL_ROWS = 8192
PACKED = "cell long, doc_id long, piece int, size long, source string, cluster long, text_hash long, bin long"


def best_fit(rows: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each (size, source bit, cluster bit) in order; bits are numbers below the cell's distinct values, -1 for none.

    Open bins are kept in order of what is left. A row takes the first bin from its size on whose bitmaps hold neither
    its source nor its cluster: the successor search goes on until the tightest compatible bin. No bin is closed early.
    """
    left: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in rows:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        i = bisect_left(left, (size, -1))
        while i < len(left) and (sources[left[i][1]] & s or clusters[left[i][1]] & c):
            i += 1
        if i < len(left):
            room, b = left.pop(i)
            sources[b] |= s
            clusters[b] |= c
            room -= size
        else:
            b, room = len(sources), capacity - size
            sources.append(s)
            clusters.append(c)
        if room > 0:
            insort(left, (room, b))
        out.append(b)
    return out


def packed_bins(docs: DataFrame, capacity: int = 2048, cell_rows: int = CELL_ROWS) -> DataFrame:
    """cell, bin, doc_id, piece, size, source, cluster: every word of docs(doc_id, text, source) in exactly one bin.

    size counts words. A text longer than the capacity is cut into pieces of capacity words and a rest (piece 0, 1, ...);
    full pieces fill bins of their own. A bin holds at most one row of a source and one of a duplicate cluster, which is
    the texts equal after lower-casing A-Z and joining words by one space. Null sources conflict with nothing; null and
    empty texts have size 0, are one cluster and fill no room. Rows are dealt into cells by hash, so that a hot source or
    cluster is spread over all cells, and equal rows are counted first and dealt one by one; a cell packs its rows by
    itself, largest first, ties by doc_id. Repeated rows are packed once each. Empty tables give no rows.
    """
    words = F.regexp_count("text", F.lit(WORD_PATTERN))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(words, F.lit(0)).cast("long").alias("words"), F.col("source").cast("string").alias("source"), cluster_of("text").alias("cluster"))
    return _packed(rows.withColumn("text_hash", F.lit(0).cast("long")), docs.select("doc_id").count(), capacity, cell_rows).drop("text_hash")


def packed_texts(docs: DataFrame, capacity: int = 2048, cell_rows: int = CELL_ROWS) -> DataFrame:
    """packed_bins with the text of each piece: the pieces of a row, in order, are its text (empty for a null one)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("words", F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long"))
    packed = _packed(rows.select("doc_id", "words", "source", cluster_of("text").alias("cluster"), "text_hash"), docs.select("doc_id").count(), capacity, cell_rows)
    # A word with the white space before it; what follows the last word goes to the last piece.
    parts = F.regexp_extract_all("text", F.lit(f"((?:[\\x20\\x09-\\x0D]*){WORD_PATTERN})"), F.lit(1))
    texts = rows.select("doc_id", "text", "text_hash", "words").distinct().withColumn("last", F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("int"))
    one = lambda i: F.concat(F.array_join(F.slice("parts", i * capacity + 1, F.lit(capacity)), ""), F.when(i == F.col("last"), F.regexp_extract("text", "([\\x20\\x09-\\x0D]*)\\z", 1)).otherwise(""))
    cut = texts.withColumn("parts", parts).select("doc_id", "text_hash", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("last")), one)).alias("piece", "text"))
    k = ["doc_id", "text_hash", "piece"]
    return packed.alias("p").join(cut.alias("t"), F.struct(*[F.col(f"p.{c}") for c in k]).eqNullSafe(F.struct(*[F.col(f"t.{c}") for c in k]))).select("p.*", "t.text").drop("text_hash")


def cluster_of(text: str) -> Column:
    norm = F.array_join(F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORD_PATTERN})"), F.lit(1)), " ")
    return F.xxhash64(F.coalesce(norm, F.lit("")))


def _packed(rows: DataFrame, n: int, capacity: int, cell_rows: int) -> DataFrame:
    cells = max(1, -(-n // cell_rows))
    # Equal rows are one with a number; each of them has a cell of its own, its number in the hash.
    same = stored(rows.groupBy("doc_id", "words", "source", "cluster", "text_hash").agg(F.count("*").alias("rows")), "pack-rows")
    numbered = repeated(same, "rows", "copy")
    sizes = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("int")), lambda i: F.least(F.col("words") - i * capacity, F.lit(capacity).cast("long")))
    pieces = numbered.select("doc_id", "source", "cluster", "text_hash", "copy", F.posexplode(sizes).alias("piece", "size"))
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "cluster", "piece", "copy"), F.lit(cells)).cast("long")).drop("copy")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        source, _ = pd.factorize(g["source"])
        cluster, _ = pd.factorize(g["cluster"])
        g["bin"] = best_fit(list(zip(g["size"].tolist(), source.tolist(), cluster.tolist(), strict=True)), capacity)
        return g[["cell", "doc_id", "piece", "size", "source", "cluster", "text_hash", "bin"]]

    return pieces.groupBy("cell").applyInPandas(pack, PACKED)


def bins(packed: DataFrame) -> DataFrame:
    """One row per bin: its words and its documents in order."""
    return packed.groupBy("cell", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
