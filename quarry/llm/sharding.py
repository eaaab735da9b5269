"""Minimax contiguous sharding of atomic groups.

Groups of equal texts are ordered by a hash of the text, prefix sums turn them into segments of a byte axis, and the
smallest shard capacity for which a greedy left-to-right filling needs no more than the given number of shards is found
by binary search. The driver only ever holds a bounded summary: group boundaries at a fixed number of cells, then the
single groups of the few cells in which a cut can fall.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import repeated, stored

#: Hash ranges whose totals give the global prefix sums; cells of the first summary; groups fetched at once.
BUCKETS, CELLS, FETCH = 4096, 1 << 16, 1 << 17
#: Pieces into which the rows of one text are dealt, so that no task holds all copies of a text.
PIECES = 256


def greedy(bounds: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards when each takes as much as fits; None if shards do not suffice. bounds: ends of the units."""
    ends, at, last = [], 0, bounds[-1] if bounds else 0
    while at < last:
        if len(ends) == shards:
            return None
        i = bisect_right(bounds, at + capacity) - 1
        if i < 0 or bounds[i] <= at:
            return None
        at = bounds[i]
        ends.append(at)
    return ends


def smallest_capacity(bounds: list[int], shards: int, low: int, high: int) -> int:
    """Smallest feasible capacity in [low, high]; high is feasible."""
    while low < high:
        mid = (low + high) // 2
        if greedy(bounds, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int, cells: int = CELLS, fetch: int = FETCH) -> list[int]:
    """Ends of the shards on the axis of groups(start long, size long), which tile [0, total) without gaps."""
    top = groups.agg(F.max(F.col("start") + F.col("size")).alias("total"), F.max("size").alias("most")).first()
    total, most = int(top.total or 0), int(top.most or 0)
    if not total:
        return []
    # A unit is a cell's small groups together, or one group larger than a cell; fine windows are refined below.
    width, windows, known = max(1, -(-total // cells)), [(0, total)], [total]
    low, high = max(-(-total // shards), most), total
    while True:
        inside = " or ".join(f"(start >= {a} and start < {b})" for a, b in windows)
        unit = groups.where(inside).groupBy(F.expr(f"start div {width}"), F.expr(f"size > {width}")).agg(F.max(F.col("start") + F.col("size")).alias("end"), F.count("*").alias("n")).collect()
        known = sorted({*known, *(int(r.end) for r in unit)})
        high = smallest_capacity(known, shards, low, high)
        if all(r.n == 1 for r in unit) or width == 1:
            return greedy(known, high, shards)
        slack = 2 * width
        low = max(low, high - slack)
        last = greedy(known, high + slack, shards)
        # The cuts of any capacity still possible lie between those of the two ends; where low fails, up to k * capacity.
        ends = []
        at = 0
        for k in range(shards):
            i = bisect_right(known, at + low) - 1
            at = known[i] if i >= 0 and known[i] > at else at
            ends.append((max(0, at - slack), (last[k] if last and k < len(last) else total) + slack))
        windows = []
        for a, b in sorted(ends):
            if windows and a <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(b, windows[-1][1]))
            else:
                windows.append((a, b))
        span = sum(b - a for a, b in windows)
        width = max(1, min(width // 2, -(-span // fetch)))


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deal all rows of docs(doc_id, text) into shards of near-equal bytes, copies of a text together.

    A row's size is its UTF-8 bytes plus 1; a null text has size 1, and null texts form one group, apart from empty
    texts. No shard is larger than the smallest capacity for which contiguous groups fit, so a shard is near the mean
    unless a single group is larger than that. slot numbers the rows of a shard from 0 by text hash and doc_id (nulls
    first; equal rows in any order, as they are counted first and dealt out last). The texts are read once. Fewer texts than shards leave shards empty; an empty table gives no rows. Only
    doc_id and text are read, so other columns may have any names.
    """
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")).alias("h"),
    ).withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).cast("int"))
    equal = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "rows")
    pieces = equal.groupBy("h", "piece").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(BUCKETS)).cast("int"))
    totals = pieces.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("bytes").alias("bb"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bb").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("bucket").orderBy("h", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.join(offsets, "bucket").select(
        "h", "piece", "n", "bytes",
        (F.col("n0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("rank0"),
        (F.col("b0") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))).alias("byte0"),
    )
    groups = placed.groupBy("h").agg(F.min("byte0").alias("start"), F.sum("bytes").alias("size"), F.min("rank0").alias("first"))
    groups = stored(groups, "groups")
    cuts = minimax_cuts(groups, shards)
    starts = [0, *cuts[:-1]]
    firsts = {int(r.start): int(r["first"]) for r in groups.where(F.col("start").isin(starts)).select("start", "first").collect()}
    ranks = [firsts.get(s, 0) for s in starts]
    shard = F.lit(0)
    for k, s in enumerate(starts):
        shard = F.when(F.col("byte0") >= s, F.lit(k)).otherwise(shard)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in ranks]), F.col("shard") + 1)
    first = F.coalesce(F.sum("n").over(Window.partitionBy("h", "piece").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = (
        equal.withColumn("i", first)
        .join(placed.select("h", "piece", "rank0", "byte0"), ["h", "piece"])
        .withColumn("shard", shard)
        .select("doc_id", "size", "text_crc32", "shard", (F.col("rank0") + F.col("i") - base).alias("at"), "n")
    )
    return repeated(numbered, "n", "copy").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("at") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
