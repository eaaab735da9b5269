"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD_PATTERN, repeated, stored

#: Units in one node of the reduction tree; pieces into which the rows of a source are dealt for lookups.
FAN_IN, SALTS = 128, 64
UNIT = "struct<row:struct<doc_id:bigint,h:bigint,size:bigint>,source:string,cls:int,p:double>"


def uniform(*parts: Column | str) -> Column:
    """A repeatable number in [0, 1) from the values of parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def capped_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: share of all sizes dealt by weight, each target at most `most` times its source.

    Weights repeat over the sources by code point, null last. Dealing the excess again by weight until no target is
    above its limit ends where every source takes min(limit, level * weight); the level comes from running sums over
    the sources by limit / weight. One row per source: the windows see the source table, never the documents.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    rated = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = rated.select(
        "source", "source_size", "w", "cap",
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("spent"),
        F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("w_left"),
    )
    full = level.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("all") - F.col("spent")))
    rest = full.withColumn("spent_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))).withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w"))).over(every))
    share_of = F.col("w") * (F.col("all") - F.col("spent_full")) / F.col("w_open")
    return rest.select("source", F.col("source_size").cast("long"), F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share_of)).alias("target"))


def folded(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Pivotal rounding inside each node: done (unit, copy 0 or 1) and the one unit left with a fraction (or null).

    Two units with fractions a and b become one decided unit and one with the rest: below a sum of 1 one of them
    gives all its mass to the other, from 1 on one of them is taken and the other keeps the sum less 1. The coin is a
    hash of the two rows, so that reruns and retried tasks agree.
    """
    nodes = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("cls"), F.col("row.size").alias("size"), F.col("row.h").alias("h"), F.col("unit")))).alias("us"))
    none = f"cast(null as {UNIT})"
    start = f"named_struct('carry', {none}, 'done', cast(array() as array<struct<unit:{UNIT},copy:int>>))"
    coin = f"pmod(xxhash64({seed}L, acc.carry.row.h, acc.carry.row.doc_id, u.unit.row.h, u.unit.row.doc_id), 4503599627370496) / 4503599627370496D"
    moved = "named_struct('row', {0}.row, 'source', {0}.source, 'cls', {0}.cls, 'p', {1})"
    s = "(acc.carry.p + u.unit.p)"
    put = "named_struct('carry', {carry}, 'done', concat(acc.done, array(named_struct('unit', {unit}, 'copy', {copy}))))"
    a, b = "acc.carry", "u.unit"
    step = (
        f"case when acc.carry is null then named_struct('carry', u.unit, 'done', acc.done) "
        f"when {s} < 1 then if({coin} * {s} < acc.carry.p, {put.format(carry=moved.format(a, s), unit=b, copy=0)}, {put.format(carry=moved.format(b, s), unit=a, copy=0)}) "
        f"else if({coin} * (2 - {s}) < 1 - u.unit.p, {put.format(carry=moved.format(b, s + ' - 1'), unit=a, copy=1)}, {put.format(carry=moved.format(a, s + ' - 1'), unit=b, copy=1)}) end"
    )
    return nodes.select(*keys, F.expr(f"aggregate(us, {start}, (acc, u) -> {step})").alias("f")).select(*keys, "f.done", "f.carry")


def rounded(units: DataFrame, seed: int = 9) -> DataFrame:
    """row, source, copy: units(row, source, p) with fractions p decided so that each source's sum stays within 1 of its mass.

    A tree of nodes of about FAN_IN units: units of similar size meet first, a node hands on at most one unit, and the
    last unit of a source is decided by a coin. Every level is one shuffle of what the level below left.
    """
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    counts = stored(counts, "mix-counts")
    top = counts.agg(F.max("n").alias("n")).first().n or 0
    nodes = counts.select("source", F.ceil(F.col("n") / FAN_IN).cast("int").alias("nodes"))
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    level = (
        units.withColumn("salt", F.pmod(F.col("row.h"), F.lit(SALTS)).cast("int")).alias("u")
        .join(salted.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")) & (F.col("u.salt") == F.col("s.salt")))
        .select("u.row", "u.source", "u.cls", F.struct("u.row", "u.source", "u.cls", "u.p").alias("unit"), F.pmod(F.xxhash64(F.lit(seed), "u.row.h", "u.row.doc_id"), F.col("s.nodes")).cast("int").alias("node"))
    )
    out, depth, left = None, 0, top
    while True:
        step = stored(folded(level, ["source", "node"], seed + depth), f"mix-{depth}")
        done = step.select(F.explode("done").alias("d")).select("d.unit.row", "d.unit.source", F.col("d.copy").alias("copy"))
        out = done if out is None else out.unionByName(done)
        carry = step.where("carry is not null").select("source", "node", "carry")
        left = -(-left // FAN_IN)
        depth += 1
        if left <= 1:
            last = carry.select("carry.row", "carry.source", (uniform(F.lit(seed), F.col("carry.row.h"), F.col("carry.row.doc_id")) < F.col("carry.p")).cast("int").alias("copy"))
            return out.unionByName(last)
        level = carry.select("carry.row", "source", "carry.cls", F.col("carry").alias("unit"), F.expr(f"node div {FAN_IN}").cast("int").alias("node"))


def decided(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """doc_id, h, size, source_size, target, rows, whole, extra for each kind of equal rows of docs(doc_id, text, source).

    A source's rows want target / source_size copies each. All `rows` of a kind get the whole part, and `extra` of them one
    more: equal rows pass their fractions on to each other until one fraction is left, and `rounded` decides that one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.col("source").cast("string").alias("source"))
    kinds = stored(rows.groupBy("doc_id", "h", "size", "source").agg(F.count("*").alias("rows")), "mix-sizes")
    sizes = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = stored(capped_targets(sizes, weights, share, most), "mix-targets")
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wanted = (
        kinds.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int")).alias("r")
        .join(salted.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.salt") == F.col("t.salt")))
        .select("r.doc_id", "r.h", "r.size", "r.source", "r.rows", "t.source_size", "t.target", F.coalesce(F.col("t.target") / F.nullif(F.col("t.source_size"), F.lit(0)), F.lit(0.0)).alias("want"))
        .withColumn("whole", F.floor("want").cast("int"))
        .withColumn("mass", F.col("rows") * (F.col("want") - F.col("whole")))
        .withColumn("sure", F.floor("mass"))
    )
    cls = F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    units = wanted.where("mass > sure").select(F.struct("doc_id", "h", "size").alias("row"), "source", cls.alias("cls"), (F.col("mass") - F.col("sure")).alias("p"))
    coins = rounded(units, seed)
    k = lambda side, row: F.struct(F.col(f"{row}.doc_id").alias("doc_id"), F.col(f"{row}.h").alias("h"), F.col(f"{side}.source").alias("source"))
    met = wanted.alias("w").join(coins.alias("c"), k("w", "w").eqNullSafe(k("c", "c.row")), "left")
    return met.select("w.doc_id", "w.h", "w.size", "w.source", "w.source_size", "w.target", "w.rows", "w.whole", (F.col("w.sure") + F.coalesce("c.copy", F.lit(0))).cast("long").alias("extra"))


def mixed_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """doc_id, h, size, source_size, target, copies, taken for every row of docs(doc_id, text, source).

    size: words of the text (null: 0). A source's rows want target / source_size copies each; the whole part is given
    to all of them and the fraction is rounded, so a row gets 0 to `most` copies and the words taken come near the target.
    A null source is one source of its own, last in order; a source without words has target 0. h identifies the text;
    of equal rows some get one copy more than others. Reruns agree. Empty tables give no rows.
    """
    kinds = decided(docs, weights, share, most, seed)
    times = F.explode(F.array(F.struct((F.col("whole") + 1).alias("copies"), F.col("extra").alias("times")), F.struct(F.col("whole").alias("copies"), (F.col("rows") - F.col("extra")).alias("times"))))
    rows = repeated(kinds.select("doc_id", "h", "size", "source_size", "target", times.alias("x")).select("doc_id", "h", "size", "source_size", "target", "x.copies", "x.times"), "times")
    return rows.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows taken 0 times go, all columns stay.

    Equal rows, which may differ in other columns, are numbered by the partition of docs they come from, so that no task
    has to see all of them; docs has to be a table that is read alike each time.
    """
    kinds = decided(docs, weights, share, most, seed).select(F.struct("doc_id", "h", "source").alias("k"), "rows", "whole", "extra")
    names = docs.columns
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("source").cast("string").alias("source"))
    placed = docs.select(key.alias("k"), F.spark_partition_id().alias("part"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    met = placed.alias("l").join(kinds.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k"))).select("l.k", "l.part", "l.row", "r.rows", "r.whole", "r.extra")
    alone = met.where("rows = 1").select("row", (F.col("whole") + F.col("extra")).alias("copies"))
    ahead = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("k", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    several = met.where("rows > 1").withColumn("i", F.row_number().over(Window.partitionBy("k", "part").orderBy(F.lit(0)))).alias("l")
    several = several.join(starts.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")) & (F.col("l.part") == F.col("r.part")))
    several = several.select("l.row", (F.col("l.whole") + (F.col("r.start") + F.col("l.i") <= F.col("l.extra")).cast("int")).alias("copies"))
    out = alone.unionByName(several).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("again"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
