"""Builders of question sets and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, c: Column | str) -> Column:
    """A repeatable random order: md5 of seed and value."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(c) if isinstance(c, str) else c).cast("binary"))


def first_valid(rows: DataFrame, valid: Column, group: str, key: str, seed: int, n: int) -> DataFrame:
    """In shuffled order one valid row of each group, then n of these."""
    order = rows.where(valid).withColumn("o", shuffle_key(seed, key))
    one = order.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy("o", key))).where("nth = 1")
    return one.orderBy("o", key).limit(n).drop("o", "nth")


def stratified(rows: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """The quota of each stratum in shuffled order. short() tells which could not be filled."""
    quota = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(stratum).orderBy(shuffle_key(seed, key), key)))
    return ranked.where(F.col("nth") <= F.coalesce(F.try_element_at(quota, F.col(stratum)), F.lit(0)))


def short(sample: DataFrame, stratum: str, quotas: dict[str, int]) -> DataFrame:
    """Strata with fewer rows than asked for; a builder stops if there are any."""
    spark = sample.sparkSession
    want = spark.createDataFrame(list(quotas.items()), f"{stratum} string, quota int")
    have = sample.groupBy(stratum).agg(F.count("*").alias("n"))
    return want.join(have, stratum, "left").where(F.coalesce("n", F.lit(0)) < F.col("quota"))


def interned(pages: DataFrame, title: str, key: str) -> DataFrame:
    """One page of each trimmed title, the first, numbered from 1 in order.

    Numbers come from counts of ranges of the key, so that no task sees all pages.
    """
    one = pages.withColumn("t", F.trim(title)).withColumn("nth", F.row_number().over(Window.partitionBy("t").orderBy(key))).where("nth = 1").drop("nth")
    cell = F.floor(F.col(key) / 4096)
    counts = one.groupBy(cell.alias("cell")).agg(F.count("*").alias("c"))
    before = counts.select("cell", F.coalesce(F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy(key))
    return one.withColumn("cell", cell).join(before, "cell").withColumn("number", F.col("base") + inside).drop("cell", "base")


def without_stubs(pages: DataFrame, body: str, gold: Column, least: int = 80) -> DataFrame:
    return pages.where((F.length(body) >= least) | gold)


def padded(docs: DataFrame, gold: Column, key: str, seed: int, target: int) -> DataFrame:
    """All gold documents and, in shuffled order, others until there are `target`."""
    keep = docs.withColumn("g", gold)
    n = keep.agg(F.count_if("g").alias("n_gold"))
    extra = keep.where("not g").orderBy(shuffle_key(seed, key), key).limit(target).withColumn("nth", F.row_number().over(Window.orderBy(shuffle_key(seed, key), key)))  # at most target rows
    return keep.where("g").drop("g").unionByName(extra.crossJoin(n).where(F.col("nth") <= F.lit(target) - F.col("n_gold")).drop("g", "nth", "n_gold"))


def alias_line(aliases: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.array_distinct(aliases), 1, n), " / ")


def hop_class(question_id: Column) -> Column:
    kind = F.substring_index(question_id, "__", 1)
    return F.when(kind.startswith("2hop"), "2hop").when(kind.startswith("3hop"), "3hop").when(kind.startswith("4hop"), "4hop").otherwise("other")
