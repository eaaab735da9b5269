"""Filter interaction audit: what each filter removes at each place of every order, from counts of failing sets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.lines import BLANKS, UPPER

# The filters, from the lowest bit of a mask; signs that filter D looks for; what stands between words.
FILTERS, SIGNS, GAPS = "ABCDE", "[#$%&*|]", "[\\x20\\x09-\\x0D]+"
MASKS, ORDERS = 1 << len(FILTERS), ["".join(x) for x in permutations(FILTERS)]
#: Counted apart in every part: all documents, those of quality 1 and toxic ones.
LABELS = ("n", "good", "toxic")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def parity(mask: Column, which: Column) -> Column:
    """1 if an even number of the filters in `which` fail, else -1."""
    return 1 - 2 * F.pmod(F.bit_count(mask.bitwiseAND(which)), F.lit(2))


def own_masks(docs: DataFrame, fewest: int, distinct_pct: int, upper_pct: int) -> DataFrame:
    """doc_id, part, t1, t2, mask of every row of docs(doc_id, text, source): bits A to D, and 128 bits of the text's hash."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.split(F.btrim(text, F.lit(BLANKS)), GAPS).alias("w"))
    none = (F.size("w") == 1) & (F.get("w", F.lit(0)) == "")
    words, distinct = F.when(none, 0).otherwise(F.size("w")).cast("long"), F.when(none, 0).otherwise(F.size(F.array_distinct("w"))).cast("long")
    upper = F.octet_length("text") - F.octet_length(F.translate("text", UPPER, ""))
    fails = {"A": words < fewest, "B": 100 * distinct < distinct_pct * words, "C": 100 * upper.cast("long") > upper_pct * F.length("text"), "D": F.col("text").rlike(SIGNS)}
    mask = sum((F.when(c, bit(x)).otherwise(0) for x, c in fails.items()), F.lit(0))
    return cut.select("doc_id", "part", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(11), "text").alias("t2"), mask.alias("mask"))


def failing_sets(docs: DataFrame, labels: DataFrame, fewest: int = 200, distinct_pct: int = 50, upper_pct: int = 2) -> DataFrame:
    """part, mask and the LABELS as counts; rows of one part and mask may be several.

    Copies share A to D, so a part's copies of a text are one row: the rows of its least doc_id, and all. E fails but for
    the rows of the least doc_id that has the text anywhere. Counts of copies are summed before they are shuffled.
    """
    rows = own_masks(docs.select("doc_id", "text", "source"), fewest, distinct_pct, upper_pct)
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    equal = rows.groupBy("doc_id", "part", "t1", "t2", "mask").agg(F.count("*").alias("n")).join(flags, "doc_id", "left")
    counts = {x: F.col("n") * (F.lit(1) if x == "n" else F.coalesce(F.col(x), F.lit(0))) for x in LABELS}
    one = equal.select("doc_id", "part", "t1", "t2", "mask", *[c.cast("long").alias(x) for x, c in counts.items()])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *LABELS))).alias("first")
    groups = stored(one.groupBy("part", "t1", "t2", "mask", F.col("doc_id").isNotNull().alias("known")).agg(first, *[F.sum(x).alias(x) for x in LABELS]), "audit-groups")
    least = groups.where("known").groupBy("t1", "t2").agg(F.min("first.doc_id").alias("least"))
    met = groups.where("known").join(least, ["t1", "t2"]).withColumn("own", F.col("first.doc_id") == F.col("least"))
    keep = {x: F.when(F.col("own"), F.col(f"first.{x}")).otherwise(0).cast("long") for x in LABELS}
    kinds = F.array(
        F.struct(F.col("mask").alias("mask"), *[keep[x].alias(x) for x in LABELS]),
        F.struct(F.col("mask").bitwiseOR(F.lit(bit("E"))).alias("mask"), *[(F.col(x) - keep[x]).alias(x) for x in LABELS]),
    )
    split = met.select("part", F.explode(kinds).alias("k")).select("part", "k.mask", *[f"k.{x}" for x in LABELS])
    return split.unionByName(groups.where("not known").select("part", "mask", *LABELS))


def parity_sums(sets: DataFrame) -> DataFrame:
    """part, label, sums: for each of the MASKS sets of filters, documents with an even number of failures in it less the others."""
    each = sets.select("part", "mask", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in LABELS])).alias("l")).select("part", "mask", "l.label", "l.n")
    signed = [F.sum(F.col("n") * parity(F.col("mask"), F.lit(w))).alias(f"s{w}") for w in range(MASKS)]
    return each.groupBy("part", "label").agg(*signed).select("part", "label", F.array(*[f"s{w}" for w in range(MASKS)]).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """part, label, cells: documents by mask, from parity_sums; the transform is its own inverse but for the factor MASKS."""
    masks = lambda: F.sequence(F.lit(0), F.lit(MASKS - 1))
    cell = lambda m: F.aggregate(masks(), F.lit(0).cast("long"), lambda s, w: s + parity(m, w) * F.get("sums", w))
    return sums.select("part", "label", F.transform(F.transform(masks(), cell), lambda c: F.shiftright(c, len(FILTERS))).alias("cells"))


def audited(by_mask: DataFrame) -> DataFrame:
    """part, filter_order, step and its counts, from cells: all orders of the filters, all steps of each."""
    parts = by_mask.groupBy("part").agg(*[F.max(F.when(F.col("label") == x, F.col("cells"))).alias(x) for x in LABELS])
    steps = parts.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda at: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", at, F.lit(1))) - ord(FILTERS[0]))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda s, i: F.when(i < F.col("step"), s + bits(i)).otherwise(s))
    placed = steps.withColumn("own", bits(F.col("step"))).withColumn("before", before)

    def total(label: str, share) -> Column:
        """Sum over all masks of their documents times share(mask)."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda s, m: s + F.get(label, m) * share(m).cast("long"))

    fails, earlier = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~earlier(m)
    return placed.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("n", F.col("own")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("n", lambda m: F.when(fails(m), F.lit(len(ORDERS)) / F.bit_count(m)).otherwise(0)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, fewest: int = 200, distinct_pct: int = 50, upper_pct: int = 2) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley over docs(doc_id, text, source).

    Filters fail texts of fewer than `fewest` words (A), with fewer than distinct_pct distinct words in 100 (B), more than
    upper_pct letters A-Z in 100 code points (C), one of SIGNS (D), or equal to the text of a smaller doc_id anywhere (E).
    A null text is an empty one, a null source the part "". A row without a doc_id has no smaller one, is smaller than none
    and has no label; rows of one doc_id do not fail E through each other. A document is good or toxic if any row of labels
    says so. In all orders a filter removes a document first in ORDERS / (number of its failing filters) of them, which
    gives shapley. Every part has a row for every order and step; empty tables give none.
    """
    return audited(cells(parity_sums(failing_sets(docs, labels, fewest, distinct_pct, upper_pct))))
