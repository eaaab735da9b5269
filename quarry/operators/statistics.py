"""Paired statistics as DataFrame plans."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed value: the 97.5 % point of the normal distribution.
Z = 1.959963985
#: The 80 % point of the normal distribution.
POWER_Z = 0.841621234
#: Distinct differences in a cell of a group's resampling, on average; cells of a group at most; rounds in a row dealt to a
#: task; counts in its memory at once.
CELL_VALUES, MOST_CELLS, ROUND_BLOCK, COUNTS_AT_ONCE = 1024, 1024, 250, 1 << 20
#: Constants of the keyed mix; distinct values of a task that draws by it, draws of a round dealt to a task, draws at once,
#: and bits of a draw that find its value at first;
#: distinct values up to which their draws are counted by comparison.
MIX_STEP, MIX_ROUND, MIX_A, MIX_B, DRAWN_VALUES, DRAWN_STRETCH, DRAWS_AT_ONCE, GUIDE_BITS, FEW_VALUES = 0x9E3779B9, 0x85EBCA77, 0x7FEB352D, 0x846CA68B, 1 << 18, 1 << 20, 1 << 15, 16, 24
#: Discordant pairs from which McNemar's test takes the corrected chi-square.
EXACT_PAIRS = 25


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p: min(1, 2 * sum over k <= min(b, c) of C(n, k) / 2^n), 1 if b = c.

    Each term is exp of its logarithm, built up by ratios, so that large counts do not overflow.
    """
    n, low = b + c, F.least(b, c)
    step = lambda s, k: F.struct((s["log"] + F.log((n - k + 1) / k)).alias("log"), (s["sum"] + F.exp(s["log"] + F.log((n - k + 1) / k))).alias("sum"))
    start = F.struct((-n * F.lit(math.log(2))).alias("log"), F.exp(-n * F.lit(math.log(2))).alias("sum"))
    ks = F.when(low >= 1, F.sequence(F.lit(1).cast("long"), low.cast("long"))).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(ks, start, step, lambda s: s["sum"])
    return F.when(b == c, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def mcnemar_switched(b: Column, c: Column) -> Column:
    """Exact below EXACT_PAIRS discordant pairs, from there the chi-square with continuity correction; null without any."""
    n = (b + c).cast("double")
    z = F.greatest(F.lit(0.0), F.abs(b - c) - 1) / F.nullif(F.sqrt(n), F.lit(0.0))
    return F.when(n > 0, F.when(n < EXACT_PAIRS, mcnemar(b, c)).otherwise(normal_tail(z)))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval of k in n, which may be fractional; (0, 1) without trials."""
    p, z2 = k / F.nullif(n, F.lit(0)), Z * Z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def with_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows (as l) joined to their group's row (as r); nulls of `by` are equal, and without `by` there is one group."""
    left, right = rows.alias("l"), groups.alias("r")
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    return left.join(right, reduce(lambda c, k: c & k, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]))


def celled(values: DataFrame, by: list[str]) -> DataFrame:
    """values(by, x, c, ...) with m, the sum of c in the group, and cell: MOST_CELLS of equal width from its least x to its greatest, -1 for null."""
    ends = values.groupBy(*by).agg(F.min("x").alias("least"), F.max("x").alias("most"), F.sum("c").alias("m"))
    cell = F.when(F.col("most") > F.col("least"), F.least(F.lit(MOST_CELLS - 1), F.floor((F.col("l.x") - F.col("least")) / (F.col("most") - F.col("least")) * MOST_CELLS))).otherwise(0)
    return with_group(values, ends, by).select("l.*", "r.m", F.when(F.col("l.x").isNotNull(), cell).otherwise(-1).cast("int").alias("cell"))


def running(cells: DataFrame, by: list[str], what: Callable[[Column | str], Column], value: str, name: str, down: bool = False) -> DataFrame:
    """cells(by, cell, x, ...) with `name`: what (sum, min) of value over all rows of the group before this one by x, null for the first.

    down: over those after it. In two steps, over the cells of a group and within a cell, so that no task sees a group.
    """
    up = (lambda c: F.col(c).desc()) if down else (lambda c: F.col(c).asc())
    ahead = lambda *keys: Window.partitionBy(*by, *keys[:-1]).orderBy(up(keys[-1])).rowsBetween(Window.unboundedPreceding, -1)
    whole = cells.groupBy(*by, "cell").agg(what(value).alias("_whole")).select(*by, "cell", what("_whole").over(ahead("cell")).alias("_far"))  # MOST_CELLS + 1 rows of a group
    near = cells.withColumn("_near", what(value).over(ahead("cell", "x")))
    both = with_group(near, whole, [*by, "cell"]).select("l.*", "r._far")
    join = (F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))) if what is F.sum else F.least("_near", "_far")
    return both.withColumn(name, join).drop("_near", "_far")


def value_cells(diffs: DataFrame, by: list[str], one: bool = False, most: int | None = None) -> DataFrame:
    """by, n, cell, xs, cs, sizes: a group's distinct differences, counted, in cells of ascending values.

    Equal differences are one value, counted before they are shuffled. A group's cells are of equal width between its least and greatest value, one for each `most` (CELL_VALUES) distinct values and
    MOST_CELLS at most (`one`: a single cell); sizes holds the rows of all cells of the group, n their sum.
    """
    values = diffs.where("diff is not null").groupBy(*by, F.col("diff").cast("double").alias("x")).agg(F.count("*").alias("c"))
    ends = values.groupBy(*by).agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count("*").alias("k"), F.sum("c").alias("n"))
    m = F.lit(1) if one else F.least(F.lit(MOST_CELLS), F.ceil(F.col("k") / (most or CELL_VALUES)))
    cell = F.when(F.col("most") > F.col("least"), F.least(m - 1, F.floor((F.col("x") - F.col("least")) / (F.col("most") - F.col("least")) * m))).otherwise(0).cast("int")
    keys = [F.col(f"l.{k}").alias(k) for k in by]
    placed = with_group(values, ends, by).select(*keys, "r.n", "l.x", "l.c", cell.alias("cell"))
    cells = placed.groupBy(*by, "n", "cell").agg(F.array_sort(F.collect_list(F.struct("x", "c"))).alias("v"), F.sum("c").alias("size"))
    sizes = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cell", "size"))).alias("sizes"))
    met = with_group(cells, sizes, by)
    part = lambda c, f: F.transform(c, lambda x: x[f])
    return met.select(*keys, "l.n", F.array_position(part("r.sizes", "cell"), F.col("l.cell")).cast("int").alias("cell"), part("l.v", "x").alias("xs"), part("l.v", "c").alias("cs"), part("r.sizes", "size").alias("sizes"))


def generator(seed: int, group: int, block: int, cell: int) -> np.random.Generator:
    """Random numbers of their own for a group's block of rounds, and for each of its cells (0: the split over the cells)."""
    return np.random.Generator(np.random.Philox(key=np.array([(group ^ (seed * 0x9E3779B97F4A7C15)) & (2**64 - 1), (cell << 40) | block], np.uint64)))


Resampled = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def sums_of(xs: np.ndarray, counts: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """What a cell adds to the mean of each resample."""
    return counts @ xs / n


def middles_of(xs: np.ndarray, counts: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """What a cell adds to the median: half of each of the two middle values that it holds; before: rows in the cells below."""
    upto = np.cumsum(counts, axis=1)
    out = np.zeros(len(counts))
    for middle in ((n - 1) // 2, n // 2):
        at = middle - before
        held = (at >= 0) & (at < upto[:, -1])
        out[held] += xs[(upto[held] > at[held, None]).argmax(1)] / 2
    return out


def with_middle(before: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Rounds in which a cell that gets `own` of n draws, after those in the cells below, holds one of the two middles."""
    return (before <= n // 2) & ((n - 1) // 2 < before + own)


STATISTICS: dict[str, Resampled] = {"mean": sums_of, "median": middles_of}


def bootstrap(diffs: DataFrame, by: list[str], stat: str | Callable[[np.ndarray], float] = "mean", rounds: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """by, point, lo, hi: percentile interval of a statistic of diffs(by, diff) over resamples, by linear interpolation.

    A resample is its counts of the distinct differences: binomial splits deal a round's n draws over the group's cells, and
    those of a cell over its values. A task takes one cell and ROUND_BLOCK rounds, repeats the split over the cells from the
    same random numbers, and gives what its cell adds to the statistic of each round; no task holds a group's rows, and the
    work is by distinct values, not by draws. Random numbers belong to (seed, group, rounds, cell), so that reruns agree in any
    partitioning. stat is "mean", "median" or a function of an array of the resample, for which a group is one cell. Null
    differences are left out; no differences at all give no row, or 0, 0, 0 if `by` is empty.
    """
    if not 0 < confidence < 1 or rounds < 1:
        raise ValueError(f"confidence must be in (0, 1) and rounds at least 1, got {confidence} and {rounds}")
    if not callable(stat) and stat not in STATISTICS:
        raise ValueError(f"unknown statistic {stat!r}")
    of = STATISTICS[stat] if isinstance(stat, str) else lambda xs, counts, before, n: np.array([float(stat(np.repeat(xs, c))) for c in counts])
    names, by = by, [f"by{i}" for i in range(len(by))]  # so that no name of a group meets one of the columns below
    cells = value_cells(diffs.select(*[F.col(f"`{c}`").alias(b) for c, b in zip(names, by, strict=True)], "diff"), by, one=callable(stat))
    last = -(-rounds // ROUND_BLOCK) - 1
    blocks = cells.select(*by, "n", "cell", "xs", "cs", "sizes", F.xxhash64(*by).alias("g") if by else F.lit(0).cast("long").alias("g"), F.explode(F.sequence(F.lit(-1), F.lit(last))).alias("block"))
    blocks = blocks.repartition(*by, "cell", "block")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a cell adds to each round of a block; block -1 is the differences themselves."""
        for f in frames:
            for i, r in enumerate(f.itertuples(index=False)):
                n, xs, cs, sizes = int(r.n), np.asarray(r.xs, float), np.asarray(r.cs, np.int64), np.asarray(r.sizes, np.int64)
                if r.block < 0:
                    numbers, parts = np.array([-1]), of(xs, cs[None, :], sizes[None, : r.cell - 1].sum(1), n)
                else:
                    numbers = np.arange(r.block * ROUND_BLOCK, min((r.block + 1) * ROUND_BLOCK, rounds))
                    split = generator(seed, r.g, r.block, 0).multinomial(n, sizes / n, len(numbers))
                    before, own = split[:, : r.cell - 1].sum(1), split[:, r.cell - 1]
                    inside, step = generator(seed, r.g, r.block, r.cell), max(1, COUNTS_AT_ONCE // len(xs))
                    if stat == "median":  # only rounds with a middle in the cell have to be dealt to its values
                        held = with_middle(before, own, n)
                        numbers, before, own = numbers[held], before[held], own[held]
                        if not len(numbers):
                            continue
                    parts = np.concatenate([of(xs, inside.multinomial(own[k : k + step], cs / cs.sum()), before[k : k + step], n) for k in range(0, len(numbers), step)])
                yield pd.DataFrame({**{c: [f[c].iloc[i]] * len(parts) for c in by}, "round": numbers, "part": parts})

    keys = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in by)
    found = blocks.mapInPandas(draw, f"{keys}round long, part double").groupBy(*by, "round").agg((F.round(F.sum("part"), 12) if stat == "mean" else F.sum("part")).alias("m"))  # digits that the order of cells shows in
    alpha, drawn = (1 - confidence) / 2, F.when(F.col("round") >= 0, F.col("m"))
    out = [F.max(F.when(F.col("round") < 0, F.col("m"))), F.percentile(drawn, alpha), F.percentile(drawn, 1 - alpha)]
    rows = found.groupBy(*by).agg(*[(c if by else F.coalesce(c, F.lit(0.0))).alias(x) for c, x in zip(out, ("point", "lo", "hi"), strict=True)])
    return rows.withColumnsRenamed(dict(zip(by, names, strict=True)))


def mixed(x: np.ndarray) -> np.ndarray:
    """x, whole numbers of 32 bits, with their bits mixed; a permutation that any engine with 64 bits can compute."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(MIX_A)
    x ^= x >> np.uint32(15)
    x *= np.uint32(MIX_B)
    x ^= x >> np.uint32(16)
    return x


def drawn_interval(diffs: DataFrame, by: list[str], rounds: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """by, lo, hi: percentile interval of the means of resamples that any engine draws alike, by linear interpolation.

    Draw i of round r of a group of n is a keyed mix h of (seed, r, i), 32 bits (mixed numbers of both, put together and mixed
    once more), and takes the difference at position
    h n / 2^32 of the group's differences in ascending order. A task takes up to DRAWN_STRETCH draws of ROUND_BLOCK rounds
    and counts of the distinct differences, in cells of DRAWN_VALUES about: it makes the draws, and adds up those that fall
    into its cell. No task holds a group's rows; work is by draws, n rounds, dealt over all tasks. Sums of a round are
    rounded to nine digits. Null differences are left out; no differences give no row.
    """
    if not 0 < confidence < 1 or rounds < 1:
        raise ValueError(f"confidence must be in (0, 1) and rounds at least 1, got {confidence} and {rounds}")
    names, by = by, [f"by{i}" for i in range(len(by))]
    cells = value_cells(diffs.select(*[F.col(f"`{c}`").alias(b) for c, b in zip(names, by, strict=True)], "diff"), by, most=DRAWN_VALUES)
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("cell") - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    dealt = cells.select(*by, "n", "cell", before.alias("before"), "xs", "cs", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // ROUND_BLOCK) - 1))).alias("block"))
    dealt = dealt.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DRAWN_STRETCH).cast("long"))))
    tasks = max(32, int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(tasks, *by, "cell", "block", "stretch")  # a fixed number, as the work is not in the bytes

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the draws of a stretch add to each round of a block, of those that fall into the cell."""
        for f in frames:
            for at, r in enumerate(f.itertuples(index=False)):
                n = int(r.n)
                if n >= 1 << 31:
                    raise ValueError(f"a group of {n} differences is beyond the 31 bits of a draw")
                # The least h of each value's positions, ascending; the last ends the cell. Below the first nothing is drawn.
                edges = int(r.before) + np.concatenate(([0], np.cumsum(np.asarray(r.cs, np.int64))))
                starts = -((-(edges << 32)) // n)
                xs = np.concatenate(([0.0], np.asarray(r.xs, float), [0.0]))  # 0 before and after the cell
                # Of most draws the first bits say the value; the others, in whose range a value starts, are NaN in the guide.
                ends = np.arange((1 << GUIDE_BITS) + 1, dtype=np.int64) << (32 - GUIDE_BITS)
                code = np.searchsorted(starts, ends[:-1], side="right")
                guide = np.where(code == np.searchsorted(starts, ends[1:] - 1, side="right"), xs[code], np.nan)
                numbers = np.arange(r.block * ROUND_BLOCK, min((r.block + 1) * ROUND_BLOCK, rounds))
                keys = mixed((numbers * MIX_ROUND + seed & 0xFFFFFFFF).astype(np.uint32))
                parts, first = np.zeros(len(numbers)), int(r.stretch) * DRAWN_STRETCH
                for low in range(first, min(first + DRAWN_STRETCH, n), DRAWS_AT_ONCE):
                    own = mixed((np.arange(low, min(low + DRAWS_AT_ONCE, first + DRAWN_STRETCH, n), dtype=np.int64) * MIX_STEP + 1 & 0xFFFFFFFF).astype(np.uint32))
                    h, bits, place, value = np.empty_like(own), np.empty_like(own), np.empty(len(own), np.intp), np.empty(len(own))
                    for j, key in enumerate(keys):
                        np.bitwise_xor(own, key, out=h)
                        np.multiply(h, np.uint32(MIX_A), out=h)
                        np.right_shift(h, 15, out=bits)
                        np.bitwise_xor(h, bits, out=h)
                        np.multiply(h, np.uint32(MIX_B), out=h)
                        if len(starts) <= FEW_VALUES:
                            parts[j] += np.diff([0 if x == 0 else len(h) if x >> 32 else np.count_nonzero(h < np.uint32(x)) for x in starts]) @ xs[1:-1]
                            continue
                        np.right_shift(h, 32 - GUIDE_BITS, out=place, casting="unsafe")
                        np.take(guide, place, out=value, mode="clip")
                        open_ = np.flatnonzero(np.isnan(value))
                        value[open_] = xs[np.searchsorted(starts, h[open_], side="right")]
                        parts[j] += value.sum()
                yield pd.DataFrame({**{c: [f[c].iloc[at]] * len(parts) for c in by}, "n": n, "round": numbers, "part": parts})

    keys = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in by)
    means = dealt.mapInPandas(draw, f"{keys}n long, round long, part double").groupBy(*by, "n", "round").agg(F.round(F.sum("part"), 9).alias("s")).select(*by, (F.col("s") / F.col("n")).alias("m"))
    alpha = (1 - confidence) / 2
    rows = means.groupBy(*by).agg(F.percentile("m", alpha).alias("lo"), F.percentile("m", 1 - alpha).alias("hi"))
    return rows.withColumnsRenamed(dict(zip(by, names, strict=True)))


def normal_interval(diffs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, point, se, step, lo, hi: the 95 % interval of resampled means from three moments, corrected for skew.

    What `bootstrap` tends to. se is the deviation of resampled means, step the most that one draw can change them by.
    """
    m = diffs.where("diff is not null").groupBy(*by).agg(F.count("*").alias("n"), (F.round(F.sum("diff"), 9) / F.count("*")).alias("point"), F.stddev_pop("diff").alias("sd"), F.skewness("diff").alias("skew"), ((F.max("diff") - F.min("diff")) / F.count("*")).alias("step"))
    se, skew = F.col("sd") / F.sqrt("n"), F.coalesce(F.when(F.col("sd") > 0, F.col("skew")), F.lit(0.0)) / F.sqrt("n")
    end = lambda z: F.col("point") + se * (z + (z * z - 1) * skew / 6)
    return m.select(*by, "n", "point", se.alias("se"), "step", end(-Z).alias("lo"), end(Z).alias("hi"))


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Two-sided normal p of z."""
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


def wilcoxon(diffs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, w, z, rank_biserial of the signed-rank test: zeros dropped, average ranks, tie and continuity correction."""
    live = diffs.where("diff <> 0").withColumn("x", F.round(F.abs("diff"), 12))
    groups = live.groupBy(*by, "x").agg(F.count("*").alias("c"), F.count_if(F.col("diff") > 0).alias("pos"))
    ranked = running(celled(groups, by), by, F.sum, "c", "before").select("*", F.col("c").alias("t"), (F.col("before") + (F.col("c") + 1) / 2).alias("rank"))
    s = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("plus"), F.sum((F.col("t") - F.col("pos")) * F.col("rank")).alias("minus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    w = F.least("plus", "minus")
    z = F.when((n >= 5) & (var > 0), F.least(F.lit(0.0), w - mean + 0.5) / F.sqrt(var))
    return s.select(*by, "n", w.alias("w"), z.alias("z"), ((F.col("plus") - F.col("minus")) / (F.col("plus") + F.col("minus"))).alias("rank_biserial"))


def false_discovery(tests: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """tests with q: Benjamini-Hochberg, the running minimum of p m / k from the largest p down.

    Equal p have equal q, that of the last of them, so that all is said by counts of distinct p.
    """
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p)))
    values = tests.groupBy(*by, x.alias("x")).agg(F.count("*").alias("c"))
    counted = running(celled(values, by), by, F.sum, "c", "before").withColumn("own", F.col("x") * F.col("m") / (F.col("before") + F.col("c")))
    q = running(counted, by, F.min, "own", "later", down=True).select(*by, F.col("x").alias("_x"), F.least(F.lit(1.0), "own", "later").alias("q"))
    return with_group(tests.withColumn("_x", x), q, [*by, "_x"]).select("l.*", "r.q").drop("_x")


def calibration_error(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """ece, brier, n: bins of equal width by truncation, scores outside fall in the end bins."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.col(score) * bins).cast("int")))
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("c"), F.avg(score).alias("s"), F.avg(F.col(label).cast("double")).alias("y"), F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("e"))
    return per.agg((F.sum(F.col("c") * F.abs(F.col("s") - F.col("y"))) / F.sum("c")).alias("ece"), (F.sum("e") / F.sum("c")).alias("brier"), F.sum("c").alias("n"))


def roc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tpr, fpr, j at each distinct score, falling, and minus infinity at the end; rates are 0 without their class."""
    g = rows.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q")).withColumn("cell", F.floor(F.col("threshold") * 4096))
    # Running counts in two steps, over cells of scores and within a cell, so that no task sees all scores.
    cells = g.groupBy("cell").agg(F.sum("p").alias("cp"), F.sum("q").alias("cq"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    base = cells.select("cell", F.coalesce(F.sum("cp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("cq").over(above), F.lit(0)).alias("q0"), F.sum("cp").over(every).alias("np"), F.sum("cq").over(every).alias("nq"))
    down = Window.partitionBy("cell").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = g.join(base, "cell").select("threshold", (F.col("p0") + F.sum("p").over(down)).alias("tp"), (F.col("q0") + F.sum("q").over(down)).alias("fp"), "np", "nq")
    last = g.agg(F.lit(float("-inf")).alias("threshold"), F.sum("p").alias("tp"), F.sum("q").alias("fp"), F.sum("p").alias("np"), F.sum("q").alias("nq")).where("np is not null")
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return run.unionByName(last).select("threshold", rate("tp", "np").alias("tpr"), rate("fp", "nq").alias("fpr"), (rate("tp", "np") - rate("fp", "nq")).alias("j"), "np", "nq")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """threshold, j of the largest Youden J, ties to the higher threshold; no row when a class is missing."""
    return sweep.where("np > 0 and nq > 0").orderBy(F.desc(F.round("j", 9)), F.desc("threshold")).limit(1).select("threshold", "j")


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """rows with `name`: the rank of the value in its group, from 1, equal ones at their mean; nulls come first."""
    values = rows.groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    ranks = running(celled(values, by), by, F.sum, "c", "before").select(*by, F.col("x").alias(value), (F.col("before") + (F.col("c") + 1) / 2).alias("_rank"))
    return with_group(rows, ranks, [*by, value]).select("l.*", F.col("r._rank").alias(name))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, rho: correlation of average ranks, null where a side does not vary."""
    live = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(live, x, by, "rx"), y, by, "ry")
    flat = (F.stddev_pop("rx") == 0) | (F.stddev_pop("ry") == 0)
    return ranked.groupBy(*by).agg(F.when(~flat, F.corr("rx", "ry")).alias("rho"))


def paired(results: DataFrame, value: str, arm: str, base: str) -> DataFrame:
    """scenario_id, question_id, arm and base value, diff where both arms have one."""
    side = lambda m, n: results.where((F.col("mode") == m) & F.col(value).isNotNull()).select("scenario_id", "question_id", F.col("qtype"), F.col(value).alias(n))
    return side(arm, "arm").join(side(base, "base").drop("qtype"), ["scenario_id", "question_id"]).withColumn("diff", F.col("arm") - F.col("base"))


def discordant(pairs: DataFrame, by: list[str], threshold: float | None = None, test: Callable[[Column, Column], Column] = mcnemar) -> DataFrame:
    """by, b, c, p: pairs won and lost (graded, or at a threshold) and the p of the test on them."""
    a, z = (F.col("arm"), F.col("base")) if threshold is None else ((F.col("arm") >= threshold).cast("int"), (F.col("base") >= threshold).cast("int"))
    return pairs.groupBy(*by).agg(F.count_if(a > z).alias("b"), F.count_if(a < z).alias("c")).withColumn("p", test(F.col("b"), F.col("c")))


def cohen_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def pairs_needed(p1: Column, p2: Column, rho: Column) -> Column:
    """Pairs that tell two proportions apart by Cohen's h at 5 % with a power of 80 %, for outcomes correlated by rho."""
    return 2 * F.pow((Z + POWER_Z) / F.nullif(cohen_h(p1, p2), F.lit(0.0)), F.lit(2)) / F.nullif(1 - rho, F.lit(0.0))


def _t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection of its distribution, integrated numerically."""
    xs = np.linspace(0, 60, 20001)
    dens = (1 + xs * xs / df) ** (-(df + 1) / 2)
    dens *= math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    cdf = 0.5 + np.concatenate(([0.0], np.cumsum((dens[1:] + dens[:-1]) / 2) * (xs[1] - xs[0])))
    return float(np.interp(p, cdf, xs)) if p >= 0.5 else -_t_quantile(1 - p, df)


def power_table(pairs: DataFrame, by: list[str], alpha: float = 0.05, power: float = 0.8, goal: float = 0.05) -> DataFrame:
    """by, n, sd, mde, needed: smallest detectable mean difference, and pairs needed to detect `goal`."""

    def fill(frames):
        for f in frames:
            mde, needed = [], []
            for n, sd in zip(f["n"], f["sd"], strict=True):
                t = _t_quantile(1 - alpha / 2, n - 1) + _t_quantile(power, n - 1) if n > 1 else math.nan
                mde.append(t * sd / math.sqrt(n))
                m = max(2.0, ((1.96 + 0.8416) * sd / goal) ** 2)
                for _ in range(20):
                    m = max(2.0, ((_t_quantile(1 - alpha / 2, m - 1) + _t_quantile(power, m - 1)) * sd / goal) ** 2)
                needed.append(int(math.ceil(m)))
            yield f.assign(mde=mde, needed=needed)

    agg = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("diff").alias("sd"))
    keys = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in by)
    return agg.mapInPandas(fill, f"{keys}, n long, sd double, mde double, needed long")
