"""Lines repeated across documents, in DataFrame operations only: per-document bitmaps of the lines that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

# Characters stripped from both ends of a line, and the letters that are lower-cased.
BLANKS, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with one line in 2^HEAVY_BITS of all, and HEAVY_LEAST lines at least, is settled by itself: at most 2^HEAVY_BITS
#: keys can be that frequent. They are looked for among the keys in frequent cells of 2^CELL_BITS.
HEAVY_BITS, HEAVY_LEAST, CELL_BITS = 16, 512, 20
#: Lines in a word of a bitmap: the bits of a long without its sign.
WORD = 63


def line_array(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_id(text: Column) -> Column:
    """64 bits that tell texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, least: int) -> DataFrame:
    """k1, k2, doc_id, text_id, pos of every line whose key has at least `least` code points; k1 and k2 are 128 bits of its hash."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("text_id"), line_array(F.col("text")).alias("lines"))  # before lines are rows
    lines = whole.select("doc_id", "text_id", F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("doc_id", "text_id", "pos", F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER).alias("key")).where(F.length("key") >= least)
    return keys.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(12), "key").alias("k2"), "doc_id", "text_id", "pos")


def heavy_keys(lines: DataFrame) -> DataFrame:
    """k1, k2, keeper, n_docs of the keys that hold one line in 2^HEAVY_BITS or more.

    Counts over cells of hashes, whose number is fixed, show where a frequent key can be; only lines in those cells are
    counted by key, all before the shuffle as far as they meet in a task. Both results have at most 2^HEAVY_BITS rows.
    """
    cell = F.shiftrightunsigned("k1", 64 - CELL_BITS)
    cells = stored(lines.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")), "line-cells")
    enough = cells.agg(F.greatest(F.lit(HEAVY_LEAST), F.shiftright(F.coalesce(F.sum("n"), F.lit(0)), HEAVY_BITS)).alias("n")).first().n
    frequent = cells.where(F.col("n") >= enough).select("cell")
    inside = lines.withColumn("cell", cell).join(F.broadcast(frequent), "cell", "left_semi")
    counted = inside.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"), F.count_distinct("doc_id").alias("n_docs"))
    return stored(counted.where(F.col("n") >= enough).select("k1", "k2", "keeper", "n_docs"), "line-heavy", cells)


def repeated_lines(lines: DataFrame, heavy: DataFrame, docs_least: int) -> DataFrame:
    """doc_id, text_id, pos of the lines that go: their key is in docs_least documents or more, and this is not the last of them.

    Hashes are partitioned by range and sorted by document, last first, and position: the first row of a key's run is its
    first occurrence in that order, and ranks of documents count those that hold it. Frequent keys are met by broadcast
    instead (at most 2^HEAVY_BITS rows), so that no range holds one.
    """
    usual = lines.join(F.broadcast(heavy), ["k1", "k2"], "left_anti").repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2", F.desc("doc_id"), "pos")
    run = Window.partitionBy("k1", "k2").orderBy(F.desc("doc_id"))
    ranked = usual.withColumn("nth", F.dense_rank().over(run))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = ranked.withColumn("n_docs", F.last("nth").over(whole)).where((F.col("nth") > 1) & (F.col("n_docs") >= docs_least))
    often = lines.join(F.broadcast(heavy), ["k1", "k2"]).where((F.col("n_docs") >= docs_least) & (F.col("doc_id") < F.col("keeper")))
    return again.select("doc_id", "text_id", "pos").unionByName(often.select("doc_id", "text_id", "pos"))


def line_bitmaps(docs: DataFrame, least: int = 20, docs_least: int = 3) -> DataFrame:
    """doc_id, text_id, n_dropped, bitmap of the documents that lose lines, from docs(doc_id, text).

    A key is a line stripped of blanks with A-Z in lower case. Keys of `least` code points or more in `docs_least`
    documents or more lose their lines in all documents but the one of the largest doc_id. bitmap is compressed: the words
    of WORD lines that lose any, as (word, keep) with a bit set for each line that stays; words that are not there, and
    documents that are not, keep all. Null texts are one empty line. Rows of one doc_id are one document, each with its own
    bitmap by text_id; a null doc_id holds no key, and so neither counts nor loses a line. Empty tables give no rows.
    """
    lines = stored(keyed_lines(docs.select("doc_id", "text").where("doc_id is not null"), least), "lines")
    heavy = heavy_keys(lines)
    gone = repeated_lines(lines, heavy, docs_least)
    dropped = F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})"))
    words = gone.groupBy("doc_id", "text_id", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(dropped.alias("dropped"))
    keep = F.bitwise_not("dropped").bitwiseAND(F.lit((1 << WORD) - 1))
    maps = words.groupBy("doc_id", "text_id").agg(F.sum(F.bit_count("dropped")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", keep.alias("keep")))).alias("bitmap"))
    return stored(maps, "line-bitmaps", lines, heavy)


def dense(bitmap: str) -> Column:
    """All words of a bitmap up to its last, with those that it leaves out."""
    ahead = lambda i: F.coalesce(F.get(bitmap, i - 1)["word"], F.lit(-1))
    return F.flatten(F.transform(bitmap, lambda w, i: F.concat(F.array_repeat(F.lit((1 << WORD) - 1), w["word"] - ahead(i) - 1), F.array(w["keep"]))))


def kept_lines(docs: DataFrame, least: int = 20, docs_least: int = 3) -> DataFrame:
    """row (a struct of the columns of docs), kept, n_lines, n_dropped for every row of docs(doc_id, text, ...).

    kept is the text without the lines that `line_bitmaps` drops, the others joined by line ends; a null text is kept as an
    empty one. Texts move once, to their bitmaps.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("d"), text_id(F.col("text")).alias("t"))
    maps = line_bitmaps(docs, least, docs_least).select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), "n_dropped", "bitmap")
    met = rows.join(maps, ["d", "t"], "left").select("row", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "bitmap", line_array(F.col("row.text")).alias("lines"))
    split = met.select("row", "n_dropped", "lines", dense("bitmap").alias("words"))
    stays = F.filter("lines", lambda x, i: F.coalesce(F.getbit(F.get("words", F.floor(i / WORD).cast("int")), F.pmod(i, F.lit(WORD))), F.lit(1)) == 1)
    kept = F.when(F.col("words").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return split.select("row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), "n_dropped")


def without_repeated_lines(docs: DataFrame, least: int = 20, docs_least: int = 3) -> DataFrame:
    """docs with the text that `kept_lines` keeps; all rows and columns stay."""
    kept = kept_lines(docs, least, docs_least)
    return kept.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, least: int = 20, docs_least: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs; see kept_lines."""
    kept = kept_lines(docs.select("doc_id", "text"), least, docs_least)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
