"""Scans: files by type, HTML, manifests, nested articles, histories and context blocks."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# File types that can be read, and upload limits.
EXTENSIONS = (".pdf", ".docx", ".xlsx", ".md", ".txt", ".html", ".htm", ".csv", ".json", ".xml", ".log")
MOST_FILES, MOST_BYTES = 10, 25 * 1024 * 1024
MANIFEST = "struct<scenarios:array<struct<id:string,name:string,questions:array<struct<id:string,question:string,reference:string,gold_files:array<string>,answerable:boolean,qtype:string,note:string>>>>>"
ARTICLE = "struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string>>>>>"


def extension(name: Column | str) -> Column:
    return F.regexp_extract(F.lower(name), "\\.[^./]+$", 0)


def supported(name: Column | str) -> Column:
    """Known types and names without a suffix pass."""
    return extension(name).isin(*EXTENSIONS, "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, ext, content of the readable files below a folder; text of plain types is content decoded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(supported("path"))
    return found.select("path", extension("path").alias("ext"), "length", "content")


def file_text(found: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text: plain types, JSON and XML decoded, CSV as a table of markdown, HTML without tags.

    parsers: functions from bytes to text for further types by suffix, such as .pdf; types without one give null.
    """
    raw = F.decode("content", "UTF-8")
    plain = F.col("ext").isin(".md", ".txt", ".log", ".json", ".xml", "")
    text = F.when(plain, raw).when(F.col("ext") == ".csv", csv_table(raw)).when(F.col("ext").isin(".html", ".htm"), html_text(raw))
    if parsers:

        @F.pandas_udf(StringType())
        def parsed(ext: pd.Series, content: pd.Series) -> pd.Series:
            return pd.Series([parsers[e](bytes(c)) if e in parsers else None for e, c in zip(ext, content, strict=True)])

        text = F.when(F.col("ext").isin(*parsers), parsed("ext", "content")).otherwise(text)
    return found.select("path", text.alias("text"))


@F.pandas_udf(StringType())
def csv_table(text: pd.Series) -> pd.Series:
    """The rows of a CSV text as a markdown table, the first one as its head; short rows are filled up, bars escaped."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        rows = [r for r in csv.reader(io.StringIO(t)) if r]
        width = max(map(len, rows), default=0)
        lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ").strip() for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
        return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if lines else ""

    return text.map(one)


def html_text(html: Column | str) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    c = F.col(html) if isinstance(html, str) else html
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " "), "[ \\t\\n\\r\\f]+", " "))


def upload_status(rows: DataFrame, request: str, order: str, size: Column, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows with status: beyond the request's file limit, empty, too large, or accepted."""
    nth = F.row_number().over(Window.partitionBy(request).orderBy(order))
    return rows.withColumn("status", F.when(nth > most_files, "too many files").when(size == 0, "empty file").when(size > most_bytes, "file too large").otherwise("accepted"))


def manifest_questions(rows: DataFrame, raw: str) -> DataFrame:
    """Questions of scenario manifests; scenarios without an id are skipped, answerable and qtype have defaults."""
    s = rows.select(F.explode(F.from_json(raw, MANIFEST)["scenarios"]).alias("s")).where("s.id is not null")
    q = s.select(F.col("s.id").alias("scenario_id"), F.explode("s.questions").alias("q"))
    return q.select("scenario_id", F.col("q.id").alias("question_id"), "q.question", F.coalesce("q.answerable", F.lit(True)).alias("answerable"), F.coalesce("q.qtype", F.lit("lookup")).alias("qtype"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a manifest file; none if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return manifest_questions(spark.read.text(path, wholetext=True), "value")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "scenario_id string, question_id string, question string, answerable boolean, qtype string")


def article_questions(rows: DataFrame, raw: str) -> DataFrame:
    a = rows.select(F.from_json(raw, ARTICLE).alias("a"))
    p = a.select(F.col("a.title").alias("title"), F.explode("a.paragraphs").alias("p"))
    return p.select("title", "p.context", F.explode("p.qas").alias("q")).select("title", "context", F.col("q.id").alias("question_id"), "q.question")


def worker_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result rows of several workers' folders with the folder they came from."""
    return spark.read.parquet(*paths).withColumn("src", F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1))


def filtered(results: DataFrame, modes: list[str] | None = None, scenarios: list[str] | None = None) -> DataFrame:
    """Rows of the given modes and scenarios; an empty list does not filter."""
    for name, wanted in (("mode", modes), ("scenario_id", scenarios)):
        if wanted:
            results = results.where(F.col(name).isin(*wanted))
    return results


def history(messages: DataFrame, n: int) -> DataFrame:
    """The newest n non-empty messages of each conversation, oldest first."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.where(F.length(F.trim("text")) > 0).withColumn("nth", nth).where(F.col("nth") <= n).drop("nth").orderBy("conv_id", "turn")


def context_blocks(hits: DataFrame) -> DataFrame:
    """query_id, context: passages by rank as the prompt shows them."""
    one = F.concat(F.lit("Passage ["), F.col("rank").cast("string"), F.lit("] (source: "), F.col("filename"), F.lit(")\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("rank", one.alias("p"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["p"]), "\n\n").alias("context"))
