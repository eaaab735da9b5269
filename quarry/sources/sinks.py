"""Writers: results, exports and documents."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder below the one that driver and executors share: spark.checkpoint.dir. It goes with the application unless `keep`.

    Only local mode, as in tests, has another such folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        top = "file:///tmp/checkpoints"
    folder = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def append_results(rows: DataFrame, path: str) -> None:
    """Append result rows, partitioned by run, so that a run can be read or dropped by itself."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def error_rows(questions: DataFrame, modes: list[str], message: str) -> DataFrame:
    """One row for each mode of a failed question."""
    return questions.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))).withColumn("error", F.lit(message))


def export_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def partial_dump(results: DataFrame) -> DataFrame:
    """Rows of an unfinished run with the report's column names, as JSON."""
    named = results.withColumnsRenamed({"mode": "arm", "scenario_id": "scenario"}).withColumn("partial", F.lit(True))
    return named.select(F.to_json(F.struct("*")).alias("value"))


def document_files(docs: DataFrame, title: str, body: str) -> DataFrame:
    return docs.select(F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(body), F.lit("\n")).alias("value"))


def conflict_block(context: DataFrame) -> DataFrame:
    """Context of passages that contradict the question's premise, under a heading."""
    return context.withColumn("context", F.concat(F.lit("The following passages contradict a premise of the question:\n\n"), F.col("context")))


def user_message(context: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, message: context and question as sent to a model."""
    return questions.join(context, "query_id", "left").select("query_id", F.concat(F.lit("Context:\n\n"), F.coalesce("context", F.lit("(none)")), F.lit("\n\nQuestion: "), F.col("question")).alias("message"))
