"""Take new files of documents into a store of chunks that searches read.

    python -m jobs.ingest_documents --documents PATH --store DIR --checkpoint DIR [--config jobs/ingest_documents.json]

A file stream with a checkpoint: a run takes the files that came since the last one and ends. Each batch of files is written
as partitions of its own number, by Spark's dynamic partition overwrite, so that a batch that runs again, after a crash or
by hand, replaces what it wrote before and adds nothing. A document that comes again replaces its older version: readers
take the chunks of the newest batch that has it (`current`), so that a shorter version leaves no old tail.

    STORE/registry/batch=N/              doc_id, source, lang, status (ready or error), error, chunk_count, n_chars
    STORE/chunks/batch=N/lang=L/         doc_id, chunk_index, text, n_tokens
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import config, log, main, read_back
from quarry.functions import text as tx
from quarry.operators import chunking

DEFAULTS: dict[str, Any] = {"chunk_size": 900, "chunk_overlap": 140, "files_per_batch": 64}
DOCUMENTS = "doc_id long, text string, lang string, source string"
REGISTRY = "doc_id long, source string, lang string, status string, error string, chunk_count long, n_chars long, batch long"
CHUNKS = "doc_id long, chunk_index int, text string, n_tokens long, batch long, lang string"


def pattern(path: str) -> str:
    """A pattern of this path alone: Spark's file streams take a folder or a pattern, but no single file by its path."""
    plain = path.rstrip("/")
    return path if re.search(r"[*?\[\]{}]", path) else f"{plain[:-1]}[{plain[-1]}]"


def newest_rows(batch: DataFrame) -> DataFrame:
    """One row for each document of a batch: of the file changed last, then the last file by name, then the greatest text."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("changed"), F.desc("file"), F.desc_nulls_last("text"), F.desc_nulls_last("lang"), F.desc_nulls_last("source"))
    return batch.where("doc_id is not null").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("doc_id", "text", "lang", "source")


def chunk_rows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_index, text, n_tokens, lang: windows of the text that overlap, with the length that a search index sees."""
    cut = chunking.fixed_chunks(docs.select("doc_id", "text").where(F.trim("text") != ""), size, overlap)
    sized = cut.withColumn("n_tokens", F.size(tx.index_tokens("text")).cast("long"))
    return sized.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "chunk_index", "text", "n_tokens", "lang")


def written(df: DataFrame, path: str, by: list[str]) -> int:
    """Rows of df written to its partitions of path; other partitions stay."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["n"]


def write_batch(batch: DataFrame, number: int, store: str, how: dict[str, Any]) -> dict[str, int]:
    """Write one batch's chunks and registry rows. The registry comes last: `current` reads only chunks that it names."""
    docs = newest_rows(batch).persist()
    try:
        mark = F.lit(number).cast("long").alias("batch")
        n_chunks = written(chunk_rows(docs, how["chunk_size"], how["chunk_overlap"]).select("*", mark), f"{store}/chunks", ["batch", "lang"])
        chunks = read_back(docs.sparkSession, f"{store}/chunks", CHUNKS).where(F.col("batch") == number)
        status = chunking.ingest_status(docs, chunks.select("doc_id"))
        rows = status.join(docs, "doc_id").select("doc_id", "source", "lang", "status", "error", "chunk_count", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), mark)
        return {"batch": number, "documents": written(rows, f"{store}/registry", ["batch"]), "chunks": n_chunks}
    finally:
        docs.unpersist()


def ingest(spark: SparkSession, documents: str, store: str, checkpoint: str, config_path: str | None = None) -> list[dict[str, int]]:
    """Take the files of `documents` that are new since the last run; what each batch wrote.

    documents is a folder, to which files are added, or a file or a pattern. Rows without a doc_id are left out and counted in the log; documents without text are in the registry as errors and
    have no chunks. Further columns of the files are not read. An empty folder gives no batch.
    """
    how = config(spark, config_path, DEFAULTS)
    if not 0 <= how["chunk_overlap"] < how["chunk_size"]:
        raise ValueError(f"chunk_overlap must be at least 0 and below chunk_size, got {how['chunk_overlap']} and {how['chunk_size']}")
    files = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", how["files_per_batch"]).parquet(pattern(documents))
    rows = files.select("doc_id", "text", "lang", "source", F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"))
    log.info("reading new files of %s, checkpoint %s", documents, checkpoint)
    done: list[dict[str, int]] = []

    def take(batch: DataFrame, number: int) -> None:
        seen = batch.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
        out = {"read": seen.n} | write_batch(batch, number, store, how)
        log.info("batch %d: read %d rows (%d without doc_id), wrote %d documents and %d chunks", number, seen.n, seen.nameless, out["documents"], out["chunks"])
        done.append(out)

    stream = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("%d new batches written to %s", len(done), store)
    return done


def current(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(registry, chunks) of the newest version of each document in the store."""
    registry = read_back(spark, f"{store}/registry", REGISTRY)
    newest = registry.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    chunks = read_back(spark, f"{store}/chunks", CHUNKS)
    return registry.join(newest, ["doc_id", "batch"], "left_semi"), chunks.join(newest, ["doc_id", "batch"], "left_semi")


if __name__ == "__main__":
    main(__doc__, {"documents": "folder, file or pattern of Parquet files", "store": "folder of the store", "checkpoint": "folder of the stream's state"}, ingest)
