"""What the jobs share: configs, tables read back, logs, and the session of a command line."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("quarry.jobs")
#: Bytes of texts that go to a Python worker at once, in place of 10,000 texts.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def config(spark: SparkSession, path: str | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """The defaults with the values of a JSON file in their place; a name that is not among them is an error."""
    given = {} if path is None else spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return defaults | {k: v for k, v in given.items() if v is not None}


def read_back(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table with this schema, partition columns too; no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Workers get batches of BATCH; the session's setting comes back."""
    before = spark.conf.get(BATCH[0], None)
    spark.conf.set(*BATCH)
    try:
        yield
    finally:
        spark.conf.unset(BATCH[0]) if before is None else spark.conf.set(BATCH[0], before)


def main(doc: str, names: dict[str, str], run: Callable[..., Any]) -> None:
    """Run a job from the command line: an option for each of `names`, and --config."""
    parser = argparse.ArgumentParser(description=doc.split("\n")[0])
    for name, what in names.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", help="JSON file of settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__name__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *[getattr(args, n) for n in names], config_path=args.config)
    finally:
        spark.stop()
