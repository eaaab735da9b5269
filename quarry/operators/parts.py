"""Numbers of partitions that follow the rows, where a task's memory would otherwise grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a partition, about, of tables that are grouped or joined by keys that hardly repeat.
PART_ROWS = 1 << 19


def parts_for(rows: DataFrame, each: int = 1) -> int:
    """Partitions for `each` rows for every row of a table, which is counted (a Parquet file by its footers): one for each core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * each // PART_ROWS))
