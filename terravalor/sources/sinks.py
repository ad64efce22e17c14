"""Writers: partitioned Parquet, full replacement, JSON metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of one written file; a year with more is written by more tasks.
FILE_ROWS = 2_000_000


def write_enriched(df: DataFrame, path: str, year: str = "tax_assessment_year") -> None:
    """One folder per assessment year. Rows are rebalanced by year: Spark sizes the tasks from
    what it shuffled and splits a year that holds most rows."""
    (
        df.hint("rebalance", F.col(year)).write.mode("overwrite")
        .option("maxRecordsPerFile", FILE_ROWS).partitionBy(year).parquet(path)
    )


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
