"""Writing tables, logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql("CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:name)", args={"name": name})


def overwrite_table(
    df: DataFrame,
    name: str,
    path: str | None = None,
    bucket_by: str | None = None,
    buckets: int | None = None,
    measures: dict[str, Column] | None = None,
) -> dict[str, int]:
    """Replace the Parquet table ``name``; with ``path`` its files lie there.

    Returns the rows written (``n_rows``) and the ``measures``, aggregates over them, all taken by the tasks that write.
    A task that runs again counts once.

    Tables with the same number of buckets by the same key are joined and grouped by that key without
    a shuffle. A bucket is read by one task, so keys should not hold a large share of all rows. The new rows must not come from the table itself.
    """
    if bucket_by and buckets:
        # One task per bucket, so that each bucket is one file.
        df = df.repartition(buckets, bucket_by)
    # Observed after any shuffle: a lost executor repeats map tasks, whose counts would come twice.
    seen = Observation()
    measured = [F.count("*").alias("n_rows"), *[m.alias(n) for n, m in (measures or {}).items()]]
    writer = df.observe(seen, *measured).write.format("parquet").mode("overwrite")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return seen.get


def overwrite_tables(
    tables: dict[str, DataFrame],
    namespace: str,
    folder: str | None = None,
    bucket_by: dict[str, str] | None = None,
    buckets: int | None = None,
    measures: dict[str, dict[str, Column]] | None = None,
) -> dict[str, dict[str, int]]:
    """Replace each table of a namespace and return what :func:`overwrite_table` counted of each, by name.

    ``bucket_by`` names the bucket key of the tables that are to have one, ``measures`` what else is to be counted.
    """
    return {
        name: overwrite_table(
            df, f"{namespace}.{name}", f"{folder}/{name}" if folder else None, (bucket_by or {}).get(name), buckets,
            (measures or {}).get(name),
        )
        for name, df in tables.items()
    }


def create_table_if_absent(spark: SparkSession, name: str, schema: StructType, path: str | None = None) -> None:
    """An empty Parquet table with the given columns unless it exists."""
    if not spark.catalog.tableExists(name):
        overwrite_table(spark.createDataFrame([], schema), name, path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as a single CSV file, written by one task; a long result is better written as a table."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, rows: int = 5) -> None:
    """Print the first rows."""
    df.show(rows)
