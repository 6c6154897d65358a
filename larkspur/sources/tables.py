"""Reading tables and looking up what exists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CONVERSION_TABLES = ("fuel_transactions", "customers", "store_purchases")
# Bucket keys that let the label join do without a shuffle.
LABEL_BUCKETS = {"fuel_transactions": "fuel_txn_id", "store_purchases": "fuel_txn_id"}


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by its one-, two- or three-part name."""
    return spark.read.table(name)


def read_folder(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_conversion_tables(spark: SparkSession, namespace: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fuel transactions, customers and store purchases of a namespace."""
    fuel, customers, store = (read_table(spark, f"{namespace}.{name}") for name in CONVERSION_TABLES)
    return fuel, customers, store


def read_database(spark: SparkSession, url: str, table: str, key: str, partitions: int, **options: str) -> DataFrame:
    """A table of a relational database in parallel ranges of a numeric key.

    Needs the driver of that database on the class path.
    """
    whole = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", table).load()
    bounds = whole.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if bounds["lo"] is None:
        return whole
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .options(**options)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", str(bounds["lo"]))
        .option("upperBound", str(bounds["hi"] + 1))
        .option("numPartitions", str(partitions))
        .load()
    )


def list_tables(spark: SparkSession, namespace: str) -> DataFrame:
    """What ``SHOW TABLES`` gives for a namespace: namespace, tableName, isTemporary."""
    return spark.sql("SHOW TABLES IN IDENTIFIER(:namespace)", args={"namespace": namespace})


def list_table_names(spark: SparkSession, namespace: str) -> DataFrame:
    """Names of the stored tables of a namespace in order."""
    stored = list_tables(spark, namespace).where(~F.col("isTemporary"))
    return stored.select(F.col("tableName").alias("table_name")).orderBy("table_name")


def use_namespace(spark: SparkSession, schema: str, catalog: str | None = None) -> None:
    """Make ``schema``, and ``catalog`` if given, the place where unqualified names are found."""
    if catalog is not None:
        spark.catalog.setCurrentCatalog(catalog)
    spark.catalog.setCurrentDatabase(schema)


def _needs_whole_files(lines: DataFrame, suffix: str) -> bool:
    """Whether some value goes on beyond the end of its line."""
    line = F.col("value")
    if suffix == "csv":
        # A quote that is open at the end of a line; an even number of quotes closes all of them.
        broken = ((F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2) == 1
    else:
        broken = F.try_parse_json(line).isNull() & (F.trim(line) != "")
    return not lines.where(broken).isEmpty()


def _not_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files that are no JSON array of objects; the reader would take the first value of such a file and drop the rest."""
    for batch in batches:
        bad = []
        for text in batch["value"].to_pylist():
            try:
                rows = json.loads(text)
                good = isinstance(rows, list) and all(isinstance(row, dict) for row in rows)
            except ValueError:
                good = False
            bad += [] if good else [text[:100]]
        yield pa.RecordBatch.from_pydict({"start": pa.array(bad, pa.string())})


def read_fixture(
    spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Rows of a ``.json`` or ``.csv`` file or folder.

    JSON has one object per line or is an array of objects, over any number of lines. CSV has a header; all its columns are
    strings, and quoted values may have line breaks. A file in which something goes beyond the end of a line is read by one
    task, others in parts; without ``multi_line`` the lines are looked through for that first. Rows that
    do not fit, in CSV those with too many or too few values, are errors when they are read, never nulls.
    """
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in ("json", "csv"):
        raise ValueError(f"neither .json nor .csv: {path}")
    if multi_line is None:
        multi_line = _needs_whole_files(spark.read.text(path), suffix)
    if suffix == "json" and multi_line:
        bad = spark.read.text(path, wholetext=True).mapInArrow(_not_arrays, "start string").first()
        if bad is not None:
            raise ValueError(f"malformed: neither an object per line nor an array of objects: {bad['start']!r}")
    strict = spark.read.option("mode", "FAILFAST").option("multiLine", multi_line)
    if suffix == "json":
        return (strict.schema(schema) if schema else strict).json(path)
    # Without all columns the parser would not see how many values a row has.
    return strict.option("header", True).option("escape", '"').option("columnPruning", False).csv(path)
