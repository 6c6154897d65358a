"""Operator 7: sharding by a two-pass external shuffle.

Pass 1 scatters records by a seeded hash into buckets of a size that fits a task's memory. Pass 2
shuffles each bucket by Fisher and Yates' method, seeded by the bucket, and writes it. A record's
place in the shuffled order is its bucket's first place plus its place in the bucket; shards are equal
cuts of that order, so row counts differ by one at most (law ``rows``).

The hash covers id and text, so neither a hot source nor a group of copies fills a bucket. Only rows
repeated in full share a hash; they are told apart by nothing and any order of them is the same.
Null texts have no bytes and checksum 0. A text longer than a bucket makes that bucket larger by itself. An empty table gives no rows. Extra columns are not
read; their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import read_table
from larkspur.session import materialise, scratch_path

SHARDS = 40
SEED = 7
BUCKET_BYTES = 16 << 20
RECORD_BYTES = 16

_SHUFFLED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("first", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("place", T.LongType()),
])


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of ``range(n)``: each place from the last swaps with one drawn from those up to it."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _shuffle(seed: int):
    def shuffled(table: pa.Table) -> pa.Table:
        # Rows arrive in any order; a fixed one makes a task that runs again write the same shuffle.
        ordered = table.take(pa.compute.sort_indices(table, [(c, "ascending") for c in ("hash", "doc_id", "text")]))
        bucket = ordered["bucket"][0].as_py()
        mixed = ordered.take(pa.array(fisher_yates(len(ordered), seed, bucket)))
        place = pa.array(np.arange(len(mixed)), pa.int64())
        return mixed.select(["doc_id", "text", "bucket", "first", "total"]).append_column("place", place)

    return shuffled


def _scattered(df: DataFrame, seed: int, buckets: int) -> DataFrame:
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")
    return df.withColumn("hash", hashed).withColumn("bucket", F.pmod("hash", F.lit(buckets)))


def write_shards(
    df: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> str:
    """Write id, text, shard and slot to Parquet below ``path``, a folder for each shard; returns the path."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "shards")
    plain = df.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    total = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES)).first()[0] or 0
    buckets = -(-total // bucket_bytes) or 1
    rows = _scattered(plain, seed, buckets)
    # One row per bucket of many megabytes; the window over them is small whatever the input.
    counts = rows.groupBy("bucket").agg(F.count("*").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = counts.select(
        "bucket",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"),
        F.sum("rows").over(every).alias("total"),
    )
    # Each row brings its bucket's first place: joined before the shuffle, or by it, rows move once either way.
    with_starts = rows.join(materialise(starts, "starts"), "bucket")
    shuffled = with_starts.groupBy("bucket").applyInArrow(_shuffle(seed), _SHUFFLED)
    # Shard s holds the positions from s * total div shards on.
    placed = shuffled.selectExpr(
        "doc_id", "text", "total", "first + place AS position",
        f"cast(((first + place + 1) * {shards} - 1) div total AS int) AS shard",
    ).selectExpr("doc_id", "text", f"position - (shard * total) div {shards} AS slot", "shard")
    placed.write.partitionBy("shard").parquet(path)
    return path


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """Where each record lies, read from the written shards."""
    schema = "doc_id bigint, text string, slot bigint, shard int"
    stored = spark.read.schema(schema).parquet(path)
    text = F.coalesce("text", F.lit(""))
    return stored.select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(spark, write_shards(read_table(spark, sf_dir, "documents")))
