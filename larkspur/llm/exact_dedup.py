"""Operator 6: exact deduplication by Grace hashing.

Rows are dealt to tasks by a hash of their normalised text. Each task fills an open-addressing table
(a ``dict``: it compares complete keys, not only their hashes) with distinct texts. If the table outgrows
its memory, it and all further rows go to spill files by another hash, and each file is treated the same
way until every bucket fits. Before the shuffle each batch keeps one row of each text, so a group of
copies that holds a third of all rows sends one row per batch.

Null counts as an empty text, and all texts of white space only are one group. Of equal texts the longest
original stays, then the smallest id (null last), then the smallest original. Long texts are compared whole. An empty table gives an empty
result. Extra columns travel inside a struct, so their names cannot clash.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import ROW, batches_of, read_table, sha256_hex, small_batches, tidy, utf8, whole_row

SPACE = b"\t\n\x0b\x0c\r "
TABLE_BYTES = 64 << 20
SPILL_FILES = 16


def _rank(row: dict) -> tuple:
    return (-row["n_chars"], row["id"] is None, row["id"] or 0, row["text"])


def _fold(table: dict[bytes, dict], row: dict) -> int:
    """Put a row into the table; returns the bytes it adds."""
    key = row["text"].translate(None, SPACE)
    best = table.get(key)
    if best is None:
        table[key] = row
        return len(key) + 2 * len(row["text"])
    size = best["size"] + row["size"]
    if _rank(row) < _rank(best):
        table[key] = best = row
    best["size"] = size
    return 0


def _one_per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best row of each text in each batch, with the number of rows it stands for."""
    for batch in batches:
        table: dict[bytes, dict] = {}
        for row in batch.to_pylist():
            _fold(table, row)
        for key, row in table.items():
            row["part"] = xxhash.xxh3_64_intdigest(key) - (1 << 63)
        yield from batches_of(table.values(), batch.schema)


def _grace(batches: Iterator[pa.RecordBatch], limit: int, level: int = 1) -> Iterator[dict]:
    """One row per distinct text, holding no more than ``limit`` bytes and a batch at any time."""
    table: dict[bytes, dict] = {}
    held = 0
    for batch in batches:
        held += sum(_fold(table, row) for row in batch.to_pylist())
        if held > limit and len(table) > 1:
            yield from _spilled(table, batches, batch.schema, limit, level)
            return
    for key, row in table.items():
        yield {**row, "text_sha256": sha256_hex(key)}


def _spilled(
    table: dict[bytes, dict], batches: Iterator[pa.RecordBatch], schema: pa.Schema, limit: int, level: int
) -> Iterator[dict]:
    with tempfile.TemporaryDirectory() as folder:
        paths = [Path(folder, str(i)) for i in range(SPILL_FILES)]
        writers = [pa.ipc.new_stream(str(p), schema) for p in paths]

        def put(rows: list[dict]) -> None:
            buckets: list[list[dict]] = [[] for _ in paths]
            for row in rows:
                key = row["text"].translate(None, SPACE)
                buckets[xxhash.xxh3_64_intdigest(key, seed=level) % SPILL_FILES].append(row)
            for writer, bucket in zip(writers, buckets, strict=True):
                for part in batches_of(bucket, schema):
                    writer.write_batch(part)

        put(list(table.values()))
        table.clear()
        for batch in batches:
            put(batch.to_pylist())
        for writer in writers:
            writer.close()
        for path in paths:
            with pa.ipc.open_stream(str(path)) as reader:
                yield from _grace(iter(reader), limit, level + 1)
            path.unlink()


def equal_text_groups(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    table_bytes: int = TABLE_BYTES,
    texts: bool = False,
) -> DataFrame:
    """One row per distinct normalised text: the row that stays, its length, the text's SHA-256, group size.

    The text is a column of its own beside struct ``row`` with all other columns, so it is shuffled once.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    others = df.select(*[F.col(f"`{c}`") for c in df.columns if c != text_column])
    rows = small_batches(df).select(
        whole_row(others),
        F.col(f"`{text_column}`").isNull().alias("no_text"),
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        utf8(text).alias("text"),
        F.length(text).cast("bigint").alias("n_chars"),
        F.lit(1).cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("part"),
    )
    dealt = rows.mapInArrow(tidy(_one_per_text), rows.schema).repartition("part")
    out = T.StructType([
        rows.schema[ROW],
        *([rows.schema["no_text"], rows.schema["text"]] if texts else []),
        T.StructField("n_chars", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("size", T.LongType()),
    ])

    def grace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([
            first.schema.field(ROW),
            *([first.schema.field("no_text"), first.schema.field("text")] if texts else []),
            pa.field("n_chars", pa.int64()), pa.field("text_sha256", pa.string()), pa.field("size", pa.int64()),
        ])

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from batches_of(_grace(chained(), table_bytes), schema)

    return dealt.mapInArrow(tidy(grace), out)


def keep_one_per_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts."""
    kept = equal_text_groups(df, id_column, text_column, texts=True)
    original = F.when(~F.col("no_text"), F.col("text").cast("string")).alias(text_column)
    return kept.select(*[original if c == text_column else F.col(f"{ROW}.`{c}`").alias(c) for c in df.columns])


def duplicate_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: its group's id that stays, size and hash, and whether it is the one.

    Rows of one group with the same id and length count as the same row. The join is on the hash; a hot
    group is one row on the right, and adaptive execution splits its rows on the left.
    """
    plain = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    groups = equal_text_groups(plain.select("doc_id", "text"), "doc_id", "text").select(
        "text_sha256",
        F.col(f"{ROW}.doc_id").alias("keep_id"),
        F.col("n_chars").alias("_most"),
        F.col("size").alias("group_size"),
    )
    text = F.coalesce("text", F.lit(""))
    keyed = plain.select(
        "doc_id",
        F.length(text).alias("_n"),
        F.sha2(F.translate(text, SPACE.decode(), ""), 256).alias("text_sha256"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == F.col("_most"))
    return keyed.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
