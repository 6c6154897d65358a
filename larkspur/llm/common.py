"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import materialise, new_file, open_folder, shared_files

ROW = "row"
# Rows in a batch that a task passes on; with documents of some kilobytes a few megabytes.
BATCH_ROWS = 2_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, so that columns added beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def utf8(column: str | Column) -> Column:
    """The text's bytes; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def tidy(task):
    """``task``, a function over batches, that gives the memory it has freed back to the machine when it ends.

    A Python worker serves tasks of many stages; without this it keeps what the largest of them took.
    """

    @wraps(task)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to give Python tasks ``BATCH_ROWS`` rows at a time at most.

    The usual 10,000 rows with whole texts are held up to four times by a task, hundreds of megabytes of an executor.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The bytes of a text column of struct ``row``, which then travels only once; null counts as empty."""
    texts = batch[ROW].field(column).cast(pa.string()).cast(pa.binary())
    return pa.compute.fill_null(texts, b"") if texts.null_count else texts


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def batches_of(rows: Iterable[dict], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Its shuffle files go once it is written. Python tasks get batches of ``BATCH_ROWS``, a few megabytes of documents.
    """
    conf = df.sparkSession.conf
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    }
    before = {name: conf.get(name, None) for name in settings}
    for setting, value in settings.items():
        conf.set(setting, value)
    try:
        return materialise(df, name)
    finally:
        for setting, value in before.items():
            if value is None:
                conf.unset(setting)
            else:
                conf.set(setting, value)
