"""Tables laid out so that lookups and filters skip most of their files.

A keyed table lies in buckets by its key, sorted in each, with Bloom filters: an equality on the key reads one bucket, of it the
row groups and pages whose ranges hold the key, and none whose filter says that it is not there. Many keys at once
are joined bucket by bucket; the table is not shuffled.

A table on a space-filling curve serves ranges over several columns at once. Rows are ordered by the interleaved bits
of their ranks in each column, so every file and row group is narrow in all of the columns, not only in the first.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.listings import find_by_key, missing_keys

# Up to this number of keys a lookup is a filter, beyond it a join.
FEW_KEYS = 200
# Small row groups let a lookup skip more.
ROW_GROUP_BYTES = 16 << 20
# Ranks of a column take so many bits; their bounds come from a sample of about so many rows, which only the layout depends on.
RANK_BITS = 6
_SAMPLE = 20_000
_PLACE = "_place"


def overwrite_keyed_table(
    df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Replace the Parquet table ``name``, bucketed and sorted by ``key``, with a Bloom filter over it.

    One task writes a bucket, so no key should hold a large share of all rows.
    """
    writer = (
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.block.size", str(row_group_bytes))
    )
    (writer.option("path", path) if path else writer).saveAsTable(name)


def _few_keys(requests: DataFrame, key: str, few: int) -> list | None:
    """The distinct keys that are asked for, if they are no more than ``few``."""
    found = [r[0] for r in requests.select(key).distinct().limit(few + 1).collect()]
    return None if len(found) > few else [k for k in found if k is not None]


def _with_keys(table: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows with one of a few keys. Equalities, unlike a long list, reach the buckets and Bloom filters."""
    kind = table.schema[key].dataType
    return table.where(reduce(or_, [F.col(key) == F.lit(k).cast(kind) for k in keys], F.lit(False)))


def find_stored(requests: DataFrame, table: DataFrame, key: str, few: int = FEW_KEYS) -> DataFrame:
    """:func:`find_by_key` in a keyed table."""
    keys = _few_keys(requests, key, few)
    return find_by_key(requests, table if keys is None else _with_keys(table, key, keys), key)


def missing_stored(requests: DataFrame, table: DataFrame, key: str, few: int = FEW_KEYS) -> DataFrame:
    """:func:`missing_keys` in a keyed table."""
    keys = _few_keys(requests, key, few)
    return missing_keys(requests, table if keys is None else _with_keys(table, key, keys), key)


def _bounds_below(value: Column, bounds: Column) -> Column:
    below = F.size(F.filter(bounds, lambda b: b <= value)).cast("bigint")
    return F.when(value.isNotNull(), below).otherwise(F.lit(0).cast("bigint"))


def curve_place(df: DataFrame, columns: list[str], bits: int = RANK_BITS) -> Column:
    """Place of a row on a Z-order curve over ``columns``; nulls rank lowest."""
    if not 1 <= bits * len(columns) <= 62:
        raise ValueError("the ranks of all columns must fit into 62 bits")
    rows = df.count()
    sample = df.select(*columns).sample(min(1.0, _SAMPLE / max(rows, 1)), seed=1).collect()
    place = F.lit(0).cast("bigint")
    for i, column in enumerate(columns):
        values = sorted(r[column] for r in sample if r[column] is not None)
        bounds = sorted({values[len(values) * j // 2**bits] for j in range(1, 2**bits)}) if values else []
        kind = df.schema[column].dataType
        known = F.array(*[F.lit(b).cast(kind) for b in bounds]).cast(f"array<{kind.simpleString()}>")
        # A column of few values has few ranks; spread over all bits they count as much as those of other columns.
        rank = F.floor(_bounds_below(F.col(column), known) * 2**bits / (len(bounds) + 1))
        for bit in range(bits):
            digit = F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("bigint"))
            place = place.bitwiseOR(F.shiftleft(digit, bit * len(columns) + i))
    return place


def write_on_curve(
    df: DataFrame, path: str, columns: list[str], files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Write ``df`` to ``path`` along a curve over ``columns``; rows alike in all of them are cut by their other columns."""
    placed = df.withColumn(_PLACE, curve_place(df, columns))
    order = [F.col(_PLACE), *[F.col(c) for c in columns], F.xxhash64(*df.columns)]
    cut = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    cut.sortWithinPartitions(_PLACE, *columns).drop(_PLACE).write.option("parquet.block.size", str(row_group_bytes)).parquet(path)
