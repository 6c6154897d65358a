"""Totals over an order without pulling the order into one task.

Rows are range-partitioned on the *full* sort key, so a hot leading value, key or instant is cut by
the columns after it. The cut is written to the shared folder once; all later passes read that table
and so agree on the slices, also after a lost executor. Totals need rows of a slice together: they are
written as a table bucketed by slice, which Spark reads back without moving a row. What crosses slices is
one row per slice.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import materialise, scratch_path

SLICE = "_slice"
_POSITION = "_position"
# monotonically_increasing_id() holds the partition above bit 33 and the row in it below.
_ROW_BITS = 33
_labels: dict[int, list[int]] = {}


def _ranged(df: DataFrame, columns: list[str | Column], slices: int | None) -> DataFrame:
    """Slices by the session's shuffle partitions unless the caller says how many; small neighbours merge."""
    return df.repartitionByRange(*columns) if slices is None else df.repartitionByRange(slices, *columns)


def _starts(sizes: DataFrame, names: list[str]) -> DataFrame:
    """Totals of all slices before each slice; ``sizes`` has one row per slice and is small."""
    rows = sorted(sizes.collect(), key=lambda r: r[SLICE])
    running = [list(accumulate((r[name] for r in rows), initial=rows[0][name] * 0)) if rows else [] for name in names]
    starts = [(r[SLICE], *(column[i] for column in running)) for i, r in enumerate(rows)]
    return F.broadcast(sizes.sparkSession.createDataFrame(starts, sizes.schema))


def slice_labels(spark: SparkSession, slices: int) -> list[int]:
    """Ascending numbers, one per slice, each of which falls into a bucket of its own out of ``slices``."""
    tried = 64
    while slices not in _labels:
        found = (
            spark.range(tried * slices)
            .select(F.col("id").cast("int").alias("label"))
            .groupBy(F.pmod(F.hash("label"), F.lit(slices)).alias("bucket"))
            .agg(F.min("label").alias("label"))
            .collect()
        )
        if len(found) == slices:
            _labels[slices] = sorted(r["label"] for r in found)
        tried *= 2
    return _labels[slices]


def sliced(df: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """``df`` cut into slices by ``order``, in a column whose values ascend with it, stored bucketed by that column."""
    spark = df.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = slice_labels(spark, count)
    place = F.spark_partition_id()
    # Should Spark cut more slices than it was asked for, the others share buckets.
    label = F.coalesce(F.try_element_at(F.array(*map(F.lit, labels)), place + 1), place + labels[-1])
    cut = _ranged(df, order, slices).withColumn(SLICE, label)
    name = f"larkspur_{uuid.uuid4().hex}"
    cut.write.bucketBy(count, SLICE).option("path", scratch_path(spark, "slices")).saveAsTable(name)
    # The frame keeps the files and their buckets; the catalog needs no entry for them.
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def number_rows(
    df: DataFrame,
    order: list[str],
    out: str,
    first: int = 1,
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Dense numbers from ``first`` on in the order of ``order``, whose columns together are unique."""
    position = F.col(_POSITION)
    columns = [F.desc(c) if descending else F.asc(c) for c in order]
    placed = (
        _ranged(df, columns, slices)
        .sortWithinPartitions(*columns)
        .withColumn(_POSITION, F.monotonically_increasing_id())
        .withColumn(SLICE, F.shiftright(position, _ROW_BITS).cast("int"))
        .withColumn(_POSITION, position.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    stored = materialise(placed, "numbered")
    starts = _starts(stored.groupBy(SLICE).agg(F.count("*").alias("_start")), ["_start"])
    return (
        stored.join(starts, SLICE)
        .withColumn(out, position + F.col("_start") + F.lit(first).cast("bigint"))
        .drop(SLICE, _POSITION, "_start")
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    slices: int | None = None,
) -> DataFrame:
    """For each name in ``values`` the sum over all earlier rows of the same key, 0 for the first.

    ``keys`` may be empty for totals over the whole frame. No slice exceeds its share of all rows,
    whatever the distribution of keys, as long as ``keys`` and ``order`` together are unique.
    """
    inputs = {f"_in_{name}": F.coalesce(value, F.lit(0)) for name, value in values.items()}
    stored = sliced(df.withColumns(inputs), [*keys, *order], slices)
    earlier = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumns({v: F.coalesce(F.sum(f"_in_{v}").over(earlier), F.lit(0)) for v in values})
    starts = _carried(stored, keys, list(values))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col(SLICE) == F.col(f"_of_{SLICE}")]
    totals = [(F.col(v) + F.coalesce(f"_before_{v}", F.lit(0))).alias(v) for v in values]
    return local.join(F.broadcast(starts), same, "left").select(*df.columns, *totals)


def _carried(stored: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per slice its first key and that key's totals in earlier slices.

    In a range order no other key of a slice has rows before it, and only a slice's last key has rows after it.
    """
    sums = stored.groupBy(SLICE, *keys).agg(*[F.sum(f"_in_{v}").alias(v) for v in names])
    ends = F.struct(F.struct(*keys, F.lit(0).alias("_all")).alias("key"), F.struct(*names).alias("sums"))
    edges = sums.groupBy(SLICE).agg(F.min(ends).alias("first"), F.max(ends).alias("last"))
    rows, before, held = [], None, ()
    for edge in sorted(edges.collect(), key=lambda r: r[SLICE]):
        start = held if before is not None and _same(before, edge["first"]["key"]) else None
        if start:
            rows.append((*edge["first"]["key"][:-1], edge[SLICE], *start))
        total = tuple(edge["last"]["sums"])
        if start and _same(edge["first"]["key"], edge["last"]["key"]):
            total = tuple(a + b for a, b in zip(start, total, strict=True))
        before, held = edge["last"]["key"], total
    types = {f.name: f.dataType for f in sums.schema}
    fields = [(f"_of_{k}", types[k]) for k in [*keys, SLICE]] + [(f"_before_{v}", types[v]) for v in names]
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    return stored.sparkSession.createDataFrame(rows, schema)


def _same(one: Row, other: Row) -> bool:
    return all(a == b or (a != a and b != b) for a, b in zip(one, other, strict=True))
