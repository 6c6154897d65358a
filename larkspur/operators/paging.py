"""Pages of an ordered frame.

A table that is paged often is stored in its page order by :func:`store_order`: files of a fixed number of rows, each of which
knows its place. A page then reads the one or two files that hold it, at any offset and after any key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.arguments import DEFAULT_LIMIT, MAX_LIMIT, check_page
from larkspur.operators.ordering import number_rows

# Up to this row the queue of `page` stays short; pages beyond it are found by numbering.
SHALLOW = 10_000
# Rows of a file of a stored order, and names of its parts.
FILE_ROWS = 100_000
_ROW, _FILE = "_row", "_file"


def page(
    df: DataFrame,
    key: str,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    order: list[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """``limit`` rows from row ``offset`` on in the order of ``order`` and then ``key``.

    Every task hands its first offset + limit rows to one that merges them, so rows beyond ``SHALLOW`` are
    left to :func:`deep_page`.
    """
    check_page(limit, offset)
    if offset + limit > SHALLOW:
        return deep_page(df, key, limit, offset, order, descending)
    return df.orderBy(*_sorting(key, order, descending)).offset(offset).limit(limit)


def _sorting(key: str, order: list[str] | None, descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in [*(order or []), key]]


def page_after(df: DataFrame, key: str, last, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The page that follows key value ``last``; ``None`` gives the first page.

    The bound goes into the scan, so the cost does not grow with the depth of the page.
    """
    check_page(limit, 0)
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def deep_page(
    df: DataFrame,
    key: str,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    order: list[str] | None = None,
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """The rows of :func:`page` for any offset, null and repeated keys included.

    Rows are numbered in parallel instead of being skipped in a queue.
    """
    check_page(limit, offset)
    columns = [*(order or []), key]
    numbered = number_rows(df, columns, "_row", 0, descending, slices)
    wanted = numbered.where(F.col("_row").between(offset, offset + limit - 1))
    return wanted.orderBy("_row").drop("_row")


def store_order(
    df: DataFrame,
    path: str,
    key: str,
    order: list[str] | None = None,
    descending: bool = False,
    file_rows: int = FILE_ROWS,
    slices: int | None = None,
) -> None:
    """Write ``df`` to ``path`` in the order of ``order`` and then ``key``, in files of ``file_rows`` rows.

    Rows are numbered in parallel and dealt to their files by number, so no file depends on the distribution
    of keys. The index has one row per file: number, rows, and the first row's columns of the order.
    """
    if file_rows < MAX_LIMIT:
        raise ValueError(f"file_rows must be at least {MAX_LIMIT}, so that a page lies in two files")
    columns = [*(order or []), key]
    numbered = number_rows(df, columns, _ROW, 0, descending, slices)
    dealt = numbered.withColumn(_FILE, F.expr(f"{_ROW} div {file_rows}"))
    dealt.repartition(_FILE).sortWithinPartitions(_FILE, _ROW).write.partitionBy(_FILE).parquet(f"{path}/rows")
    df.limit(0).write.parquet(f"{path}/columns")
    stored = df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    first = F.min_by(F.struct(*columns), _ROW).alias("first")
    index = stored.groupBy(_FILE).agg(F.count("*").alias("rows"), first)
    index = index.withColumns({"file_rows": F.lit(file_rows), "descending": F.lit(descending)})
    index.coalesce(1).sortWithinPartitions(_FILE).write.parquet(f"{path}/index")


def order_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a stored order."""
    return spark.read.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """Rows of some files with their numbers; the other files are not even listed."""
    empty = spark.read.parquet(f"{path}/columns")
    schema = empty.withColumn(_ROW, F.lit(0).cast("bigint")).schema
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{_FILE}={n}" for n in numbers])


def stored_page(spark: SparkSession, path: str, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """The rows of :func:`page` from a stored order."""
    check_page(limit, offset)
    index = order_index(spark, path)
    one = index.select("file_rows").first()
    first, last = (offset // one[0], (offset + limit - 1) // one[0]) if one else (0, -1)
    numbers = [r[0] for r in index.where(F.col(_FILE).between(first, last)).select(_FILE).collect()]
    rows = _files(spark, path, numbers).where(F.col(_ROW).between(offset, offset + limit - 1))
    return rows.orderBy(_ROW).drop(_ROW)


def stored_page_after(spark: SparkSession, path: str, last: tuple | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The page that follows the row whose columns of the order are ``last``; ``None`` gives the first page.

    ``last`` need not be there itself; rows that are equal to it in all these columns count as seen. The index tells the
    file in which rows after it start.
    """
    check_page(limit, 0)
    if last is None:
        return stored_page(spark, path, limit)
    index = order_index(spark, path)
    kinds = index.schema["first"].dataType.fields
    place = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, kinds, strict=True)])
    descending = F.col("descending")
    # The last file that starts at or before that row, and the one after it.
    starts_before = F.when(descending, F.col("first") >= place).otherwise(F.col("first") <= place)
    at = index.where(starts_before).agg(F.max(_FILE)).first()[0]
    numbers = [r[0] for r in index.where(F.col(_FILE).between(at or 0, (at or 0) + 1)).select(_FILE).collect()]
    down = any(r[0] for r in index.select("descending").limit(1).collect())
    rows = _files(spark, path, numbers)
    own = F.struct(*[F.col(f.name) for f in kinds])
    return rows.where(own < place if down else own > place).orderBy(_ROW).limit(limit).drop(_ROW)
