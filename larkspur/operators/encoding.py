"""Ordinal codes for categorical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import running_totals

UNSEEN = -1


def ordinal_dictionary(train: DataFrame, columns: list[str]) -> DataFrame:
    """Codes 0, 1, ... of the values of each column in their sort order, as (feature, category, code)."""
    cells = train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "category"
    )
    seen = cells.where(F.col("category").isNotNull()).distinct()
    return running_totals(seen, ["feature"], ["category"], {"code": F.lit(1)}).withColumn(
        "code", F.col("code").cast("int")
    )


def ordinal_encode(df: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the values of ``columns`` by their codes; -1 for values without one and for null.

    The dictionary is read from a written table, so its size is known when the join is planned: a
    small one is broadcast, a large one is joined by shuffle.
    """
    for column in columns:
        codes = dictionary.where(F.col("feature") == column).select(
            F.col("category").alias(column), F.col("code").alias("_code")
        )
        df = (
            df.join(codes, column, "left")
            .withColumn(column, F.coalesce("_code", F.lit(UNSEEN)))
            .drop("_code")
        )
    return df
