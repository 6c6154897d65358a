"""Optional conjunctive filters as Columns; values are literals, never SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals_if_given(column: str, value) -> list[Column]:
    return [] if value is None else [F.col(column) == F.lit(value)]


def at_least_if_given(column: str, value) -> list[Column]:
    return [] if value is None else [F.col(column) >= F.lit(value)]


def at_most_if_given(column: str, value) -> list[Column]:
    return [] if value is None else [F.col(column) <= F.lit(value)]


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows that meet every condition; all rows when there is none."""
    return df.where(reduce(Column.__and__, conditions)) if conditions else df
