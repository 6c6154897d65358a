"""Listing, review and destination queries: search, lookups, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.arguments import DEFAULT_LIMIT, check_not_negative
from larkspur.functions.predicates import (
    at_least_if_given,
    at_most_if_given,
    equals_if_given,
    where_all,
)
from larkspur.operators.paging import page


def matching_listings(
    properties: DataFrame,
    property_type: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    min_bedrooms: int | None = None,
) -> DataFrame:
    """Listings that meet all given filters; bounds are inclusive.

    An empty ``property_type`` is no filter, a price of 0 is one. Unknown cells never match.
    """
    check_not_negative(min_price=min_price, max_price=max_price, min_bedrooms=min_bedrooms)
    return where_all(
        properties,
        equals_if_given("property_type", property_type or None)
        + at_least_if_given("base_price", min_price)
        + at_most_if_given("base_price", max_price)
        + at_least_if_given("bedrooms", min_bedrooms),
    )


def search_listings(
    properties: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **filters
) -> DataFrame:
    """One page of :func:`matching_listings`."""
    return page(matching_listings(properties, **filters), "property_id", limit, offset)


def count_by_type(properties: DataFrame) -> DataFrame:
    """Listings per type, most frequent first, ties by name."""
    return (
        properties.groupBy("property_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "property_type")
    )


def active_reviews(reviews: DataFrame, property_id: int | None = None) -> DataFrame:
    """Reviews marked as not deleted; an unknown mark does not count as active."""
    return where_all(reviews, [~F.col("is_deleted"), *equals_if_given("property_id", property_id)])


def find_by_key(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One row per distinct requested key that exists.

    Should the table hold a key more than once, the smallest row by its columns is taken, so the
    answer does not depend on partitioning.
    """
    columns = [F.col(c) for c in table.columns if c != key]
    wanted = requests.select(key).distinct()
    return (
        table.join(wanted, key, "left_semi")
        .groupBy(key)
        .agg(F.min(F.struct(*columns)).alias("_row"))
        .select(*[key if c == key else F.col("_row")[c].alias(c) for c in table.columns])
    )


def missing_keys(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Distinct requested keys that the table does not hold."""
    return requests.select(key).distinct().join(table.select(key), key, "left_anti")
