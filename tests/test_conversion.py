from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from larkspur.operators.conversion import (
    basket_averages,
    conversion_by,
    conversion_by_each,
    conversion_by_profile,
    conversion_by_tier,
    customer_conversion,
    fare_by_zone,
    overall_conversion,
    repeated_keys,
    store_gap,
    table_counts,
    top_categories,
)
from larkspur.plans.datasets import build
from tests.helpers import rows_of


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        ("a", "Regular", "Cash", 1),
        ("a", "Regular", "Card", 0),
        ("b", None, "Cash", 1),
        ("z", "Diesel", "Cash", 0),
    ]
    return spark.createDataFrame(
        rows, "customer_id string, fuel_type string, payment_method string, went_to_store int"
    )


@pytest.fixture(scope="module")
def customers(spark):
    rows = [("a", "Gold"), ("b", None), ("c", "Gold")]
    return spark.createDataFrame(rows, "customer_id string, loyalty_tier string")


def test_overall(labelled):
    assert rows_of(overall_conversion(labelled)) == [(4, 2, 0.5)]
    assert rows_of(overall_conversion(labelled.limit(0))) == [(0, None, None)]


def test_by_column_and_by_each(labelled):
    assert rows_of(conversion_by(labelled, "payment_method"), "payment_method") == [
        ("Card", 1, 0, 0.0),
        ("Cash", 3, 2, 2 / 3),
    ]
    assert rows_of(conversion_by_each(labelled, "fuel_type", "payment_method"), "dimension", "value") == [
        ("fuel_type", None, 1, 1, 1.0),
        ("fuel_type", "Diesel", 1, 0, 0.0),
        ("fuel_type", "Regular", 2, 1, 0.5),
        ("payment_method", "Card", 1, 0, 0.0),
        ("payment_method", "Cash", 3, 2, 2 / 3),
    ]


def test_by_tier(labelled, customers):
    assert rows_of(conversion_by_profile(labelled, customers, "loyalty_tier"), "loyalty_tier") == [
        (None, 2, 1, 0.5),
        ("Gold", 2, 1, 0.5),
    ]
    assert rows_of(conversion_by_tier(labelled, customers), "loyalty_tier") == [
        ("Gold", 2, 1, 0.5),
        ("None", 2, 1, 0.5),
    ]


@pytest.fixture(scope="module")
def store(spark):
    start = datetime(2025, 1, 1, 10)
    rows = [
        ("P1", "F1", "Snacks", 2, Decimal("3.00"), start + timedelta(minutes=5)),
        ("P1", "F1", "Beverages", 1, Decimal("1.50"), start + timedelta(minutes=5)),
        ("P2", "F2", "Snacks", 1, Decimal("1.50"), start + timedelta(minutes=12, seconds=59)),
        ("P3", "F9", None, 3, Decimal("9.00"), start),
    ]
    return spark.createDataFrame(
        rows,
        "purchase_id string, fuel_txn_id string, category string, quantity int, line_total decimal(9,2), "
        "store_ts timestamp_ntz",
    )


@pytest.fixture(scope="module")
def fuel(spark):
    start = datetime(2025, 1, 1, 10)
    rows = [("F1", "a", start), ("F2", "b", start), ("F3", "b", start)]
    return spark.createDataFrame(rows, "fuel_txn_id string, customer_id string, transaction_ts timestamp_ntz")


def test_baskets_count_once(store):
    assert rows_of(basket_averages(store)) == [(3, 4 / 3, 7 / 3, 5.0)]
    assert rows_of(basket_averages(store.limit(0))) == [(0, None, None, None)]


def test_categories(store):
    got = [(r.category, r.lines, r["items"]) for r in top_categories(store, 2).collect()]
    assert got == [(None, 1, 3), ("Snacks", 2, 3)]


def test_gap_is_per_basket(fuel, store):
    assert rows_of(store_gap(fuel, store)) == [(2, 8.5, 5, 12, 8.5)]
    assert rows_of(store_gap(fuel, store.limit(0))) == [(0, None, None, None, None)]


def test_customers_who_convert(spark, fuel):
    shoppers = spark.createDataFrame([("a",), ("a",), (None,)], "customer_id string")
    assert rows_of(customer_conversion(fuel, shoppers)) == [(2, 1, 50.0)]
    assert rows_of(customer_conversion(fuel.limit(0), shoppers.limit(0))) == [(0, 0, None)]


def test_counts_and_repeats(fuel, store):
    assert rows_of(table_counts({"fuel": fuel, "store": store}), "table_name") == [("fuel", 3), ("store", 4)]
    assert rows_of(repeated_keys(fuel, "customer_id")) == [("b", 2)]


def test_unknown_zip_is_a_zone_and_unknown_fares_are_left_out(spark):
    trips = spark.createDataFrame(
        [("1", 2.0), ("1", None), (None, 3.0), ("2", None)], "pickup_zip string, fare_amount double"
    )
    assert rows_of(fare_by_zone(trips), "pickup_zip") == [(None, 3.0), ("1", 2.0), ("2", None)]


def test_datasets_read_each_other(spark):
    trips = spark.range(20).selectExpr("19 - id AS trip_id", "id % 2 AS pickup_zip", "1.0D AS fare_amount")
    stored = []

    def keep(name, df):
        stored.append(name)
        return df

    totals = build("zone_totals", {"trips": trips}, store=keep)
    assert stored == ["trips_sample", "zone_totals"]
    assert rows_of(totals, "pickup_zip") == [(0, 2.0), (1, 3.0)]
    assert [r[0] for r in rows_of(build("trips_sample", {"trips": trips}))] == [0, 1, 2, 3, 4]
    assert rows_of(build("all_zone_totals", {"trips": trips}), "pickup_zip") == [(0, 10.0), (1, 10.0)]
    with pytest.raises(KeyError):
        build("other", {})
