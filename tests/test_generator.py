import pytest
from pyspark.sql import functions as F

from larkspur.plans.generator import (
    GeneratorSettings,
    check_generated,
    conversion_summary,
    generate_customers,
    generate_fuel_transactions,
    generate_store_purchases,
    row_numbers,
)
from larkspur.sources.schemas import CUSTOMERS, FUEL_TRANSACTIONS, STORE_PURCHASES
from tests.helpers import rows_of

SMALL = GeneratorSettings(customers=50, fuel_transactions=600)


def tables(spark, settings=SMALL, partitions=3):
    visits = row_numbers(spark, settings.fuel_transactions).repartition(partitions)
    people = row_numbers(spark, settings.customers).repartition(partitions)
    return (
        generate_customers(people, settings),
        generate_fuel_transactions(visits, settings),
        generate_store_purchases(visits, settings, slices=partitions),
    )


def types(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def test_schemas(spark):
    for df, schema in zip(tables(spark), (CUSTOMERS, FUEL_TRANSACTIONS, STORE_PURCHASES)):
        assert types(df.schema) == types(schema)


def test_rules_hold(spark):
    assert {r.violations for r in check_generated(*tables(spark)).collect()} == {0}


def test_a_broken_rule_is_found(spark):
    customers, fuel, store = tables(spark)
    broken = fuel.withColumn("loyalty_points_earned", F.col("loyalty_points_earned") + 1)
    found = {r.rule: r.violations for r in check_generated(customers, broken, store).collect()}
    assert found["loyalty points"] == 600
    missing = fuel.where("fuel_txn_id <> 'FUEL-0000001'")
    found = {r.rule: r.violations for r in check_generated(customers.limit(0), missing, store).collect()}
    assert found["customer exists"] == 599


def test_same_rows_for_any_partitioning(spark):
    for one, many in zip(tables(spark, partitions=1), tables(spark, partitions=8)):
        key = one.columns[0]
        assert rows_of(one, key) == rows_of(many, key)


def test_seed_changes_rows(spark):
    other = GeneratorSettings(customers=50, fuel_transactions=600, seed=7)
    assert rows_of(tables(spark)[1], "fuel_txn_id") != rows_of(tables(spark, other)[1], "fuel_txn_id")


def test_ids_are_dense_and_ordered(spark):
    store = tables(spark)[2].orderBy("store_item_id").collect()
    assert [r.store_item_id for r in store] == [f"ITEM-{i + 1:08d}" for i in range(len(store))]
    baskets = list(dict.fromkeys(r.purchase_id for r in store))
    assert baskets == [f"STORE-{i + 1:07d}" for i in range(len(baskets))]
    visits = list(dict.fromkeys(r.fuel_txn_id for r in store))
    assert visits == sorted(visits)


def test_shares(spark):
    settings = GeneratorSettings(customers=500, fuel_transactions=20_000)
    customers, fuel, store = tables(spark, settings)
    summary = conversion_summary(customers, fuel, store).first()
    assert (summary.customers, summary.fuel_transactions) == (500, 20_000)
    assert summary.conversion_pct == pytest.approx(100)
    assert store.select("purchase_id").distinct().count() / 20_000 == pytest.approx(0.38, abs=0.02)
    assert summary.store_line_items / 20_000 == pytest.approx(0.38 * 2.5, abs=0.05)
    share = store.agg(F.avg((F.col("category") == "Beverages").cast("int"))).first()[0]
    assert share == pytest.approx(0.35, abs=0.02)
    assert customers.agg(F.avg(F.col("loyalty_member").cast("int"))).first()[0] == pytest.approx(0.6, abs=0.06)
    bounds = fuel.agg(F.min("gallons"), F.max("gallons"), F.min("pump_number"), F.max("pump_number")).first()
    assert bounds[0] >= 3 and bounds[1] <= 20 and tuple(bounds[2:]) == (1, 12)


def test_brand_names_the_house_methods():
    assert GeneratorSettings(brand="Acme").payment_methods == (
        "Credit Card",
        "Debit Card",
        "Acme Gift Card",
        "Acme Rewards",
        "Cash",
    )
