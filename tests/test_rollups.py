"""Reports from stored sums equal the reports over all input, in whatever batches it came."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import conversion
from larkspur.plans import rollups
from larkspur.sources.commits import CommitConflict
from tests.helpers import rows_of

FULL = {
    "fare_by_zone": lambda t: conversion.fare_by_zone(t["trips"]),
    "table_counts": lambda t: conversion.table_counts({"fuel": t["fuel"], "store": t["store"]}),
    "conversion_overall": lambda t: conversion.overall_conversion(conversion.label_visits(t["fuel"], t["store"])),
    "conversion_by_tier": lambda t: conversion.conversion_by_tier(conversion.label_visits(t["fuel"], t["store"]), t["customers"]),
    "conversion_by_each": lambda t: conversion.conversion_by_each(
        conversion.label_visits(t["fuel"], t["store"]), "fuel_type", "payment_method"),
    "basket_averages": lambda t: conversion.basket_averages(t["store"]),
    "top_categories": lambda t: conversion.top_categories(t["store"]),
}
NEEDS = {
    "fare_by_zone": ["trips"], "table_counts": ["fuel", "store"], "conversion_overall": ["fuel", "store"],
    "conversion_by_tier": ["fuel", "store", "customers"], "conversion_by_each": ["fuel", "store"],
    "basket_averages": ["store"], "top_categories": ["store"],
}


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "trips": spark.range(60).selectExpr(
            "id AS trip", "nullif(id % 4, 3) AS pickup_zip", "cast(IF(id = 5, NULL, id / 4) AS decimal(18,2)) AS fare_amount"),
        "fuel": spark.range(60).selectExpr(
            "id AS fuel_txn_id", "nullif(id % 7, 6) AS customer_id", "IF(id % 2 = 0, 'a', NULL) AS fuel_type", "concat('p', id % 3) AS payment_method"),
        "store": spark.range(90).selectExpr(
            "id % 45 * 2 AS fuel_txn_id", "id % 45 AS purchase_id", "concat('c', id % 13) AS category",
            "cast(nullif(id % 5, 4) AS int) AS quantity", "cast(id / 8 AS decimal(18,2)) AS line_total"),
        "customers": spark.range(5).selectExpr("id AS customer_id", "element_at(array('Gold', 'Tin', 'Silver', NULL, 'Gold'), cast(id + 1 AS int)) AS loyalty_tier"),
    }


def batch(tables, name, number, of=3):
    """Whole visits and baskets: store lines go with the visit they name."""
    by = {"trips": "trip % {0} = {1}", "fuel": "fuel_txn_id div 2 % {0} = {1}", "store": "fuel_txn_id div 2 % {0} = {1}", "customers": "true"}
    return {t: tables[t].where(by[t].format(of, number)) for t in NEEDS[name]}


def same(spark, folder, name, tables):
    found, expected = rollups.report(spark, folder, name), FULL[name](tables)
    assert sorted(found.columns) == sorted(expected.columns)
    doubles = [F.round(F.col(c).cast("double"), 9).alias(c) if c != "value" and dict(found.dtypes)[c] not in ("string",) else F.col(c) for c in sorted(found.columns)]
    order = lambda rows: sorted(rows, key=repr)
    assert order(rows_of(found.select(*doubles))) == order(rows_of(expected.select(*doubles)))


@pytest.mark.parametrize("name", sorted(rollups.ROLLUPS))
def test_reports_from_batches(spark, tables, tmp_path, name):
    folder = str(tmp_path)
    with pytest.raises(ValueError, match="no batch"):
        rollups.report(spark, folder, name)
    # The second batch first brings the rows of the third, and then its own.
    for number, rows in ((0, 0), (1, 2), (2, 2), (1, 1)):
        rollups.refresh(spark, folder, name, number, **batch(tables, name, rows))
    same(spark, folder, name, tables)
    rollups.fold(spark, folder, name)
    rollups.fold(spark, folder, name)
    same(spark, folder, name, tables)
    assert len(rollups.report(spark, folder, name).inputFiles()) == len(set(rollups.report(spark, folder, name).inputFiles()))
    with pytest.raises(ValueError, match="closed"):
        rollups.refresh(spark, folder, name, 2, **batch(tables, name, 2))
    # An empty batch changes nothing.
    rollups.refresh(spark, folder, name, 3, **{t: df.where("false") if t != "customers" else df for t, df in batch(tables, name, 0).items()})
    same(spark, folder, name, tables)


def test_a_report_reads_no_input(spark, tables, tmp_path):
    """A refresh reads its own batch, and the report only stored sums."""
    path = str(tmp_path / "trips")
    for number in range(2):
        batch(tables, "fare_by_zone", number, 2)["trips"].write.parquet(f"{path}/{number}")
        trips = spark.read.parquet(f"{path}/{number}")
        rollups.refresh(spark, str(tmp_path), "fare_by_zone", number, trips=trips)
        assert all(f"/trips/{number}/" in f for f in trips.inputFiles())
    files = rollups.report(spark, str(tmp_path), "fare_by_zone").inputFiles()
    assert files and all("/fare_by_zone/sums/" in f for f in files)


def test_one_of_two_writers_raises(spark, tables, tmp_path, monkeypatch):
    folder, trips = str(tmp_path), batch(tables, "fare_by_zone", 0)
    plain = rollups.ROLLUPS["fare_by_zone"]

    def slow(trips):
        monkeypatch.setitem(rollups.ROLLUPS, "fare_by_zone", plain)
        rollups.refresh(spark, folder, "fare_by_zone", 1, trips=trips)
        return plain.partial(trips)

    monkeypatch.setitem(rollups.ROLLUPS, "fare_by_zone", rollups.Rollup(plain.keys, plain.sums, slow, plain.finish))
    with pytest.raises(CommitConflict):
        rollups.refresh(spark, folder, "fare_by_zone", 1, **trips)
    expected = conversion.fare_by_zone(trips["trips"])
    assert sorted(rows_of(rollups.report(spark, folder, "fare_by_zone")), key=repr) == sorted(rows_of(expected), key=repr)
