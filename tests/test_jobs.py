import pytest

from larkspur.jobs import generate_tables, preview_table, refresh_datasets, train_and_score
from larkspur.operators.conversion import label_visits
from larkspur.plans.generator import GeneratorSettings
from larkspur.plans.training import ModelSettings
from larkspur.sources.sinks import overwrite_table
from larkspur.sources.tables import list_table_names, read_conversion_tables, read_table, use_namespace
from tests.helpers import operators_in


@pytest.fixture(scope="module")
def station(spark):
    summary = generate_tables(spark, "station", GeneratorSettings(customers=100, fuel_transactions=1_500))
    return summary.first()


def test_generated_tables(spark, station):
    assert (station.customers, station.fuel_transactions) == (100, 1_500)
    names = [r[0] for r in list_table_names(spark, "station").collect()]
    assert {"customers", "fuel_transactions", "store_purchases"} <= set(names)


def test_train_and_score(spark, station, tmp_path):
    for _ in range(2):
        result = train_and_score(spark, "station", ModelSettings(rounds=2, depth=2), str(tmp_path))
    assert result["predictions"].count() == 1_500
    assert result["predictions"].select("fuel_txn_id").distinct().count() == 1_500
    assert sum(r.n_rows for r in result["split"].collect()) == 1_500
    metrics = {r.metric: r.value for r in result["metrics"].collect()}
    assert set(metrics) == {"roc_auc", "f1", "precision", "recall", "accuracy"}
    assert 0.3 < metrics["roc_auc"] < 0.7
    assert result["top_drivers"].count() == 10
    for report in ("feature_importance", "contribution_importance"):
        assert spark.read.option("header", True).csv(str(tmp_path / report)).count() == 25


def test_repeated_customers_are_refused(spark, station):
    fuel = read_table(spark, "station.fuel_transactions")
    for name in ("fuel_transactions", "store_purchases"):
        spark.sql("CREATE SCHEMA IF NOT EXISTS doubled")
        overwrite_table(read_table(spark, f"station.{name}"), f"doubled.{name}")
    customers = read_table(spark, "station.customers")
    overwrite_table(customers.union(customers), "doubled.customers")
    assert fuel.count() == 1_500
    with pytest.raises(ValueError):
        train_and_score(spark, "doubled")


def test_preview(spark, station, capsys):
    try:
        df = preview_table(spark, "fuel_transactions", "station", "spark_catalog", 3)
    finally:
        use_namespace(spark, "default")
    assert df.count() > 5
    assert "only showing top 3 rows" in capsys.readouterr().out


def test_datasets_as_tables(spark, station):
    trips = spark.range(30).selectExpr("id AS trip_id", "id % 3 AS pickup_zip", "2.0D AS fare_amount")
    overwrite_table(trips, "station.trips")
    for _ in range(2):
        refresh_datasets(spark, "station.trips", "zones")
    assert read_table(spark, "zones.trips_sample").count() == 5
    totals = {r.pickup_zip: r.total_fare for r in read_table(spark, "zones.zone_totals").collect()}
    assert totals == {0: 4.0, 1: 4.0, 2: 2.0}
    assert read_table(spark, "zones.all_zone_totals").count() == 3


def test_label_join_of_bucketed_tables_needs_no_shuffle(spark):
    generate_tables(spark, "bucketed", GeneratorSettings(customers=10, fuel_transactions=200), buckets=4)
    fuel, _, store = read_conversion_tables(spark, "bucketed")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labelled = label_visits(fuel, store)
        assert "Exchange" not in operators_in(labelled)
        assert labelled.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
