from pyspark.pipelines.graph_element_registry import (
    GraphElementRegistry,
    graph_element_registration_context,
)

from larkspur.plans.datasets import DATASETS
from larkspur.plans.declarative import define
from larkspur.sources.sinks import overwrite_table
from larkspur.sources.tables import use_namespace
from tests.helpers import rows_of


class Collected(GraphElementRegistry):
    def __init__(self):
        self.outputs, self.flows = [], {}

    def register_output(self, output):
        self.outputs.append(output.name)

    def register_flow(self, flow):
        self.flows[flow.target] = flow.func

    def register_sql(self, sql_text, file_path):
        raise NotImplementedError


def test_views_read_each_other_by_name(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS pipeline")
    trips = spark.range(20).selectExpr("id AS trip_id", "id % 2 AS pickup_zip", "1.0D AS fare_amount")
    overwrite_table(trips, "pipeline.trips")
    collected = Collected()
    with graph_element_registration_context(collected):
        define("pipeline.trips", spark)
    assert collected.outputs == list(DATASETS)
    use_namespace(spark, "pipeline")
    try:
        for name in collected.outputs:
            overwrite_table(collected.flows[name](), f"pipeline.{name}")
        assert rows_of(spark.read.table("zone_totals"), "pickup_zip") == [(0, 3.0), (1, 2.0)]
        assert rows_of(spark.read.table("all_zone_totals"), "pickup_zip") == [(0, 10.0), (1, 10.0)]
    finally:
        use_namespace(spark, "default")
