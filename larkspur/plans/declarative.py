"""The datasets as materialized views of a Spark declarative pipeline.

A pipeline source file calls ``define`` with the name of the trips table; Spark finds out which view
reads which, and refreshes them in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import pipelines
from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.datasets import DATASETS, Read


def define(trips: str, spark: SparkSession | None = None) -> None:
    """Define one view per dataset over the table ``trips``."""

    def read(name: str) -> DataFrame:
        session = spark or SparkSession.active()
        return session.read.table(trips if name == "trips" else name)

    def query(dataset: Callable[[Read], DataFrame]) -> Callable[[], DataFrame]:
        def rows() -> DataFrame:
            return dataset(read)

        return rows

    for name, dataset in DATASETS.items():
        comment = (dataset.__doc__ or "").strip()
        pipelines.materialized_view(name=name, comment=comment, format="parquet")(query(dataset))
