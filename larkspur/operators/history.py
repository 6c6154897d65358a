"""What was known about a customer before each visit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.conversion import LABEL
from larkspur.operators.ordering import running_totals

_KEY = "customer_id"
_ORDER = ["transaction_ts", "fuel_txn_id"]
# Amounts are added in decimal, so no cut between slices changes a digit.
_AMOUNT = "decimal(18,6)"


def _inputs() -> dict[str, Column]:
    return {
        "hist_visit_count": F.col("fuel_txn_id").isNotNull().cast("bigint"),
        "_gallons": F.col("gallons").cast(_AMOUNT),
        "_gallons_known": F.col("gallons").isNotNull().cast("bigint"),
        "_cost": F.col("total_fuel_cost").cast(_AMOUNT),
        "_cost_known": F.col("total_fuel_cost").isNotNull().cast("bigint"),
        "hist_total_loyalty_pts": F.col("loyalty_points_earned").cast("bigint"),
        "hist_store_visits": F.col(LABEL).cast("bigint"),
    }


def _ratio(total: str, count: str) -> Column:
    return F.when(F.col(count) > 0, F.col(total).cast("double") / F.col(count)).otherwise(0.0)


def _finished(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "hist_avg_gallons": _ratio("_gallons", "_gallons_known"),
            "hist_avg_cost": _ratio("_cost", "_cost_known"),
            "hist_store_rate": _ratio("hist_store_visits", "hist_visit_count"),
        }
    ).drop("_gallons", "_gallons_known", "_cost", "_cost_known")


def with_history(visits: DataFrame, slices: int | None = None) -> DataFrame:
    """Add the ``hist_`` columns, computed from strictly earlier visits of the same customer.

    Visits at the same moment are ordered by transaction id. The order by customer and time is cut into slices of
    equal size, so a customer may have any number of visits; the result is the same for any number of slices.
    """
    return _finished(running_totals(visits, [_KEY], _ORDER, _inputs(), slices))
