"""The feature matrix of the store-visit model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.calendar import calendar_features, known_tier, tenure_days
from larkspur.operators.conversion import LABEL, label_visits, with_profile
from larkspur.operators.history import with_history

# Names and order of the model's inputs.
TRANSACTION_FEATURES = [
    "fuel_type",
    "gallons",
    "price_per_gallon",
    "total_fuel_cost",
    "payment_method",
    "pump_number",
    "loyalty_points_earned",
]
TIME_FEATURES = [
    "hour_of_day",
    "day_of_week",
    "month",
    "is_weekend",
    "is_morning",
    "is_lunch",
    "is_evening",
]
PROFILE_FEATURES = [
    "is_loyalty_member",
    "loyalty_tier",
    "member_tenure_days",
    "preferred_fuel",
    "preferred_fuel_match",
    "near_entrance_pump",
]
HISTORY_FEATURES = [
    "hist_visit_count",
    "hist_avg_gallons",
    "hist_avg_cost",
    "hist_total_loyalty_pts",
    "hist_store_rate",
]
FEATURES = TRANSACTION_FEATURES + TIME_FEATURES + PROFILE_FEATURES + HISTORY_FEATURES
CATEGORICAL = ["fuel_type", "payment_method", "loyalty_tier", "preferred_fuel"]


def with_calendar(visits: DataFrame) -> DataFrame:
    return visits.withColumns(calendar_features("transaction_ts"))


def with_profile_features(visits: DataFrame) -> DataFrame:
    """Profile features; null where the customer is unknown, apart from tenure (0) and tier (``None``)."""
    return visits.withColumns(
        {
            "member_tenure_days": tenure_days("loyalty_member", "transaction_ts", "member_since"),
            "preferred_fuel_match": (F.col("fuel_type") == F.col("preferred_fuel")).cast("int"),
            "near_entrance_pump": (F.col("pump_number") <= 3).cast("int"),
            "is_loyalty_member": F.col("loyalty_member").cast("int"),
            "loyalty_tier": known_tier("loyalty_tier"),
        }
    )


def feature_matrix(fuel: DataFrame, store: DataFrame, customers: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per fuel transaction: id, time, label and the 25 features.

    History comes before the profile join, so a repeated customer row cannot inflate it.
    """
    known = with_profile(with_history(label_visits(fuel, store), slices), customers)
    featured = with_profile_features(with_calendar(known))
    return featured.select("fuel_txn_id", "transaction_ts", LABEL, *FEATURES)
