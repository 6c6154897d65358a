"""Time and profile features of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_features(ts: str) -> dict[str, Column]:
    """Hour, weekday (1 = Sunday) and month of ``ts`` with their flags.

    Hour 11 counts as morning and as lunch.
    """
    hour, weekday = F.hour(ts), F.dayofweek(ts)
    return {
        "hour_of_day": hour,
        "day_of_week": weekday,
        "month": F.month(ts),
        "is_weekend": weekday.isin(1, 7).cast("int"),
        "is_morning": hour.between(6, 11).cast("int"),
        "is_lunch": hour.between(11, 14).cast("int"),
        "is_evening": hour.between(17, 21).cast("int"),
    }


def tenure_days(member: str, ts: str, since: str) -> Column:
    """Calendar days from ``since`` to ``ts`` for members; 0 for others and for unknown."""
    return F.when(F.col(member), F.datediff(ts, since)).otherwise(0)


def known_tier(tier: str) -> Column:
    """The tier if it is one of the four known names, else the text ``None``."""
    return F.when(F.col(tier).isin("Platinum", "Gold", "Silver", "Bronze"), F.col(tier)).otherwise("None")
