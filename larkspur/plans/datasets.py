"""Named datasets that read each other by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.conversion import fare_by_zone

Read = Callable[[str], DataFrame]
SAMPLE_ROWS = 5


def trips_sample(read: Read) -> DataFrame:
    """The first five trips by id."""
    return read("trips").orderBy("trip_id").limit(SAMPLE_ROWS)


def zone_totals(read: Read) -> DataFrame:
    """Fares per zone of the sampled trips."""
    return fare_by_zone(read("trips_sample"))


def all_zone_totals(read: Read) -> DataFrame:
    """Fares per zone of all trips."""
    return fare_by_zone(read("trips").select("pickup_zip", F.col("fare_amount")))


DATASETS: dict[str, Callable[[Read], DataFrame]] = {
    "trips_sample": trips_sample,
    "zone_totals": zone_totals,
    "all_zone_totals": all_zone_totals,
}


def build(
    name: str,
    sources: dict[str, DataFrame],
    datasets: dict[str, Callable[[Read], DataFrame]] = DATASETS,
    store: Callable[[str, DataFrame], DataFrame] = lambda _, df: df,
) -> DataFrame:
    """The dataset ``name`` from ``sources``, with what it reads built first.

    ``store`` may write each dataset and return it as read back; each is built once.
    """
    done = dict(sources)

    def read(wanted: str) -> DataFrame:
        if wanted not in done:
            if wanted not in datasets:
                raise KeyError(f"no dataset or source named {wanted}")
            done[wanted] = store(wanted, datasets[wanted](read))
        return done[wanted]

    return read(name)
