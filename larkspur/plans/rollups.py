"""Reports kept up to date from batches of input.

A report is a few sums per group and what follows from them. Each batch of input is summed once, and its sums are
stored and committed; a report adds the sums of all batches and never reads input again. A batch that runs again
replaces its own sums. Folding replaces the sums of all batches so far by their total, which closes them.

A batch brings whole visits and baskets: fuel transactions together with the store lines that name them, and all lines of a
basket. Profiles count as they are when the batch is summed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.calendar import known_tier
from larkspur.operators.conversion import LABEL, label_visits
from larkspur.sources.commits import CommitLog, Commits


@dataclass(frozen=True)
class Rollup:
    """A report: groups, sums per group, how a batch gives them, and how they give the report."""

    keys: tuple[str, ...]
    sums: tuple[str, ...]
    partial: Callable[..., DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def _fares(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pickup_zip").agg(F.sum("fare_amount").alias("total_fare"))


def _row_counts(**tables: DataFrame) -> DataFrame:
    counts = [t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, t in tables.items()]
    out = counts[0]
    for count in counts[1:]:
        out = out.unionByName(count)
    return out


_VISITS = ("visits", "conversions")


def _visit_sums(labelled: DataFrame, *keys: str) -> DataFrame:
    return labelled.groupBy(*keys).agg(F.count("*").alias("visits"), F.coalesce(F.sum(LABEL), F.lit(0)).alias("conversions"))


def _with_rate(merged: DataFrame) -> DataFrame:
    return merged.withColumn("conversion_rate", F.col("conversions") / F.nullif(F.col("visits"), F.lit(0)))


def _overall(fuel: DataFrame, store: DataFrame) -> DataFrame:
    return _visit_sums(label_visits(fuel, store))


def _by_fuel_and_payment(fuel: DataFrame, store: DataFrame) -> DataFrame:
    """One row per pair; the report has one per value of either."""
    return _visit_sums(label_visits(fuel, store), "fuel_type", "payment_method")


def _each(merged: DataFrame) -> DataFrame:
    sides = [
        merged.groupBy(F.lit(c).alias("dimension"), F.col(c).alias("value")).agg(*[F.sum(s).alias(s) for s in _VISITS])
        for c in ("fuel_type", "payment_method")
    ]
    return _with_rate(sides[0].unionByName(sides[1]))


def _by_tier(fuel: DataFrame, store: DataFrame, customers: DataFrame) -> DataFrame:
    per_customer = _visit_sums(label_visits(fuel, store), "customer_id")
    tiers = per_customer.join(customers.select("customer_id", "loyalty_tier"), "customer_id", "left")
    return tiers.groupBy(known_tier("loyalty_tier").alias("loyalty_tier")).agg(*[F.sum(s).alias(s) for s in _VISITS])


def _baskets(store: DataFrame) -> DataFrame:
    baskets = store.groupBy("purchase_id").agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("items"), F.sum("line_total").alias("value")
    )
    # Averages leave out baskets without a known amount, so those that have one are counted.
    return baskets.agg(
        F.count("*").alias("baskets"), F.sum("lines").alias("lines"), F.sum("items").alias("items"),
        F.count("items").alias("counted"), F.sum("value").alias("value"),
    )


def _basket_averages(merged: DataFrame) -> DataFrame:
    def share(total: str, count: str):
        return F.col(total).cast("double") / F.nullif(F.col(count), F.lit(0))

    return merged.select(
        "baskets", share("lines", "baskets").alias("avg_lines"), share("items", "counted").alias("avg_items"),
        share("value", "baskets").alias("avg_value"),
    )


def _categories(store: DataFrame) -> DataFrame:
    return store.groupBy("category").agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("items"), F.sum("line_total").alias("revenue")
    )


def _top_ten(merged: DataFrame) -> DataFrame:
    return merged.orderBy(F.desc("items"), "category").limit(10)


def _as_is(merged: DataFrame) -> DataFrame:
    return merged


ROLLUPS = {
    "fare_by_zone": Rollup(("pickup_zip",), ("total_fare",), _fares, _as_is),
    "table_counts": Rollup(("table_name",), ("n_rows",), _row_counts, _as_is),
    "conversion_overall": Rollup((), _VISITS, _overall, _with_rate),
    "conversion_by_tier": Rollup(("loyalty_tier",), _VISITS, _by_tier, _with_rate),
    "conversion_by_each": Rollup(("fuel_type", "payment_method"), _VISITS, _by_fuel_and_payment, _each),
    "basket_averages": Rollup((), ("baskets", "lines", "items", "counted", "value"), _baskets, _basket_averages),
    "top_categories": Rollup(("category",), ("lines", "items", "revenue"), _categories, _top_ten),
}


def _log(spark: SparkSession, folder: str, name: str) -> CommitLog:
    return CommitLog(spark, f"{folder}/{name}/commits")


def _path(folder: str, name: str, record: dict) -> str:
    return f"{folder}/{name}/sums/{record['attempt']}"


def _merged(spark: SparkSession, folder: str, name: str, commits: Commits) -> DataFrame:
    """The sums of the last fold and of all batches after it, added up."""
    rollup = ROLLUPS[name]
    records = {r["batch"]: r for r in commits.records}
    held = [*([commits.snapshot] if commits.snapshot else []), *[records[b] for b in sorted(records)]]
    if not held:
        raise ValueError(f"no batch of {name} has been summed in {folder}")
    # Sums of decimals widen when they are added; each batch is read by its own types.
    parts = [spark.read.parquet(_path(folder, name, r)) for r in held]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*rollup.keys).agg(*[F.sum(s).alias(s) for s in rollup.sums])


def refresh(spark: SparkSession, folder: str, name: str, batch: int, **inputs: DataFrame) -> None:
    """Sum a batch of the report ``name`` and commit its sums; of two writers at once one raises."""
    log = _log(spark, folder, name)
    commits = log.read()
    if commits.snapshot and batch <= commits.snapshot["batch"]:
        raise ValueError(f"batch {batch} is closed by the fold of batch {commits.snapshot['batch']}")
    record = {"batch": batch, "attempt": uuid.uuid4().hex}
    ROLLUPS[name].partial(**inputs).write.parquet(_path(folder, name, record))
    log.append(commits.last, record)


def fold(spark: SparkSession, folder: str, name: str) -> None:
    """Replace the sums of all batches by their total, so that a report reads one table again."""
    log = _log(spark, folder, name)
    commits = log.read()
    if commits.records:
        record = {"batch": max(r["batch"] for r in commits.records), "attempt": uuid.uuid4().hex}
        _merged(spark, folder, name, commits).write.parquet(_path(folder, name, record))
        log.append(commits.last, record, snapshot=True)


def report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The report over all batches."""
    return ROLLUPS[name].finish(_merged(spark, folder, name, _log(spark, folder, name).read()))
