"""Visit labels and conversion reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.calendar import known_tier
from larkspur.operators.ordering import running_totals

LABEL = "went_to_store"


def label_visits(fuel: DataFrame, store: DataFrame) -> DataFrame:
    """Fuel rows with 1 if any store line names them, else 0; the row count stays the same."""
    named = store.groupBy(F.col("fuel_txn_id").alias("_named")).agg(F.count("*").alias("_lines"))
    matched = fuel.join(named, F.col("fuel_txn_id") == F.col("_named"), "left_outer")
    return matched.select(*fuel.columns, F.col("_lines").isNotNull().cast("int").alias(LABEL))


def with_profile(visits: DataFrame, customers: DataFrame) -> DataFrame:
    """Visits with the profile columns of their customer, null where the customer is unknown.

    A customer with very many visits is one row on the right; adaptive execution splits the visits on the left.
    """
    return visits.join(_profiles(customers), "customer_id", "left")


def _profiles(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "loyalty_member", "loyalty_tier", "member_since", "preferred_fuel"
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def _conversion() -> list[Column]:
    return [
        F.count("*").alias("visits"),
        F.sum(LABEL).alias("conversions"),
        F.avg(LABEL).alias("conversion_rate"),
    ]


def overall_conversion(labelled: DataFrame) -> DataFrame:
    """Share of fuel visits that went on to the store."""
    return labelled.agg(*_conversion())


def conversion_by(labelled: DataFrame, *columns: str) -> DataFrame:
    return labelled.groupBy(*columns).agg(*_conversion())


def conversion_by_profile(
    labelled: DataFrame, profiles: DataFrame, column: str, group: Column | None = None
) -> DataFrame:
    """Conversion by a column of the customer, or by ``group``, an expression over that column.

    Visits of unknown customers have a null in the column. Visits are summed per customer before they
    meet the profiles, so a customer with very many visits is one row in the join.
    """
    per_customer = labelled.groupBy("customer_id").agg(
        F.count("*").alias("visits"), F.sum(LABEL).alias("conversions")
    )
    visits, conversions = F.sum("visits"), F.sum("conversions")
    return (
        per_customer.join(profiles.select("customer_id", column), "customer_id", "left")
        .groupBy((F.col(column) if group is None else group).alias(column))
        .agg(
            visits.alias("visits"),
            conversions.alias("conversions"),
            (conversions / visits).alias("conversion_rate"),
        )
    )


def conversion_by_tier(labelled: DataFrame, customers: DataFrame) -> DataFrame:
    """Conversion by known loyalty tier, with all else under ``None``."""
    return conversion_by_profile(labelled, customers, "loyalty_tier", known_tier("loyalty_tier"))


def conversion_by_each(labelled: DataFrame, *columns: str) -> DataFrame:
    """Conversion by each column on its own, in one pass over the rows."""
    dimension = F.element_at(
        F.array(*[F.lit(c) for c in columns]),
        reduce(
            lambda rest, i: F.when(F.grouping(columns[i]) == 0, i + 1).otherwise(rest),
            range(len(columns)),
            F.lit(1),
        ),
    )
    return (
        labelled.groupingSets([[c] for c in columns], *columns)
        .agg(dimension.alias("dimension"), F.coalesce(*columns).alias("value"), *_conversion())
        .select("dimension", "value", "visits", "conversions", "conversion_rate")
    )


def basket_averages(store: DataFrame) -> DataFrame:
    """Mean items, lines and value of a basket.

    Baskets are summed first: the basket total repeats on every line of a basket.
    """
    baskets = store.groupBy("purchase_id").agg(
        F.count("*").alias("lines"),
        F.sum("quantity").alias("items"),
        F.sum("line_total").alias("value"),
    )
    return baskets.agg(
        F.count("*").alias("baskets"),
        F.avg("lines").alias("avg_lines"),
        F.avg("items").alias("avg_items"),
        (F.sum("value").cast("double") / F.nullif(F.count("*"), F.lit(0))).alias("avg_value"),
    )


def top_categories(store: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` categories with the most items sold, ties by name."""
    return (
        store.groupBy("category")
        .agg(
            F.count("*").alias("lines"),
            F.sum("quantity").alias("items"),
            F.sum("line_total").alias("revenue"),
        )
        .orderBy(F.desc("items"), "category")
        .limit(k)
    )


def store_gap(fuel: DataFrame, store: DataFrame) -> DataFrame:
    """Minutes from fuelling to store entry, one value per basket.

    Baskets are counted per minute; the exact median is found by the totals before each minute.
    """
    entries = store.groupBy("purchase_id", "fuel_txn_id").agg(F.min("store_ts").alias("store_ts"))
    gap = F.timestamp_diff("MINUTE", F.col("transaction_ts"), F.col("store_ts"))
    per_gap = (
        entries.join(fuel.select("fuel_txn_id", "transaction_ts"), "fuel_txn_id")
        .groupBy(gap.alias("gap"))
        .agg(F.count("*").alias("n"))
        .where(F.col("gap").isNotNull())
    )
    placed = running_totals(per_gap, [], ["gap"], {"before": F.col("n")})
    placed = placed.withColumn("total", placed.agg(F.sum("n").alias("total")).scalar())

    def gap_at(place: str) -> Column:
        here = F.expr(f"before <= {place} AND before + n > {place}")
        return F.max(F.when(here, F.col("gap")))

    baskets = F.sum("n")
    return placed.agg(
        F.coalesce(baskets, F.lit(0)).alias("baskets"),
        (F.sum(F.col("gap") * F.col("n")) / baskets).alias("avg_minutes"),
        F.min("gap").alias("min_minutes"),
        F.max("gap").alias("max_minutes"),
        ((gap_at("(total - 1) div 2") + gap_at("total div 2")) / 2).alias("median_minutes"),
    )


def customer_conversion(fuel: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct customers who fuelled, who shopped, and the second as a percentage of the first.

    Both sides are counted in one grouping by customer, so no join is needed.
    """
    seen = fuel.select("customer_id", F.lit(1).alias("fuelled"), F.lit(0).alias("shopped")).unionByName(
        store.select("customer_id", F.lit(0).alias("fuelled"), F.lit(1).alias("shopped"))
    )
    per_customer = (
        seen.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.max("fuelled").alias("fuelled"), F.max("shopped").alias("shopped"))
    )
    fuelled, shopped = F.coalesce(F.sum("fuelled"), F.lit(0)), F.coalesce(F.sum("shopped"), F.lit(0))
    return per_customer.agg(
        fuelled.alias("unique_pumpers"),
        shopped.alias("store_shoppers"),
        (shopped / F.nullif(fuelled, F.lit(0)) * 100).alias("conversion_pct"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Name and row count of each table."""
    counts = [t.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def fare_by_zone(trips: DataFrame) -> DataFrame:
    """Sum of fares per pickup zip; an unknown zip is a zone of its own."""
    return trips.groupBy("pickup_zip").agg(F.sum("fare_amount").alias("total_fare"))
