
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.calendar import calendar_features
from larkspur.functions.hashing import digest, draw
from larkspur.jobs import PREDICTIONS, train_and_score
from larkspur.operators import bookings, conversion, encoding, listings, metrics, paging
from larkspur.operators.history import with_history
from larkspur.plans import datasets, features, generator, rollups, training
from larkspur.plans.booking_log import cancel_bookings, create_bookings, read_bookings, snapshot_bookings
from larkspur.session import materialise, scratch_path
from larkspur.sources import sinks
from larkspur.sources.adapters import CUTOFF, EVENT_TYPES, PAYMENTS, Entities
from larkspur.sources.layout import find_stored, missing_stored, overwrite_keyed_table, write_on_curve
from larkspur.sources.schemas import BOOKING_REQUESTS, BOOKINGS
from larkspur.sources.tables import (
    LABEL_BUCKETS,
    list_table_names,
    read_conversion_tables,
    read_fixture,
    read_table,
    use_namespace,
)
from larkspur.streaming.booking_intake import read_checked, read_requests, store_checked

# The operators on training data and the pipeline made of them can be left out as a whole.
try:
    import corpus_pipeline
    from larkspur.llm import queries as training_data
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "larkspur.llm"):
        raise
    corpus_pipeline = training_data = None

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
MODEL = training.ModelSettings(cutoff=CUTOFF)
CHECK_SCHEMA, KEYED_SCHEMA, GENERATED_SCHEMA = "larkspur_check", "larkspur_keyed", "larkspur_generated"
KEPT_SCHEMA = "larkspur_kept"


def entry(spark: SparkSession) -> DataFrame:
    """Visit-level conversion by loyalty tier at the smallest scale."""
    return queries()["conversion_by_tier"](spark, "/root/testdata/sf0.001")


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Listings, reviews, destinations


def listing_lookup_hits(e: Entities) -> DataFrame:
    wanted = e.table("events").select(F.col("event_id").alias("property_id"))
    return listings.find_by_key(wanted, e.properties, "property_id")


def listing_lookup_misses(e: Entities) -> DataFrame:
    wanted = e.table("events").select(F.col("event_id").alias("property_id"))
    return listings.missing_keys(wanted, e.properties, "property_id")


def listing_keyed_hits(e: Entities) -> DataFrame:
    """The lookup from a table bucketed by its key: many keys are joined bucket by bucket."""
    wanted = e.table("events").select(F.col("event_id").alias("property_id"))
    return find_stored(wanted, _keyed_listings(e), "property_id")


def listing_keyed_misses(e: Entities) -> DataFrame:
    wanted = e.table("events").select(F.col("event_id").alias("property_id"))
    return missing_stored(wanted, _keyed_listings(e), "property_id")


def listing_keyed_few(e: Entities) -> DataFrame:
    """A lookup of few keys, which becomes a filter on buckets and Bloom filters: the keys of the regions, times seven."""
    wanted = e.table("region").select((F.col("r_regionkey") * 7).alias("property_id"))
    return find_stored(wanted, _keyed_listings(e), "property_id")


def _keyed_listings(e: Entities) -> DataFrame:
    sinks.create_schema(e.spark, KEYED_SCHEMA)
    name = f"{KEYED_SCHEMA}.properties"
    overwrite_keyed_table(e.properties, name, "property_id", 8, scratch_path(e.spark, "properties"))
    return read_table(e.spark, name)


def _listings_on_curve(e: Entities) -> DataFrame:
    path = scratch_path(e.spark, "curve")
    write_on_curve(e.properties, path, ["property_type", "base_price", "bedrooms"])
    return e.spark.read.parquet(path)


def booking_curve_list(e: Entities) -> DataFrame:
    """The bookings of a user from a table on a curve over property and user."""
    path = scratch_path(e.spark, "curve")
    write_on_curve(e.bookings, path, ["property_id", "user_id"])
    found = bookings.list_bookings(e.spark.read.parquet(path), user_id=7, limit=100)
    return _as_double(found, "total_price")


def listing_stored_page(e: Entities) -> DataFrame:
    """A page from the listings stored in their page order."""
    path = scratch_path(e.spark, "listings")
    paging.store_order(e.properties, path, "property_id")
    return paging.stored_page(e.spark, path, 100, 90)


def listing_stored_page_after(e: Entities) -> DataFrame:
    path = scratch_path(e.spark, "listings")
    paging.store_order(e.properties, path, "property_id")
    return paging.stored_page_after(e.spark, path, (59,), 20)


def _fares(df: DataFrame) -> DataFrame:
    return _as_double(df, "total_fare")


def _dataset(name: str) -> Callable[[Entities], DataFrame]:
    return lambda e: datasets.build(name, {"trips": e.trips})


# Conversion


def _labelled(e: Entities) -> DataFrame:
    return conversion.label_visits(e.fuel, e.store)


def conversion_by_tier(e: Entities) -> DataFrame:
    return conversion.conversion_by_tier(_labelled(e), e.customers)


def top_categories(e: Entities) -> DataFrame:
    return _as_double(conversion.top_categories(e.categorised_store), "revenue")


def _profiled(e: Entities) -> DataFrame:
    return features.with_profile_features(conversion.with_profile(e.fuel, e.customers))


def profile_features(e: Entities) -> DataFrame:
    return _profiled(e).select("fuel_txn_id", *features.PROFILE_FEATURES)


def time_features(e: Entities) -> DataFrame:
    names = list(calendar_features("transaction_ts"))
    return features.with_calendar(e.fuel).select("fuel_txn_id", *names)


def history_features(e: Entities) -> DataFrame:
    names = [*features.HISTORY_FEATURES, "hist_store_visits"]
    return with_history(_labelled(e)).select("fuel_txn_id", *names)


def history_features_sliced(e: Entities) -> DataFrame:
    """The same result from another number of slices."""
    names = [*features.HISTORY_FEATURES, "hist_store_visits"]
    return with_history(_labelled(e), 16).select("fuel_txn_id", *names)


def feature_matrix(e: Entities) -> DataFrame:
    matrix = features.feature_matrix(e.fuel, e.store, e.customers)
    return _as_double(matrix, "gallons", "total_fuel_cost")


# Bookings


def booking_valid(e: Entities) -> DataFrame:
    return _as_double(bookings.valid_requests(e.booking_requests), "total_price")


def booking_defaults(e: Entities) -> DataFrame:
    """Requests without a time, number of guests or price get the defaults of a new booking."""
    key = F.col("request_id")
    requests = e.booking_requests.withColumns({
        "created_at": F.when(key % 3 != 0, F.col("created_at")),
        "total_price": F.when(key % 7 != 0, F.col("total_price")),
    })
    return _as_double(bookings.valid_requests(requests, datetime(2025, 5, 1, 12)), "total_price")


def table_kept(e: Entities) -> DataFrame:
    """A stored table that is to be created if it is absent stays, and one that is absent has the given columns."""
    sinks.create_schema(e.spark, KEPT_SCHEMA)
    for name in ("destinations", "bookings"):
        e.spark.sql(f"DROP TABLE IF EXISTS {KEPT_SCHEMA}.{name}")
    sinks.overwrite_table(e.destinations, f"{KEPT_SCHEMA}.destinations", scratch_path(e.spark, "destinations"))
    for name in ("destinations", "bookings"):
        sinks.create_table_if_absent(e.spark, f"{KEPT_SCHEMA}.{name}", BOOKINGS, scratch_path(e.spark, name))
    kept = read_table(e.spark, f"{KEPT_SCHEMA}.destinations")
    created = read_table(e.spark, f"{KEPT_SCHEMA}.bookings")
    return kept.unionByName(
        created.selectExpr("booking_id AS destination_id", "status AS name", "CAST(check_in AS string) AS region")
    )


def listing_types_ranked(e: Entities) -> DataFrame:
    """The types with their places in the report's order; there are few of them."""
    ranked = listings.count_by_type(e.properties).withColumn("_at", F.monotonically_increasing_id())
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("_at"))).drop("_at")


def json_fixture_array(e: Entities) -> DataFrame:
    """The listings as one array over many lines, and loaded again."""
    path = scratch_path(e.spark, "properties.json")
    line = F.to_json(F.struct(*e.properties.columns))
    places = Window.orderBy("property_id")
    # A fixture is one file; the tables of listings are small.
    rows = e.properties.select("property_id", line.alias("line"), F.row_number().over(places).alias("n"), F.count("*").over(Window.partitionBy()).alias("of"))
    opened = F.concat(F.when(F.col("n") == 1, "[\n").otherwise(""), "line", F.when(F.col("n") == F.col("of"), "\n]").otherwise(","))
    rows.select(opened.alias("value"), "n").orderBy("n").select("value").coalesce(1).write.text(path)
    return read_fixture(e.spark, path, e.properties.schema)


def booking_numbered(e: Entities) -> DataFrame:
    numbered = bookings.number_bookings(bookings.valid_requests(e.booking_requests))
    return _as_double(numbered, "total_price")


def booking_rejects(e: Entities) -> DataFrame:
    return bookings.rejected_requests(e.booking_requests).select("request_id", bookings.REASON)


def booking_current_state(e: Entities) -> DataFrame:
    return _as_double(bookings.current_bookings(e.bookings, e.cancellations), "total_price")


def booking_stored_page(e: Entities) -> DataFrame:
    """A page far into all bookings, newest first, from their stored order."""
    path = scratch_path(e.spark, "bookings")
    paging.store_order(e.bookings, path, "booking_id", ["created_at"], descending=True)
    return _as_double(paging.stored_page(e.spark, path, 100, 700), "total_price")


def booking_lookup(e: Entities) -> DataFrame:
    return _as_double(listings.find_by_key(e.lookups, e.bookings, "booking_id"), "total_price")


def _booking_log(e: Entities, batches: tuple[int, ...]) -> DataFrame:
    log = scratch_path(e.spark, "log")
    early = F.col("created_at") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    for batch in batches:
        create_bookings(e.booking_requests.where(early if batch == 1 else ~early), log, batch)
    cancel_bookings(e.cancellations, log, 2)
    return _as_double(read_bookings(e.spark, log), "total_price")


def booking_batches(e: Entities) -> DataFrame:
    """Two batches of requests and one of cancellations through the stored log."""
    return _booking_log(e, (1, 2))


def booking_batch_rerun(e: Entities) -> DataFrame:
    """The same log when the first batch runs again after the second."""
    return _booking_log(e, (1, 2, 1))


def booking_snapshot(e: Entities) -> DataFrame:
    """The same log with a snapshot between its batches."""
    log = scratch_path(e.spark, "log")
    early = F.col("created_at") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    create_bookings(e.booking_requests.where(early), log, 1)
    snapshot_bookings(e.spark, log)
    create_bookings(e.booking_requests.where(~early), log, 2)
    cancel_bookings(e.cancellations, log, 2)
    return _as_double(read_bookings(e.spark, log), "total_price")


def booking_intake(e: Entities) -> DataFrame:
    """Requests through the streaming intake: how many were taken, and why others were not."""
    inbox, outbox, state = (scratch_path(e.spark, n) for n in ("inbox", "checked", "state"))
    e.booking_requests.select(*BOOKING_REQUESTS.names).write.parquet(inbox)
    store_checked(read_requests(e.spark, inbox), outbox, state).awaitTermination()
    checked = read_checked(e.spark, outbox)
    return checked.groupBy("accepted", bookings.REASON).agg(F.count("*").alias("requests"))


# Reports kept up to date: all rows in three batches of whole visits and baskets, one of them twice


def _rolled_up(e: Entities, name: str, key: dict[str, str], **tables: DataFrame) -> DataFrame:
    folder = scratch_path(e.spark, "rollups")
    for batch in (0, 1, 2, 1):
        parts = {t: df.where(F.expr(f"{key[t]} % 3 = {batch}")) if t in key else df for t, df in tables.items()}
        rollups.refresh(e.spark, folder, name, batch, **parts)
    return rollups.report(e.spark, folder, name)


_VISIT = {"fuel": "fuel_txn_id div 3", "store": "fuel_txn_id div 3"}


def rollup_fares(e: Entities) -> DataFrame:
    return _fares(_rolled_up(e, "fare_by_zone", {"trips": "trip_id"}, trips=e.trips))


def rollup_by_tier(e: Entities) -> DataFrame:
    return _rolled_up(e, "conversion_by_tier", _VISIT, fuel=e.fuel, store=e.store, customers=e.customers)


def rollup_by_fuel_and_payment(e: Entities) -> DataFrame:
    return _rolled_up(e, "conversion_by_each", _VISIT, fuel=e.fuel, store=e.store)


def rollup_baskets(e: Entities) -> DataFrame:
    return _rounded(_rolled_up(e, "basket_averages", _VISIT, store=e.store), "avg_lines", "avg_items", "avg_value")


def rollup_categories(e: Entities) -> DataFrame:
    return _as_double(_rolled_up(e, "top_categories", _VISIT, store=e.categorised_store), "revenue")


def rollup_counts(e: Entities) -> DataFrame:
    key = {"fuel_transactions": _VISIT["fuel"], "store_purchases": _VISIT["store"], "customers": "customer_id"}
    return _rolled_up(e, "table_counts", key, **_conversion_tables(e))


# Encoding and metrics on a given score


def _score(key: str) -> Column:
    return draw(digest(SEED, "score", F.col(key)), 0) % 1000 / 1000


def _scored(e: Entities) -> DataFrame:
    scored = _labelled(e).select(
        "fuel_txn_id", "transaction_ts", conversion.LABEL, _score("fuel_txn_id").alias("score")
    )
    return metrics.with_prediction(scored, "score", "predicted")


def _categories(e: Entities) -> DataFrame:
    return _profiled(e).select("fuel_txn_id", "transaction_ts", *features.CATEGORICAL)


def _dictionary(e: Entities) -> DataFrame:
    visits = _categories(e)
    train = visits.where(metrics.before(visits, "transaction_ts", CUTOFF))
    return encoding.ordinal_dictionary(train, features.CATEGORICAL)


def ordinal_encoded(e: Entities) -> DataFrame:
    codes = materialise(_dictionary(e), "dictionary")
    visits = encoding.ordinal_encode(_categories(e), codes, features.CATEGORICAL)
    return visits.select("fuel_txn_id", *features.CATEGORICAL)


def _metric(function: Callable[..., DataFrame]) -> Callable[[Entities], DataFrame]:
    return lambda e: function(_scored(e), conversion.LABEL, "predicted")


# Generated tables: one customer per row of customer, one fuel visit per row of orders


def _customer_numbers(e: Entities) -> DataFrame:
    return e.table("customer").select((F.col("c_custkey") + 1).alias("n"))


def _fuel_numbers(e: Entities) -> DataFrame:
    return e.table("orders").select((F.col("o_orderkey") + 1).alias("n"))


def _sizes(e: Entities) -> generator.GeneratorSettings:
    return generator.GeneratorSettings(customers=e.table("customer").count(), seed=SEED)


def _generated(e: Entities) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The generated tables, stored: each is generated once, whatever reads it."""
    sizes = _sizes(e)
    tables = (
        generator.generate_customers(_customer_numbers(e), sizes),
        generator.generate_fuel_transactions(_fuel_numbers(e), sizes),
        generator.generate_store_purchases(_fuel_numbers(e), sizes),
    )
    return tuple(materialise(t, "generated") for t in tables)


def gen_broken_rules(e: Entities) -> DataFrame:
    """The rules over generated tables in which some rows of each kind were changed."""
    customers, fuel, store = _generated(e)
    ends = lambda column, digit: F.col(column).endswith(digit)
    fuel = fuel.withColumns({
        "total_fuel_cost": F.when(~ends("fuel_txn_id", "7"), F.col("total_fuel_cost")),
        "loyalty_points_earned": F.col("loyalty_points_earned") + ends("fuel_txn_id", "12").cast("int"),
    })
    late = F.timestamp_add("HOUR", F.lit(1), "store_ts")
    store = store.withColumns({
        "line_total": F.col("line_total") + ends("store_item_id", "3").cast("int"),
        "store_ts": F.when(ends("purchase_id", "5"), late).otherwise(F.col("store_ts")),
        "customer_id": F.when(ends("purchase_id", "1"), "nobody").otherwise(F.col("customer_id")),
        "fuel_txn_id": F.when(ends("purchase_id", "8"), F.concat("fuel_txn_id", F.lit("x"))).otherwise(F.col("fuel_txn_id")),
    })
    return generator.check_generated(customers.where(~ends("customer_id", "9")), fuel, store)


def gen_written(e: Entities) -> DataFrame:
    """Rows and broken rules of the generated tables, counted by the tasks that wrote them."""
    sizes = _sizes(e)
    sinks.create_schema(e.spark, GENERATED_SCHEMA)
    tables = {
        "fuel_transactions": generator.generate_fuel_transactions(_fuel_numbers(e), sizes),
        "store_purchases": generator.generate_store_purchases(_fuel_numbers(e), sizes),
    }
    counted = sinks.overwrite_tables(
        tables, GENERATED_SCHEMA, scratch_path(e.spark, "generated"), measures=generator.row_rules()
    )
    rows = [(name, measure, n) for name, found in counted.items() for measure, n in found.items()]
    return e.spark.createDataFrame(rows, "table_name string, measure string, n bigint")


def _plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# Model


def _stored_matrix(e: Entities) -> DataFrame:
    return materialise(features.feature_matrix(e.fuel, e.store, e.customers), "matrix")


def gbt_scores(e: Entities) -> DataFrame:
    matrix = _stored_matrix(e)
    return training.score_visits(training.train_model(matrix, MODEL), matrix)


def gain_importance(e: Entities) -> DataFrame:
    matrix = _stored_matrix(e)
    return training.gain_importance(training.train_model(matrix, MODEL), matrix)


def permutation_importance(e: Entities) -> DataFrame:
    matrix = _stored_matrix(e)
    return training.permutation_importance(training.train_model(matrix, MODEL), matrix)


def contribution_importance(e: Entities) -> DataFrame:
    matrix = _stored_matrix(e)
    return training.contribution_importance(training.train_model(matrix, MODEL), matrix)


def visit_contributions(e: Entities) -> DataFrame:
    matrix = _stored_matrix(e)
    return training.visit_contributions(training.train_model(matrix, MODEL), matrix)


def model_metrics(e: Entities) -> DataFrame:
    """The whole model job over stored tables: predictions are stored, metrics returned."""
    _store_conversion_tables(e)
    return train_and_score(e.spark, CHECK_SCHEMA, MODEL, folder=scratch_path(e.spark, "predictions"))["metrics"]


# Sources and sinks


def csv_fixture_load(e: Entities) -> DataFrame:
    """The listings written as CSV and loaded again: every column is a string."""
    path = scratch_path(e.spark, "properties.csv")
    e.properties.write.option("header", True).csv(path)
    return read_fixture(e.spark, path)


def report_csv(e: Entities) -> DataFrame:
    """A short report written as CSV and loaded again."""
    path = scratch_path(e.spark, "types.csv")
    sinks.write_report(listings.count_by_type(e.properties), path)
    return read_fixture(e.spark, path)


def json_fixture_load(e: Entities) -> DataFrame:
    path = scratch_path(e.spark, "properties.json")
    e.properties.write.json(path)
    return read_fixture(e.spark, path, e.properties.schema)


def _conversion_tables(e: Entities) -> dict[str, DataFrame]:
    return {"fuel_transactions": e.fuel, "customers": e.customers, "store_purchases": e.categorised_store}


def _store_conversion_tables(e: Entities, buckets: int | None = None) -> DataFrame:
    sinks.create_schema(e.spark, CHECK_SCHEMA)
    folder = scratch_path(e.spark, "tables")
    counted = sinks.overwrite_tables(_conversion_tables(e), CHECK_SCHEMA, folder, LABEL_BUCKETS, buckets)
    rows = [(name, found["n_rows"]) for name, found in counted.items()]
    return e.spark.createDataFrame(rows, "table_name string, n_rows bigint")


def visit_label_bucketed(e: Entities) -> DataFrame:
    """The label join over tables bucketed by transaction, which needs no shuffle."""
    _store_conversion_tables(e, buckets=8)
    fuel, _, store = read_conversion_tables(e.spark, CHECK_SCHEMA)
    return conversion.label_visits(fuel, store).select("fuel_txn_id", "customer_id", conversion.LABEL)


def overwrite_roundtrip(e: Entities) -> DataFrame:
    """Store the three conversion tables, load them by name and report on them."""
    _store_conversion_tables(e)
    fuel, _, store = read_conversion_tables(e.spark, CHECK_SCHEMA)
    return conversion.overall_conversion(conversion.label_visits(fuel, store))


def table_inventory(e: Entities) -> DataFrame:
    """What the namespace lists, beside what was stored: a table that either lacks has a null."""
    counts = _store_conversion_tables(e).withColumnRenamed("table_name", "stored")
    listed = list_table_names(e.spark, CHECK_SCHEMA).where(F.col("table_name") != PREDICTIONS)
    return listed.join(counts, F.col("table_name") == F.col("stored"), "full").drop("stored")


def namespace_scan(e: Entities) -> DataFrame:
    """A stored table read by its unqualified name."""
    _store_conversion_tables(e)
    before = e.spark.catalog.currentDatabase()
    use_namespace(e.spark, CHECK_SCHEMA)
    try:
        return e.spark.read.table("customers")
    finally:
        use_namespace(e.spark, before)


_QUERIES: dict[str, Callable[[Entities], DataFrame]] = {
    "listing_page": lambda e: paging.page(e.properties, "property_id", 20, 40),
    "listing_page_after": lambda e: paging.page_after(e.properties, "property_id", 59, 20),
    "listing_deep_page": lambda e: paging.deep_page(e.properties, "property_id", 100, 90),
    "listing_keyed_hits": listing_keyed_hits,
    "listing_keyed_misses": listing_keyed_misses,
    "listing_keyed_few": listing_keyed_few,
    "listing_curve_matches": lambda e: listings.matching_listings(_listings_on_curve(e), "PROMO", 920, 980, 10),
    "listing_curve_price": lambda e: listings.matching_listings(_listings_on_curve(e), min_price=950, max_price=960),
    "booking_curve_list": booking_curve_list,
    "listing_stored_page": listing_stored_page,
    "listing_stored_page_after": listing_stored_page_after,
    "listing_matches": lambda e: listings.matching_listings(e.properties, "PROMO", 920, 980, 10),
    "listing_search": lambda e: listings.search_listings(
        e.properties, 20, 20, property_type="PROMO", min_price=920, max_price=980, min_bedrooms=10
    ),
    "listing_lookup_hits": listing_lookup_hits,
    "listing_lookup_misses": listing_lookup_misses,
    "listing_type_counts": lambda e: listings.count_by_type(e.properties),
    "reviews_active": lambda e: listings.active_reviews(e.reviews),
    "reviews_active_page": lambda e: paging.page(listings.active_reviews(e.reviews), "review_id", 20, 20),
    "reviews_by_property": lambda e: paging.page(listings.active_reviews(e.reviews, 7), "review_id", 100),
    "destinations_page": lambda e: paging.page(e.destinations, "destination_id", 20, 0),
    "trips_scan": lambda e: _as_double(e.trips, "fare_amount"),
    "trips_sample": lambda e: _as_double(_dataset("trips_sample")(e), "fare_amount"),
    "sample_zone_totals": lambda e: _fares(_dataset("zone_totals")(e)),
    "zone_fare_totals": lambda e: _fares(_dataset("all_zone_totals")(e)),
    "visit_label": lambda e: _labelled(e).select("fuel_txn_id", "customer_id", conversion.LABEL),
    "conversion_overall": lambda e: conversion.overall_conversion(_labelled(e)),
    "conversion_by_tier": conversion_by_tier,
    "conversion_by_fuel_and_payment": lambda e: conversion.conversion_by_each(
        _labelled(e), "fuel_type", "payment_method"
    ),
    "basket_averages": lambda e: _rounded(
        conversion.basket_averages(e.store), "avg_lines", "avg_items", "avg_value"
    ),
    "top_categories": top_categories,
    "store_gap": lambda e: _rounded(conversion.store_gap(e.fuel, e.store), "avg_minutes"),
    "customer_conversion": lambda e: conversion.customer_conversion(e.fuel, e.shoppers),
    "table_counts": lambda e: conversion.table_counts(_conversion_tables(e)),
    "repeated_customers": lambda e: conversion.repeated_keys(e.fuel, "customer_id"),
    "time_features": time_features,
    "profile_features": profile_features,
    "history_features": history_features,
    "history_features_sliced": history_features_sliced,
    "feature_matrix": feature_matrix,
    "booking_valid": booking_valid,
    "booking_defaults": booking_defaults,
    "booking_rejects": booking_rejects,
    "booking_numbered": booking_numbered,
    "booking_list": lambda e: _as_double(bookings.list_bookings(e.bookings, limit=50, offset=10), "total_price"),
    "booking_list_by_user": lambda e: _as_double(
        bookings.list_bookings(e.bookings, user_id=7, limit=100), "total_price"
    ),
    "booking_stored_page": booking_stored_page,
    "booking_lookup": booking_lookup,
    "booking_lookup_misses": lambda e: listings.missing_keys(e.lookups, e.bookings, "booking_id"),
    "booking_current_state": booking_current_state,
    "cancelled_bookings": lambda e: _as_double(
        bookings.cancelled_bookings(e.bookings, e.cancellations), "total_price"
    ),
    "cancel_not_found": lambda e: listings.missing_keys(e.cancellations, e.bookings, "booking_id"),
    "booking_batches": booking_batches,
    "booking_batch_rerun": booking_batch_rerun,
    "booking_snapshot": booking_snapshot,
    "booking_intake": booking_intake,
    "rollup_fares": rollup_fares,
    "rollup_overall": lambda e: _rolled_up(e, "conversion_overall", _VISIT, fuel=e.fuel, store=e.store),
    "rollup_by_tier": rollup_by_tier,
    "rollup_by_fuel_and_payment": rollup_by_fuel_and_payment,
    "rollup_baskets": rollup_baskets,
    "rollup_categories": rollup_categories,
    "rollup_counts": rollup_counts,
    "split_summary": lambda e: metrics.split_summary(_labelled(e), "transaction_ts", CUTOFF, conversion.LABEL),
    "ordinal_dictionary": _dictionary,
    "ordinal_encoded": ordinal_encoded,
    "threshold_scores": lambda e: _scored(e).select("fuel_txn_id", "score", "predicted"),
    "confusion_matrix": _metric(metrics.confusion_matrix),
    "classification_report": _metric(metrics.classification_report),
    "binary_metrics": _metric(metrics.binary_metrics),
    "roc_auc": lambda e: metrics.roc_auc(_scored(e), conversion.LABEL, "score"),
    "gen_customers": lambda e: _plain_time(
        generator.generate_customers(_customer_numbers(e), _sizes(e)), "member_since"
    ),
    "gen_fuel": lambda e: _plain_time(
        generator.generate_fuel_transactions(_fuel_numbers(e), _sizes(e)), "transaction_ts"
    ),
    "gen_store": lambda e: _plain_time(
        generator.generate_store_purchases(_fuel_numbers(e), _sizes(e)), "store_ts"
    ),
    "gen_invariants": lambda e: generator.check_generated(*_generated(e)),
    "gen_broken_rules": gen_broken_rules,
    "gen_written": gen_written,
    "gen_summary": lambda e: generator.conversion_summary(*_generated(e)),
    "gbt_scores": gbt_scores,
    "gain_importance": gain_importance,
    "permutation_importance": permutation_importance,
    "contribution_importance": contribution_importance,
    "visit_contributions": visit_contributions,
    "model_metrics": model_metrics,
    "csv_fixture_load": csv_fixture_load,
    "json_fixture_array": json_fixture_array,
    "table_kept": table_kept,
    "listing_types_ranked": listing_types_ranked,
    "json_fixture_load": json_fixture_load,
    "report_csv": report_csv,
    "visit_label_bucketed": visit_label_bucketed,
    "overwrite_roundtrip": overwrite_roundtrip,
    "table_inventory": table_inventory,
    "namespace_scan": namespace_scan,
}


def queries() -> dict[str, Query]:
    """All queries by name; each takes the session and the folder of the tables."""

    def bind(build: Callable[[Entities], DataFrame]) -> Query:
        return lambda spark, folder: build(Entities(spark, folder))

    found = {name: bind(build) for name, build in _QUERIES.items()}
    return found | ({**training_data.QUERIES, "pipeline": corpus_pipeline.run} if training_data else {})


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Views shared by the oracle queries, written for DuckDB.
_VIEWS = {
    "properties": """
        SELECT p_partkey AS property_id, p_name AS title, p_type AS property_type,
               p_retailprice AS base_price, p_size AS bedrooms FROM part""",
    "reviews": """
        SELECT event_id AS review_id, user_id AS property_id, value AS rating,
               event_type = 'error' AS is_deleted, ts AS created_at FROM events""",
    "destinations": """
        SELECT n_nationkey AS destination_id, n_name AS name, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "trips": """
        SELECT o_orderkey AS trip_id, o_orderpriority AS pickup_zip,
               CAST(o_totalprice AS DECIMAL(18,2)) AS fare_amount FROM orders""",
    "requests": """
        SELECT o_orderkey AS request_id, o_orderkey % 200 AS property_id, o_custkey AS user_id,
               CAST(o_orderdate AS DATE) AS check_in,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 8 - 1 AS INTEGER) AS check_out,
               CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE CAST(o_orderkey % 4 + 1 AS INTEGER) END AS guests,
               o_totalprice AS total_price, o_orderdate AS created_at FROM orders""",
    "bookings": """
        SELECT request_id AS booking_id, property_id, user_id, check_in, check_out, guests,
               'CONFIRMED' AS status, total_price, created_at
        FROM requests WHERE check_out > check_in""",
    "cancelled": "SELECT DISTINCT event_id * 2 AS booking_id FROM events WHERE event_type = 'error'",
    "fuel": f"""
        SELECT event_id AS fuel_txn_id, user_id AS customer_id, ts AS transaction_ts,
               CAST(event_id % 12 + 1 AS INTEGER) AS pump_number, event_type AS fuel_type,
               CAST(value AS DECIMAL(12,2)) AS gallons, CAST(3.5 AS DOUBLE) AS price_per_gallon,
               CAST(CAST(value AS DECIMAL(12,2)) * CAST(3.5 AS DECIMAL(4,1)) AS DECIMAL(14,2)) AS total_fuel_cost,
               {_sql_list(PAYMENTS)}[event_id % 5 + 1] AS payment_method,
               CAST(floor(CAST(value AS DECIMAL(12,2)) * 10) AS INTEGER) AS loyalty_points_earned
        FROM events""",
    "customers": f"""
        SELECT c_custkey + c_custkey // 9 AS customer_id, c_acctbal > 0 AS loyalty_member,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Bronze' WHEN 'BUILDING' THEN 'Silver'
                    WHEN 'FURNITURE' THEN 'Gold' WHEN 'HOUSEHOLD' THEN 'Platinum' END AS loyalty_tier,
               DATE '2020-01-01' + CAST(c_custkey % 1461 AS INTEGER) AS member_since,
               {_sql_list(EVENT_TYPES)}[c_custkey % 5 + 1] AS preferred_fuel
        FROM customer""",
    "store": """
        SELECT l_orderkey * 3 AS fuel_txn_id, l_orderkey AS purchase_id, p_type AS category,
               CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total,
               l_shipdate AS store_ts
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "labelled": """
        SELECT fuel.*, CASE WHEN fuel_txn_id IN (SELECT fuel_txn_id FROM store) THEN 1 ELSE 0 END AS went_to_store
        FROM fuel""",
    "profiled": """
        SELECT f.*, CAST(c.loyalty_member AS INTEGER) AS is_loyalty_member,
               coalesce(c.loyalty_tier, 'None') AS loyalty_tier,
               CAST(CASE WHEN c.loyalty_member THEN date_diff('day', c.member_since, CAST(f.transaction_ts AS DATE))
                         ELSE 0 END AS INTEGER) AS member_tenure_days,
               c.preferred_fuel, CAST(f.fuel_type = c.preferred_fuel AS INTEGER) AS preferred_fuel_match,
               CAST(f.pump_number <= 3 AS INTEGER) AS near_entrance_pump
        FROM labelled f LEFT JOIN customers c ON f.customer_id = c.customer_id""",
    "timed": """
        SELECT fuel_txn_id, CAST(hour(transaction_ts) AS INTEGER) AS hour_of_day,
               CAST(dayofweek(transaction_ts) + 1 AS INTEGER) AS day_of_week,
               CAST(month(transaction_ts) AS INTEGER) AS month,
               CAST(dayofweek(transaction_ts) IN (0, 6) AS INTEGER) AS is_weekend,
               CAST(hour(transaction_ts) BETWEEN 6 AND 11 AS INTEGER) AS is_morning,
               CAST(hour(transaction_ts) BETWEEN 11 AND 14 AS INTEGER) AS is_lunch,
               CAST(hour(transaction_ts) BETWEEN 17 AND 21 AS INTEGER) AS is_evening
        FROM fuel""",
    "sums": """
        SELECT fuel_txn_id, count(*) OVER w AS n, sum(gallons) OVER w AS g, sum(total_fuel_cost) OVER w AS c,
               sum(loyalty_points_earned) OVER w AS p, sum(went_to_store) OVER w AS v
        FROM labelled WINDOW w AS (PARTITION BY customer_id ORDER BY transaction_ts, fuel_txn_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "history": """
        SELECT fuel_txn_id, n AS hist_visit_count,
               CASE WHEN n > 0 THEN CAST(g AS DOUBLE) / n ELSE 0 END AS hist_avg_gallons,
               CASE WHEN n > 0 THEN CAST(c AS DOUBLE) / n ELSE 0 END AS hist_avg_cost,
               CAST(coalesce(p, 0) AS BIGINT) AS hist_total_loyalty_pts,
               CASE WHEN n > 0 THEN CAST(v AS DOUBLE) / n ELSE 0 END AS hist_store_rate,
               CAST(coalesce(v, 0) AS BIGINT) AS hist_store_visits
        FROM sums""",
    "scored": """
        SELECT fuel_txn_id, transaction_ts, went_to_store, s AS score, CAST(s >= 0.5 AS INTEGER) AS predicted
        FROM (SELECT *, (CAST('0x' || substr(md5('42|score|' || fuel_txn_id), 1, 8) AS BIGINT) % 1000)
                        / CAST(1000 AS DOUBLE) AS s FROM labelled)""",
    "cells": """
        SELECT CAST(count(*) FILTER (went_to_store = 0 AND predicted = 0) AS DOUBLE) AS tn,
               CAST(count(*) FILTER (went_to_store = 0 AND predicted = 1) AS DOUBLE) AS fp,
               CAST(count(*) FILTER (went_to_store = 1 AND predicted = 0) AS DOUBLE) AS fn,
               CAST(count(*) FILTER (went_to_store = 1 AND predicted = 1) AS DOUBLE) AS tp FROM scored""",
    "codes": """
        SELECT feature, category,
               CAST(row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT feature, category FROM (
                UNPIVOT (SELECT fuel_type, payment_method, loyalty_tier, preferred_fuel FROM profiled
                         WHERE transaction_ts < TIMESTAMP '2024-01-23')
                ON fuel_type, payment_method, loyalty_tier, preferred_fuel INTO NAME feature VALUE category))""",
}


def _with_views(query: str, views: dict[str, str]) -> str:
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in views.items()) + " " + query


_CONVERSION = """count(*) AS visits, CAST(sum(went_to_store) AS BIGINT) AS conversions,
                 avg(went_to_store) AS conversion_rate"""
_BOOKING = "property_id, user_id, check_in, check_out, guests, total_price, created_at"


def _part(digits: str, i: int) -> str:
    return f"CAST('0x' || substr({digits}, {8 * i + 1}, 8) AS BIGINT)"


def _md5(stream: str, *ids: str) -> str:
    return "md5('42|" + stream + "'" + "".join(f" || '|' || {i}" for i in ids) + ")"


def _choose(values, number: str) -> str:
    return f"{_sql_list(values)}[({number}) % {len(values)} + 1]"


def _category_case(column: str, field: int) -> str:
    limit, cases = 0, []
    for name, entry in generator.CATEGORIES.items():
        limit += entry[0]
        value = f"'{name}'" if field == 0 else entry[field]
        cases.append(f"WHEN {column} < {limit} THEN {value}")
    return "CASE " + " ".join(cases) + " END"


def _generator_views() -> dict[str, str]:
    first, last = "a", "b"
    titled = [[w.title() for w in words] for words in (generator.VERBS, generator.ADJECTIVES, generator.NOUNS)]
    member = f"{_part(_md5('customer', 'c'), 1)} % 100 < 60"
    return {
        "gen_c": f"""
            SELECT n, printf('CUST-%05d', n) AS customer_id, {first} || ' ' || {last} AS full_name,
                   lower({first}) || '.' || lower({last}) || n || '@example.com' AS email,
                   printf('%03d-555-%04d', {_part('k', 1)} % 800 + 200, {_part('k', 2)} % 10000) AS phone,
                   printf('%05d', {_part('k', 0)} % 90000 + 10000) AS zip_code,
                   {_part('t', 1)} % 100 < 60 AS loyalty_member,
                   CASE WHEN {_part('t', 2)} % 100 < 60 THEN {_choose(generator.TIERS, _part('t', 3))} END
                     AS loyalty_tier,
                   strftime(TIMESTAMP '2020-01-01' + to_seconds({_part('t', 0)} % 157852801), '%Y-%m-%d %H:%M:%S')
                     AS member_since,
                   {_choose(generator.FUEL_CENTS, _part('p', 2))} AS preferred_fuel
            FROM (SELECT *, {_choose(generator.FIRST_NAMES, _part('p', 0))} AS a,
                         {_choose(generator.LAST_NAMES, _part('p', 1))} AS b
                  FROM (SELECT n, {_md5('customer', 'n')} AS t, {_md5('person', 'n')} AS p, {_md5('contact', 'n')} AS k
                        FROM (SELECT c_custkey + 1 AS n FROM customer)))""",
        "gen_v": f"""
            SELECT n, CAST('0x' || substr({_md5('fuel_customer', 'n')}, 1, 15) AS BIGINT)
                        % (SELECT count(*) FROM customer) + 1 AS c,
                   {_part('f', 0)} % 4 AS fuel, {_part('f', 1)} % 17001 + 3000 AS milli,
                   TIMESTAMP '2025-01-01' + to_seconds({_part('f', 2)} % 31449601) AS ts,
                   {_part('f', 3)} % 12 + 1 AS pump, {_part(_md5('payment', 'n'), 0)} AS pay
            FROM (SELECT n, {_md5('fuel', 'n')} AS f FROM (SELECT o_orderkey + 1 AS n FROM orders))""",
        "gen_f": f"""
            SELECT printf('FUEL-%07d', n) AS fuel_txn_id, printf('CUST-%05d', c) AS customer_id,
                   strftime(ts, '%Y-%m-%d %H:%M:%S') AS transaction_ts, CAST(pump AS INTEGER) AS pump_number,
                   {_choose(generator.FUEL_CENTS, 'fuel')} AS fuel_type, milli / CAST(1000 AS DOUBLE) AS gallons,
                   cents / CAST(100 AS DOUBLE) AS price_per_gallon,
                   ((milli * cents + 500) // 1000) / CAST(100 AS DOUBLE) AS total_fuel_cost,
                   {_choose(generator.PAYMENT_METHODS, 'pay')} AS payment_method,
                   CAST(CASE WHEN {member} THEN milli // 100 ELSE 0 END AS INTEGER) AS loyalty_points_earned
            FROM (SELECT *, {list(generator.FUEL_CENTS.values())}[fuel + 1] AS cents FROM gen_v)""",
        "gen_b": f"""
            SELECT *, row_number() OVER (ORDER BY n) AS purchase
            FROM (SELECT n, c, ts, {_part('v', 1)} % 4 + 1 AS lines, {_part('v', 2)} % 14 + 2 AS gap
                  FROM (SELECT *, {_md5('visit', 'n')} AS v FROM gen_v) WHERE {_part('v', 0)} % 100 < 38)""",
        "gen_l": f"""
            SELECT *, {_part('h', 0)} % 100 AS chance, {_part('h', 2)} % 3 + 1 AS qty, {_part('h', 3)} AS w
            FROM (SELECT *, {_md5('item', 'n', 'k')} AS h
                  FROM (SELECT *, unnest(generate_series(1, lines)) AS k FROM gen_b))""",
        "gen_p": f"""
            SELECT *, {_part('h', 1)} % ({_category_case('chance', 2)} - {_category_case('chance', 1)} + 1)
                      + {_category_case('chance', 1)} AS cents FROM gen_l""",
        "gen_s": f"""
            SELECT printf('ITEM-%08d', row_number() OVER (ORDER BY n, k)) AS store_item_id,
                   printf('FUEL-%07d', n) AS fuel_txn_id, printf('CUST-%05d', c) AS customer_id,
                   printf('STORE-%07d', purchase) AS purchase_id,
                   strftime(ts + to_minutes(gap), '%Y-%m-%d %H:%M:%S') AS store_ts,
                   {_category_case('chance', 0)} AS category,
                   {_choose(titled[0], 'w')} || ' ' || {_choose(titled[1], 'w // 8')} || ' '
                     || {_choose(titled[2], 'w // 64')} AS product_name,
                   cents / CAST(100 AS DOUBLE) AS unit_price, CAST(qty AS INTEGER) AS quantity,
                   cents * qty / CAST(100 AS DOUBLE) AS line_total,
                   CAST(sum(cents * qty) OVER (PARTITION BY n) AS BIGINT) / CAST(100 AS DOUBLE) AS basket_total
            FROM gen_p""",
    }


def _rules_sql(customers: str, fuel: str, store: str) -> str:
    """Violations of each rule of the generated tables; what cannot be judged counts."""

    def broken(condition: str) -> str:
        return f"count(*) FILTER (coalesce({condition}, true))"

    milli = "CAST(round(gallons * 1000) AS BIGINT)"
    visits = {
        "customer exists": "loyalty_member IS NULL",
        "fuel cost": f"round(total_fuel_cost * 100) <> ({milli} * CAST(round(price_per_gallon * 100) AS BIGINT) + 500) // 1000",
        "loyalty points": f"loyalty_points_earned <> CASE WHEN loyalty_member THEN {milli} // 100 ELSE 0 END",
    }
    minutes = "trunc((epoch(entry) - epoch(CAST(transaction_ts AS TIMESTAMP))) / 60)"
    baskets = {
        "basket total": "total <> lowest OR total <> highest",
        "lines per basket": f"lines NOT BETWEEN 1 AND {generator.MAX_ITEMS}",
        "fuel visit exists": "customer_id IS NULL",
        "same customer": "customer_id <> shopper",
        "minutes to store": f"{minutes} NOT BETWEEN {generator.GAP_MINUTES[0]} AND {generator.GAP_MINUTES[1]}",
    }
    visit_rules = [f"SELECT '{r}' AS rule, {broken(c)} AS violations FROM visits" for r, c in visits.items()]
    basket_rules = [f"SELECT '{r}', {broken(c)} FROM entries" for r, c in baskets.items()]
    line_rule = "round(line_total * 100) <> round(unit_price * 100) * quantity"
    return f"""
        SELECT * FROM (WITH c AS (SELECT * FROM {customers}), f AS (SELECT * FROM {fuel}), s AS (SELECT * FROM {store}),
          visits AS (SELECT f.*, loyalty_member FROM f LEFT JOIN c USING (customer_id)),
          baskets AS (SELECT purchase_id, fuel_txn_id, count(*) AS lines, sum(round(line_total * 100)) AS total,
                             min(round(basket_total * 100)) AS lowest, max(round(basket_total * 100)) AS highest,
                             min(CAST(store_ts AS TIMESTAMP)) AS entry, min(customer_id) AS shopper
                      FROM s GROUP BY purchase_id, fuel_txn_id),
          entries AS (SELECT baskets.*, customer_id, transaction_ts FROM baskets LEFT JOIN f USING (fuel_txn_id))
        {" UNION ALL ".join(visit_rules + basket_rules)}
        UNION ALL SELECT 'line total', {broken(line_rule)} FROM s)"""


def _report_sql() -> str:
    def line(name, precision, recall, f1, support):
        return f"""SELECT '{name}' AS class, round({precision}, 4) AS "precision", round({recall}, 4) AS recall,
                          round({f1}, 4) AS f1, CAST({support} AS BIGINT) AS support FROM cells"""

    def share(a, b):
        return f"coalesce({a} / nullif({b}, 0), 0)"

    no = (share("tn", "(tn + fn)"), share("tn", "(tn + fp)"), share("2 * tn", "(2 * tn + fn + fp)"))
    yes = (share("tp", "(tp + fp)"), share("tp", "(tp + fn)"), share("2 * tp", "(2 * tp + fp + fn)"))
    total = "(tn + fp + fn + tp)"
    return " UNION ALL ".join(
        [
            line("Pumps Only", *no, "tn + fp"),
            line("Goes to Store", *yes, "tp + fn"),
            line("accuracy", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", f"(tn + tp) / {total}", total),
            line("macro avg", *[f"({a} + {b}) / 2" for a, b in zip(no, yes)], total),
            line("weighted avg", *[f"({a} * (tn + fp) + {b} * (tp + fn)) / {total}" for a, b in zip(no, yes)], total),
        ]
    )


def oracle_sql() -> dict[str, str]:
    """SQL with the same result for every query that SQL can express."""
    log_bookings = f"""
        SELECT n AS booking_id, request_id, {_BOOKING},
               CASE WHEN n IN (SELECT booking_id FROM cancelled) THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status
        FROM (SELECT *, row_number() OVER (ORDER BY created_at, request_id) AS n
              FROM requests WHERE check_out > check_in)"""
    history_columns = ", ".join([*features.HISTORY_FEATURES, "hist_store_visits"])
    matrix_columns = [c for c in features.FEATURES if c not in ("gallons", "total_fuel_cost")]
    encoded = ", ".join(
        f"coalesce((SELECT code FROM codes WHERE feature = '{c}' AND category = p.{c}), -1) AS {c}"
        for c in features.CATEGORICAL
    )
    rejected = "check_out is not later than check_in"
    inventory = """
        SELECT 'fuel_transactions' AS table_name, count(*) AS n_rows FROM fuel
        UNION ALL SELECT 'customers', count(*) FROM customers
        UNION ALL SELECT 'store_purchases', count(*) FROM store"""
    plain = {
        "listing_page": "SELECT * FROM properties ORDER BY property_id LIMIT 20 OFFSET 40",
        "listing_page_after": "SELECT * FROM properties WHERE property_id > 59 ORDER BY property_id LIMIT 20",
        "listing_deep_page": "SELECT * FROM properties ORDER BY property_id LIMIT 100 OFFSET 90",
        "listing_keyed_hits": "SELECT * FROM properties WHERE property_id IN (SELECT event_id FROM events)",
        "listing_keyed_misses": """
            SELECT DISTINCT event_id AS property_id FROM events
            WHERE event_id NOT IN (SELECT property_id FROM properties)""",
        "listing_keyed_few": "SELECT * FROM properties WHERE property_id IN (SELECT r_regionkey * 7 FROM region)",
        "listing_curve_matches": """
            SELECT * FROM properties WHERE property_type = 'PROMO' AND base_price >= 920 AND base_price <= 980
            AND bedrooms >= 10""",
        "listing_curve_price": "SELECT * FROM properties WHERE base_price BETWEEN 950 AND 960",
        "booking_curve_list": """
            SELECT * FROM bookings WHERE user_id = 7 ORDER BY created_at DESC, booking_id DESC LIMIT 100""",
        "listing_stored_page": "SELECT * FROM properties ORDER BY property_id LIMIT 100 OFFSET 90",
        "listing_stored_page_after": "SELECT * FROM properties WHERE property_id > 59 ORDER BY property_id LIMIT 20",
        "listing_matches": """
            SELECT * FROM properties WHERE property_type = 'PROMO' AND base_price >= 920 AND base_price <= 980
            AND bedrooms >= 10""",
        "listing_search": """
            SELECT * FROM properties WHERE property_type = 'PROMO' AND base_price >= 920 AND base_price <= 980
            AND bedrooms >= 10 ORDER BY property_id LIMIT 20 OFFSET 20""",
        "listing_lookup_hits": "SELECT * FROM properties WHERE property_id IN (SELECT event_id FROM events)",
        "listing_lookup_misses": """
            SELECT DISTINCT event_id AS property_id FROM events
            WHERE event_id NOT IN (SELECT property_id FROM properties)""",
        "listing_type_counts": "SELECT property_type, count(*) AS count FROM properties GROUP BY property_type",
        "reviews_active": "SELECT * FROM reviews WHERE is_deleted = false",
        "reviews_active_page": """
            SELECT * FROM reviews WHERE is_deleted = false ORDER BY review_id LIMIT 20 OFFSET 20""",
        "reviews_by_property": """
            SELECT * FROM reviews WHERE is_deleted = false AND property_id = 7 ORDER BY review_id LIMIT 100""",
        "destinations_page": "SELECT * FROM destinations ORDER BY destination_id LIMIT 20",
        "trips_scan": "SELECT * REPLACE (CAST(fare_amount AS DOUBLE) AS fare_amount) FROM trips",
        "trips_sample": """
            SELECT * REPLACE (CAST(fare_amount AS DOUBLE) AS fare_amount) FROM trips ORDER BY trip_id LIMIT 5""",
        "sample_zone_totals": """
            SELECT pickup_zip, CAST(sum(fare_amount) AS DOUBLE) AS total_fare
            FROM (SELECT * FROM trips ORDER BY trip_id LIMIT 5) GROUP BY pickup_zip""",
        "zone_fare_totals": """
            SELECT pickup_zip, CAST(sum(fare_amount) AS DOUBLE) AS total_fare FROM trips GROUP BY pickup_zip""",
        "visit_label": "SELECT fuel_txn_id, customer_id, went_to_store FROM labelled",
        "visit_label_bucketed": "SELECT fuel_txn_id, customer_id, went_to_store FROM labelled",
        "conversion_overall": f"SELECT {_CONVERSION} FROM labelled",
        "conversion_by_tier": f"SELECT loyalty_tier, {_CONVERSION} FROM profiled GROUP BY loyalty_tier",
        "conversion_by_fuel_and_payment": f"""
            SELECT 'fuel_type' AS dimension, fuel_type AS value, {_CONVERSION} FROM labelled GROUP BY fuel_type
            UNION ALL SELECT 'payment_method', payment_method, {_CONVERSION} FROM labelled GROUP BY payment_method""",
        "basket_averages": """
            SELECT count(*) AS baskets, round(avg(lines), 6) AS avg_lines, round(avg(items), 6) AS avg_items,
                   round(CAST(sum(value) AS DOUBLE) / count(*), 6) AS avg_value
            FROM (SELECT purchase_id, count(*) AS lines, sum(quantity) AS items, sum(line_total) AS value
                  FROM store GROUP BY purchase_id)""",
        "top_categories": """
            SELECT category, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS items,
                   CAST(sum(line_total) AS DOUBLE) AS revenue
            FROM store GROUP BY category ORDER BY items DESC, category LIMIT 10""",
        "store_gap": """
            SELECT count(*) AS baskets, round(avg(gap), 6) AS avg_minutes, min(gap) AS min_minutes,
                   max(gap) AS max_minutes, median(gap) AS median_minutes
            FROM (SELECT CAST(trunc((epoch_us(s) - epoch_us(transaction_ts)) / 60000000.0) AS BIGINT) AS gap
                  FROM (SELECT purchase_id, fuel_txn_id, min(store_ts) AS s FROM store
                        GROUP BY purchase_id, fuel_txn_id) b JOIN fuel USING (fuel_txn_id))""",
        "customer_conversion": """
            SELECT pumpers AS unique_pumpers, shoppers AS store_shoppers,
                   CAST(shoppers AS DOUBLE) / pumpers * 100 AS conversion_pct
            FROM (SELECT (SELECT count(DISTINCT customer_id) FROM fuel) AS pumpers,
                         (SELECT count(DISTINCT customer_id) FROM store JOIN fuel USING (fuel_txn_id)) AS shoppers)""",
        "table_counts": inventory,
        "repeated_customers": """
            SELECT customer_id, count(*) AS n_rows FROM fuel GROUP BY customer_id HAVING count(*) > 1""",
        "time_features": "SELECT * FROM timed",
        "profile_features": f"SELECT fuel_txn_id, {', '.join(features.PROFILE_FEATURES)} FROM profiled",
        "history_features": f"SELECT fuel_txn_id, {history_columns} FROM history",
        "history_features_sliced": f"SELECT fuel_txn_id, {history_columns} FROM history",
        "feature_matrix": f"""
            SELECT fuel_txn_id, transaction_ts, went_to_store, CAST(gallons AS DOUBLE) AS gallons,
                   CAST(total_fuel_cost AS DOUBLE) AS total_fuel_cost, {', '.join(matrix_columns)}
            FROM profiled JOIN timed USING (fuel_txn_id) JOIN history USING (fuel_txn_id)""",
        "booking_valid": f"""
            SELECT request_id, 'CONFIRMED' AS status, {_BOOKING} FROM requests WHERE check_out > check_in""",
        "booking_defaults": """
            SELECT request_id, property_id, user_id, check_in, check_out, guests, 'CONFIRMED' AS status,
                   CASE WHEN request_id % 7 <> 0 THEN total_price END AS total_price,
                   CASE WHEN request_id % 3 <> 0 THEN created_at ELSE TIMESTAMP '2025-05-01 12:00:00' END AS created_at
            FROM requests WHERE check_out > check_in""",
        "booking_rejects": f"""
            SELECT request_id, '{rejected}' AS reject_reason FROM requests WHERE check_out <= check_in""",
        "booking_numbered": f"""
            SELECT row_number() OVER (ORDER BY created_at, request_id) AS booking_id, 'CONFIRMED' AS status,
                   request_id, {_BOOKING} FROM requests WHERE check_out > check_in""",
        "booking_list": "SELECT * FROM bookings ORDER BY created_at DESC, booking_id DESC LIMIT 50 OFFSET 10",
        "booking_list_by_user": """
            SELECT * FROM bookings WHERE user_id = 7 ORDER BY created_at DESC, booking_id DESC LIMIT 100""",
        "booking_stored_page": "SELECT * FROM bookings ORDER BY created_at DESC, booking_id DESC LIMIT 100 OFFSET 700",
        "booking_lookup": "SELECT * FROM bookings WHERE booking_id IN (SELECT l_orderkey * 2 FROM lineitem)",
        "booking_lookup_misses": """
            SELECT DISTINCT l_orderkey * 2 AS booking_id FROM lineitem
            WHERE l_orderkey * 2 NOT IN (SELECT booking_id FROM bookings)""",
        "booking_current_state": f"""
            SELECT booking_id, {_BOOKING}, CASE WHEN booking_id IN (SELECT booking_id FROM cancelled)
                   THEN 'CANCELLED' ELSE status END AS status FROM bookings""",
        "cancelled_bookings": f"""
            SELECT booking_id, {_BOOKING}, 'CANCELLED' AS status FROM bookings
            WHERE booking_id IN (SELECT booking_id FROM cancelled)""",
        "cancel_not_found": """
            SELECT booking_id FROM cancelled WHERE booking_id NOT IN (SELECT booking_id FROM bookings)""",
        "booking_batches": log_bookings,
        "booking_batch_rerun": log_bookings,
        "booking_snapshot": log_bookings,
        "booking_intake": f"""
            SELECT check_out > check_in AS accepted,
                   CASE WHEN check_out <= check_in THEN '{rejected}' END AS reject_reason, count(*) AS requests
            FROM requests GROUP BY 1, 2""",
        "split_summary": """
            SELECT CASE WHEN transaction_ts < TIMESTAMP '2024-01-23' THEN 'train' ELSE 'test' END AS split,
                   count(*) AS n_rows, avg(went_to_store) AS positive_rate FROM labelled GROUP BY 1""",
        "ordinal_dictionary": "SELECT * FROM codes",
        "ordinal_encoded": f"SELECT fuel_txn_id, {encoded} FROM profiled p",
        "threshold_scores": "SELECT fuel_txn_id, score, predicted FROM scored",
        "confusion_matrix": """
            SELECT actual, predicted, count(fuel_txn_id) AS n_rows
            FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c (actual, predicted)
            LEFT JOIN (SELECT fuel_txn_id, went_to_store AS actual, predicted FROM scored) USING (actual, predicted)
            GROUP BY actual, predicted""",
        "classification_report": _report_sql(),
        "binary_metrics": """
            SELECT round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(tp / (tp + fp), 4) AS "precision",
                   round(tp / (tp + fn), 4) AS recall, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy
            FROM cells""",
        "roc_auc": """
            SELECT round(sum(pos * (lower + neg / 2)) / (sum(pos) * sum(neg)), 4) AS roc_auc,
                   CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
            FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                                           AND 1 PRECEDING), 0) AS lower
                  FROM (SELECT score, CAST(sum(went_to_store) AS DOUBLE) AS pos,
                               CAST(sum(1 - went_to_store) AS DOUBLE) AS neg FROM scored GROUP BY score))""",
        "gen_customers": "SELECT * EXCLUDE (n) FROM gen_c",
        "gen_fuel": "SELECT * FROM gen_f",
        "gen_store": "SELECT * FROM gen_s",
        "gen_invariants": _rules_sql("gen_c", "gen_f", "gen_s"),
        "gen_broken_rules": _rules_sql(
            "(SELECT * FROM gen_c WHERE customer_id NOT LIKE '%9')",
            """(SELECT * REPLACE (CASE WHEN fuel_txn_id NOT LIKE '%7' THEN total_fuel_cost END AS total_fuel_cost,
                                  loyalty_points_earned + CAST(fuel_txn_id LIKE '%12' AS INTEGER) AS loyalty_points_earned)
                FROM gen_f)""",
            """(SELECT * REPLACE (line_total + CAST(store_item_id LIKE '%3' AS INTEGER) AS line_total,
                  CAST(store_ts AS TIMESTAMP) + to_hours(CAST(purchase_id LIKE '%5' AS INTEGER)) AS store_ts,
                  CASE WHEN purchase_id LIKE '%1' THEN 'nobody' ELSE customer_id END AS customer_id,
                  CASE WHEN purchase_id LIKE '%8' THEN fuel_txn_id || 'x' ELSE fuel_txn_id END AS fuel_txn_id)
                FROM gen_s)""",
        ),
        "gen_written": """
            SELECT 'fuel_transactions' AS table_name, 'n_rows' AS measure, count(*) AS n FROM gen_f
            UNION ALL SELECT 'store_purchases', 'n_rows', count(*) FROM gen_s
            UNION ALL SELECT 'fuel_transactions', 'fuel cost', count(*) FROM gen_f WHERE round(total_fuel_cost * 100)
              <> (CAST(round(gallons * 1000) AS BIGINT) * CAST(round(price_per_gallon * 100) AS BIGINT) + 500) // 1000
            UNION ALL SELECT 'store_purchases', 'line total', count(*) FROM gen_s
              WHERE round(line_total * 100) <> round(unit_price * 100) * quantity""",
        "gen_summary": """
            SELECT *, CAST(store_shoppers AS DOUBLE) / unique_pumpers * 100 AS conversion_pct
            FROM (SELECT (SELECT count(*) FROM customer) AS customers,
                         (SELECT count(*) FROM gen_f) AS fuel_transactions,
                         (SELECT count(*) FROM gen_s) AS store_line_items,
                         (SELECT count(DISTINCT customer_id) FROM gen_f) AS unique_pumpers,
                         (SELECT count(DISTINCT customer_id) FROM gen_s) AS store_shoppers)""",
        "csv_fixture_load": """
            SELECT CAST(property_id AS VARCHAR) AS property_id, title, property_type,
                   CAST(base_price AS VARCHAR) AS base_price, CAST(bedrooms AS VARCHAR) AS bedrooms FROM properties""",
        "json_fixture_load": "SELECT * FROM properties",
        "json_fixture_array": "SELECT * FROM properties",
        "table_kept": "SELECT * FROM destinations",
        "listing_types_ranked": """
            SELECT *, CAST(row_number() OVER (ORDER BY count DESC, property_type) AS INTEGER) AS place
            FROM (SELECT property_type, count(*) AS count FROM properties GROUP BY property_type)""",
        "report_csv": """
            SELECT property_type, CAST(count(*) AS VARCHAR) AS count FROM properties GROUP BY property_type""",
        "overwrite_roundtrip": f"SELECT {_CONVERSION} FROM labelled",
        "table_inventory": inventory,
        "namespace_scan": "SELECT * FROM customers",
    }
    # A report kept up to date gives the rows of the report over everything.
    plain |= {
        "rollup_fares": plain["zone_fare_totals"],
        "rollup_overall": plain["conversion_overall"],
        "rollup_by_tier": plain["conversion_by_tier"],
        "rollup_by_fuel_and_payment": plain["conversion_by_fuel_and_payment"],
        "rollup_baskets": plain["basket_averages"],
        "rollup_categories": plain["top_categories"],
        "rollup_counts": inventory,
    }
    generated = _generator_views()
    found = {
        name: _with_views(query, generated if name.startswith("gen_") else _VIEWS)
        for name, query in plain.items()
    }
    return found | (training_data.SQL if training_data else {})
