"""The entities of the data model as views of the provided Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.bookings import valid_requests
from larkspur.sources.tables import read_folder

EVENT_TYPES = ("signup", "view", "click", "error", "purchase")
PAYMENTS = ("Credit Card", "Debit Card", "Gift Card", "Rewards", "Cash")
CUTOFF = "2024-01-23 00:00:00"
FUEL_PRICE = 3.5


class Entities:
    """Entities over the tables in one folder; each is built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_folder(self.spark, self.folder, name)

    @property
    def properties(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("property_id"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("property_type"),
            F.col("p_retailprice").alias("base_price"),
            F.col("p_size").alias("bedrooms"),
        )

    @property
    def reviews(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("review_id"),
            F.col("user_id").alias("property_id"),
            F.col("value").alias("rating"),
            (F.col("event_type") == "error").alias("is_deleted"),
            F.col("ts").alias("created_at"),
        )

    @property
    def destinations(self) -> DataFrame:
        region = self.table("region")
        return (
            self.table("nation")
            .join(region, F.col("n_regionkey") == region["r_regionkey"])
            .select(
                F.col("n_nationkey").alias("destination_id"),
                F.col("n_name").alias("name"),
                F.col("r_name").alias("region"),
            )
        )

    @property
    def trips(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("trip_id"),
            F.col("o_orderpriority").alias("pickup_zip"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("fare_amount"),
        )

    @property
    def booking_requests(self) -> DataFrame:
        key, check_in = F.col("o_orderkey"), F.to_date("o_orderdate")
        return self.table("orders").select(
            key.alias("request_id"),
            (key % 200).alias("property_id"),
            F.col("o_custkey").alias("user_id"),
            check_in.alias("check_in"),
            F.date_add(check_in, (key % 8 - 1).cast("int")).alias("check_out"),
            F.when(key % 5 != 0, key % 4 + 1).cast("int").alias("guests"),
            F.col("o_totalprice").alias("total_price"),
            F.col("o_orderdate").alias("created_at"),
        )

    @property
    def bookings(self) -> DataFrame:
        """Valid requests as bookings that keep the request id."""
        return valid_requests(self.booking_requests).withColumnRenamed("request_id", "booking_id")

    @property
    def cancellations(self) -> DataFrame:
        errors = self.table("events").where(F.col("event_type") == "error")
        return errors.select((F.col("event_id") * 2).alias("booking_id"))

    @property
    def lookups(self) -> DataFrame:
        """Keys to look up: some exist, some do not, some are asked for more than once."""
        return self.table("lineitem").select((F.col("l_orderkey") * 2).alias("booking_id"))

    @property
    def fuel(self) -> DataFrame:
        event = F.col("event_id")
        gallons = F.col("value").cast("decimal(12,2)")
        return self.table("events").select(
            event.alias("fuel_txn_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("transaction_ts"),
            (event % 12 + 1).cast("int").alias("pump_number"),
            F.col("event_type").alias("fuel_type"),
            gallons.alias("gallons"),
            F.lit(FUEL_PRICE).alias("price_per_gallon"),
            (gallons * F.lit(FUEL_PRICE).cast("decimal(4,1)")).cast("decimal(14,2)").alias("total_fuel_cost"),
            F.element_at(F.array(*[F.lit(p) for p in PAYMENTS]), (event % 5 + 1).cast("int")).alias(
                "payment_method"
            ),
            F.floor(gallons * 10).cast("int").alias("loyalty_points_earned"),
        )

    @property
    def customers(self) -> DataFrame:
        """All customers; every tenth id is no customer's, so some visits have none."""
        key = F.col("c_custkey")
        tier = F.col("c_mktsegment")
        return self.table("customer").select(
            (key + F.expr("c_custkey div 9")).alias("customer_id"),
            (F.col("c_acctbal") > 0).alias("loyalty_member"),
            F.when(tier == "AUTOMOBILE", "Bronze")
            .when(tier == "BUILDING", "Silver")
            .when(tier == "FURNITURE", "Gold")
            .when(tier == "HOUSEHOLD", "Platinum")
            .alias("loyalty_tier"),
            F.date_add(F.lit("2020-01-01").cast("date"), (key % 1461).cast("int")).alias("member_since"),
            F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (key % 5 + 1).cast("int")).alias("preferred_fuel"),
        )

    @property
    def store(self) -> DataFrame:
        """All store lines, without customer and category; a third of the visits and of the baskets have each other."""
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 3).alias("fuel_txn_id"),
            F.col("l_orderkey").alias("purchase_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("line_total"),
            F.col("l_shipdate").alias("store_ts"),
        )

    @property
    def categorised_store(self) -> DataFrame:
        """Store lines with the category of their product."""
        part = self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category")
        )
        return self.store.join(part, "product_id", "left")

    @property
    def shoppers(self) -> DataFrame:
        """The customers of fuel transactions with a store line."""
        return self.fuel.join(self.store.select("fuel_txn_id").distinct(), "fuel_txn_id", "left_semi").select(
            "customer_id"
        )
