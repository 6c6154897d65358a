"""Entity schemas. Names and types are fixed values of the data model."""

from pyspark.sql import types as T

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("full_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("loyalty_member", T.BooleanType()),
        T.StructField("loyalty_tier", T.StringType()),
        T.StructField("member_since", T.TimestampType()),
        T.StructField("preferred_fuel", T.StringType()),
    ]
)

FUEL_TRANSACTIONS = T.StructType(
    [
        T.StructField("fuel_txn_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("transaction_ts", T.TimestampType(), False),
        T.StructField("pump_number", T.IntegerType()),
        T.StructField("fuel_type", T.StringType()),
        T.StructField("gallons", T.DoubleType()),
        T.StructField("price_per_gallon", T.DoubleType()),
        T.StructField("total_fuel_cost", T.DoubleType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("loyalty_points_earned", T.IntegerType()),
    ]
)

STORE_PURCHASES = T.StructType(
    [
        T.StructField("store_item_id", T.StringType(), False),
        T.StructField("fuel_txn_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("purchase_id", T.StringType(), False),
        T.StructField("store_ts", T.TimestampType(), False),
        T.StructField("category", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("line_total", T.DoubleType()),
        T.StructField("basket_total", T.DoubleType()),
    ]
)

BOOKING_REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType(), False),
        T.StructField("property_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("check_in", T.DateType()),
        T.StructField("check_out", T.DateType()),
        T.StructField("guests", T.IntegerType()),
        T.StructField("total_price", T.DoubleType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

# request_id says which request made the booking; the other columns are the booking record.
BOOKINGS = T.StructType(
    [
        T.StructField("booking_id", T.LongType(), False),
        T.StructField("property_id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("check_in", T.DateType(), False),
        T.StructField("check_out", T.DateType(), False),
        T.StructField("guests", T.IntegerType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("total_price", T.DecimalType(10, 2)),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("request_id", T.LongType(), False),
    ]
)

CANCELLATIONS = T.StructType([T.StructField("booking_id", T.LongType(), False)])
