"""Booking life cycle as batch jobs over append-only logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.arguments import DEFAULT_LIMIT
from larkspur.functions.predicates import equals_if_given, where_all
from larkspur.operators.ordering import number_rows
from larkspur.operators.paging import page
from larkspur.sources.schemas import BOOKINGS

REASON = "reject_reason"
CONFIRMED, CANCELLED = "CONFIRMED", "CANCELLED"
_REQUIRED = ("property_id", "user_id", "check_in", "check_out")


# Columns of a limited range and their types in a booking.
_LIMITED = {"guests": "int", "total_price": "decimal(10,2)"}


def _limited(column: str) -> Column:
    """The column in the type of a booking, null if it does not fit."""
    return F.col(column).try_cast(_LIMITED[column])


def with_reject_reason(requests: DataFrame) -> DataFrame:
    """Requests with the first rule they break in ``reject_reason``, null if they are valid."""
    reason = F.when(F.lit(False), "")
    for column in _REQUIRED:
        reason = reason.when(F.col(column).isNull(), f"{column} is required")
    reason = reason.when(F.col("check_out") <= F.col("check_in"), "check_out is not later than check_in")
    for column in _LIMITED:
        unfit = F.col(column).isNotNull() & _limited(column).isNull()
        reason = reason.when(unfit, f"{column} out of range")
    return requests.withColumn(REASON, reason)


def rejected_requests(requests: DataFrame) -> DataFrame:
    return rejected(with_reject_reason(requests))


def valid_requests(requests: DataFrame, now: datetime | None = None) -> DataFrame:
    """Requests that pass all rules, with the defaults of a new booking filled in."""
    return accepted(with_reject_reason(requests), now)


def rejected(checked: DataFrame) -> DataFrame:
    """The requests of :func:`with_reject_reason` that break a rule."""
    return checked.where(F.col(REASON).isNotNull())


def accepted(checked: DataFrame, now: datetime | None = None) -> DataFrame:
    """The requests of :func:`with_reject_reason` that break none, as bookings without an id.

    ``now`` stands in for a missing creation time; pass it for results that can be repeated.
    """
    moment = F.localtimestamp() if now is None else F.lit(now.isoformat(" ")).cast("timestamp_ntz")
    return checked.where(F.col(REASON).isNull()).select(
        "request_id",
        F.col("property_id").cast("bigint").alias("property_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        "check_in",
        "check_out",
        F.coalesce(_limited("guests"), F.lit(1)).alias("guests"),
        F.lit(CONFIRMED).alias("status"),
        _limited("total_price").alias("total_price"),
        F.coalesce(F.col("created_at").cast("timestamp_ntz"), moment).alias("created_at"),
    )


def number_bookings(valid: DataFrame, last_id: int = 0, slices: int | None = None) -> DataFrame:
    """Bookings with dense ids after ``last_id`` in the order of request time, then request id."""
    numbered = number_rows(
        valid, ["created_at", "request_id"], "booking_id", last_id + 1, slices=slices
    )
    return numbered.select(*BOOKINGS.names)


def list_bookings(
    bookings: DataFrame,
    property_id: int | None = None,
    user_id: int | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """One page of the bookings that meet the given filters, newest first."""
    found = where_all(
        bookings, equals_if_given("property_id", property_id) + equals_if_given("user_id", user_id)
    )
    return page(found, "booking_id", limit, offset, ["created_at"], descending=True)


def current_bookings(bookings: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Bookings with the status after all cancellations; a repeated cancellation changes nothing."""
    cancelled = cancellations.select("booking_id").distinct().withColumn("_cancelled", F.lit(True))
    status = F.when(F.col("_cancelled"), CANCELLED).otherwise(F.col("status"))
    return (
        bookings.join(cancelled, "booking_id", "left")
        .withColumn("status", status)
        .select(*bookings.columns)
    )


def cancelled_bookings(bookings: DataFrame, cancellations: DataFrame) -> DataFrame:
    """The bookings that the cancellations name, as they are afterwards."""
    named = cancellations.select("booking_id").distinct()
    return bookings.join(named, "booking_id", "left_semi").withColumn("status", F.lit(CANCELLED))
