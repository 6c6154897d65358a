"""Booking requests as they arrive.

The checks of the batch job run on a stream unchanged, as they look at one request at a time. Ids are
given later by the batch job, which needs the order of all requests of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from larkspur.operators.bookings import REASON, with_reject_reason
from larkspur.sources.schemas import BOOKING_REQUESTS


def read_requests(spark: SparkSession, folder: str, file_format: str = "parquet") -> DataFrame:
    """Requests as an unbounded frame of the files that appear in ``folder``."""
    return spark.readStream.schema(BOOKING_REQUESTS).format(file_format).load(folder)


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``accepted`` and, for the others, the reason."""
    return with_reject_reason(requests).withColumn("accepted", F.col(REASON).isNull())


def store_checked(
    requests: DataFrame, folder: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write checked requests below ``folder`` exactly once, split by ``accepted``.

    Takes what is there and ends, or goes on in steps of ``every``, such as ``1 minute``.
    """
    when = {"processingTime": every} if every else {"availableNow": True}
    return (
        checked_requests(requests)
        .writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .partitionBy("accepted")
        .outputMode("append")
        .trigger(**when)
        .start()
    )


def read_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What the intake has stored so far; pruned to one side by a filter on ``accepted``."""
    schema = StructType(
        [
            *BOOKING_REQUESTS.fields,
            StructField(REASON, StringType()),
            StructField("accepted", BooleanType()),
        ]
    )
    return spark.read.schema(schema).parquet(folder)
