"""Bookings and cancellations as append-only logs, one folder per batch and attempt.

Both logs share one sequence of batch numbers and one log of commits. An attempt counts once it is committed, so
a write that fails leaves the batch as it was; of two writers that started from the same state one raises
:class:`CommitConflict`, whatever their batches. A batch that runs again keeps its first id, so it gets the same ids
whatever came later; a cancellation finds the bookings of its own and earlier batches only.

A snapshot holds the state of all bookings up to its batch. Reads take it and fold in the batches after it, without listing
the folders of older ones; batches up to a snapshot are closed.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from larkspur.operators.bookings import (
    accepted,
    cancelled_bookings,
    current_bookings,
    number_bookings,
    rejected,
    with_reject_reason,
)
from larkspur.operators.listings import missing_keys
from larkspur.session import materialise
from larkspur.sources.commits import CommitLog, Commits
from larkspur.sources.schemas import BOOKINGS, CANCELLATIONS

_BOOKED, _CANCELLED, _STATE = "bookings", "cancellations", "snapshots"


def _commits(spark: SparkSession, folder: str) -> CommitLog:
    return CommitLog(spark, f"{folder}/commits")


def _batches(commits: Commits, name: str) -> dict[int, dict]:
    """The last commit of each batch of the log ``name`` since the last snapshot."""
    return {c["batch"]: c for c in commits.records if c["log"] == name}


def _read(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _path(folder: str, commit: dict) -> str:
    return f"{folder}/{commit['log']}/batch={commit['batch']}/attempt={commit['attempt']}"


def _bookings(spark: SparkSession, folder: str, commits: Commits, last_batch: int | None = None) -> DataFrame:
    """The snapshot's bookings and those of later batches, up to ``last_batch``, without cancellations after the snapshot."""
    found = [c for b, c in sorted(_batches(commits, _BOOKED).items()) if last_batch is None or b <= last_batch]
    first = [commits.snapshot] if commits.snapshot else []
    return _read(spark, [_path(folder, c) for c in first + found], BOOKINGS)


def _write_batch(df: DataFrame, folder: str, name: str, batch: int, commits: Commits, **numbers: int) -> DataFrame:
    commit = {"log": name, "batch": batch, "attempt": uuid.uuid4().hex, **numbers}
    df.write.parquet(_path(folder, commit))
    _commits(df.sparkSession, folder).append(commits.last, commit, name == _STATE)
    return _read(df.sparkSession, [_path(folder, commit)], df.schema)


def _check_open(commits: Commits, batch: int) -> None:
    if commits.snapshot and batch <= commits.snapshot["batch"]:
        raise ValueError(f"batch {batch} is closed by the snapshot of batch {commits.snapshot['batch']}")


def _end(commit: dict) -> int:
    return commit["first_id"] + commit["count"]


def _next_id(commits: Commits) -> int:
    ends = [_end(c) for c in _batches(commits, _BOOKED).values()]
    return max([*ends, commits.snapshot["next_id"] if commits.snapshot else 1])


def _first_id(commits: Commits, batch: int, count: int) -> int:
    """The first id of a batch: that of its last run, else the one after all ids given."""
    batches = _batches(commits, _BOOKED)
    own = batches.get(batch)
    if own is None:
        return _next_id(commits)
    later = [c for b, c in batches.items() if b != batch and _end(c) > own["first_id"]]
    if count != own["count"] and later:
        raise ValueError(f"batch {batch} had {own['count']} bookings, now {count}; ids after it are given")
    return own["first_id"]


def create_bookings(
    requests: DataFrame, folder: str, batch: int, now: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Append the valid requests of a batch; returns the stored bookings and the rejected requests.

    Requests are read and checked once; what is numbered and what is returned comes from that. A batch that runs
    again with another number of bookings raises if ids after its own are given.
    """
    spark = requests.sparkSession
    commits = _commits(spark, folder).read()
    _check_open(commits, batch)
    checked = materialise(with_reject_reason(requests), "checked")
    valid = accepted(checked, now)
    count = valid.count()
    first = _first_id(commits, batch, count)
    numbered = number_bookings(valid, first - 1)
    return _write_batch(numbered, folder, _BOOKED, batch, commits, first_id=first, count=count), rejected(checked)


def read_bookings(spark: SparkSession, folder: str) -> DataFrame:
    """All bookings in their state after all cancellations."""
    return _state(spark, folder, _commits(spark, folder).read())


def _state(spark: SparkSession, folder: str, commits: Commits) -> DataFrame:
    cancelled = [_path(folder, c) for _, c in sorted(_batches(commits, _CANCELLED).items())]
    return current_bookings(_bookings(spark, folder, commits), _read(spark, cancelled, CANCELLATIONS))


def cancel_bookings(ids: DataFrame, folder: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """Append cancellations; returns the bookings they name and the ids that name none.

    Only ids of known bookings are kept: an id that is given to a booking later stays untouched.
    """
    spark = ids.sparkSession
    commits = _commits(spark, folder).read()
    _check_open(commits, batch)
    bookings = _bookings(spark, folder, commits, batch)
    asked = materialise(ids.select("booking_id").distinct(), "asked")
    known = asked.join(bookings.select("booking_id"), "booking_id", "left_semi")
    named = _write_batch(known, folder, _CANCELLED, batch, commits)
    return cancelled_bookings(bookings, named), missing_keys(asked, named, "booking_id")


def snapshot_bookings(spark: SparkSession, folder: str) -> None:
    """Store the state of all bookings, so that reads need no batch before it; nothing to do without new batches."""
    commits = _commits(spark, folder).read()
    if commits.records:
        batch = max(c["batch"] for c in commits.records)
        _write_batch(_state(spark, folder, commits), folder, _STATE, batch, commits, next_id=_next_id(commits))
