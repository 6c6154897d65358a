from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from decimal import Decimal

import pytest

from larkspur.operators.bookings import (
    cancelled_bookings,
    current_bookings,
    list_bookings,
    number_bookings,
    rejected_requests,
    valid_requests,
)
from larkspur.operators.listings import missing_keys
from larkspur.plans import booking_log
from larkspur.plans.booking_log import cancel_bookings, create_bookings, read_bookings, snapshot_bookings
from larkspur.sources.commits import CommitConflict, CommitLog, Commits
from larkspur.sources.schemas import BOOKING_REQUESTS, BOOKINGS
from larkspur.streaming.booking_intake import read_checked, read_requests, store_checked
from tests.helpers import operators_in, rows_of

NOW = datetime(2025, 5, 1, 12)
IN, OUT = date(2025, 6, 1), date(2025, 6, 4)


def request(i, prop=1, user=1, check_in=IN, check_out=OUT, guests=2, price=10.0, at=datetime(2025, 1, 1)):
    return (i, prop, user, check_in, check_out, guests, price, at)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [
        request(1),
        request(2, check_out=IN),
        request(3, check_out=date(2025, 5, 30)),
        request(4, prop=None),
        request(5, user=None),
        request(6, check_in=None),
        request(7, check_out=None),
        request(8, guests=None, price=None, at=None),
        request(9, price=99_999_999.99),
        request(10, price=100_000_000.0),
        request(11, price=1.005, guests=0),
    ]
    return spark.createDataFrame(rows, BOOKING_REQUESTS)


def test_rejects_and_reasons(requests):
    assert {r.request_id: r.reject_reason for r in rejected_requests(requests).collect()} == {
        2: "check_out is not later than check_in",
        3: "check_out is not later than check_in",
        4: "property_id is required",
        5: "user_id is required",
        6: "check_in is required",
        7: "check_out is required",
        10: "total_price out of range",
    }


def test_valid_rows_and_defaults(requests):
    rows = {r.request_id: r for r in valid_requests(requests, NOW).collect()}
    assert sorted(rows) == [1, 8, 9, 11]
    assert (rows[8].guests, rows[8].total_price, rows[8].created_at) == (1, None, NOW)
    assert rows[9].total_price == Decimal("99999999.99")
    assert (rows[11].guests, rows[11].total_price) == (0, Decimal("1.01"))
    assert {r.status for r in rows.values()} == {"CONFIRMED"}


def test_guests_out_of_range(requests):
    many = requests.where("request_id = 1").selectExpr("* EXCEPT (guests)", "3000000000 AS guests")
    assert [r.reject_reason for r in rejected_requests(many).collect()] == ["guests out of range"]


def test_numbers_follow_time_then_request(spark):
    rows = [request(i, at=datetime(2025, 1, 1 + i % 3)) for i in range(60)]
    valid = valid_requests(spark.createDataFrame(rows, BOOKING_REQUESTS))
    for slices in (1, 3, 16):
        numbered = number_bookings(valid, 100, slices)
        assert numbered.columns == BOOKINGS.names
        got = [r.request_id for r in numbered.orderBy("booking_id").collect()]
        assert got == sorted(range(60), key=lambda i: (i % 3, i))
        assert sorted(r.booking_id for r in numbered.collect()) == list(range(101, 161))


def test_numbering_needs_no_single_task(spark, requests):
    plan = operators_in(number_bookings(valid_requests(requests, NOW)))
    assert "Window" not in plan and "SinglePartition" not in plan


@pytest.fixture(scope="module")
def bookings(spark):
    rows = [(i, i % 2, i % 3, datetime(2025, 1, 1 + i % 4), "CONFIRMED") for i in range(1, 9)]
    return spark.createDataFrame(
        rows, "booking_id long, property_id long, user_id long, created_at timestamp_ntz, status string"
    )


def test_list_newest_first(bookings):
    assert [r[0] for r in rows_of(list_bookings(bookings))] == [7, 3, 6, 2, 5, 1, 8, 4]
    assert [r[0] for r in rows_of(list_bookings(bookings, property_id=1, user_id=1))] == [7, 1]
    assert [r[0] for r in rows_of(list_bookings(bookings, limit=2, offset=3))] == [2, 5]


def test_cancelling(spark, bookings):
    named = spark.createDataFrame([(2,), (2,), (5,), (77,)], "booking_id long")
    state = {r.booking_id: r.status for r in current_bookings(bookings, named).collect()}
    assert {i for i, s in state.items() if s == "CANCELLED"} == {2, 5}
    assert len(state) == 8
    again = current_bookings(current_bookings(bookings, named), named)
    assert {r.booking_id: r.status for r in again.collect()} == state
    assert sorted(r.booking_id for r in cancelled_bookings(bookings, named).collect()) == [2, 5]
    assert rows_of(missing_keys(named, bookings, "booking_id")) == [(77,)]


def test_log_gives_the_same_ids_when_a_batch_runs_again(spark, requests, tmp_path):
    log = str(tmp_path)
    stored, rejected = create_bookings(requests, log, 1, NOW)
    assert (stored.count(), rejected.count()) == (4, 7)
    later = spark.createDataFrame([request(20), request(21)], BOOKING_REQUESTS)
    for _ in range(2):
        stored, _ = create_bookings(later, log, 2, NOW)
        assert sorted(r.booking_id for r in stored.collect()) == [5, 6]
    ids = spark.createDataFrame([(5,), (5,), (7,)], "booking_id long")
    for _ in range(2):
        named, missing = cancel_bookings(ids, log, 2)
        assert [(r.booking_id, r.status) for r in named.collect()] == [(5, "CANCELLED")]
        assert rows_of(missing) == [(7,)]
        create_bookings(spark.createDataFrame([request(30)], BOOKING_REQUESTS), log, 3, NOW)
    create_bookings(requests, log, 1, NOW)
    state = {r.booking_id: r.status for r in read_bookings(spark, log).collect()}
    assert state == {i: "CANCELLED" if i == 5 else "CONFIRMED" for i in range(1, 8)}


def test_log_repeats_no_id(spark, tmp_path):
    def batch(*ids):
        return spark.createDataFrame([request(i) for i in ids], BOOKING_REQUESTS)

    log = str(tmp_path)
    create_bookings(batch(1, 2, 3), log, 1, NOW)
    create_bookings(batch(11, 12, 13), log, 2, NOW)
    with pytest.raises(ValueError, match="batch 1 had 3 bookings, now 5"):
        create_bookings(batch(1, 2, 3, 4, 5), log, 1, NOW)
    create_bookings(batch(1, 2, 3), log, 1, NOW)
    create_bookings(batch(11, 12, 13, 14), log, 2, NOW)
    # What a failed attempt leaves is not read.
    read_bookings(spark, log).write.parquet(f"{log}/bookings/batch=1/attempt=failed")
    assert sorted((r.booking_id, r.request_id) for r in read_bookings(spark, log).collect()) == [
        (1, 1), (2, 2), (3, 3), (4, 11), (5, 12), (6, 13), (7, 14)
    ]
    # A batch that comes late takes ids after all others.
    create_bookings(batch(9), log, 0, NOW)
    assert {r.request_id: r.booking_id for r in read_bookings(spark, log).collect()}[9] == 8


def test_two_writers_cannot_both_commit(spark, tmp_path, monkeypatch):
    """The second one works on what the first has made obsolete; whichever batch it has, it raises and can run again."""

    def batch(*ids):
        return spark.createDataFrame([request(i) for i in ids], BOOKING_REQUESTS)

    log = str(tmp_path)
    create_bookings(batch(1), log, 1, NOW)
    number = booking_log.number_bookings

    def slow(other):
        def work(*args):
            monkeypatch.setattr(booking_log, "number_bookings", number)
            create_bookings(batch(5, 6), log, other, NOW)
            return number(*args)

        return work

    for other in (2, 1):
        monkeypatch.setattr(booking_log, "number_bookings", slow(2))
        with pytest.raises(CommitConflict):
            create_bookings(batch(7, 8, 9), log, 3 if other == 2 else 2, NOW)
    create_bookings(batch(7, 8, 9), log, 3, NOW)
    assert sorted((r.booking_id, r.request_id) for r in read_bookings(spark, log).collect()) == [
        (1, 1), (2, 5), (3, 6), (4, 7), (5, 8), (6, 9)
    ]


def test_a_commit_is_made_once(spark, tmp_path):
    """Many writers at once: every number is given to one of them, and no attempt is left half made."""
    log = CommitLog(spark, str(tmp_path / "commits"))
    assert log.read() == Commits(0, None, [])
    made, lost = [], []

    def write(writer):
        own = CommitLog(spark, str(tmp_path / "commits"))
        for _ in range(5):
            try:
                own.append(own.read().last, {"writer": writer})
                made.append(writer)
            except CommitConflict:
                lost.append(writer)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    commits = log.read()
    assert commits.last == len(commits.records) == len(made) and len(made) + len(lost) == 30
    assert [c["number"] for c in commits.records] == list(range(1, len(made) + 1))
    assert sorted(c["writer"] for c in commits.records) == sorted(made)
    assert not [f for f in (tmp_path / "commits").iterdir() if f.name.startswith("_")]
    log.append(commits.last, {"sum": 1}, snapshot=True)
    log.append(commits.last + 1, {"writer": 9})
    assert log.read().snapshot["sum"] == 1 and [c["writer"] for c in log.read().records] == [9]
    (tmp_path / "commits" / "_last_snapshot").unlink()
    assert log.read().snapshot["sum"] == 1 and log.read().last == commits.last + 2


def test_snapshot_of_the_log(spark, requests, tmp_path):
    log = str(tmp_path)
    snapshot_bookings(spark, log)
    create_bookings(requests, log, 1, NOW)
    cancel_bookings(spark.createDataFrame([(2,)], "booking_id long"), log, 2)
    before = rows_of(read_bookings(spark, log), "booking_id")
    snapshot_bookings(spark, log)
    assert rows_of(read_bookings(spark, log), "booking_id") == before
    assert not [f for f in read_bookings(spark, log).inputFiles() if "/bookings/" in f or "/cancellations/" in f]
    for batch in (1, 2):
        with pytest.raises(ValueError, match="closed"):
            create_bookings(requests, log, batch, NOW)
        with pytest.raises(ValueError, match="closed"):
            cancel_bookings(spark.createDataFrame([(3,)], "booking_id long"), log, batch)
    later = spark.createDataFrame([request(20), request(21)], BOOKING_REQUESTS)
    for _ in range(2):
        create_bookings(later, log, 3, NOW)
        named, missing = cancel_bookings(spark.createDataFrame([(1,), (5,), (9,)], "booking_id long"), log, 3)
        assert sorted(r.booking_id for r in named.collect()) == [1, 5] and rows_of(missing) == [(9,)]
    # A read lists the snapshot and what came after it.
    files = read_bookings(spark, log).inputFiles()
    assert not [f for f in files if "batch=1/" in f or "cancellations/batch=2/" in f]
    state = {r.booking_id: r.status for r in read_bookings(spark, log).collect()}
    assert state == {i: "CANCELLED" if i in (1, 2, 5) else "CONFIRMED" for i in range(1, 7)}
    snapshot_bookings(spark, log)
    snapshot_bookings(spark, log)
    assert {r.booking_id: r.status for r in read_bookings(spark, log).collect()} == state
    create_bookings(spark.createDataFrame([request(30)], BOOKING_REQUESTS), log, 4, NOW)
    assert {r.request_id: r.booking_id for r in read_bookings(spark, log).collect()}[30] == 7


def test_reading_writes_nothing(spark, tmp_path):
    assert read_bookings(spark, str(tmp_path / "none")).count() == 0
    assert list(tmp_path.iterdir()) == []


def test_empty_log(spark, tmp_path):
    nothing = spark.createDataFrame([], BOOKING_REQUESTS)
    stored, rejected = create_bookings(nothing, str(tmp_path), 1, NOW)
    assert stored.count() == rejected.count() == read_bookings(spark, str(tmp_path)).count() == 0


def test_intake_takes_each_request_once(spark, requests, tmp_path):
    inbox, outbox, state = (str(tmp_path / n) for n in ("inbox", "checked", "state"))
    requests.where("request_id < 5").write.parquet(inbox)
    store_checked(read_requests(spark, inbox), outbox, state).awaitTermination()
    requests.where("request_id >= 5").write.mode("append").parquet(inbox)
    store_checked(read_requests(spark, inbox), outbox, state).awaitTermination()
    checked = read_checked(spark, outbox)
    assert checked.count() == 11
    assert sorted(r.request_id for r in checked.where("accepted").collect()) == [1, 8, 9, 11]
