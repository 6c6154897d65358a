from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions.calendar import calendar_features
from larkspur.operators.conversion import LABEL, label_visits, with_profile
from larkspur.operators.history import with_history
from larkspur.plans.features import FEATURES, feature_matrix, with_profile_features
from tests.helpers import operators_in, rows_of

FUEL = (
    "fuel_txn_id string, customer_id string, transaction_ts timestamp_ntz, pump_number int, fuel_type string, "
    "gallons double, price_per_gallon double, total_fuel_cost decimal(10,2), payment_method string, "
    "loyalty_points_earned int"
)
CUSTOMERS = (
    "customer_id string, loyalty_member boolean, loyalty_tier string, member_since timestamp_ntz, "
    "preferred_fuel string"
)
HISTORY = [
    "hist_visit_count",
    "hist_avg_gallons",
    "hist_avg_cost",
    "hist_total_loyalty_pts",
    "hist_store_visits",
    "hist_store_rate",
]
START = datetime(2025, 3, 2, 11)  # a Sunday


def visit(i, customer="a", at=START, pump=1, fuel="Regular", gallons=10.0, cost="33.00", points=100):
    return (f"F{i:03d}", customer, at, pump, fuel, gallons, 3.3, Decimal(cost), "Cash", points)


def fuel_frame(spark, rows):
    return spark.createDataFrame(rows, FUEL)


def store_frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "fuel_txn_id string")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [
            ("a", True, "Gold", datetime(2025, 3, 1, 23, 59), "Regular"),
            ("b", False, "Bronze", datetime(2020, 1, 1), "Diesel"),
            ("c", None, None, None, None),
            ("d", True, "Tin", datetime(2025, 4, 1), "Diesel"),
        ],
        CUSTOMERS,
    )


def test_label_keeps_the_row_count(spark):
    fuel = fuel_frame(spark, [visit(i) for i in range(4)])
    labelled = label_visits(fuel, store_frame(spark, ["F001", "F001", "F003", "F099"]))
    assert [(r.fuel_txn_id, r[LABEL]) for r in labelled.orderBy("fuel_txn_id").collect()] == [
        ("F000", 0),
        ("F001", 1),
        ("F002", 0),
        ("F003", 1),
    ]


@pytest.mark.parametrize(
    "moment, expected",
    [
        (datetime(2025, 3, 2, 11), (11, 1, 3, 1, 1, 1, 0)),
        (datetime(2025, 3, 1, 5, 59), (5, 7, 3, 1, 0, 0, 0)),
        (datetime(2025, 3, 3, 6), (6, 2, 3, 0, 1, 0, 0)),
        (datetime(2025, 12, 31, 14, 59), (14, 4, 12, 0, 0, 1, 0)),
        (datetime(2025, 12, 31, 21, 59), (21, 4, 12, 0, 0, 0, 1)),
        (datetime(2025, 12, 31, 22), (22, 4, 12, 0, 0, 0, 0)),
        (None, (None,) * 7),
    ],
)
def test_calendar(spark, moment, expected):
    df = spark.createDataFrame([(moment,)], "ts timestamp_ntz")
    assert tuple(df.select(*calendar_features("ts").values()).first()) == expected


def test_profile(spark, customers):
    rows = [
        visit(1, "a", datetime(2025, 3, 2, 0, 1), pump=3),
        visit(2, "b", pump=4),
        visit(3, "c", fuel="Diesel"),
        visit(4, "d", fuel="Diesel"),
        visit(5, "z"),
    ]
    featured = with_profile_features(with_profile(fuel_frame(spark, rows), customers))
    got = featured.select(
        "fuel_txn_id",
        "is_loyalty_member",
        "loyalty_tier",
        "member_tenure_days",
        "preferred_fuel_match",
        "near_entrance_pump",
    )
    assert rows_of(got, "fuel_txn_id") == [
        ("F001", 1, "Gold", 1, 1, 1),
        ("F002", 0, "Bronze", 0, 0, 0),
        ("F003", None, "None", 0, None, 1),
        ("F004", 1, "None", -30, 1, 1),
        ("F005", None, "None", 0, None, 1),
    ]


def labelled_frame(spark, rows, visited=()):
    return label_visits(fuel_frame(spark, rows), store_frame(spark, visited))


def history(df):
    return {r[0]: tuple(r[1:]) for r in df.select("fuel_txn_id", *HISTORY).collect()}


def test_history_of_earlier_visits(spark):
    rows = [
        visit(1, gallons=4.0, cost="10.00", points=40),
        visit(2, at=START + timedelta(hours=1), gallons=None, cost="20.00", points=None),
        visit(3, at=START + timedelta(hours=2)),
        visit(4, "b"),
    ]
    got = history(with_history(labelled_frame(spark, rows, ["F001", "F003"])))
    assert got == {
        "F001": (0, 0.0, 0.0, 0, 0, 0.0),
        "F002": (1, 4.0, 10.0, 40, 1, 1.0),
        "F003": (2, 4.0, 15.0, 40, 1, 0.5),
        "F004": (0, 0.0, 0.0, 0, 0, 0.0),
    }


def test_same_moment_goes_by_id(spark):
    rows = [visit(i, points=i) for i in (3, 1, 2)]
    got = history(with_history(labelled_frame(spark, rows).repartition(3)))
    assert {k: (v[0], v[3]) for k, v in got.items()} == {"F001": (0, 0), "F002": (1, 1), "F003": (2, 3)}


VISITS = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 3), st.booleans()), min_size=1, max_size=25
)


@settings(max_examples=5, deadline=None)
@given(visits=VISITS)
def test_own_and_later_rows_do_not_matter(spark, visits):
    rows = [visit(i, c, START + timedelta(hours=h)) for i, (c, h, _) in enumerate(visits)]
    went = [f"F{i:03d}" for i, v in enumerate(visits) if v[2]]
    last = max(range(len(rows)), key=lambda i: (rows[i][2], rows[i][0]))
    changed = [*rows]
    changed[last] = rows[last][:5] + (99.0, 9.9, Decimal("999.00"), "Cash", 999)
    flipped = sorted(set(went) ^ {rows[last][0]})
    before = history(with_history(labelled_frame(spark, rows, went)))
    assert history(with_history(labelled_frame(spark, changed, flipped))) == before


@settings(max_examples=4, deadline=None)
@given(visits=VISITS, slices=st.integers(1, 6))
def test_any_number_of_slices_gives_the_same_history(spark, visits, slices):
    rows = [visit(i, c, START + timedelta(hours=h), points=i) for i, (c, h, _) in enumerate(visits)]
    labelled = labelled_frame(spark, rows, [f"F{i:03d}" for i, v in enumerate(visits) if v[2]])
    assert history(with_history(labelled, slices)) == history(with_history(labelled, 1))


def test_one_customer_with_most_visits(spark):
    rows = [
        visit(i, "a" if i % 10 else "b", START + timedelta(minutes=i // 2), gallons=0.1 + i / 7, cost=f"{i}.37")
        for i in range(800)
    ]
    labelled = labelled_frame(spark, rows, [f"F{i:03d}" for i in range(0, 800, 3)])
    expected = history(with_history(labelled, 1))
    mine = [r for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[1] == "a"]
    for k in (1, 5, 700):
        assert expected[mine[k][0]][1] == pytest.approx(sum(r[5] for r in mine[:k]) / k, abs=1e-6)
    for slices in (4, 16):
        assert history(with_history(labelled, slices)) == expected


def test_matrix_columns(spark, customers):
    df = feature_matrix(fuel_frame(spark, [visit(1)]), store_frame(spark, []), customers)
    assert df.columns == ["fuel_txn_id", "transaction_ts", LABEL, *FEATURES]
    assert len(FEATURES) == 25 and "hist_store_visits" not in FEATURES


def test_matrix_plan(spark, customers):
    """The visits as stored in slices meet their totals and profiles; nothing is done twice or in one task."""
    plan = operators_in(feature_matrix(fuel_frame(spark, [visit(1)]), store_frame(spark, ["F001"]), customers))
    assert "SinglePartition" not in plan and "Python" not in plan
    assert plan.count("Join") <= 2 * 3


def test_empty_tables(spark, customers):
    empty = fuel_frame(spark, [])
    assert feature_matrix(empty, store_frame(spark, []), customers).count() == 0
    assert with_history(label_visits(empty, store_frame(spark, [])).where(F.lit(True))).count() == 0
