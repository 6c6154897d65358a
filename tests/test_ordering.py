from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators.ordering import SLICE, number_rows, running_totals, sliced
from tests.helpers import operators_in

ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3)), max_size=40)


def frame(spark, rows):
    data = [(key, t, i, i % 5) for i, (key, t) in enumerate(rows)]
    return spark.createDataFrame(data, "k string, t int, id int, v long").repartition(3)


@settings(max_examples=6, deadline=None)
@given(rows=ROWS, slices=st.integers(1, 9))
def test_totals_per_key(spark, rows, slices):
    df = frame(spark, rows)
    got = running_totals(df, ["k"], ["t", "id"], {"before": F.col("v"), "n": F.lit(1)}, slices)
    expected = {}
    for key in ("a", "b", None):
        mine = sorted((t, i) for i, (k, t) in enumerate(rows) if k == key)
        sums = accumulate((i % 5 for _, i in mine), initial=0)
        expected.update({i: (s, n) for n, ((_, i), s) in enumerate(zip(mine, sums))})
    assert {r.id: (r.before, r.n) for r in got.collect()} == expected


@settings(max_examples=6, deadline=None)
@given(rows=ROWS, slices=st.integers(1, 9))
def test_totals_over_everything(spark, rows, slices):
    df = frame(spark, rows)
    got = running_totals(df, [], ["t", "id"], {"before": F.col("v").cast("decimal(9,2)")}, slices)
    ordered = sorted((t, i) for i, (_, t) in enumerate(rows))
    sums = accumulate((i % 5 for _, i in ordered), initial=0)
    assert {r.id: r.before for r in got.collect()} == {i: s for (_, i), s in zip(ordered, sums)}


@pytest.mark.parametrize("descending", [False, True])
def test_numbers_are_dense(spark, descending):
    df = frame(spark, [("a", i % 4) for i in range(100)])
    got = number_rows(df, ["t", "id"], "n", 5, descending, 7)
    ordered = sorted(((i % 4, i) for i in range(100)), reverse=descending)
    assert [r.id for r in got.orderBy("n").collect()] == [i for _, i in ordered]
    assert sorted(r.n for r in got.collect()) == list(range(5, 105))


def test_one_value_that_holds_all_rows_is_cut(spark):
    """Ties in the leading column do not end up in one slice, and each slice lies in a bucket of its own."""
    df = spark.range(4_000).selectExpr("1 AS k", "2 AS t", "id", "id AS v")
    cut = sliced(df, ["k", "t", "id"], 8)
    sizes = cut.groupBy(SLICE).agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy(SLICE).collect()
    assert len(sizes) == 8 and max(r.n for r in sizes) < 1_000
    assert [r["first"] for r in sizes] == sorted(r["first"] for r in sizes)
    buckets = {r[SLICE]: r.bucket for r in spark.createDataFrame(sizes).select(
        F.col(SLICE).cast("int").alias(SLICE), F.pmod(F.hash(F.col(SLICE).cast("int")), F.lit(8)).alias("bucket")).collect()}
    assert sorted(buckets.values()) == list(range(8))


def test_totals_move_rows_once(spark):
    """The rows are range-partitioned before they are stored; after that only one row per slice is joined to them."""
    df = frame(spark, [("a", i % 7) for i in range(200)])
    plan = operators_in(running_totals(df, ["k"], ["t", "id"], {"before": F.col("v")}, 5))
    assert plan.count("Window") == 1 and "Bucketed: true" in plan
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert not exchanges


def test_nothing_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert running_totals(frame(spark, [("a", 1)]), ["k"], ["t", "id"], {"n": F.lit(1)}).count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("slices", [1, 4])
def test_keys_that_are_not_a_number(spark, slices):
    """Nulls and NaN are keys like others, also where a cut goes through them."""
    keys = [None] * 20 + [float("nan")] * 20 + [1.0] * 20
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k double, id int")
    got = running_totals(df, ["k"], ["id"], {"n": F.lit(1)}, slices).collect()
    assert sorted(r.n for r in got) == sorted(3 * list(range(20)))


def test_no_window_over_the_whole_frame(spark):
    df = frame(spark, [("a", 1), ("b", 2)])
    plan = operators_in(running_totals(df, [], ["t", "id"], {"before": F.col("v")}))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 and SLICE in windows[0].split("windowspecdefinition(")[1]
