import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.operators.listings import (
    active_reviews,
    count_by_type,
    find_by_key,
    matching_listings,
    missing_keys,
    search_listings,
)
from larkspur.operators import paging
from larkspur.operators.paging import deep_page, order_index, page, page_after, store_order, stored_page, stored_page_after
from tests.helpers import operators_in, rows_of

SCHEMA = "property_id long, property_type string, base_price double, bedrooms int"


@pytest.fixture(scope="module")
def properties(spark):
    rows = [
        (1, "Hotel", 0.0, 1),
        (2, "Villa", 100.0, 3),
        (3, "Hotel", 200.0, 2),
        (4, None, 150.0, 4),
        (5, "O'Brien\\", None, None),
        (6, "Hotel", 300.0, 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r["property_id"] for r in df.collect())


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({}, [1, 2, 3, 4, 5, 6]),
        ({"property_type": ""}, [1, 2, 3, 4, 5, 6]),
        ({"property_type": "Hotel"}, [1, 3, 6]),
        ({"property_type": "O'Brien\\"}, [5]),
        ({"property_type": "' OR 1=1 --"}, []),
        ({"min_price": 0}, [1, 2, 3, 4, 6]),
        ({"min_price": 100, "max_price": 200}, [2, 3, 4]),
        ({"min_bedrooms": 0}, [1, 2, 3, 4, 6]),
        ({"property_type": "Hotel", "max_price": 200, "min_bedrooms": 2}, [3]),
    ],
)
def test_filters(properties, filters, expected):
    assert ids(matching_listings(properties, **filters)) == expected


def test_search_is_a_page_of_the_matches(properties):
    assert ids(search_listings(properties, 2, 1, property_type="Hotel")) == [3, 6]


@pytest.mark.parametrize("limit, offset", [(0, 0), (101, 0), (20, -1)])
def test_page_bounds(properties, limit, offset):
    with pytest.raises(ValueError):
        page(properties, "property_id", limit, offset)


@pytest.mark.parametrize("name", ["min_price", "max_price", "min_bedrooms"])
def test_negative_bounds_are_rejected(properties, name):
    with pytest.raises(ValueError):
        matching_listings(properties, **{name: -1})


@settings(max_examples=5, deadline=None)
@given(size=st.integers(0, 40), limit=st.integers(1, 15))
def test_pages_cover_every_row_once(spark, size, limit):
    df = spark.range(size).withColumnRenamed("id", "k").repartition(3)
    by_offset, by_key, last = [], [], None
    for offset in range(0, size, limit):
        by_offset += [r.k for r in page(df, "k", limit, offset).collect()]
        found = [r.k for r in page_after(df, "k", last, limit).collect()]
        by_key, last = by_key + found, found[-1]
    assert by_offset == by_key == list(range(size))


def test_deep_page_equals_page(spark):
    df = spark.range(500).selectExpr("id AS k", "id % 7 AS g", "concat('t', id) AS text").repartition(5)
    shallow = page(df, "k", 30, 200, ["g"], descending=True)
    deep = deep_page(df, "k", 30, 200, ["g"], descending=True, slices=4)
    assert rows_of(deep) == rows_of(shallow)
    assert deep_page(df, "k", 30, 495).count() == 5
    assert deep_page(df, "k", 30, 900).count() == 0


def test_deep_page_with_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(k,) for k in (None, 1, 1, 2, 3)], "k int")
    for limit, offset in ((2, 0), (1, 1), (3, 2), (5, 4)):
        assert rows_of(deep_page(df, "k", limit, offset)) == rows_of(page(df, "k", limit, offset))


def test_pages_far_in_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW", 100)
    df = spark.range(400).withColumnRenamed("id", "k").repartition(3)
    plans = [operators_in(page(df, "k", 10, offset)) for offset in (90, 91)]
    assert "TakeOrderedAndProject" in plans[0] and "TakeOrderedAndProject" not in plans[1]
    assert [r.k for offset in (90, 91) for r in page(df, "k", 10, offset).collect()] == [*range(90, 100), *range(91, 101)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A table stored in two orders, with ties, repeated keys and nulls."""
    folder = tmp_path_factory.mktemp("orders")
    df = spark.range(1_050).selectExpr(
        "nullif(id % 1000, 500) AS k", "IF(id % 11 = 0, NULL, id % 7) AS g", "concat('t', id % 1000) AS text"
    ).repartition(5)
    for descending in (False, True):
        store_order(df, f"{folder}/{descending}", "k", ["g"], descending, file_rows=100, slices=4)
    return df, folder


@pytest.mark.parametrize("descending", [False, True])
def test_stored_pages(spark, stored, descending):
    df, folder = stored
    path = f"{folder}/{descending}"
    for limit, offset in ((20, 0), (100, 0), (100, 55), (7, 698), (100, 1_000), (20, 1_049), (20, 1_050), (20, 10**9)):
        found = stored_page(spark, path, limit, offset)
        expected = page(df, "k", limit, offset, ["g"], descending)
        assert found.columns == df.columns
        # Equal rows of the order are equal rows of the table here.
        assert rows_of(found) == rows_of(expected)
        assert len(found.inputFiles()) <= 2
    index = rows_of(order_index(spark, path), "_file")
    assert [r[0] for r in index] == list(range(11)) and [r[1] for r in index] == [100] * 10 + [50]


@pytest.mark.parametrize("descending", [False, True])
def test_stored_pages_after_a_key(spark, stored, descending):
    df, folder = stored
    path, last, seen = f"{folder}/{descending}", None, []
    distinct = df.distinct()
    while True:
        found = stored_page_after(spark, path, last, 90)
        assert len(found.inputFiles()) <= 2
        rows = [tuple(r) for r in found.collect()]
        if not rows:
            break
        seen += rows
        last = rows[-1][1], rows[-1][0]
    assert set(seen) == {tuple(r) for r in distinct.collect()} and len(seen) >= distinct.count()
    missing = stored_page_after(spark, path, (3, 10_000), 5)
    assert rows_of(missing)[0][1] == (3 if descending else 4)


def test_a_stored_order_without_rows(spark, tmp_path):
    df = spark.createDataFrame([], "k long, v string")
    store_order(df, str(tmp_path / "none"), "k")
    assert rows_of(stored_page(spark, str(tmp_path / "none"))) == []
    assert stored_page_after(spark, str(tmp_path / "none"), (3,)).columns == ["k", "v"]
    with pytest.raises(ValueError):
        store_order(df, str(tmp_path / "small"), "k", file_rows=99)


def test_page_keeps_only_its_rows_per_task(properties):
    assert "TakeOrderedAndProject" in operators_in(page(properties, "property_id", 2, 1))


def test_types_most_frequent_first_then_by_name(properties):
    assert rows_of(count_by_type(properties)) == [("Hotel", 3), (None, 1), ("O'Brien\\", 1), ("Villa", 1)]


def test_unknown_deletion_mark_is_not_active(spark):
    reviews = spark.createDataFrame(
        [(1, 7, False), (2, 7, True), (3, 7, None), (4, 8, False)],
        "review_id long, property_id long, is_deleted boolean",
    )
    assert [r[0] for r in rows_of(active_reviews(reviews), "review_id")] == [1, 4]
    assert [r[0] for r in rows_of(active_reviews(reviews, 7))] == [1]


def test_lookup(spark, properties):
    wanted = spark.createDataFrame([(2,), (2,), (6,), (9,)], "property_id long")
    doubled = properties.union(spark.createDataFrame([(6, "Castle", 1.0, 9)], SCHEMA))
    found = find_by_key(wanted, doubled, "property_id")
    assert rows_of(found, "property_id") == [(2, "Villa", 100.0, 3), (6, "Castle", 1.0, 9)]
    assert rows_of(missing_keys(wanted, properties, "property_id")) == [(9,)]


def test_search_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "part")
    rows = [(1, "Hotel", 5.0, 2, "long text")]
    spark.createDataFrame(rows, SCHEMA + ", description string").write.parquet(path)
    found = matching_listings(spark.read.parquet(path), "Hotel", 1, 9, 1).select("property_id")
    plan = operators_in(found)
    for pushed in ("EqualTo(property_type,Hotel)", "GreaterThanOrEqual(base_price,1.0)"):
        assert pushed in plan
    assert "description" not in plan
