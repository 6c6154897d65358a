"""Keyed tables and tables on a curve: the same rows as plain ones, and far fewer of them read."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators.listings import find_by_key, matching_listings, missing_keys
from larkspur.sources.layout import (
    _with_keys,
    curve_place,
    find_stored,
    missing_stored,
    overwrite_keyed_table,
    write_on_curve,
)
from larkspur.sources.tables import read_table
from tests.helpers import operators_in, rows_of

ROWS = 40_000


def rows_read(df):
    """Rows that the scans of a plan without exchanges gave to it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numOutputRows").value()
    return total


@pytest.fixture(scope="module")
def keyed(spark, tmp_path_factory):
    """Even keys only, some of them twice."""
    df = spark.range(ROWS).selectExpr("2 * id AS k", "id % 7 AS g", "concat('text ', id) AS t")
    df = df.union(df.where("k % 1000 = 0").withColumn("g", F.col("g") + 100))
    spark.sql("CREATE SCHEMA IF NOT EXISTS layout")
    overwrite_keyed_table(df, "layout.keyed", "k", 8, str(tmp_path_factory.mktemp("keyed") / "k"), 64 << 10)
    return df, read_table(spark, "layout.keyed")


@pytest.mark.parametrize("few", [0, 2, 200])
def test_lookups_in_a_keyed_table(spark, keyed, few):
    df, table = keyed
    wanted = spark.createDataFrame([(4,), (4,), (2_000,), (5,), (None,), (-3,), (10**12,)], "k bigint")
    assert rows_of(find_stored(wanted, table, "k", few), "k") == rows_of(find_by_key(wanted, df, "k"), "k")
    assert rows_of(missing_stored(wanted, table, "k", few), "k") == rows_of(missing_keys(wanted, df, "k"), "k")
    assert find_stored(wanted.where("false"), table, "k", few).count() == 0
    narrow = spark.createDataFrame([(4,), (5,)], "k int")
    assert [r.k for r in find_stored(narrow, table, "k", few).collect()] == [4]


def test_rows_read_follow_the_number_of_keys(spark, keyed):
    """One key reads a page or so, a miss in range reads nothing, and ten keys less than a bucket each."""
    _, table = keyed
    one, ten = rows_read(_with_keys(table, "k", [31_000])), rows_read(_with_keys(table, "k", list(range(0, 80_000, 8_000))))
    assert 0 < one < ROWS / 16 and one <= ten < ROWS / 2
    assert rows_read(_with_keys(table, "k", [31_001])) == 0
    assert rows_read(_with_keys(table, "k", [-5, 10**9])) == 0


def test_many_keys_do_not_move_the_table(spark, keyed):
    _, table = keyed
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.range(0, 5_000).withColumnRenamed("id", "k")
        found = find_stored(wanted, table, "k")
        # The requests are made distinct and dealt to the buckets; the table stays where it is.
        side = [line for line in operators_in(found).splitlines() if "Exchange" in line]
        assert len(side) == 1 and found.count() == 2_500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.fixture(scope="module")
def listings(spark, tmp_path_factory):
    types = "element_at(array('Hotel', 'Villa', 'Cabin', 'Loft', 'Barn', 'Castle', 'Boat', 'Tent'), cast(1 + xxhash64(id, 1) % 4 + 3 AS int))"
    df = spark.range(ROWS).selectExpr(
        "id AS property_id", f"IF(id % 50 = 0, NULL, {types}) AS property_type",
        "cast(pmod(xxhash64(id, 2), 100000) / 100.0 AS double) AS base_price", "cast(pmod(xxhash64(id, 3), 12) AS int) AS bedrooms",
    )
    folder = tmp_path_factory.mktemp("curve")
    write_on_curve(df, f"{folder}/curve", ["property_type", "base_price", "bedrooms"], 128)
    df.repartitionByRange(128, "property_type").sortWithinPartitions("property_type").write.parquet(f"{folder}/sorted")
    return df, spark.read.parquet(f"{folder}/curve"), spark.read.parquet(f"{folder}/sorted")


SHAPES = [
    {"property_type": "Villa"}, {"min_price": 550, "max_price": 650}, {"min_bedrooms": 11},
    {"property_type": "Loft", "max_price": 200, "min_bedrooms": 9}, {},
]


@pytest.mark.parametrize("filters", SHAPES)
def test_a_curve_holds_the_same_rows(listings, filters):
    df, curve, _ = listings
    assert rows_of(matching_listings(curve, **filters), "property_id") == rows_of(matching_listings(df, **filters), "property_id")


def test_a_curve_prunes_by_every_column(listings):
    """Rows read for filters on each column alone and on all, against a table sorted by the first."""
    _, curve, plain = listings
    read = [[rows_read(matching_listings(t, **filters)) for filters in SHAPES[:4]] for t in (curve, plain)]
    assert all(n < 0.6 * ROWS for n in read[0][:3]) and read[0][3] < 0.2 * ROWS
    # Sorted by type, the other two columns prune nothing.
    assert read[1][1] == read[1][2] == ROWS
    assert sum(read[0]) < 0.6 * sum(read[1])


def test_places_interleave_ranks(spark):
    df = spark.createDataFrame([(a, b) for a in (None, 1, 2, 3, 4) for b in ("x", "y", None)], "a int, b string")
    place = {(r.a, r.b): r.p for r in df.withColumn("p", curve_place(df, ["a", "b"], 2)).collect()}
    assert place[None, None] == 0 and place[None, "x"] <= place[None, "y"]
    ranks = {}
    for (a, b), p in place.items():
        ranks.setdefault(("a", a), set()).add(p & 1 | p >> 1 & 2)
        ranks.setdefault(("b", b), set()).add(p >> 1 & 1 | p >> 2 & 2)
    assert all(len(r) == 1 for r in ranks.values())
    order = [ranks["a", a] for a in (None, 1, 2, 3, 4)]
    assert [min(r) for r in order] == sorted(min(r) for r in order) and len({min(r) for r in order}) >= 3
    empty = df.where("false")
    assert empty.withColumn("p", curve_place(empty, ["a", "b"])).count() == 0
    with pytest.raises(ValueError):
        curve_place(df, ["a", "b"], 40)
