import json
import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from larkspur.session import discard, materialise, shared_folder
from larkspur.sources import sinks
from larkspur.sources.schemas import BOOKINGS
from larkspur.sources.tables import (
    list_table_names,
    list_tables,
    read_conversion_tables,
    read_fixture,
    read_folder,
    read_table,
    use_namespace,
)
from tests.helpers import rows_of


@pytest.fixture(scope="module")
def namespace(spark):
    sinks.create_schema(spark, "shop")
    sinks.create_schema(spark, "shop")
    return "shop"


def test_overwrite_and_read_back(spark, namespace):
    tables = {"store_purchases": spark.range(3), "customers": spark.range(2), "fuel_transactions": spark.range(5)}
    for _ in range(2):
        counts = sinks.overwrite_tables(tables, namespace)
        assert {name: c["n_rows"] for name, c in counts.items()} == {"customers": 2, "fuel_transactions": 5, "store_purchases": 3}
    assert [t.count() for t in read_conversion_tables(spark, namespace)] == [5, 2, 3]
    assert [r[0] for r in list_table_names(spark, namespace).collect()] == sorted(tables)
    assert set(list_tables(spark, namespace).columns) == {"namespace", "tableName", "isTemporary"}


def test_rows_are_counted_as_they_are_written(spark, namespace):
    """Also empty tables, tables in buckets, and what a caller wants to know besides."""
    df = spark.range(1_000).repartition(5)
    measures = {"odd": F.count_if(F.col("id") % 2 == 1), "total": F.sum("id")}
    for buckets in (None, 3):
        counted = sinks.overwrite_table(df, "shop.counted", None, "id", buckets, measures)
        assert counted == {"n_rows": 1_000, "odd": 500, "total": 499_500}
        assert read_table(spark, "shop.counted").count() == 1_000
    assert sinks.overwrite_table(df.where("id < 0"), "shop.counted", measures=measures)["n_rows"] == 0
    assert sinks.overwrite_table(spark.createDataFrame([], "id int"), "shop.counted") == {"n_rows": 0}


RETRIES = """
import sys
from pyspark import TaskContext
from pyspark.sql import functions as F
from larkspur.session import local_session
from larkspur.sources import sinks

spark = local_session(**{"cores": "2,3", "spark.sql.warehouse.dir": sys.argv[1]})

def fails_once(batches):
    context = TaskContext.get()
    for batch in batches:
        yield batch
        if context.attemptNumber() == 0 and context.partitionId() % 2:
            raise RuntimeError("lost")

df = spark.range(0, 50_000, 1, 4).mapInArrow(fails_once, "id bigint")
print(sinks.overwrite_table(df, "t", measures={"total": F.sum("id")}), spark.table("t").count())
"""


def test_a_task_that_runs_again_counts_once(tmp_path):
    here = {**os.environ, "PYTHONPATH": str(Path(__file__).parent.parent)}
    done = subprocess.run(
        [sys.executable, "-c", RETRIES, str(tmp_path)], capture_output=True, text=True, timeout=300, env=here, cwd=tmp_path
    )
    assert done.stdout.strip().endswith("{'n_rows': 50000, 'total': 1249975000} 50000"), done.stderr[-2000:]


def test_overwrite_replaces_the_schema(spark, namespace):
    sinks.overwrite_table(spark.range(3), "shop.predictions")
    sinks.overwrite_table(spark.createDataFrame([("x",)], "name string"), "shop.predictions")
    assert rows_of(read_table(spark, "shop.predictions")) == [("x",)]


def test_unqualified_names(spark, namespace):
    sinks.overwrite_table(spark.range(4), "shop.unqualified")
    use_namespace(spark, namespace, "spark_catalog")
    try:
        assert read_table(spark, "unqualified").count() == 4
    finally:
        use_namespace(spark, "default")


def test_create_if_absent_keeps_what_is_there(spark, namespace):
    sinks.create_table_if_absent(spark, "shop.bookings", BOOKINGS)
    assert read_table(spark, "shop.bookings").columns == BOOKINGS.names
    sinks.overwrite_table(spark.range(1), "shop.kept")
    sinks.create_table_if_absent(spark, "shop.kept", BOOKINGS)
    assert read_table(spark, "shop.kept").count() == 1


def test_csv_is_all_strings(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text('id,price,text\n1,2.50,"a, ""b""\nc"\n2,,x\n')
    df = read_fixture(spark, str(path), multi_line=True)
    assert dict(df.dtypes) == {"id": "string", "price": "string", "text": "string"}
    assert rows_of(df, "id") == [("1", "2.50", 'a, "b"\nc'), ("2", None, "x")]


def test_json_array(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text(json.dumps([{"id": 1, "name": "a"}, {"id": 2, "name": None}], indent=1))
    df = read_fixture(spark, str(path), multi_line=True)
    assert rows_of(df.select("id", "name"), "id") == [(1, "a"), (2, None)]


def test_values_over_several_lines_are_found(spark, tmp_path):
    """Without being told: indented arrays, also without a schema, and line breaks in quotes, also in the last or only column."""
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"id": 1, "name": "a\nb"}, {"id": 2, "name": None}], indent=2))
    for schema in (None, "id bigint, name string"):
        assert rows_of(read_fixture(spark, str(array), schema).select("id", "name"), "id") == [(1, "a\nb"), (2, None)]
    one = tmp_path / "one.json"
    one.write_text('[{"id": 1}, {"id": 2}]\n\n{"id": 3}\n')
    assert rows_of(read_fixture(spark, str(one)), "id") == [(1,), (2,), (3,)]
    pair = tmp_path / "pair.csv"
    pair.write_text('k,t\n"x\ny",1\n2,"say ""hi"",\nplease"\n')
    assert rows_of(read_fixture(spark, str(pair)), "k") == [("2", 'say "hi",\nplease'), ("x\ny", "1")]
    single = tmp_path / "single.csv"
    single.write_text('t\n"x\ny"\nz\n')
    assert rows_of(read_fixture(spark, str(single)), "t") == [("x\ny",), ("z",)]
    folder = tmp_path / "folder.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("k,t\n1,a\n")
    (folder / "b.csv").write_text('k,t\n2,"b\nc"\n')
    assert rows_of(read_fixture(spark, str(folder)), "k") == [("1", "a"), ("2", "b\nc")]


@pytest.mark.parametrize(
    "name, text",
    [("a.json", '{"id": 1}\n{"id": '), ("b.json", '[{"id": 1},\n{"id" 2}]'), ("a.csv", "k,t\n1\n"), ("b.csv", "k,t\n1,2,3\n2,3\n")],
)
def test_rows_that_do_not_fit_are_errors(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE|FAILFAST"):
        read_fixture(spark, str(tmp_path / name)).collect()
    if name.endswith("csv"):
        with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE|FAILFAST"):
            read_fixture(spark, str(tmp_path / name)).select("k").collect()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text('{"id": 1}\n{"id": 2}\n')
    assert read_fixture(spark, str(path)).count() == 2


def test_other_suffixes_are_refused_before_reading(spark):
    with pytest.raises(ValueError):
        read_fixture(spark, "/nowhere/data.xml")


def test_folder(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "trips.parquet"))
    assert read_folder(spark, str(tmp_path), "trips").count() > 5


def test_report_is_one_file(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.range(20_000).repartition(5), path)
    assert len(list((tmp_path / "report").glob("part-*.csv"))) == 1
    assert spark.read.option("header", True).csv(path).count() == 20_000


def test_preview(spark, capsys):
    sinks.preview(spark.range(50), 2)
    assert "only showing top 2 rows" in capsys.readouterr().out


def test_discarded_tables_are_gone(spark, tmp_path):
    kept, gone = materialise(spark.range(5), "kept"), materialise(spark.range(7), "gone")
    empty = materialise(spark.range(0), "empty")
    folder = Path(gone.inputFiles()[0].removeprefix("file:")).parent
    assert folder.is_dir()
    discard(gone, empty)
    assert not folder.exists() and kept.count() == 5
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=context))
