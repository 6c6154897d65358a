import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator

import __spark_entry__ as entry
from larkspur.operators.encoding import ordinal_dictionary, ordinal_encode
from larkspur.operators.metrics import (
    binary_metrics,
    classification_report,
    confusion_matrix,
    roc_auc,
    split_summary,
    with_prediction,
)
from larkspur.plans import training
from larkspur.plans.features import CATEGORICAL, FEATURES
from larkspur.session import materialise
from tests.helpers import rows_of


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def area_by_pairs(rows):
    pos, neg = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


SCORES = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6).map(lambda n: n / 8)), max_size=40)


@settings(max_examples=8, deadline=None)
@given(rows=SCORES, slices=st.integers(1, 5))
def test_area_equals_counting_pairs(spark, rows, slices):
    got = roc_auc(scored(spark, rows), "y", "p", digits=10, slices=slices).first()["roc_auc"]
    expected = area_by_pairs(rows)
    assert got == (None if expected is None else pytest.approx(expected, abs=1e-9))


def test_area_agrees_with_the_library(spark):
    generator = random.Random(1)
    rows = [(int(generator.random() < 0.4), generator.random()) for _ in range(500)]
    df = scored(spark, rows)
    library = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y").evaluate(df)
    assert roc_auc(df, "y", "p").first()["roc_auc"] == pytest.approx(library, abs=1e-3)


def test_area_per_group(spark):
    first, second = [(1, 0.9), (0, 0.1)], [(1, 0.2), (0, 0.2), (0, 0.5)]
    df = spark.createDataFrame(
        [("a", *r) for r in first] + [("b", *r) for r in second], "g string, y int, p double"
    )
    got = {r.g: r.roc_auc for r in roc_auc(df, "y", "p", by=["g"], slices=3).collect()}
    assert got == {"a": 1.0, "b": 0.25}


def predictions(spark, rows):
    return spark.createDataFrame(rows, "y int, p int")


def test_confusion_matrix_has_empty_cells(spark):
    got = rows_of(confusion_matrix(predictions(spark, [(1, 1), (1, 1), (0, 0)]), "y", "p"), "actual", "predicted")
    assert got == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 2)]


def test_metrics(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4
    assert rows_of(binary_metrics(predictions(spark, rows), "y", "p")) == [(0.6667, 0.6, 0.75, 0.7)]
    report = {r[0]: tuple(r[1:]) for r in classification_report(predictions(spark, rows), "y", "p").collect()}
    assert report == {
        "Pumps Only": (0.8, 0.6667, 0.7273, 6),
        "Goes to Store": (0.6, 0.75, 0.6667, 4),
        "accuracy": (None, None, 0.7, 10),
        "macro avg": (0.7, 0.7083, 0.697, 10),
        "weighted avg": (0.72, 0.7, 0.703, 10),
    }


def test_metrics_without_anything_to_divide_by(spark):
    assert rows_of(binary_metrics(predictions(spark, [(0, 0)]), "y", "p")) == [(0.0, 0.0, 0.0, 1.0)]
    assert rows_of(binary_metrics(predictions(spark, []), "y", "p")) == [(0.0, 0.0, 0.0, 0.0)]


def test_threshold_is_inclusive(spark):
    got = with_prediction(scored(spark, [(0, 0.5), (0, 0.4999)]), "p", "guess")
    assert [r.guess for r in got.orderBy("p").collect()] == [0, 1]


def test_split_boundary_belongs_to_test(spark):
    moment = datetime(2025, 10, 1)
    df = spark.createDataFrame(
        [(moment - timedelta(seconds=1), 1), (moment, 0), (moment, 1)], "ts timestamp_ntz, y int"
    )
    assert rows_of(split_summary(df, "ts", "2025-10-01 00:00:00", "y"), "split") == [
        ("test", 2, 0.5),
        ("train", 1, 1.0),
    ]


def test_codes(spark):
    train = spark.createDataFrame([("b", "x"), ("a", None), ("b", "x"), ("B", "y")], "c string, d string")
    dictionary = ordinal_dictionary(train, ["c", "d"])
    assert rows_of(dictionary, "feature", "code") == [
        ("c", "B", 0),
        ("c", "a", 1),
        ("c", "b", 2),
        ("d", "x", 0),
        ("d", "y", 1),
    ]
    new = spark.createDataFrame([(1, "a", "y"), (2, "zzz", None), (3, None, "x")], "id int, c string, d string")
    coded = ordinal_encode(new, materialise(dictionary, "dictionary"), ["c", "d"])
    assert rows_of(coded.select("id", "c", "d"), "id") == [(1, 1, 1), (2, -1, -1), (3, -1, 0)]


@pytest.fixture(scope="module")
def matrix(spark):
    """Visits where the label follows the pump number and little else."""
    generator = random.Random(3)
    rows = []
    for i in range(1_200):
        pump = generator.randint(1, 12)
        values = {f: float(generator.randint(0, 5)) for f in FEATURES}
        values.update({c: generator.choice(["x", "y", None]) for c in CATEGORICAL})
        values["pump_number"] = float(pump)
        moment = datetime(2025, 7, 1) + timedelta(hours=3 * i)
        label = int((pump <= 4) != (generator.random() < 0.1))
        rows.append((i, moment, label, *[values[f] for f in FEATURES]))
    types = [f"{f} {'string' if f in CATEGORICAL else 'double'}" for f in FEATURES]
    schema = "fuel_txn_id long, transaction_ts timestamp_ntz, went_to_store int, " + ", ".join(types)
    return materialise(spark.createDataFrame(rows, schema), "matrix")


@pytest.fixture(scope="module")
def model(matrix):
    return training.train_model(matrix, training.ModelSettings(rounds=5))


def test_defaults_are_those_of_the_full_model():
    settings_ = training.ModelSettings()
    assert (settings_.rounds, settings_.depth, settings_.learning_rate) == (400, 5, 0.05)
    assert (settings_.min_hessian_per_leaf, settings_.positive_weight) == (5, 1.6)
    boost = settings_.boosting()
    assert (boost.row_sample, boost.column_sample, boost.l2, boost.seed) == (0.8, 0.8, 1.0, 42)


def test_registered_queries_fit_all_rounds():
    assert entry.MODEL.rounds == training.ModelSettings().rounds


def test_scores(model, matrix):
    scores = training.score_visits(model, matrix)
    assert scores.columns == ["fuel_txn_id", "store_visit_prob", "predicted_store_visit"]
    rows = scores.collect()
    assert len(rows) == 1_200
    assert all(0 <= r[1] <= 1 and r[2] == int(r[1] >= 0.5) for r in rows)


def test_model_learns_and_explains(model, matrix):
    metrics = training.evaluate(model, matrix)
    assert metrics["roc_auc"] > 0.8 and metrics["accuracy"] > 0.8
    gains = training.gain_importance(model, matrix)
    assert gains.count() == 25
    assert training.top_drivers(gains, "gain", 1).first()["feature"] == "pump_number"
    drivers = training.contribution_importance(model, matrix)
    assert drivers.count() == 25 and drivers.first()["feature"] == "pump_number"
    one = training.visit_contributions(model, matrix)
    assert one.columns == ["fuel_txn_id", "base_value", *FEATURES] and one.count() == 1_200
    drops = training.permutation_importance(model, matrix, rows_per_block=100)
    assert drops.count() == 25
    best = drops.first()
    assert best["feature"] == "pump_number" and best["auc_drop"] > 0.2
