"""Train, evaluate, explain and apply the store-visit model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import boosting, contributions
from larkspur.operators.boosting import EXCHANGED, INPUTS, MARGIN, MARGINS, Boosted, BoostSettings
from larkspur.operators.conversion import LABEL
from larkspur.operators.encoding import ordinal_dictionary, ordinal_encode
from larkspur.operators.metrics import before, binary_metrics, roc_auc, with_prediction
from larkspur.plans.features import CATEGORICAL, FEATURES
from larkspur.session import materialise

PROBABILITY, PREDICTED = "store_visit_prob", "predicted_store_visit"
_ID, _TS = "fuel_txn_id", "transaction_ts"


@dataclass(frozen=True)
class ModelSettings:
    """Boosting settings and the boundary between train and test."""

    rounds: int = 400
    depth: int = 5
    learning_rate: float = 0.05
    row_sample: float = 0.8
    column_sample: float = 0.8
    min_hessian_per_leaf: float = 5.0
    positive_weight: float = 1.6
    seed: int = 42
    cutoff: str = "2025-10-01 00:00:00"

    def boosting(self) -> BoostSettings:
        return BoostSettings(
            rounds=self.rounds,
            depth=self.depth,
            learning_rate=self.learning_rate,
            row_sample=self.row_sample,
            column_sample=self.column_sample,
            min_hessian=self.min_hessian_per_leaf,
            positive_weight=self.positive_weight,
            seed=self.seed,
        )


@dataclass
class VisitModel:
    trees: Boosted
    dictionary: DataFrame
    settings: ModelSettings = field(default_factory=ModelSettings)


def split_by_time(matrix: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    early = before(matrix, _TS, cutoff)
    return matrix.where(early), matrix.where(~early)


def numeric_inputs(matrix: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Inputs as doubles. A category that training has not seen is -1; null stays null, for which each split has learnt a way."""
    known = {c: F.col(c).isNotNull() for c in CATEGORICAL}
    marked = matrix.withColumns({f"_known_{c}": k for c, k in known.items()})
    encoded = ordinal_encode(marked, dictionary, CATEGORICAL)
    codes = {c: F.when(F.col(f"_known_{c}"), F.col(c).cast("double")) for c in CATEGORICAL}
    plain = {c: F.col(c).cast("double") for c in FEATURES if c not in codes}
    return encoded.withColumns(codes | plain).drop(*[f"_known_{c}" for c in CATEGORICAL])


def _with_inputs(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn(INPUTS, F.array(*[F.col(c) for c in FEATURES]))


def train_model(matrix: DataFrame, settings: ModelSettings = ModelSettings()) -> VisitModel:
    """Fit codes and trees on the rows before the cutoff; ``matrix`` should be a stored table."""
    train, _ = split_by_time(matrix, settings.cutoff)
    dictionary = materialise(ordinal_dictionary(train, CATEGORICAL), "dictionary")
    trees = boosting.fit(numeric_inputs(train, dictionary), FEATURES, LABEL, _ID, settings.boosting())
    return VisitModel(trees, dictionary, settings)


def _scored(model: VisitModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability in place of their inputs."""
    return _with_probability(boosting.with_margin(model.trees, rows))


def _with_probability(margins: DataFrame) -> DataFrame:
    return margins.withColumn(PROBABILITY, 1 / (1 + F.exp(-F.col(MARGIN)))).drop(MARGIN)


def score_visits(model: VisitModel, matrix: DataFrame) -> DataFrame:
    """Id, probability and 0/1 decision of every transaction."""
    rows = _with_inputs(numeric_inputs(matrix, model.dictionary)).select(_ID, INPUTS)
    return with_prediction(_scored(model, rows), PROBABILITY, PREDICTED).select(_ID, PROBABILITY, PREDICTED)


def evaluate(model: VisitModel, matrix: DataFrame) -> dict[str, float | None]:
    """Metrics over the rows from the cutoff on."""
    _, test = split_by_time(matrix, model.settings.cutoff)
    rows = _with_inputs(numeric_inputs(test, model.dictionary)).select(LABEL, INPUTS)
    result = materialise(with_prediction(_scored(model, rows), PROBABILITY, PREDICTED), "test")
    area = roc_auc(result, LABEL, PROBABILITY).first()["roc_auc"]
    return {"roc_auc": area, **binary_metrics(result, LABEL, PREDICTED).first().asDict()}


def gain_importance(model: VisitModel, like: DataFrame) -> DataFrame:
    """Mean gain of the splits on each feature; 0 for a feature no tree uses."""
    gains = list(boosting.mean_gains(model.trees).items())
    report = like.sparkSession.createDataFrame(gains, "feature string, gain double")
    return report.orderBy(F.desc("gain"), "feature")


def visit_contributions(model: VisitModel, matrix: DataFrame) -> DataFrame:
    """Per transaction the base value and each feature's Shapley value; together they are the row's margin."""
    rows = _with_inputs(numeric_inputs(matrix, model.dictionary)).select(_ID, INPUTS)
    explained = contributions.with_contributions(model.trees, rows)
    values = [F.col(contributions.CONTRIBUTIONS)[i].alias(c) for i, c in enumerate(FEATURES)]
    return explained.select(_ID, "base_value", *values)


def contribution_importance(model: VisitModel, matrix: DataFrame) -> DataFrame:
    """Mean absolute contribution of each feature to the margin of the rows from the cutoff on, largest first."""
    _, test = split_by_time(matrix, model.settings.cutoff)
    return contributions.mean_absolute_contributions(model.trees, _with_inputs(numeric_inputs(test, model.dictionary)))


def permutation_importance(
    model: VisitModel, matrix: DataFrame, rows_per_block: int = 100_000
) -> DataFrame:
    """Loss of test ROC AUC when one feature is given the value of another row.

    Rows fall into random blocks and take the feature from their neighbour in a random order, so one
    shuffle serves all features.
    """
    _, test = split_by_time(matrix, model.settings.cutoff)
    test = materialise(numeric_inputs(test, model.dictionary).select(_ID, LABEL, *FEATURES), "test")
    blocks = test.count() // rows_per_block + 1
    mixed = F.xxhash64(F.lit(model.settings.seed), _ID)
    in_block = Window.partitionBy("_block").orderBy("_mix", _ID)
    whole_block = in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = test.withColumns({"_mix": mixed, "_block": F.pmod(mixed, F.lit(blocks))}).withColumns(
        {f"_other_{c}": F.coalesce(F.lag(c).over(in_block), F.last(c).over(whole_block)) for c in FEATURES}
    )

    exchanged = F.array(*[F.col(f"_other_{c}") for c in FEATURES])
    pairs = _with_inputs(other).select(_ID, LABEL, INPUTS, exchanged.alias(EXCHANGED))
    # There are few blocks; the work per row is many times that of a block's order.
    context, settings = test.sparkSession.sparkContext, test.sparkSession.conf
    tasks = max(context.defaultParallelism, int(settings.get("spark.sql.shuffle.partitions")))
    margins = boosting.with_exchanged_margins(model.trees, pairs.repartition(tasks, _ID).select(LABEL, INPUTS, EXCHANGED))
    names = F.array(*[F.lit(c) for c in ["", *FEATURES]])
    each = margins.select(LABEL, F.inline(F.arrays_zip(names.alias("feature"), F.col(MARGINS).alias(MARGIN))))
    scored = _with_probability(each)
    areas = materialise(roc_auc(scored, LABEL, PROBABILITY, by=["feature"], digits=6), "areas")
    unchanged = areas.where(F.col("feature") == "").first()
    whole = F.lit(unchanged["roc_auc"] if unchanged else None).cast("double")
    return (
        areas.where(F.col("feature") != "")
        .select("feature", F.round(whole - F.col("roc_auc"), 6).alias("auc_drop"))
        .orderBy(F.desc("auc_drop"), "feature")
    )


def top_drivers(importance: DataFrame, measure: str, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc(measure), "feature").limit(k)
