"""Measures of a binary classifier over a scored frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import running_totals

# Names of the two classes in the report.
CLASS_NAMES = {0: "Pumps Only", 1: "Goes to Store"}


def with_prediction(scored: DataFrame, score: str, out: str, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn(out, (F.col(score) >= threshold).cast("int"))


def before(df: DataFrame, ts: str, cutoff: str) -> Column:
    """Whether ``ts`` lies before ``cutoff``, read in the type of the column."""
    return F.col(ts) < F.lit(cutoff).cast(df.schema[ts].dataType)


def split_summary(df: DataFrame, ts: str, cutoff: str, label: str) -> DataFrame:
    """Size and positive rate of the rows before ``cutoff`` (train) and from it on (test).

    Rows without a time are in neither.
    """
    df = df.where(F.col(ts).isNotNull())
    split = F.when(before(df, ts, cutoff), "train").otherwise("test")
    return df.groupBy(split.alias("split")).agg(
        F.count("*").alias("n_rows"), F.avg(label).alias("positive_rate")
    )


def _cells(label: str, predicted: str) -> dict[str, Column]:
    def rows_with(actual: int, guess: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(predicted) == guess))

    return {"tn": rows_with(0, 0), "fp": rows_with(0, 1), "fn": rows_with(1, 0), "tp": rows_with(1, 1)}


def _counts(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in _cells(label, predicted).items()])


def _share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where nothing is there to divide by."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _scores(hits: Column, false_alarms: Column, misses: Column) -> tuple[Column, Column, Column]:
    return (
        _share(hits, hits + false_alarms),
        _share(hits, hits + misses),
        _share(2 * hits, 2 * hits + false_alarms + misses),
    )


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows (actual, predicted, n_rows) for all four cells, also empty ones."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n_rows"))
            for a, p, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
        ]
    )
    return _counts(df, label, predicted).select(F.inline(cells))


def binary_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """F1, precision, recall and accuracy of class 1, to four decimals."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, f1 = _scores(tp, fp, fn)
    accuracy = _share(tp + tn, tp + tn + fp + fn)
    return _counts(df, label, predicted).select(
        F.round(f1, 4).alias("f1"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(accuracy, 4).alias("accuracy"),
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    no, yes = _scores(tn, fn, fp), _scores(tp, fp, fn)
    n_no, n_yes = tn + fp, tp + fn
    total = n_no + n_yes
    accuracy = _share(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(no, yes)]
    weighted = [_share(a * n_no + b * n_yes, total) for a, b in zip(no, yes)]
    nothing = F.lit(None).cast("double")
    lines = [
        (CLASS_NAMES[0], no, n_no),
        (CLASS_NAMES[1], yes, n_yes),
        ("accuracy", (nothing, nothing, accuracy), total),
        ("macro avg", macro, total),
        ("weighted avg", weighted, total),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("class"),
                F.round(precision, 4).alias("precision"),
                F.round(recall, 4).alias("recall"),
                F.round(f1, 4).alias("f1"),
                support.alias("support"),
            )
            for name, (precision, recall, f1), support in lines
        ]
    )
    return _counts(df, label, predicted).select(F.inline(rows))


def roc_auc(
    scored: DataFrame,
    label: str,
    score: str,
    by: list[str] | None = None,
    digits: int = 4,
    slices: int | None = None,
) -> DataFrame:
    """Area under the ROC curve, one row per value of ``by``; ties count half, one class gives null.

    Rows are first counted per score. A positive then beats the negatives at lower scores and half of
    those at its own, which is what the running total of negatives gives.
    """
    by = by or []
    positive = F.col(label) == 1
    per_score = scored.groupBy(*by, score).agg(
        F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg")
    )
    ranked = running_totals(per_score, by, [score], {"_lower": F.col("_neg")}, slices)
    beaten = F.sum(F.col("_pos").cast("double") * (F.col("_lower") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*by).agg(
        F.round(beaten / F.nullif(pairs, F.lit(0.0)), digits).alias("roc_auc"),
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
    )
