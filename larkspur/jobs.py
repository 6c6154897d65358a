"""Complete jobs over catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators.conversion import LABEL, repeated_keys
from larkspur.operators.metrics import split_summary
from larkspur.plans import datasets, generator, training
from larkspur.plans.features import FEATURES, feature_matrix
from larkspur.session import materialise
from larkspur.sources import sinks
from larkspur.sources.tables import LABEL_BUCKETS, read_conversion_tables, read_table, use_namespace

PREDICTIONS = "store_visit_predictions"
_MEASURE = "mean_abs_contribution"


def preview_table(
    spark: SparkSession, name: str, schema: str, catalog: str | None = None, rows: int = 5
) -> DataFrame:
    """Go to a namespace, read a table and print its first rows."""
    use_namespace(spark, schema, catalog)
    df = read_table(spark, name)
    sinks.preview(df, rows)
    return df


def refresh_datasets(
    spark: SparkSession, trips: str, namespace: str, folder: str | None = None
) -> dict[str, DataFrame]:
    """Store every dataset over the table ``trips`` in a namespace; each reads the stored rows of the others."""
    sinks.create_schema(spark, namespace)
    stored: dict[str, DataFrame] = {}

    def store(name: str, df: DataFrame) -> DataFrame:
        sinks.overwrite_table(df, f"{namespace}.{name}", f"{folder}/{name}" if folder else None)
        stored[name] = read_table(spark, f"{namespace}.{name}")
        return stored[name]

    for name in datasets.DATASETS:
        datasets.build(name, {"trips": read_table(spark, trips), **stored}, store=store)
    return stored


def generate_tables(
    spark: SparkSession,
    namespace: str,
    settings: generator.GeneratorSettings = generator.GeneratorSettings(),
    folder: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Generate and store the three conversion tables; returns the conversion summary of what is stored.

    With ``buckets`` fuel and store tables are bucketed by transaction, for the label join. Rows, and rows that
    break a rule of their own, are counted while they are written; one that does is an error.
    """
    people = generator.row_numbers(spark, settings.customers)
    visits = generator.row_numbers(spark, settings.fuel_transactions)
    sinks.create_schema(spark, namespace)
    counted = sinks.overwrite_tables(
        {
            "customers": generator.generate_customers(people, settings),
            "fuel_transactions": generator.generate_fuel_transactions(visits, settings),
            "store_purchases": generator.generate_store_purchases(visits, settings),
        },
        namespace,
        folder,
        LABEL_BUCKETS,
        buckets,
        generator.row_rules(),
    )
    sizes = {name: counts.pop("n_rows") for name, counts in counted.items()}
    broken = {rule: n for counts in counted.values() for rule, n in counts.items() if n}
    if broken:
        raise RuntimeError(f"generated rows break their rules: {broken}")
    fuel, customers, store = read_conversion_tables(spark, namespace)
    return generator.conversion_summary(customers, fuel, store, sizes)


def train_and_score(
    spark: SparkSession,
    namespace: str,
    settings: training.ModelSettings = training.ModelSettings(),
    reports: str | None = None,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Build features, train, evaluate, explain, and store a prediction for every transaction.

    ``reports`` is where the importance tables go as CSV, ``folder`` where the files of the
    prediction table lie if not in the warehouse. Returns what the job reports, by name.
    """
    fuel, customers, store = read_conversion_tables(spark, namespace)
    if not repeated_keys(customers, "customer_id").isEmpty():
        raise ValueError(f"{namespace}.customers holds a customer_id more than once")
    matrix = materialise(feature_matrix(fuel, store, customers), "matrix")
    model = training.train_model(matrix, settings)
    gain = training.gain_importance(model, matrix)
    drivers = materialise(training.contribution_importance(model, matrix), "importance")
    if reports:
        sinks.write_report(gain, f"{reports}/feature_importance")
        sinks.write_report(training.top_drivers(drivers, _MEASURE, len(FEATURES)), f"{reports}/contribution_importance")
    predictions = f"{namespace}.{PREDICTIONS}"
    sinks.overwrite_table(training.score_visits(model, matrix), predictions, folder)
    return {
        "split": split_summary(matrix, "transaction_ts", settings.cutoff, LABEL),
        "metrics": spark.createDataFrame(
            list(training.evaluate(model, matrix).items()), "metric string, value double"
        ),
        "gain": gain,
        "top_drivers": training.top_drivers(drivers, _MEASURE),
        "predictions": read_table(spark, predictions),
    }
