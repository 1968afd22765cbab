"""Oracle routing: every test sample under every cluster's model, the best model by each metric, and what switching gains.

predictions: (idx, test_cluster, actual, model, prediction), one row per sample and model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, regression
from .quantiles import grouped

#: Which error picks the model for a metric. MAPE falls back to the absolute error where the target is 0.
PICKS = {"MSE": "squared_error", "RMSE": "squared_error", "MAE": "absolute_error", "RMSLE": "squared_log_error", "MAPE": "percent_or_absolute"}


def comparison(predictions: DataFrame) -> DataFrame:
    """predictions with is_same_cluster and the errors of each pair."""
    error = F.col("actual") - F.col("prediction")
    logs = F.log1p(F.greatest("actual", F.lit(0.0))) - F.log1p(F.greatest("prediction", F.lit(0.0)))
    return predictions.withColumns(
        {
            "is_same_cluster": F.col("model") == F.col("test_cluster"),
            "squared_error": error * error,
            "absolute_error": F.abs(error),
            "squared_log_error": logs * logs,
            "absolute_percent_error": F.when(F.col("actual") != 0, F.abs(error / F.col("actual")) * 100),
        }
    )


def selection(compared: DataFrame, metrics: tuple[str, ...] = tuple(PICKS)) -> DataFrame:
    """The best model of each sample and metric (the lowest id on ties), next to the sample's own cluster's model."""
    rows = compared.withColumn("percent_or_absolute", F.coalesce("absolute_percent_error", "absolute_error"))
    worst = F.lit(float("inf"))
    best = [F.min(F.struct(F.coalesce(F.col(PICKS[m]), worst).alias("e"), F.col("model").alias("m"), F.col("prediction").alias("p"))).alias(m) for m in metrics]
    own = F.max(F.when(F.col("is_same_cluster"), F.col("prediction"))).alias("same_cluster_prediction")
    found = rows.groupBy("idx", "test_cluster", "actual").agg(*best, own)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)["m"].alias("model"), F.col(m)["p"].alias("prediction")) for m in metrics])).alias("s")
    found = found.select("idx", "test_cluster", "actual", "same_cluster_prediction", each)
    return found.select(
        "idx",
        "test_cluster",
        F.col("s.metric").alias("metric"),
        F.col("s.model").alias("selected_model_cluster"),
        (F.col("s.model") == F.col("test_cluster")).alias("selected_is_same_cluster"),
        "actual",
        F.col("s.prediction").alias("selected_prediction"),
        "same_cluster_prediction",
        F.abs(F.col("actual") - F.col("s.prediction")).alias("selected_absolute_error"),
        F.abs(F.col("actual") - F.col("same_cluster_prediction")).alias("same_cluster_absolute_error"),
    )


def metric_summary(selected: DataFrame) -> DataFrame:
    """Of each metric: measures before and after selection, improvements and shares, and how many samples switched."""
    before = regression(F.col("actual"), F.col("same_cluster_prediction"), suffix="_original")
    after = regression(F.col("actual"), F.col("selected_prediction"), suffix="_selected")
    switched = F.count(F.when(~F.col("selected_is_same_cluster"), 1))
    found = selected.groupBy("metric").agg(*before, *after, F.count("*").alias("n_test"), switched.alias("switched_samples"))
    columns = {}
    for name in (m.lower() for m in METRICS):
        old, new = F.col(f"{name}_original"), F.col(f"{name}_selected")
        columns[f"{name}_improvement"] = new - old if name == "r2" else old - new
        if name != "r2":
            columns[f"{name}_improvement_percent"] = (old - new) / F.nullif(old, F.lit(0.0)) * 100
    columns["switched_percent"] = F.col("switched_samples") / F.col("n_test") * 100
    return found.withColumns(columns)


def _of_metric(selected: DataFrame, metric: str) -> DataFrame:
    return selected.where(F.upper("metric") == metric.upper())


def transfer_matrix(selected: DataFrame, metric: str, models: list[int] | None = None) -> DataFrame:
    """assigned_test_cluster and a count column LSTM_<id> for each selected model."""
    rows = _of_metric(selected, metric)
    models = models if models is not None else sorted(r[0] for r in rows.select("selected_model_cluster").distinct().collect())
    counts = rows.groupBy(F.col("test_cluster").alias("assigned_test_cluster")).pivot("selected_model_cluster", models).count().fillna(0)
    return counts.select("assigned_test_cluster", *[F.col(str(m)).alias(f"LSTM_{m}") for m in models])


def _gains(selected: DataFrame, metric: str) -> DataFrame:
    old, new = F.col("same_cluster_absolute_error"), F.col("selected_absolute_error")
    return _of_metric(selected, metric).withColumns({"_gain": old - new, "_gain2": old * old - new * new})


def cluster_summary(selected: DataFrame, metric: str) -> DataFrame:
    """Routing gains of each assigned cluster."""
    old, new = F.col("same_cluster_absolute_error"), F.col("selected_absolute_error")
    switched = F.count(F.when(~F.col("selected_is_same_cluster"), 1))
    measures = [
        F.count("*").alias("n_test"),
        switched.alias("oracle_switched_samples"),
        (switched / F.count("*") * 100).alias("oracle_switched_percent"),
        F.sqrt(F.avg(old * old)).alias("same_cluster_rmse"),
        F.sqrt(F.avg(new * new)).alias("oracle_rmse"),
        F.avg(old).alias("same_cluster_mae"),
        F.avg(new).alias("oracle_mae"),
        F.avg("_gain").alias("mae_improvement"),
        F.avg("_gain2").alias("mean_squared_error_improvement"),
        F.avg("actual").alias("mean_actual_precipitation_mm"),
    ]
    used = ("same_cluster_absolute_error", "selected_absolute_error", "selected_is_same_cluster", "_gain", "_gain2", "actual")
    found = grouped(_gains(selected, metric).select(F.col("test_cluster").alias("assigned_test_cluster"), *used), "_gain", [0.5], ["assigned_test_cluster"], measures)
    found = found.withColumn("median_absolute_error_improvement", F.col("q")[0]).drop("q")
    return found.withColumn("rmse_improvement", F.col("same_cluster_rmse") - F.col("oracle_rmse"))


def pair_summary(selected: DataFrame, metric: str) -> DataFrame:
    """Routing gains of each pair of assigned and selected cluster, with its share of the assigned one."""
    found = _gains(selected, metric).groupBy(F.col("test_cluster").alias("assigned_test_cluster"), F.col("selected_model_cluster").alias("oracle_selected_model_cluster")).agg(
        F.count("*").alias("n_test"),
        F.avg("actual").alias("mean_actual_precipitation_mm"),
        F.avg("same_cluster_absolute_error").alias("same_cluster_mae"),
        F.avg("selected_absolute_error").alias("oracle_mae"),
        F.avg("_gain").alias("mae_improvement"),
        F.avg("_gain2").alias("mean_squared_error_improvement"),
    )
    return found.withColumn("percent_of_assigned_cluster", F.col("n_test") / F.sum("n_test").over(Window.partitionBy("assigned_test_cluster")) * 100)


def aligned(samples: DataFrame, selected: DataFrame, metric: str) -> DataFrame:
    """Samples (idx, ...) with the model and forecast the oracle picks, in order of idx."""
    pick = _of_metric(selected, metric).select("idx", "selected_model_cluster", "selected_prediction", "same_cluster_prediction")
    return samples.join(pick, "idx", "left").orderBy("idx")
