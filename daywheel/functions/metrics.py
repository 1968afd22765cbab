"""Evaluation measures as aggregate columns: usable under any grouping, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("MSE", "RMSE", "MAE", "RMSLE", "R2", "MAPE")


def _both(actual: Column, predicted: Column) -> Column:
    return actual.isNotNull() & predicted.isNotNull() & ~F.isnan(actual) & ~F.isnan(predicted)


def regression(actual: Column, predicted: Column, where: Column | None = None, suffix: str = "") -> list[Column]:
    """mse, rmse, mae, rmsle, r2, mape over pairs that are both known (and meet where); null where there are none.

    r2 is null for fewer than two pairs; for a constant target it is 1 if all errors are 0, else 0. mape is in percent over
    targets other than 0.
    """
    known = _both(actual, predicted) if where is None else _both(actual, predicted) & where
    on = lambda c: F.when(known, c)
    error = actual - predicted
    mse = F.avg(on(error * error))
    logs = F.log1p(F.greatest(actual, F.lit(0.0))) - F.log1p(F.greatest(predicted, F.lit(0.0)))
    spread = F.var_pop(on(actual))
    n = F.count(on(F.lit(1)))
    r2 = F.when(n >= 2, F.when(spread == 0, F.when(mse == 0, 1.0).otherwise(0.0)).otherwise(1 - mse / spread))
    found = {
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(on(F.abs(error))),
        "rmsle": F.sqrt(F.avg(on(logs * logs))),
        "r2": r2,
        "mape": F.avg(on(F.when(actual != 0, F.abs(error / actual)))) * 100,
    }
    return [c.alias(k + suffix) for k, c in found.items()]


def dry_and_rainy(actual: Column, predicted: Column, threshold: float = 1.0) -> list[Column]:
    """Counts, shares and measures of dry (under threshold) and rainy targets."""
    dry, wet = actual < threshold, actual >= threshold
    n = F.count(actual)
    counts = [F.count(F.when(dry, 1)).alias("n_dry"), F.count(F.when(wet, 1)).alias("n_rainy"), (F.count(F.when(dry, 1)) / n * 100).alias("dry_percent")]
    return counts + [c for part, name in ((dry, "_dry"), (wet, "_rainy")) for c in regression(actual, predicted, part, name)[:3]]


def by(df: DataFrame, *keys: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """n and the regression measures of each group."""
    measures = [F.count(F.lit(1)).alias("n"), *regression(F.col(actual), F.col(predicted))]
    return df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)


def by_sets(df: DataFrame, *keys: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """The measures by each key alone and over all, in one pass: columns key_set, the keys (null outside their set), measures."""
    name = F.concat_ws("_", *[F.when(F.expr(f"grouping(`{k}`)") == 0, F.lit(k)) for k in keys])
    groups = df.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys])
    return groups.agg(F.when(name == "", "all").otherwise(name).alias("key_set"), F.count(F.lit(1)).alias("n"), *regression(F.col(actual), F.col(predicted)))


def weight_of(value: Column, thresholds: list[float], weights: list[float]) -> Column:
    """The weight of a value's bin; its bin is the number of thresholds below it."""
    if len(weights) != len(thresholds) + 1:
        raise ValueError("one more weight than thresholds is needed")
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    out = F.lit(float(weights[-1]))
    for t, w in reversed(list(zip(thresholds, weights, strict=False))):
        out = F.when(value <= t, float(w)).otherwise(out)
    return out


def weighted_mse(actual: Column, predicted: Column, thresholds: list[float], weights: list[float]) -> Column:
    error = actual - predicted
    return F.avg(weight_of(actual, thresholds, weights) * error * error)
