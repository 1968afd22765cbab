"""Evaluation tables: lead days, horizon behaviour, bins, counts, summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import regression
from .quantiles import grouped
from .shared import cut


def lead_long(samples: DataFrame, ids: list[str], actual: str = "y_by_lead", predicted: str = "yhat_by_lead", dates: str | None = "date_by_lead") -> DataFrame:
    """A row for each sample and lead day: ids, lead_day (from 1), target_date, actual, predicted, residual, absolute_error, squared_error."""
    zipped = F.arrays_zip(F.col(actual).alias("a"), F.col(predicted).alias("p"), *([F.col(dates).alias("d")] if dates else []))
    rows = samples.select(*ids, F.posexplode(zipped).alias("_at", "_z"))
    names = rows.schema["_z"].dataType.fieldNames()
    date = [F.col("_z")[names[2]].alias("target_date")] if dates else []
    rows = rows.select(*ids, (F.col("_at") + 1).alias("lead_day"), *date, F.col("_z")[names[0]].alias("actual"), F.col("_z")[names[1]].alias("predicted"))
    r = F.col("actual") - F.col("predicted")
    return rows.withColumns({"residual": r, "absolute_error": F.abs(r), "squared_error": r * r})


def lead_matrix(values: Column, horizon: int, trained: bool = True) -> Column:
    """A scalar or one-column forecast as a row of `horizon`: repeated if it wasn't trained by lead day."""
    return F.when(F.size(values) == horizon, values).otherwise(F.array_repeat(values[F.size(values) - 1], horizon)) if not trained else values


def horizon_diagnostics(samples: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Of each split: correlation of the current value with the target, mean and median change, persistence against the model.

    samples: keys, current, y, predicted.
    """
    delta = F.col("y") - F.col("current")
    keep = regression(F.col("y"), F.col("current"), suffix="_persistence")[1:3]
    model = regression(F.col("y"), F.col("predicted"), suffix="_model")[1:3]
    measures = [F.count("*").alias("n"), F.when(F.count("*") >= 2, F.corr("current", "y")).alias("correlation"), F.avg(delta).alias("mean_delta"), *keep, *model]
    found = grouped(samples.select(*keys, "current", "y", "predicted"), delta, [0.5], keys, measures)
    found = found.withColumn("median_delta", F.col("q")[0]).drop("q")
    return found.withColumns({"rmse_improvement": F.col("rmse_persistence") - F.col("rmse_model"), "mae_improvement": F.col("mae_persistence") - F.col("mae_model")})


def bin_count(values: DataFrame, column: str = "y") -> DataFrame:
    """One row: n_bins and top of the shared histogram. Freedman-Diaconis, held between 8 and 35; without positive values 1 bin up to 1."""
    v = F.col(column)
    stats = grouped(values.select(column), v, [0.25, 0.75], (), [F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")])
    width = 2 * (F.col("q")[1] - F.col("q")[0]) * F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    raw = F.when((width > 0) & (F.col("hi") > F.col("lo")), F.ceil((F.col("hi") - F.col("lo")) / width)).otherwise(1)
    some = (F.col("n") > 0) & (F.col("hi") > 0)
    return stats.select(F.when(some, F.greatest(F.lit(8), F.least(raw, F.lit(35)))).otherwise(1).cast("int").alias("n_bins"), F.when(some, F.col("hi")).otherwise(1.0).alias("top"))


def bin_edges(values: DataFrame, column: str = "y") -> DataFrame:
    """(edge_index, edge)."""
    rows = bin_count(values, column).select("n_bins", "top", F.explode(F.sequence(F.lit(0), F.col("n_bins"))).alias("edge_index"))
    return rows.select("edge_index", F.when(F.col("edge_index") == F.col("n_bins"), F.col("top")).otherwise(F.col("top") / F.col("n_bins") * F.col("edge_index")).alias("edge"))


def histogram(values: DataFrame, keys: tuple[str, ...], column: str = "y", bins: DataFrame | None = None) -> DataFrame:
    """keys, bin (from 1), count over even bins from 0; the last bin is closed, values outside are left out."""
    bins = bin_count(values, column) if bins is None else bins
    rows = values.crossJoin(F.broadcast(bins)).where(F.col(column).between(F.lit(0.0), F.col("top")))
    place = F.least(F.floor(F.col(column) / F.col("top") * F.col("n_bins")) + 1, F.col("n_bins").cast("long"))
    return rows.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("count"))


def error_by_magnitude(rows: DataFrame, n_bins: int = 10, actual: str = "actual", predicted: str = "predicted", keep_largest: bool = False) -> DataFrame:
    """(bin, n, mae, rmse) by percentile bins of the target. The largest target belongs to no bin, unless keep_largest."""
    rows = rows.select(F.col(actual).alias("a"), F.col(predicted).alias("p")).persist()
    edges = grouped(rows, "a", np.linspace(0, 1, n_bins + 1), persist=False).select(F.col("q").alias("edges"))
    at = F.size(F.filter("edges", lambda e: e <= F.col("a"))) - 1
    place = F.least(at, F.lit(n_bins - 1)) if keep_largest else at
    binned = rows.crossJoin(F.broadcast(edges)).select(place.alias("bin"), (F.col("a") - F.col("p")).alias("e")).where(F.col("bin") < n_bins)
    found = cut(binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")))
    rows.unpersist()
    return found


def batch_statistics(assigned: DataFrame, batch: int = 32) -> DataFrame:
    """(cluster, n_train, n_val, n_test, batches_per_epoch) of every cluster that occurs in any split."""
    counts = assigned.groupBy("cluster").pivot("split", ["train", "val", "test"]).count().fillna(0)
    return counts.select("cluster", *[F.col(s).alias(f"n_{s}") for s in ("train", "val", "test")], F.ceil(F.col("train") / batch).alias("batches_per_epoch"))


def cluster_shares(assigned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, cluster, n, percent."""
    counts = assigned.groupBy(*keys, "cluster").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) * 100)


def most_common(assigned: DataFrame) -> DataFrame:
    """One row: the cluster most rows are in (the lowest on ties), its count and share."""
    shares = cluster_shares(assigned)
    return shares.orderBy(F.desc("n"), "cluster").limit(1)


def nonzero_stats(rows: DataFrame, column: str = "y", key: str = "cluster") -> DataFrame:
    """Of each cluster: zeros and their share; mean, median, deviation (population), extremes and quartiles of the rest."""
    v = F.col(column)
    rest = F.when(v != 0, v)
    measures = [F.count(v).alias("n"), F.count(F.when(v == 0, 1)).alias("zeros"), F.avg(rest).alias("mean"), F.stddev_pop(rest).alias("std"), F.min(rest).alias("min"), F.max(rest).alias("max")]
    found = grouped(rows.select(key, column), rest, [0.25, 0.5, 0.75], [key], measures)
    return found.select(key, "n", "zeros", (F.col("zeros") / F.col("n") * 100).alias("zero_percent"), "mean", "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def box_summary(rows: DataFrame, column: str = "y", key: str = "cluster") -> DataFrame:
    found = grouped(rows.select(key, column), column, [0.0, 0.25, 0.5, 0.75, 1.0], [key])
    return found.select(key, *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "q25", "median", "q75", "max"))])


def sample_stats(rows: DataFrame, column: str = "y") -> DataFrame:
    """n, mean, deviation (sample), min, max."""
    return rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))


def scatter_limits(rows: DataFrame, actual: str = "actual", predicted: str = "predicted", padding: float = 0.05) -> DataFrame:
    """low and high of a square plot: the extremes of both columns, padded; a point gets 1 to either side."""
    ends = rows.agg(F.least(F.min(actual), F.min(predicted)).alias("a"), F.greatest(F.max(actual), F.max(predicted)).alias("b"))
    pad = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) * padding).otherwise(1.0)
    return ends.select((F.col("a") - pad).alias("low"), (F.col("b") + pad).alias("high"))


def quantile_weights(values: DataFrame, quantiles: list[float], column: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, bin, threshold (upper, null for the last), n, weight: inverse frequency, the least weight being 1; empty bins count as weight 1."""
    if not quantiles or any(not 0 < q < 1 for q in quantiles) or any(b <= a for a, b in zip(quantiles, quantiles[1:], strict=False)):
        raise ValueError("quantiles must increase strictly between 0 and 1")
    known = values.where(F.col(column).isNotNull())
    limits = grouped(known.select(*keys, column), column, quantiles, keys).where(F.col("q")[0].isNotNull()).select(*keys, F.array_sort(F.array_distinct("q")).alias("t"))
    join = (lambda a, b: a.join(b, list(keys))) if keys else (lambda a, b: a.crossJoin(F.broadcast(b)))
    place = F.size(F.filter("t", lambda t: t < F.col(column)))
    counts = join(known, limits).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    bins = limits.select(*keys, "t", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("bin"))
    rows = bins.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.get("t", F.col("bin")).alias("threshold"), F.coalesce("n", F.lit(0)).alias("n"))
    over = Window.partitionBy(*keys)
    raw = F.when(F.col("n") > 0, F.min(F.when(F.col("n") > 0, F.col("n"))).over(over) / F.col("n")).otherwise(1.0)
    rows = rows.withColumn("_raw", raw)
    return rows.withColumn("weight", F.col("_raw") / F.min("_raw").over(over)).drop("_raw")


def bootstrap_ci(values: DataFrame, column: str = "value", seed: int = 42, resamples: int = 2000, confidence: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, mean, low, high, p_positive of the mean, by resampling.

    Each resample weighs every row by a Poisson(1) draw hashed from row and resample. Every task sums its rows under all
    resamples, so rows are read once and only sums (keys x resamples for each task) are shuffled. Rows need an id column
    `idx` (long) and a known value.
    """
    limits = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(9)])

    def run(parts):
        sums: dict[tuple, list[np.ndarray]] = {}
        turns = np.arange(resamples, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        for part in parts:
            group = list(zip(*[part.column(i).to_pylist() for i in range(2, part.num_columns)], strict=True)) or [()] * len(part)
            ids, x = part.column(0).to_numpy().astype(np.uint64), part.column(1).to_numpy()
            for key in dict.fromkeys(group):
                own = np.flatnonzero([g == key for g in group])
                total = sums.setdefault(key, [np.zeros(resamples), np.zeros(resamples)])
                for a in range(0, len(own), 512):
                    some = own[a : a + 512]
                    h = _scrambled(_scrambled(ids[some] + np.uint64(seed))[:, None] + turns)
                    weight = np.searchsorted(limits, (h >> np.uint64(11)).astype(float) * 2.0**-53, "right").astype(float)
                    total[0] += weight.sum(0)
                    total[1] += x[some] @ weight
        for key, (w, wx) in sums.items():
            columns = {"_b": pa.array(np.arange(resamples, dtype=np.int32)), "_w": pa.array(w), "_x": pa.array(wx)}
            fields = {k: pa.array([v] * resamples, arrow[k]) for k, v in zip(keys, key, strict=True)}
            yield pa.RecordBatch.from_pydict(columns | fields)

    from pyspark.sql.pandas.types import to_arrow_type

    known = values.where(F.col(column).isNotNull()).select(F.col("idx").cast("long"), F.col(column).cast("double").alias("_v"), *keys)
    arrow = {k: to_arrow_type(known.schema[k].dataType) for k in keys}
    schema = ", ".join(["_b int, _w double, _x double", *[f"`{k}` {known.schema[k].dataType.simpleString()}" for k in keys]])
    means = known.mapInArrow(run, schema).groupBy(*keys, "_b").agg((F.sum("_x") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("m"))
    tail = (1 - confidence) / 2
    ci = means.groupBy(*keys).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_positive"))
    plain = values.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"))
    return plain.join(ci, list(keys)) if keys else plain.crossJoin(ci)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pooled_gaps(samples: DataFrame, features: dict[str, int], value: str = "next", quantile: float = 0.75, key: str = "cluster") -> DataFrame:
    """(cluster, feature, mean_high, mean_low, difference): means over all days of the windows before high and other values.

    High is at or above the quantile of the values above 0. samples: cluster, value, win (days as arrays); features name
    places in a day.
    """
    limit = grouped(samples.where(F.col(value) > 0).select(value), value, [quantile]).select(F.col("q")[0].alias("q"))
    days = samples.crossJoin(F.broadcast(limit)).select(key, (F.col(value) >= F.col("q")).alias("high"), F.explode("win").alias("day"))
    cells = F.create_map(*[c for name, at in features.items() for c in (F.lit(name), F.col("day")[at])])
    long = days.select(key, "high", F.explode(cells).alias("feature", "v"))
    found = long.groupBy(key, "feature").agg(F.avg(F.when(F.col("high"), F.col("v"))).alias("mean_high"), F.avg(F.when(~F.col("high"), F.col("v"))).alias("mean_low"))
    return found.withColumn("difference", F.abs(F.col("mean_high") - F.col("mean_low")))
