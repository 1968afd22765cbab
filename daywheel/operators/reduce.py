"""Principal components, fitted on train rows: centred, signs fixed, chosen by explained variance.

The covariance is summed by Spark (d x d numbers leave the executors); the projection is an array expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import signed


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance of the sample) of the features."""
    stats = rows.select(array_to_vector("features").alias("v")).select(Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s")).select("s.mean", "s.count").first()
    mean, n = np.array(stats[0]), int(stats[1])
    d = len(mean)

    def run(parts):
        total = np.zeros((d, d))
        for part in parts:
            x = np.stack(part["features"].to_numpy()) - mean
            total += x.T @ x
        yield __import__("pandas").DataFrame({"c": [total.ravel().tolist()]})

    parts = rows.select("features").mapInPandas(run, "c array<double>").collect()  # one d x d row of each task
    total = np.sum([r.c for r in parts], axis=0).reshape(d, d)
    return n, mean, total / max(n - 1, 1)


class PCA:
    """Mean, components (d x k) and explained variance ratios."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, ratios: np.ndarray) -> None:
        self.mean, self.components, self.ratios = mean, components, ratios

    def apply(self, rows: DataFrame, out: str = "features") -> DataFrame:
        """rows with the projected features."""
        centred = F.zip_with("features", F.array(*[F.lit(float(m)) for m in self.mean]), lambda x, m: x - m)
        rows = rows.withColumn("_c", centred)
        dots = []
        for k in range(self.components.shape[1]):
            axis = F.array(*[F.lit(float(v)) for v in self.components[:, k]])
            dots.append(F.aggregate(F.zip_with("_c", axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
        return rows.withColumn(out, F.array(*dots)).drop("_c")


def components_for(ratios: np.ndarray, threshold: float) -> int:
    """The fewest components whose explained variance adds up to threshold; all, if it is never reached."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    total = np.cumsum(ratios)
    return int(np.argmax(total >= threshold)) + 1 if (total >= threshold).any() else len(ratios)


def fit(rows: DataFrame, threshold: float | None = 0.9, k: int | None = None) -> PCA:
    n, mean, covariance = moments(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    most = min(n, len(mean))
    ratios = values / values.sum() if values.sum() > 0 else np.zeros_like(values)
    k = k or components_for(ratios[:most], threshold)
    return PCA(mean, signed(vectors[:, :k]), ratios[:k])


def route(samples: DataFrame, threshold: float | None, mode: str = "clustering_only") -> DataFrame:
    """samples with cluster_features (and, in mode "both", features) reduced by what the train rows say; threshold None: unreduced."""
    if mode not in ("clustering_only", "both"):
        raise ValueError("mode must be 'clustering_only' or 'both'")
    if threshold is None:
        return samples.withColumn("cluster_features", F.col("features"))
    reduced = fit(samples.where("split = 'train'"), threshold).apply(samples, "cluster_features")
    return reduced.withColumn("features", F.col("cluster_features")) if mode == "both" else reduced


def mode_label(threshold: float | None, mode: str) -> str:
    return "none" if threshold is None else {"clustering_only": "clustering only", "both": "clustering and model inputs"}[mode]


def projection(rows: DataFrame, high: str = "high") -> tuple[DataFrame, DataFrame]:
    """(rows with x and y, centroids of high and low rows) on the first two components."""
    flat = fit(rows, k=2).apply(rows, "_xy").select("*", F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y")).drop("_xy")
    return flat, flat.groupBy(high).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
