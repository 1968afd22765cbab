"""Configuration grids, runs with isolated failures, rankings."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import regression


@dataclasses.dataclass(frozen=True)
class Config:
    """A clustering run."""

    window: int
    k: int
    sigma: float | None = None

    @property
    def name(self) -> str:
        tail = "" if self.sigma is None else f"_s{self.sigma}".replace(".", "p")
        return f"w{self.window}_k{self.k}{tail}"


@dataclasses.dataclass(frozen=True)
class ArmaConfig:
    """A baseline run."""

    window: int
    horizon: int
    p: int
    q: int

    @property
    def name(self) -> str:
        return f"arma_p{self.p}_q{self.q}_w{self.window}_h{self.horizon}"


def configurations(windows: list[int], ks: list[int], sigmas: list[float] | None = None) -> list[Config]:
    if not windows or not ks:
        raise ValueError("a grid needs window sizes and cluster counts")
    return [Config(w, k, s) for w, k, s in itertools.product(windows, ks, sigmas or [None])]


def arma_configurations(windows: list[int], horizon: int, orders: list[tuple[int, int]]) -> list[ArmaConfig]:
    if not windows or not orders or horizon <= 0:
        raise ValueError("a grid needs window sizes, orders and a positive horizon")
    return [ArmaConfig(w, horizon, p, q) for w, (p, q) in itertools.product(windows, orders)]


def grid_table(spark: SparkSession, grid: list[Config]) -> DataFrame:
    return spark.createDataFrame([(c.name, c.window, c.k, c.sigma) for c in grid], "name string, window int, k int, sigma double")


def sized(runs: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """runs (a row each, with window) with stations and windows: how many keys of rows are long enough, and their windows in all."""
    sizes = runs.select("window").distinct()
    days = rows.groupBy(*keys).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(sizes))
    found = days.groupBy("window").agg(F.count_if(F.col("_n") >= F.col("window")).alias("stations"), F.sum(F.greatest(F.col("_n") - F.col("window") + 1, F.lit(0))).alias("windows"))
    return runs.join(found, "window", "left").fillna(0, ["stations", "windows"])


def run_all(grid: list, run: Callable[[object], dict]) -> tuple[list[dict], list[dict]]:
    """(results, failures): a failing configuration is a row, not the end of the sweep."""
    done, failed = [], []
    for config in grid:
        try:
            done.append({"run_name": config.name} | run(config))
        except Exception as why:  # noqa: BLE001  whatever a run raises is its result
            failed.append({"run_name": config.name, "error": f"{type(why).__name__}: {why}"})
    return done, failed


def window_mean_sweep(rows: DataFrame, windows: list[int], rain: str = "rain", keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """window, test_rmse, test_mae of forecasting the next day by the window's mean; all window sizes share one sort."""
    order = Window.partitionBy(*keys).orderBy("row_idx")
    cells = [F.struct(F.lit(w).alias("window"), F.lead(rain, w).over(order).alias("y"), F.avg(rain).over(order.rowsBetween(0, w - 1)).alias("m")) for w in windows]
    long = rows.select(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*").where("y is not null")
    return long.groupBy("window").agg(*[c for c, n in zip(regression(F.col("y"), F.col("m"), suffix=""), ("mse", "rmse", "mae", "rmsle", "r2", "mape"), strict=True) if n in ("rmse", "mae")]).withColumnsRenamed({"rmse": "test_rmse", "mae": "test_mae"})


def rank(results: DataFrame, by: tuple[str, ...] = ("test_rmse", "test_mae")) -> DataFrame:
    """results with rank, best first, unknown last. One row per run: the window needs no partitions."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_last() for c in by])))
