"""Row order, chronological splits, filters and small projections. Station is part of every key; a split is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schema import DATE, RAIN, STATION

SPLITS = ("train", "val", "test")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = (DATE, "row_idx")) -> list[str]:
    """Numeric columns in the frame's order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def check_ratios(train: float, val: float) -> None:
    if train <= 0 or val <= 0:
        raise ValueError("train and validation ratios must be positive")
    if train + val >= 1:
        raise ValueError("train and validation ratios leave nothing to test on")


def split(daily: DataFrame, train: float = 0.6, val: float = 0.2, key: str = STATION, check: bool = False) -> DataFrame:
    """daily with split, split_row (from 0) and split_offset: the first floor(n * train) rows of a key train, the next floor(n * val) validate.

    Bounds use double arithmetic. check: raise if a part of some key is empty.
    """
    check_ratios(train, val)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = daily.withColumn("_n", n).withColumn("_a", F.floor(F.col("_n") * F.lit(float(train))))
    rows = rows.withColumn("_b", F.col("_a") + F.floor(F.col("_n") * F.lit(float(val))))
    i = F.col("row_idx")
    rows = rows.withColumn("split", F.when(i < F.col("_a"), "train").when(i < F.col("_b"), "val").otherwise("test"))
    offset = F.when(F.col("split") == "train", F.lit(0)).when(F.col("split") == "val", F.col("_a")).otherwise(F.col("_b")).cast("long")
    if check and rows.where("_a < 1 or _b <= _a or _n <= _b").limit(1).count():
        raise ValueError("a split is empty")
    return rows.withColumn("split_offset", offset).withColumn("split_row", i - F.col("split_offset")).drop("_n", "_a", "_b")


def train_prefix(daily: DataFrame, ratio: float, window: int = 1, key: str = STATION, check: bool = False) -> DataFrame:
    """The first floor(n * ratio) rows of each key; check: raise if a key has fewer than window."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio must lie between 0 and 1")
    n = F.floor(F.count(F.lit(1)).over(Window.partitionBy(key)) * F.lit(float(ratio)))
    rows = daily.withColumn("_n", n)
    if check and rows.where(F.col("_n") < window).limit(1).count():
        raise ValueError("the train part is shorter than a window")
    return rows.where(F.col("row_idx") < F.col("_n")).drop("_n")


def all_known(values: Column) -> Column:
    """Whether every element of an array is known."""
    return F.forall(values, lambda x: x.isNotNull())


def clipped(prediction: Column) -> Column:
    """Forecasts are amounts: negatives are 0."""
    return F.greatest(prediction, F.lit(0.0))


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """df with residual, absolute_error and squared_error."""
    r = F.col(actual) - F.col(predicted)
    return df.withColumns({"residual": r, "absolute_error": F.abs(r), "squared_error": r * r})


def precedes_event(rain: Column, window: int, threshold: float, over) -> Column:
    """On a window's first row: whether the day after the window reaches threshold; false if there is none."""
    return F.coalesce(F.lead(rain, window).over(over) >= threshold, F.lit(False))


def melted(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def spread_map(df: DataFrame, column: str, keys: list[int], prefix: str) -> DataFrame:
    """A map column as columns prefix<key>, 0 where a key is absent."""
    return df.withColumns({f"{prefix}{k}": F.coalesce(F.try_element_at(F.col(column), F.lit(k)), F.lit(0)) for k in keys}).drop(column)


def top_days(daily: DataFrame, n: int = 10, rain: str = RAIN, keys: tuple[str, ...] = (STATION,)) -> DataFrame:
    """keys, event_date, rain, rank: the n days of most rain of each station, the earlier first on ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(rain), "row_idx")
    rows = daily.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return rows.select(*keys, F.col(DATE).alias("event_date"), F.col(rain).alias("rain"), "rank")
