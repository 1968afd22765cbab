"""Sliding windows, targets and alignment, all as frames over one window specification per key.

A window is named by its first row; window_index is that row's row_idx. Frames never cross a key, and keys hold the split
wherever a split exists, so no window reaches from one split into the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import DATE, RAIN, STATION
from .frame import numeric_columns

KEYS = (STATION,)
SPLIT_KEYS = (STATION, "split")


def by_row(keys: tuple[str, ...] = KEYS):
    return Window.partitionBy(*keys).orderBy("row_idx")


def check_window(window: int, horizon: int = 1) -> None:
    if window <= 0 or horizon <= 0:
        raise ValueError("window size and horizon must be positive")


def sliding(daily: DataFrame, window: int = 4, columns: list[str] | None = None, keys: tuple[str, ...] = KEYS, check: bool = False) -> DataFrame:
    """keys, window_index, win: array of `window` days, each an array of the columns. Unknown cells keep their place.

    check: raise if some key has fewer rows than a window.
    """
    check_window(window)
    columns = columns or numeric_columns(daily)
    if not columns:
        raise ValueError("no numeric columns")
    if check and daily.groupBy(*keys).count().where(F.col("count") < window).limit(1).count():
        raise ValueError("fewer rows than a window")
    frame = by_row(keys).rowsBetween(0, window - 1)
    day = F.array(*[F.col(c).cast("double") for c in columns])
    rows = daily.select(*keys, F.col("row_idx").alias("window_index"), F.collect_list(day).over(frame).alias("win"))
    return rows.where(F.size("win") == window)


def flat(windows: Column) -> Column:
    """Days one after the other, each with all its columns."""
    return F.flatten(windows)


def wide(windows: DataFrame, columns: list[str], window: int, scales: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Windows as columns {column}_day{d}, column by column; scales (mean, deviation) undo a scaling."""
    found = []
    for i, c in enumerate(columns):
        for d in range(window):
            cell = F.col("win")[d][i]
            if scales and c in scales:
                cell = cell * scales[c][1] + scales[c][0]
            found.append(cell.alias(f"{c}_day{d}"))
    return windows.select(*[c for c in windows.columns if c != "win"], *found)


def horizon_target(y: Column, window: int, horizon: int, over) -> Column:
    """On a window's first row: the value `horizon` days after the window's last day; null beyond the end."""
    check_window(window, horizon)
    return F.lead(y, window - 1 + horizon).over(over)


def targets(daily: DataFrame, window: int, horizon: int = 1, rain: str = RAIN, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, window_index, target) of the windows whose target is known."""
    rows = daily.select(*keys, F.col("row_idx").alias("window_index"), horizon_target(F.col(rain), window, horizon, by_row(keys)).alias("target"))
    return rows.where("target is not null")


def lead_days(value: Column, window: int, horizon: int, over) -> Column:
    """On a window's first row: the values of the 1..horizon days after the window."""
    return F.array(*[F.lead(value, window - 1 + k).over(over) for k in range(1, horizon + 1)])


def supervised(daily: DataFrame, window: int = 7, horizon: int = 3, rain: str = RAIN, features: list[str] | None = None, keys: tuple[str, ...] = SPLIT_KEYS, need_current: bool = False) -> DataFrame:
    """Samples: keys, window_index, origin_index, win, features, current, y_by_lead, date_by_lead, y (the last lead day).

    Windows whose lead days are all known; need_current also asks for the last day inside the window.
    """
    check_window(window, horizon)
    over = by_row(keys)
    columns = features or numeric_columns(daily, (DATE, "row_idx", "split_row", "split_offset"))
    day = F.array(*[F.col(c).cast("double") for c in columns])
    rows = daily.select(
        *keys,
        F.col("row_idx").alias("window_index"),
        (F.col("row_idx") + window - 1).alias("origin_index"),
        F.collect_list(day).over(over.rowsBetween(0, window - 1)).alias("win"),
        F.lead(rain, window - 1).over(over).alias("current"),
        lead_days(F.col(rain), window, horizon, over).alias("y_by_lead"),
        lead_days(F.col(DATE), window, horizon, over).alias("date_by_lead"),
        F.count(F.lit(1)).over(over.rowsBetween(0, window - 1)).alias("_n"),
    )
    # The days of a window are counted, not its array measured, so that the array is only built where it is read.
    rows = rows.where((F.col("_n") == window) & F.forall("y_by_lead", lambda x: x.isNotNull())).drop("_n")
    rows = rows.where("current is not null") if need_current else rows
    return rows.withColumn("features", F.flatten("win")).withColumn("y", F.col("y_by_lead")[horizon - 1])


def window_stats(daily: DataFrame, column: str, window: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, window_index, mean, min, max, total) of a column inside each whole window; no array is built."""
    frame = by_row(keys).rowsBetween(0, window - 1)
    stats = [f(column).over(frame).alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("total", F.sum))]
    whole = F.count(F.lit(1)).over(frame)
    return daily.select(*keys, F.col("row_idx").alias("window_index"), *stats, whole.alias("_n")).where(F.col("_n") == window).drop("_n")


def window_before(events: DataFrame, daily: DataFrame, window: int, event_date: str = "event_date", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """events with window_index of the window that ends the day before; null if that day is absent or the window would start too early."""
    ends = daily.select(*keys, F.date_add(DATE, 1).alias(event_date), (F.col("row_idx") - window + 1).alias("window_index"))
    return events.join(ends.where("window_index >= 0"), [*keys, event_date], "left")


def window_before_asof(events: DataFrame, daily: DataFrame, window: int, event_date: str = "event_date", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """events with the window that ends on the last day present before the event, whichever that is."""
    marks = daily.select(*keys, F.col(DATE).alias("_at"), F.col("row_idx").alias("_row"), F.lit(0).alias("_event"), F.lit(None).cast("date").alias(event_date))
    asked = events.select(*keys, F.col(event_date).alias("_at"), F.lit(None).cast("long").alias("_row"), F.lit(-1).alias("_event"), F.col(event_date))
    order = Window.partitionBy(*keys).orderBy("_at", "_event").rowsBetween(Window.unboundedPreceding, -1)
    both = marks.unionByName(asked).withColumn("_last", F.last("_row", ignorenulls=True).over(order))
    start = F.col("_last") - window + 1
    return both.where("_event = -1").select(*keys, event_date, F.when(start >= 0, start).alias("window_index"))


def compressed_positions(rows: DataFrame, max_gap: int = 10, index: str = "window_index", keys: tuple[str, ...] = KEYS, check: bool = False) -> DataFrame:
    """rows with position (gaps over max_gap shortened to it, from 0) and after_gap. check: raise unless indices increase strictly."""
    if max_gap <= 0:
        raise ValueError("max_gap must be positive")
    order = Window.partitionBy(*keys).orderBy(index)
    gap = F.col(index) - F.lag(index).over(order)
    rows = rows.withColumn("_gap", gap)
    if check and rows.where("_gap <= 0").limit(1).count():
        raise ValueError("indices must increase strictly")
    shown = F.when(F.col("_gap").isNotNull(), F.least("_gap", F.lit(max_gap)))
    position = F.coalesce(F.sum(shown).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("position", position).withColumn("after_gap", F.coalesce(F.col("_gap") > max_gap, F.lit(False))).drop("_gap")


def parts(rows: DataFrame, n: int, index: str = "window_index", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rows with part 1..n: contiguous, as even as they go, longer ones first."""
    return rows.withColumn("part", F.ntile(n).over(Window.partitionBy(*keys).orderBy(index)))
