"""Station files to gap-free daily frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import DATE, MEAN_MEASURES, RAIN, RAW_DATE, STATION, SUM_MEASURES

#: root/state/station/station_<years>_daily.csv
PATH = r"([^/]+)/([^/]+)/([^/]+)_daily\.csv$"


def station_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, state, station_id, station_key) of each station file under root; empty if root is missing or holds none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*/*/*_daily.csv")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    paths = sorted(str(f.getPath().toString()) for f in found or [])
    return station_from_path(spark.createDataFrame([(p,) for p in paths], "path string"))


def station_from_path(files: DataFrame, path: str = "path") -> DataFrame:
    """files with state, station_id and station_key, read from the path's folders."""
    part = lambda i: F.regexp_extract(path, PATH, i)
    return files.withColumns({"state": part(1), STATION: part(2), "station_key": F.concat_ws("_", part(1), part(2))})


def parsed_date(text: Column) -> Column:
    """A date, or null if the text is none."""
    return F.try_to_date(text, "yyyy-MM-dd")


def decimal(text: Column) -> Column:
    """A number written with a decimal comma or point; null if it is none."""
    return F.replace(text.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def normalize_decimals(df: DataFrame, exclude: tuple[str, ...] = (DATE, RAW_DATE)) -> DataFrame:
    return df.withColumns({c: decimal(F.col(c)) for c, kind in df.dtypes if kind == "string" and c not in exclude})


def fill_missing(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Nulls (and NaN) of numeric columns replaced."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(value, subset=numeric)


#: Measures as large as this (or NaN) are summed as doubles.
EXACT_BELOW = 1e11


def _exact(measure: str, decimals: int, mean: bool) -> Column:
    """The sum, or mean, of a measure by whole numbers: one rounding, the last."""
    c = F.col(measure)
    total = F.sum(F.when(F.abs(c) < EXACT_BELOW, c).cast(f"decimal(18,{decimals})"))
    return (total * 10**decimals).cast("double") / (F.count(c) * 10.0**decimals) if mean else total.cast("double")


def resample_daily(rows: DataFrame, keys: tuple[str, ...] = (STATION,), date: str = DATE, means: tuple[str, ...] = MEAN_MEASURES, sums: tuple[str, ...] = SUM_MEASURES, decimals: int | None = None) -> DataFrame:
    """One row per key and calendar day between the key's first and last, with row_idx from 0.

    Measures that aren't columns are left out. On a day without rows means are null and sums 0. Where measures have at most
    so many decimals, sums and means are the doubles nearest to the exact ones, in whatever order the rows come.
    """
    means, sums = [c for c in means if c in rows.columns], [c for c in sums if c in rows.columns]
    found = {c: F.avg(c) for c in means} | {c: F.sum(c) for c in sums}
    if decimals is not None:
        found = {c: F.when(F.max(F.abs(F.col(c))) < EXACT_BELOW, _exact(c, decimals, c in means)).otherwise(plain) for c, plain in found.items()}
    daily = rows.groupBy(*keys, date).agg(*[f.alias(c) for c, f in found.items()])
    # Each day stands for itself and the days without rows after it: one pass, and no join with a calendar.
    own = Window.partitionBy(*keys)
    until = F.coalesce(F.date_sub(F.lead(date).over(own.orderBy(date)), 1), F.col(date))
    rows = daily.withColumns({"_first": F.min(date).over(own), "_until": until})
    rows = rows.select(*keys, F.col(date).alias("_own"), "_first", *means, *sums, F.explode(F.sequence(date, "_until")).alias(date))
    known = lambda c: F.when(F.col(date) == F.col("_own"), F.col(c))
    return rows.select(*keys, date, *[known(c).alias(c) for c in means], *[F.coalesce(known(c), F.lit(0.0)).alias(c) for c in sums], F.datediff(date, "_first").cast("long").alias("row_idx"))


def load_station(spark: SparkSession, state: str, station: str, root: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The daily frame of one station: state, station_id, Data, measures, row_idx.

    Columns are read as text, dates that don't parse are dropped, decimal commas become points, missing numbers 0.
    Exactly one file must match.
    """
    files = [r.path for r in station_files(spark, root).where((F.col("state") == state) & (F.col(STATION) == station)).collect()]
    if not files:
        raise FileNotFoundError(f"{root}/{state}/{station}/{station}_*_daily.csv")
    if len(files) > 1:
        raise ValueError(f"more than one file of {state}/{station}: {files}")
    wanted = columns or (RAW_DATE, *MEAN_MEASURES, *SUM_MEASURES)
    raw = spark.read.csv(files[0], sep=";", header=True, nullValue="", inferSchema=False)
    raw = raw.select(*[c for c in raw.columns if c in wanted])
    # Names are case-insensitive: the raw date column is replaced, not added to.
    raw = raw.select(parsed_date(F.col(RAW_DATE)).alias(DATE), *[c for c in raw.columns if c != RAW_DATE]).where(F.col(DATE).isNotNull())
    raw = fill_missing(normalize_decimals(raw)).withColumn(STATION, F.lit(station))
    return resample_daily(raw).withColumn("state", F.lit(state))


def rain_series(daily: DataFrame, rain: str = RAIN, date: str = DATE, keys: tuple[str, ...] = (STATION,), least: int = 10, check: bool = False) -> DataFrame:
    """Dated values in order, rows without date or value dropped and row_idx counted anew; check: need at least `least` of each key."""
    rows = daily.select(*keys, F.col(date).cast("date").alias(date), F.col(rain).try_cast("double").alias(rain)).dropna(subset=[date, rain])
    rows = rows.withColumn("row_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1).cast("long"))
    if check and (short := rows.groupBy(*keys).count().where(F.col("count") < least).limit(1).count()) or check and not rows.limit(1).count():
        raise ValueError(f"a series needs at least {least} values")
    return rows


def select_period(daily: DataFrame, max_days: int | None = None, selection: str = "recent", start: str | None = None, end: str | None = None, keys: tuple[str, ...] = (STATION,), date: str = DATE) -> DataFrame:
    """Rows between start and end (inclusive), then the first ("oldest") or last ("recent") max_days of each key."""
    if selection not in ("recent", "oldest"):
        raise ValueError("selection must be 'recent' or 'oldest'")
    rows = daily.where(F.col(date) >= F.lit(start).cast("date")) if start else daily
    rows = rows.where(F.col(date) <= F.lit(end).cast("date")) if end else rows
    if max_days is None:
        return rows
    order = F.col(date).asc() if selection == "oldest" else F.col(date).desc()
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_at") <= max_days).drop("_at")
