"""Queries of sources, frames, windows and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame, scaling, windows
from ..sources import adapters, station
from . import base
from .base import CTES, CTES_ALL, FEATURES, HORIZON, WINDOW
from .registry import query

PATHS = "'data/' || replace(r_name, ' ', '_') || '/' || n_name || '/' || n_name || '_2000_2026_daily.csv'"


@query("s02_station_from_path", "state:s station_id:s station_key:s", "SELECT replace(r_name, ' ', '_') AS state, n_name AS station_id, replace(r_name, ' ', '_') || '_' || n_name AS station_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def s02(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "nation").join(adapters.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return station.station_from_path(rows.selectExpr(f"{PATHS} AS path"))


@query("s04_dates_coerced", "o_orderkey:i Data:t", "SELECT o_orderkey, o_orderdate::DATE AS \"Data\" FROM orders WHERE o_orderkey % 7 <> 0")
def s04(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = adapters.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("bad "), text)).otherwise(text).alias("DATA"))
    return rows.withColumn("Data", station.parsed_date(F.col("DATA"))).where("Data is not null")


@query("s05_decimals", "c_custkey:i c_acctbal:d4", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def s05(spark, sf_dir):
    text = F.replace(F.format_string("%.2f", F.col("c_acctbal")), F.lit("."), F.lit(","))
    rows = adapters.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, F.lit("n/a")).otherwise(text).alias("c_acctbal"))
    return station.normalize_decimals(rows)


@query("s06_filled", "station_id:s Data:t tmax:d6 rain:d6", "SELECT * FROM filled", CTES)
def s06(spark, sf_dir):
    return base.filled(spark, sf_dir)


@query("s07_daily_resample", "station_id:s Data:t row_idx:i tmax:d6 tmin:d6 rain:d6 radiation:d6", "SELECT * FROM daily", CTES)
def s07(spark, sf_dir):
    return base.daily(spark, sf_dir)


@query("s08_rain_series", "station_id:s Data:t row_idx:i tmax:d6", "SELECT station_id, \"Data\", tmax, row_number() OVER (PARTITION BY station_id ORDER BY \"Data\") - 1 AS row_idx FROM daily WHERE tmax IS NOT NULL", CTES)
def s08(spark, sf_dir):
    return station.rain_series(base.daily(spark, sf_dir), "tmax")


@query(
    "s09_raw_period",
    "selection:s station_id:s Data:t row_idx:i",
    """SELECT 'recent' AS selection, station_id, "Data", row_idx FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "Data" DESC) AS r FROM daily WHERE "Data" BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') WHERE r <= 30
    UNION ALL SELECT 'oldest', station_id, "Data", row_idx FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "Data") AS r FROM daily WHERE "Data" BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') WHERE r <= 30""",
    CTES,
)
def s09(spark, sf_dir):
    rows = base.daily(spark, sf_dir)
    parts = [station.select_period(rows, 30, s, "1996-01-01", "1999-12-31").withColumn("selection", F.lit(s)) for s in ("recent", "oldest")]
    return parts[0].unionByName(parts[1])


@query("p02_split", "station_id:s split:s split_offset:i n:i first:t last:t", 'SELECT station_id, split, split_offset, count(*) AS n, min("Data") AS first, max("Data") AS last FROM split GROUP BY ALL', CTES)
def p02(spark, sf_dir):
    return base.split(spark, sf_dir).groupBy("station_id", "split", "split_offset").agg(F.count("*").alias("n"), F.min("Data").alias("first"), F.max("Data").alias("last"))


@query("p03_train_prefix", "station_id:s n:i last:t", 'SELECT station_id, count(*) AS n, max("Data") AS last FROM (SELECT *, floor(count(*) OVER (PARTITION BY station_id) * 0.29::DOUBLE) AS m FROM filled) WHERE row_idx < m GROUP BY 1', CTES)
def p03(spark, sf_dir):
    return frame.train_prefix(base.filled(spark, sf_dir), 0.29, WINDOW).groupBy("station_id").agg(F.count("*").alias("n"), F.max("Data").alias("last"))


@query("p04_known_targets", "station_id:s n:i", "SELECT station_id, count(*) AS n FROM (SELECT station_id, lead(tmax, 7) OVER w AS a, lead(tmax, 8) OVER w AS b, lead(row_idx, 8) OVER w AS e FROM daily WINDOW w AS (PARTITION BY station_id ORDER BY row_idx)) WHERE a IS NOT NULL AND b IS NOT NULL AND e IS NOT NULL GROUP BY 1", CTES)
def p04(spark, sf_dir):
    rows = base.daily(spark, sf_dir).select("station_id", windows.lead_days(F.col("tmax"), WINDOW, 2, windows.by_row()).alias("y"))
    return rows.where(frame.all_known(F.col("y"))).groupBy("station_id").agg(F.count("*").alias("n"))


@query("p05_known_current", "station_id:s window_index:i origin_index:i current:d6", "SELECT station_id, window_index, window_index + 6 AS origin_index, c AS current FROM (SELECT station_id, row_idx AS window_index, lead(tmax, 6) OVER w AS c, lead(tmax, 7) OVER w AS a FROM daily WINDOW w AS (PARTITION BY station_id ORDER BY row_idx)) WHERE a IS NOT NULL AND c IS NOT NULL", CTES)
def p05(spark, sf_dir):
    return windows.supervised(base.daily(spark, sf_dir), WINDOW, 1, "tmax", FEATURES, ("station_id",), need_current=True)


@query("p07_clipped_residuals", "station_id:s window_index:i predicted:d6 residual:d6 absolute_error:d6 squared_error:d6", "SELECT station_id, window_index, p AS predicted, y3 - p AS residual, abs(y3 - p) AS absolute_error, (y3 - p) * (y3 - p) AS squared_error FROM (SELECT *, greatest(current - 3, 0) AS p FROM samples)", CTES)
def p07(spark, sf_dir):
    rows = base.samples(spark, sf_dir).withColumn("actual", F.col("y")).withColumn("predicted", frame.clipped(F.col("current") - 3))
    return frame.residuals(rows)


@query("p09_precedes_event", "station_id:s n_events:i n:i", "SELECT station_id, count(*) FILTER (WHERE e) AS n_events, count(*) AS n FROM (SELECT station_id, coalesce(lead(rain, 7) OVER (PARTITION BY station_id ORDER BY row_idx) >= 20, false) AS e FROM filled) GROUP BY 1", CTES)
def p09(spark, sf_dir):
    rows = base.filled(spark, sf_dir).select("station_id", frame.precedes_event(F.col("rain"), WINDOW, 20.0, windows.by_row()).alias("e"))
    return rows.groupBy("station_id").agg(F.count(F.when(F.col("e"), 1)).alias("n_events"), F.count("*").alias("n"))


@query("p11_melted", "station_id:s variable:s value:d4", "SELECT station_id, unnest(['rain', 'radiation']) AS variable, unnest([avg(rain), avg(radiation)]) AS value FROM filled GROUP BY station_id", CTES)
def p11(spark, sf_dir):
    rows = base.filled(spark, sf_dir).groupBy("station_id").agg(F.avg("rain").alias("rain"), F.avg("radiation").alias("radiation"))
    return frame.melted(rows, ["station_id"], ["rain", "radiation"])


@query("p12_map_columns", "station_id:s cluster_0:i cluster_1:i cluster_2:i cluster_3:i cluster_9:i", "SELECT station_id, count(*) FILTER (WHERE cluster = 0) AS cluster_0, count(*) FILTER (WHERE cluster = 1) AS cluster_1, count(*) FILTER (WHERE cluster = 2) AS cluster_2, count(*) FILTER (WHERE cluster = 3) AS cluster_3, 0 AS cluster_9 FROM samples GROUP BY 1", CTES)
def p12(spark, sf_dir):
    counts = base.samples(spark, sf_dir).groupBy("station_id", "cluster").agg(F.count("*").alias("n"))
    maps = counts.groupBy("station_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("m"))
    return frame.spread_map(maps, "m", [0, 1, 2, 3, 9], "cluster_")


W_ALL = "WINDOW w AS (PARTITION BY station_id ORDER BY row_idx), f AS (PARTITION BY station_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"


@query("w01_sliding_windows", "station_id:s window_index:i flat:a6", f"SELECT station_id, window_index, flat FROM (SELECT station_id, row_idx AS window_index, flatten(list([tmax, rain]) OVER f) AS flat, lead(row_idx, 3) OVER w AS e FROM filled {W_ALL}) WHERE e IS NOT NULL", CTES)
def w01(spark, sf_dir):
    rows = windows.sliding(base.filled(spark, sf_dir), 4, ["tmax", "rain"])
    return rows.withColumn("flat", windows.flat(F.col("win")))


@query("w02_normalized_windows", "station_id:s window_index:i flat:a4", f"SELECT station_id, window_index, flat FROM (SELECT station_id, row_idx AS window_index, flatten(list([(tmax - m) / s, (rain - rm) / rs]) OVER f) AS flat, lead(row_idx, 3) OVER w AS e FROM filled, (SELECT avg(tmax) AS m, stddev_pop(tmax) AS s, avg(rain) AS rm, stddev_pop(rain) AS rs FROM filled) {W_ALL}) WHERE e IS NOT NULL", CTES)
def w02(spark, sf_dir):
    rows = base.filled(spark, sf_dir)
    scaled = scaling.apply(rows, scaling.fit(rows, ["tmax", "rain"], "standard"), ["tmax", "rain"])
    return windows.sliding(scaled, 4, ["tmax", "rain"]).withColumn("flat", windows.flat(F.col("win")))


@query(
    "w03_wide_windows",
    "window_index:i rain_day0:d6 rain_day1:d6 rain_day2:d6 radiation_day0:d6 radiation_day1:d6 radiation_day2:d6",
    "SELECT row_idx AS window_index, rain AS rain_day0, lead(rain, 1) OVER w AS rain_day1, lead(rain, 2) OVER w AS rain_day2, radiation AS radiation_day0, lead(radiation, 1) OVER w AS radiation_day1, lead(radiation, 2) OVER w AS radiation_day2 FROM filled_all WINDOW w AS (ORDER BY row_idx) QUALIFY lead(row_idx, 2) OVER w IS NOT NULL",
    CTES_ALL,
)
def w03(spark, sf_dir):
    return windows.wide(windows.sliding(base.filled(spark, sf_dir, False), 3, ["rain", "radiation"]), ["rain", "radiation"], 3)


@query("w05_horizon_target", "station_id:s window_index:i target:d6", "SELECT station_id, row_idx AS window_index, lead(rain, 9) OVER (PARTITION BY station_id ORDER BY row_idx) AS target FROM filled", CTES)
def w05(spark, sf_dir):
    return base.filled(spark, sf_dir).select("station_id", F.col("row_idx").alias("window_index"), windows.horizon_target(F.col("rain"), WINDOW, HORIZON, windows.by_row()).alias("target"))


@query("w06_known_targets", "station_id:s window_index:i target:d6", "SELECT * FROM (SELECT station_id, row_idx AS window_index, lead(tmax, 7) OVER (PARTITION BY station_id ORDER BY row_idx) AS target FROM daily) WHERE target IS NOT NULL", CTES)
def w06(spark, sf_dir):
    return windows.targets(base.daily(spark, sf_dir), WINDOW, 1, "tmax")


@query("w08_supervised", "station_id:s split:s window_index:i origin_index:i current:d6 y_by_lead:a6 y:d6 last_date:t", "SELECT *, window_index + 6 AS origin_index, [y1, y2, y3] AS y_by_lead, y3 AS y, d3 AS last_date FROM samples", CTES)
def w08(spark, sf_dir):
    return base.samples(spark, sf_dir).withColumn("last_date", F.col("date_by_lead")[HORIZON - 1])


@query("w09_arma_targets", "station_id:s split:s n:i first:i last:i", "SELECT station_id, split, count(*) AS n, min(window_index + 6) AS first, max(window_index + 6) AS last FROM samples GROUP BY ALL", CTES)
def w09(spark, sf_dir):
    rows = windows.supervised(base.split(spark, sf_dir), WINDOW, HORIZON, "rain", FEATURES, need_current=True)
    return rows.groupBy("station_id", "split").agg(F.count("*").alias("n"), F.min("origin_index").alias("first"), F.max("origin_index").alias("last"))


EVENTS = "events_of AS (SELECT station_id, \"Data\" AS event_date, rain FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY rain DESC, row_idx) AS r FROM filled) WHERE r <= 10),"


def top_days(spark, sf_dir, n=10):
    return frame.top_days(base.filled(spark, sf_dir), n, "rain")


@query("w10_window_before_event", "station_id:s event_date:t window_index:i", "SELECT e.station_id, event_date, CASE WHEN row_idx - 6 >= 0 THEN row_idx - 6 END AS window_index FROM events_of e LEFT JOIN filled f ON f.station_id = e.station_id AND f.\"Data\" = e.event_date - 1", CTES + EVENTS)
def w10(spark, sf_dir):
    return windows.window_before(top_days(spark, sf_dir), base.filled(spark, sf_dir), WINDOW)


@query("w10b_window_before_event_asof", "station_id:s event_date:t window_index:i", "SELECT e.station_id, event_date, CASE WHEN row_idx - 6 >= 0 THEN row_idx - 6 END AS window_index FROM events_of e ASOF LEFT JOIN (SELECT * FROM daily WHERE tmax IS NOT NULL) f ON f.station_id = e.station_id AND f.\"Data\" < e.event_date", CTES + EVENTS)
def w10b(spark, sf_dir):
    return windows.window_before_asof(top_days(spark, sf_dir), base.daily(spark, sf_dir).where("tmax is not null"), WINDOW)


@query("w11_persistence_delta", "station_id:s split:s n:i mean_delta:d4", "SELECT station_id, split, count(*) AS n, avg(y3 - current) AS mean_delta FROM samples GROUP BY ALL", CTES)
def w11(spark, sf_dir):
    return base.samples(spark, sf_dir).groupBy("station_id", "split").agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("current")).alias("mean_delta"))


@query("w12_window_stats", "station_id:s window_index:i mean:d6 min:d6 max:d6 total:d6", "SELECT station_id, row_idx AS window_index, avg(rain) OVER f AS mean, min(rain) OVER f AS min, max(rain) OVER f AS max, sum(rain) OVER f AS total FROM filled WINDOW w AS (PARTITION BY station_id ORDER BY row_idx), f AS (PARTITION BY station_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) QUALIFY lead(row_idx, 6) OVER w IS NOT NULL", CTES)
def w12(spark, sf_dir):
    return windows.window_stats(base.filled(spark, sf_dir), "rain", WINDOW)


@query("w13_compressed_axis", "station_id:s window_index:i position:i after_gap:b", "SELECT station_id, window_index, coalesce(sum(CASE WHEN gap IS NOT NULL THEN least(gap, 10) END) OVER (PARTITION BY station_id ORDER BY window_index ROWS UNBOUNDED PRECEDING), 0) AS position, coalesce(gap > 10, false) AS after_gap FROM (SELECT *, window_index - lag(window_index) OVER (PARTITION BY station_id ORDER BY window_index) AS gap FROM samples WHERE wsum > 20)", CTES)
def w13(spark, sf_dir):
    return windows.compressed_positions(base.samples(spark, sf_dir).where("wsum > 20"), 10)


@query("w14_parts", "station_id:s part:i n:i first:i last:i", "SELECT station_id, part, count(*) AS n, min(window_index) AS first, max(window_index) AS last FROM (SELECT *, ntile(4) OVER (PARTITION BY station_id ORDER BY window_index) AS part FROM samples WHERE split = 'test') GROUP BY ALL", CTES)
def w14(spark, sf_dir):
    rows = windows.parts(base.samples(spark, sf_dir).where("split = 'test'"), 4)
    return rows.groupBy("station_id", "part").agg(F.count("*").alias("n"), F.min("window_index").alias("first"), F.max("window_index").alias("last"))


@query("f01_standard_scale", "station_id:s row_idx:i tmax:d4 rain:d4", "SELECT station_id, row_idx, (tmax - m) / s AS tmax, (rain - rm) / rs AS rain FROM filled, (SELECT avg(tmax) AS m, stddev_pop(tmax) AS s, avg(rain) AS rm, stddev_pop(rain) AS rs FROM filled)", CTES)
def f01(spark, sf_dir):
    rows = base.filled(spark, sf_dir)
    return scaling.apply(rows, scaling.fit(rows, ["tmax", "rain"], "standard"), ["tmax", "rain"])


@query("f02_minmax_train_only", "split:s low:d4 high:d4 mean:d4", "SELECT split, min(v) AS low, max(v) AS high, avg(v) AS mean FROM (SELECT split, (radiation - a) / (b - a) AS v FROM split, (SELECT min(radiation) AS a, max(radiation) AS b FROM split WHERE split = 'train')) GROUP BY 1", CTES)
def f02(spark, sf_dir):
    rows = base.split(spark, sf_dir)
    model = scaling.fit(rows.where("split = 'train'"), ["radiation"], "minmax")
    return scaling.apply(rows, model, ["radiation"]).groupBy("split").agg(F.min("radiation").alias("low"), F.max("radiation").alias("high"), F.avg("radiation").alias("mean"))


@query(
    "f03_split_scaling",
    "station_id:s row_idx:i tmax:d4 tmin:d4 rain:d4",
    "SELECT station_id, row_idx, (tmax - m) / s AS tmax, (tmin - tm) / ts AS tmin, (rain - a) / (b - a) AS rain FROM split, (SELECT avg(tmax) AS m, stddev_pop(tmax) AS s, avg(tmin) AS tm, stddev_pop(tmin) AS ts, min(rain) AS a, max(rain) AS b FROM split WHERE split = 'train')",
    CTES,
)
def f03(spark, sf_dir):
    return scaling.scale_split(base.split(spark, sf_dir), ["tmax", "tmin", "rain"], "standard", "MinMax", "rain")


@query("f05_target_scaling", "station_id:s window_index:i y_by_lead:a4", "SELECT station_id, window_index, [(y1 - m) / s, (y2 - m) / s, (y3 - m) / s] AS y_by_lead FROM samples, (SELECT avg(y) AS m, stddev_pop(y) AS s FROM (SELECT unnest([y1, y2, y3]) AS y FROM samples WHERE split = 'train'))", CTES)
def f05(spark, sf_dir):
    rows = base.samples(spark, sf_dir)
    return scaling.scale_targets(rows, scaling.fit_targets(rows, "standard"))


@query("k01_top_days", "station_id:s event_date:t rain:d6", "SELECT * FROM events_of", CTES + EVENTS)
def k01(spark, sf_dir):
    return top_days(spark, sf_dir)


@query("k02_top_windows", "station_id:s window_index:i score:d6", "SELECT station_id, window_index, wmean + wmax AS score FROM samples ORDER BY round(wmean + wmax, 9) DESC, station_id, window_index LIMIT 50", CTES)
def k02(spark, sf_dir):
    rows = base.samples(spark, sf_dir).withColumn("score", F.col("wmean") + F.col("wmax"))
    return rows.orderBy(F.desc(F.round("score", 9)), "station_id", "window_index").limit(50)


@query("k04_concatenated", "split:s n:i first:i last:i", "SELECT split, count(*) AS n, min(window_index) AS first, max(window_index) AS last FROM samples GROUP BY 1", CTES)
def k04(spark, sf_dir):
    rows = base.samples(spark, sf_dir)
    every = rows.where("split = 'train'").unionByName(rows.where("split = 'val'")).unionByName(rows.where("split = 'test'"))
    return every.groupBy("split").agg(F.count("*").alias("n"), F.min("window_index").alias("first"), F.max("window_index").alias("last"))


@query("w07_lead_days", "station_id:s window_index:i first_day:t last_day:t y_by_lead:a6", "SELECT station_id, row_idx AS window_index, lead(\"Data\", 7) OVER w AS first_day, lead(\"Data\", 9) OVER w AS last_day, [lead(rain, 7) OVER w, lead(rain, 8) OVER w, lead(rain, 9) OVER w] AS y_by_lead FROM filled WINDOW w AS (PARTITION BY station_id ORDER BY row_idx) QUALIFY lead(row_idx, 9) OVER w IS NOT NULL", CTES)
def w07(spark, sf_dir):
    over = windows.by_row()
    rows = base.filled(spark, sf_dir).select("station_id", F.col("row_idx").alias("window_index"), windows.lead_days(F.col("rain"), WINDOW, HORIZON, over).alias("y_by_lead"), windows.lead_days(F.col("Data"), WINDOW, HORIZON, over).alias("dates"))
    rows = rows.where(frame.all_known(F.col("y_by_lead")))
    return rows.withColumn("first_day", F.col("dates")[0]).withColumn("last_day", F.col("dates")[HORIZON - 1])


@query("w07b_events_without_window", "station_id:s n:i", "SELECT station_id, count(*) AS n FROM events_of e ANTI JOIN (SELECT station_id, \"Data\" + 1 AS d FROM daily WHERE row_idx >= 6 AND tmax IS NOT NULL) f ON f.station_id = e.station_id AND f.d = e.event_date GROUP BY 1", CTES + EVENTS)
def w07b(spark, sf_dir):
    ends = base.daily(spark, sf_dir).where((F.col("row_idx") >= WINDOW - 1) & F.col("tmax").isNotNull()).select("station_id", F.date_add("Data", 1).alias("event_date"))
    return top_days(spark, sf_dir).join(ends, ["station_id", "event_date"], "left_anti").groupBy("station_id").agg(F.count("*").alias("n"))
