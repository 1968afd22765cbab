"""Queries of models, sweeps and fitted transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import arma, cluster, evaluate, frame, network, reduce
from ..sources import adapters
from ..streaming import daily as streaming_daily
from . import base, sweep
from .base import CTES, metrics_sql
from .registry import query

AR = [0.4, 0.1]
MEAN = 2.0


@query("m04_quantile_weighted_mse", "split:s loss:d4", "SELECT split, avg(CASE WHEN y3 <= 1 THEN 1 WHEN y3 <= 10 THEN 2.5 ELSE 6 END * pow(y3 - current, 2)) AS loss FROM samples GROUP BY 1", CTES)
def m04(spark, sf_dir):
    return base.samples(spark, sf_dir).groupBy("split").agg(metrics.weighted_mse(F.col("y"), F.col("current"), [1.0, 10.0], [1.0, 2.5, 6.0]).alias("loss"))


@query(
    "m05_quantile_weights",
    "station_id:s bin:i threshold:d6 n:i weight:d4",
    """SELECT station_id, bin, threshold, n, raw / min(raw) OVER (PARTITION BY station_id) AS weight FROM (SELECT *, CASE WHEN n > 0 THEN min(n) FILTER (WHERE n > 0) OVER (PARTITION BY station_id) / n ELSE 1.0 END AS raw FROM (
    SELECT t.station_id, b AS bin, t.q[b + 1] AS threshold, count(s.y3) AS n FROM (SELECT station_id, list_sort(list_distinct(quantile_cont(y3, [0.5, 0.9]))) AS q FROM samples WHERE split = 'train' GROUP BY 1) t, LATERAL (SELECT unnest(generate_series(0, len(t.q))) AS b)
    LEFT JOIN samples s ON s.station_id = t.station_id AND s.split = 'train' AND len(list_filter(t.q, lambda x: x < s.y3)) = b GROUP BY ALL))""",
    CTES,
)
def m05(spark, sf_dir):
    return evaluate.quantile_weights(base.samples(spark, sf_dir).where("split = 'train'"), [0.5, 0.9], keys=("station_id",))


LAGS = CTES + f"""
fitted AS (SELECT station_id, row_idx, rain, {MEAN} + {AR[0]} * (coalesce(lag(rain, 1) OVER w, {MEAN}) - {MEAN}) + {AR[1]} * (coalesce(lag(rain, 2) OVER w, {MEAN}) - {MEAN}) AS fitted, coalesce(lag(rain, 1) OVER w, {MEAN}) AS before
  FROM filled WINDOW w AS (PARTITION BY station_id ORDER BY row_idx)),"""


@query("m09_ar_residuals", "station_id:s row_idx:i fitted:d8 residual:d8", "SELECT *, rain - fitted AS residual FROM fitted", LAGS)
def m09(spark, sf_dir):
    return arma.ar_residuals(base.filled(spark, sf_dir), MEAN, AR, "rain")


@query(
    "m09b_arma_residuals",
    "row_idx:i residual:d6",
    "SELECT row_idx, e AS residual FROM rec",
    base.CTES_ALL
    + f"""
rec(row_idx, y, e) AS (SELECT row_idx, rain, rain - {MEAN}::DOUBLE FROM filled_all WHERE row_idx = 0 UNION ALL
  SELECT f.row_idx, f.rain, f.rain - ({MEAN}::DOUBLE + 0.4::DOUBLE * (r.y - {MEAN}::DOUBLE) + 0.3::DOUBLE * r.e) FROM rec r JOIN filled_all f ON f.row_idx = r.row_idx + 1),""",
)
def m09b(spark, sf_dir):
    return arma.arma_residuals(base.filled(spark, sf_dir, False), MEAN, [0.4], [0.3], "rain")


@query(
    "m10_multi_step_forecasts",
    "station_id:s row_idx:i yhat_by_lead:a8",
    f"SELECT station_id, row_idx, [greatest(f1, 0), greatest(f2, 0), greatest({MEAN} + {AR[0]} * (f2 - {MEAN}) + {AR[1]} * (f1 - {MEAN}), 0)] AS yhat_by_lead FROM (SELECT *, {MEAN} + {AR[0]} * (f1 - {MEAN}) + {AR[1]} * (rain - {MEAN}) AS f2 FROM (SELECT *, {MEAN} + {AR[0]} * (rain - {MEAN}) + {AR[1]} * (before - {MEAN}) AS f1 FROM fitted))",
    LAGS,
)
def m10(spark, sf_dir):
    return arma.forecasts(base.filled(spark, sf_dir), MEAN, AR, [], 3, rain="rain")


@query("m12_persistence", "split:s n:i rmse:d4 mae:d4", f"SELECT split, count(*) AS n, {metrics_sql('y1', 'current')} FROM samples GROUP BY 1", CTES)
def m12(spark, sf_dir):
    rows = base.samples(spark, sf_dir).withColumn("first", F.col("y_by_lead")[0])
    return metrics.by(rows, "split", actual="first")


@query(
    "m13_config_grid",
    "name:s window:i k:i sigma:d4 stations:i windows:i",
    """SELECT 'w' || w || '_k' || k || '_s' || replace(s, '.', 'p') AS name, w AS window, k, s::DOUBLE AS sigma, stations, windows
    FROM (SELECT w, count(*) FILTER (WHERE n >= w) AS stations, sum(greatest(n - w + 1, 0)) AS windows
      FROM (SELECT station_id, count(*) AS n FROM split WHERE split = 'train' GROUP BY 1), (SELECT unnest([5, 10, 15]) AS w) GROUP BY 1),
    (SELECT unnest([3, 4]) AS k), (SELECT unnest(['0.5', '1.0']) AS s)""",
    CTES,
)
def m13(spark, sf_dir):
    """The runs of a grid, with the stations and train windows each has to work on."""
    runs = sweep.grid_table(spark, sweep.configurations([5, 10, 15], [3, 4], [0.5, 1.0]))
    return sweep.sized(runs, base.split(spark, sf_dir).where("split = 'train'"))


@query("k03_sweep_ranking", "rank:i window:i test_rmse:d4 test_mae:d4", f"SELECT *, row_number() OVER (ORDER BY test_rmse, test_mae) AS rank FROM (" + " UNION ALL ".join(f"SELECT {w} AS window, sqrt(avg(pow(y - m, 2))) AS test_rmse, avg(abs(y - m)) AS test_mae FROM (SELECT lead(rain, {w}) OVER w AS y, avg(rain) OVER f AS m FROM split WHERE split = 'test' WINDOW w AS (PARTITION BY station_id ORDER BY row_idx), f AS (PARTITION BY station_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)) WHERE y IS NOT NULL" for w in (3, 7, 14)) + ")", CTES)
def k03(spark, sf_dir):
    return sweep.rank(sweep.window_mean_sweep(base.split(spark, sf_dir).where("split = 'test'"), [3, 7, 14]))


@query("c01_kmeans", "cluster:i n:i")
def c01(spark, sf_dir):
    rows = adapters.features(spark, sf_dir)
    return cluster.nearest(rows, cluster.kmeans(rows, 3)[0]).groupBy("cluster").agg(F.count("*").alias("n"))


@query("c02_spectral", "cluster:i n:i")
def c02(spark, sf_dir):
    rows = adapters.features(spark, sf_dir)
    return cluster.spectral(rows, 0.5, 3).groupBy("cluster").agg(F.count("*").alias("n"))


@query("c19_eigengaps", "sigma:d4 k:i gap:d6 best:b")
def c19(spark, sf_dir):
    return cluster.eigengap_table(adapters.features(spark, sf_dir), [0.3, 0.5, 1.0], 10)


@query("c20_best_sigma", "sigma:d6 best_k:i best_gap:d6 evaluations:i")
def c20(spark, sf_dir):
    found = cluster.best_row_sigma(adapters.features(spark, sf_dir), 0.1, 1.0)
    return spark.createDataFrame([(float(found["sigma"]), found["best_k"], found["best_gap"], found["evaluations"])], "sigma double, best_k int, best_gap double, evaluations int")


@query("f06_pca_components", "component:i ratio:d6")
def f06(spark, sf_dir):
    model = reduce.fit(adapters.features(spark, sf_dir), 0.9)
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(model.ratios)], "component int, ratio double")


@query("f09_pca_routing", "split:s n:i mean_first:d4")
def f09(spark, sf_dir):
    rows = reduce.route(base.samples(spark, sf_dir, False).drop("win"), 0.9, "clustering_only")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("cluster_features")[0])).alias("mean_first"))


@query("f10_projection", "high:b x:d4 y:d4")
def f10(spark, sf_dir):
    return reduce.projection(adapters.features(spark, sf_dir).withColumn("high", F.col("label") >= 5))[1]


@query("m01_cluster_networks", "cluster:i n:i mae:d4 rmse:d4")
def m01(spark, sf_dir):
    rows = base.samples(spark, sf_dir, False).drop("predicted", "yhat_by_lead")
    scaled = rows.withColumn("features", F.transform("features", lambda x: F.signum(x) * F.log1p(F.abs(x)) / 10))
    models = network.train_clusters(scaled, base.HORIZON)
    found = network.predict(scaled.where("split = 'test'"), models, ["window_index"], base.HORIZON)
    both = rows.where("split = 'test'").join(found, "window_index").withColumn("predicted", F.col("yhat_by_lead")[base.HORIZON - 1])
    return metrics.by(both, "cluster", actual="y")


@query("m02_training_history", "cluster:i epochs:i best_val_loss:d6")
def m02(spark, sf_dir):
    rows = base.samples(spark, sf_dir, False)
    scaled = rows.withColumn("features", F.transform("features", lambda x: F.signum(x) * F.log1p(F.abs(x)) / 10))
    history = network.history_table(network.train_clusters(scaled, base.HORIZON))
    return history.groupBy("cluster").agg(F.count("*").alias("epochs"), F.min("val_loss").alias("best_val_loss"))


@query("m08_arma_fits", "station_id:s p:i q:i mean:d3 loglik:d2 n:i error:s")
def m08(spark, sf_dir):
    rows = base.split(spark, sf_dir, False).where("split = 'train'")
    return arma.fit_stations(rows, [(1, 0), (2, 1)], "rain")


@query("st01_streaming_daily", "event_type:s day:t n:i total:d4 mean:d4", "SELECT event_type, ts::DATE AS day, count(*) AS n, sum(value) AS total, avg(value) AS mean FROM events GROUP BY ALL")
def st01(spark, sf_dir):
    return streaming_daily.run_daily(spark, sf_dir)


@query("st02_streaming_sliding", "event_type:s day:t n:i total:d4", "SELECT event_type, d::DATE AS day, count(*) AS n, sum(value) AS total FROM (SELECT event_type, value, unnest(generate_series(date_trunc('day', ts) - INTERVAL 2 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY ALL")
def st02(spark, sf_dir):
    return streaming_daily.run_sliding(spark, sf_dir)


@query("c21_eigengap_by_window", "window:i k:i gap:d6 best:b")
def c21(spark, sf_dir):
    """Gaps of the train windows of the whole company's series, for several window sizes."""
    from ..operators import scaling, windows

    rows = scaling.scale_split(base.split(spark, sf_dir, False), ["radiation"], "standard", None, "rain").where("split = 'train'")
    parts = []
    for w in (3, 5):
        found = windows.sliding(rows, w, ["radiation"]).select(F.col("window_index").alias("idx"), windows.flat(F.col("win")).alias("features"))
        parts.append(cluster.eigengap_table(found, [1.0], 8).withColumn("window", F.lit(w)))
    return parts[0].unionByName(parts[1])


@query(
    "st03_streaming_sessions",
    "user_id:i sessions:i events:i longest:i",
    """SELECT user_id, count(*) AS sessions, sum(n) AS events, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM
    (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY ALL) GROUP BY 1""",
)
def st03(spark, sf_dir):
    found = streaming_daily.drained(streaming_daily.sessions(streaming_daily.event_stream(spark, sf_dir), "2 hours"))
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


@query("st04_online_clusters", "cluster:i n:i total:d4", "SELECT CASE WHEN abs(value) <= abs(value - 100) THEN 0 WHEN abs(value - 100) <= abs(value - 300) THEN 1 ELSE 2 END AS cluster, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def st04(spark, sf_dir):
    centres = spark.createDataFrame([(0, [0.0]), (1, [100.0]), (2, [300.0])], "cluster int, centroid array<double>")
    rows = streaming_daily.event_stream(spark, sf_dir).select(F.col("event_id").alias("idx"), F.array("value").alias("features"))
    found = streaming_daily.drained(streaming_daily.assign_online(rows, centres), "append")
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("features")[0]).alias("total"))

