"""Queries of evaluation, clustering, distances and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import cluster, distance, evaluate, routing, scaling, windows
from ..sources import adapters
from . import base
from .base import CTES, LONG, ROUTES, metrics_sql
from .registry import query

MEASURES = "mse:d4 rmse:d4 mae:d4 rmsle:d4 r2:d4 mape:d4"


@query("a01_persistence_metrics", f"split:s n:i {MEASURES}", f"SELECT split, count(*) AS n, {metrics_sql('y3', 'current')} FROM samples GROUP BY 1", CTES)
def a01(spark, sf_dir):
    return metrics.by(base.samples(spark, sf_dir), "split", actual="y")


@query(
    "a02_dry_and_rainy",
    "split:s n_dry:i n_rainy:i dry_percent:d4 mse_dry:d4 rmse_dry:d4 mae_dry:d4 mse_rainy:d4 rmse_rainy:d4 mae_rainy:d4",
    f"SELECT split, count(*) FILTER (WHERE y3 < 1) AS n_dry, count(*) FILTER (WHERE y3 >= 1) AS n_rainy, count(*) FILTER (WHERE y3 < 1) / count(*) * 100 AS dry_percent, {metrics_sql('y3', 'current', 'y3 < 1', '_dry')}, {metrics_sql('y3', 'current', 'y3 >= 1', '_rainy')} FROM samples GROUP BY 1",
    CTES,
)
def a02(spark, sf_dir):
    return base.samples(spark, sf_dir).groupBy("split").agg(*metrics.dry_and_rainy(F.col("y"), F.col("current")))


@query(
    "a03_metrics_by_sets",
    f"key_set:s split:s cluster:i lead_day:i n:i {MEASURES}",
    f"SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(cluster) = 0 THEN 'cluster' WHEN grouping(lead_day) = 0 THEN 'lead_day' ELSE 'all' END AS key_set, split, cluster, lead_day, count(*) AS n, {metrics_sql('actual', 'predicted')} FROM long GROUP BY GROUPING SETS ((split), (cluster), (lead_day), ())",
    LONG,
)
def a03(spark, sf_dir):
    return metrics.by_sets(base.long_table(spark, sf_dir), "split", "cluster", "lead_day")


@query("a04_lead_long", "station_id:s split:s window_index:i cluster:i lead_day:i target_date:t actual:d6 predicted:d6 residual:d6 absolute_error:d6 squared_error:d6", "SELECT *, actual - predicted AS residual, abs(actual - predicted) AS absolute_error, (actual - predicted) * (actual - predicted) AS squared_error FROM long", LONG)
def a04(spark, sf_dir):
    return base.long_table(spark, sf_dir)


@query("a05_lead_matrix", "station_id:s window_index:i matrix:a6", "SELECT station_id, window_index, [current, current, current] AS matrix FROM samples", CTES)
def a05(spark, sf_dir):
    return base.samples(spark, sf_dir).withColumn("matrix", evaluate.lead_matrix(F.array("current"), base.HORIZON, trained=False))


@query(
    "a06_horizon_diagnostics",
    "split:s n:i correlation:d4 mean_delta:d4 median_delta:d4 rmse_persistence:d4 mae_persistence:d4 rmse_model:d4 mae_model:d4 rmse_improvement:d4 mae_improvement:d4",
    """SELECT *, rmse_persistence - rmse_model AS rmse_improvement, mae_persistence - mae_model AS mae_improvement FROM (
    SELECT split, count(*) AS n, corr(current, y3) AS correlation, avg(y3 - current) AS mean_delta, quantile_cont(y3 - current, 0.5) AS median_delta, sqrt(avg(pow(y3 - current, 2))) AS rmse_persistence, avg(abs(y3 - current)) AS mae_persistence,
    sqrt(avg(pow(y3 - wmean, 2))) AS rmse_model, avg(abs(y3 - wmean)) AS mae_model FROM samples GROUP BY 1)""",
    CTES,
)
def a06(spark, sf_dir):
    return evaluate.horizon_diagnostics(base.samples(spark, sf_dir).withColumn("predicted", F.col("wmean")))


@query("a07_input_assignments", "split:s window_index:i station_id:s cluster:i current:d6 y:d6 delta:d6", "SELECT split, window_index, station_id, cluster, current, y3 AS y, y3 - current AS delta FROM samples", CTES)
def a07(spark, sf_dir):
    return base.samples(spark, sf_dir).withColumn("delta", F.col("y") - F.col("current"))


BINS = """
fd AS (SELECT count(*) AS n, min(y3) AS lo, max(y3) AS hi, 2 * (quantile_cont(y3, 0.75) - quantile_cont(y3, 0.25)) * pow(count(*), -1.0::DOUBLE / 3) AS width FROM samples),
bins AS (SELECT CASE WHEN hi > 0 THEN greatest(8, least(CASE WHEN width > 0 AND hi > lo THEN ceil((hi - lo) / width) ELSE 1 END, 35)) ELSE 1 END::INT AS n_bins, CASE WHEN hi > 0 THEN hi ELSE 1.0 END AS top FROM fd),"""


@query("a08_bin_edges", "edge_index:i edge:d4", "SELECT k AS edge_index, top / n_bins * k AS edge FROM (SELECT *, unnest(generate_series(0, n_bins)) AS k FROM bins)", CTES + BINS)
def a08(spark, sf_dir):
    return evaluate.bin_edges(base.samples(spark, sf_dir))


@query("a09_cluster_histogram", "cluster:i bin:i count:i", "SELECT cluster, least(floor(y3 / top * n_bins) + 1, n_bins) AS bin, count(*) AS count FROM samples, bins WHERE y3 BETWEEN 0 AND top GROUP BY ALL", CTES + BINS)
def a09(spark, sf_dir):
    return evaluate.histogram(base.samples(spark, sf_dir), ("cluster",))


@query("a10_rainy_ratio", "cluster:i ratio:d4", "SELECT cluster, avg((y3 > 0)::INT) AS ratio FROM samples GROUP BY 1", CTES)
def a10(spark, sf_dir):
    return base.samples(spark, sf_dir).groupBy("cluster").agg(F.avg((F.col("y") > 0).cast("double")).alias("ratio"))


@query(
    "a11_error_by_magnitude",
    "bin:i n:i mae:d4 rmse:d4",
    "SELECT bin, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM (SELECT y3 - current AS e, len(list_filter(q, lambda x: x <= y3)) - 1 AS bin FROM samples, (SELECT quantile_cont(y3, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM samples WHERE y3 > 0) WHERE y3 > 0) WHERE bin < 10 GROUP BY 1",
    CTES,
)
def a11(spark, sf_dir):
    return evaluate.error_by_magnitude(base.samples(spark, sf_dir).where("y > 0"), actual="y", predicted="current")


@query("a12_cluster_performance", "cluster:i n:i mae:d4 rmse:d4", f"SELECT cluster, count(*) AS n, {metrics_sql('y3', 'current')} FROM samples WHERE split = 'test' GROUP BY 1", CTES)
def a12(spark, sf_dir):
    return metrics.by(base.samples(spark, sf_dir).where("split = 'test'"), "cluster", actual="y")


@query("a13_batch_statistics", "cluster:i n_train:i n_val:i n_test:i batches_per_epoch:i", "SELECT *, ceil(n_train / 32) AS batches_per_epoch FROM (SELECT cluster, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test FROM samples GROUP BY 1)", CTES)
def a13(spark, sf_dir):
    return evaluate.batch_statistics(base.samples(spark, sf_dir))


@query("a14_cluster_shares", "station_id:s cluster:i n:i percent:d4", "SELECT station_id, cluster, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY station_id) * 100 AS percent FROM samples GROUP BY station_id, cluster", CTES)
def a14(spark, sf_dir):
    return evaluate.cluster_shares(base.samples(spark, sf_dir), ("station_id",))


@query("a14b_event_cluster_share", "cluster:i n:i percent:d4", "SELECT cluster, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS percent FROM samples WHERE y1 >= 20 GROUP BY 1 ORDER BY n DESC, cluster LIMIT 1", CTES)
def a14b(spark, sf_dir):
    return evaluate.most_common(base.samples(spark, sf_dir).where(F.col("y_by_lead")[0] >= 20))


@query(
    "a15_nonzero_stats",
    "cluster:i n:i zeros:i zero_percent:d4 mean:d4 std:d4 min:d4 max:d4 q25:d4 median:d4 q75:d4",
    "SELECT cluster, count(y1) AS n, count(*) FILTER (WHERE y1 = 0) AS zeros, count(*) FILTER (WHERE y1 = 0) / count(y1) * 100 AS zero_percent, avg(y1) FILTER (WHERE y1 <> 0) AS mean, stddev_pop(y1) FILTER (WHERE y1 <> 0) AS std, min(y1) FILTER (WHERE y1 <> 0) AS min, max(y1) FILTER (WHERE y1 <> 0) AS max, quantile_cont(y1, 0.25) FILTER (WHERE y1 <> 0) AS q25, quantile_cont(y1, 0.5) FILTER (WHERE y1 <> 0) AS median, quantile_cont(y1, 0.75) FILTER (WHERE y1 <> 0) AS q75 FROM samples GROUP BY 1",
    CTES,
)
def a15(spark, sf_dir):
    return evaluate.nonzero_stats(base.samples(spark, sf_dir).withColumn("y", F.col("y_by_lead")[0]))


@query("a16_box_summary", "cluster:i min:d4 q25:d4 median:d4 q75:d4 max:d4", "SELECT cluster, min(y3) AS min, quantile_cont(y3, 0.25) AS q25, quantile_cont(y3, 0.5) AS median, quantile_cont(y3, 0.75) AS q75, max(y3) AS max FROM samples GROUP BY 1", CTES)
def a16(spark, sf_dir):
    return evaluate.box_summary(base.samples(spark, sf_dir))


@query("a17_high_rain_stats", "n:i mean:d4 std:d4 min:d4 max:d4", "SELECT count(*) AS n, avg(wsum) AS mean, stddev_samp(wsum) AS std, min(wsum) AS min, max(wsum) AS max FROM samples WHERE y1 >= 20", CTES)
def a17(spark, sf_dir):
    return evaluate.sample_stats(base.samples(spark, sf_dir).where(F.col("y_by_lead")[0] >= 20), "wsum")


@query("a18_scatter_limits", "low:d4 high:d4", "SELECT a - (b - a) * 0.05 AS low, b + (b - a) * 0.05 AS high FROM (SELECT least(min(y3), min(current)) AS a, greatest(max(y3), max(current)) AS b FROM samples)", CTES)
def a18(spark, sf_dir):
    return evaluate.scatter_limits(base.samples(spark, sf_dir), "y", "current")


def _gains(spark, sf_dir):
    rows = base.samples(spark, sf_dir).where("split = 'test'").withColumn("value", F.abs(F.col("y") - F.col("current")) - F.abs(F.col("y") - F.col("wmean")))
    return rows.withColumn("idx", F.col("station_id").cast("long") * 100000 + F.col("window_index"))


@query("a20_bootstrap_ci", "split:s n:i mean:d6 low:d6 high:d6 p_positive:d6")
def a20(spark, sf_dir):
    return evaluate.bootstrap_ci(_gains(spark, sf_dir), keys=("split",))


@query("a20b_bootstrap_bounds", "split:s n:i mean:d6 inside:b near:b", "SELECT split, count(*) AS n, avg(abs(y3 - current) - abs(y3 - wmean)) AS mean, true AS inside, true AS near FROM samples WHERE split = 'test' GROUP BY 1", CTES)
def a20b(spark, sf_dir):
    """The interval holds the mean and is about as wide as the normal one."""
    rows = _gains(spark, sf_dir)
    found = evaluate.bootstrap_ci(rows, keys=("split",)).join(rows.groupBy("split").agg(F.stddev_pop("value").alias("sd")), "split")
    wide = 2 * 1.959964 * F.col("sd") / F.sqrt("n")
    return found.withColumn("inside", F.col("mean").between(F.col("low"), F.col("high"))).withColumn("near", F.abs((F.col("high") - F.col("low")) / wide - 1) < 0.15)


MANUAL = """
known AS (SELECT station_id::BIGINT * 100000 + window_index AS idx, CASE WHEN window_index % 10 = 3 THEN NULL ELSE y1 END AS rain, wsum AS f1, wmax AS f2 FROM samples),
parted AS (SELECT *, CASE WHEN rain = 0 THEN 0 WHEN rain > 0 THEN ntile(3) OVER (PARTITION BY coalesce(rain > 0, false) ORDER BY rain, idx) END AS cluster FROM known),
centres AS (SELECT cluster, avg(f1) AS c1, avg(f2) AS c2 FROM parted WHERE cluster IS NOT NULL GROUP BY 1),"""


def _known(spark, sf_dir):
    rows = base.samples(spark, sf_dir).withColumn("idx", F.col("station_id").cast("long") * 100000 + F.col("window_index"))
    return rows.select("idx", F.when(F.col("window_index") % 10 != 3, F.col("y_by_lead")[0]).alias("rain"), F.array("wsum", "wmax").alias("features"))


@query("c03_rain_guided_known", "idx:i cluster:i", "SELECT idx, cluster FROM parted WHERE cluster IS NOT NULL", CTES + MANUAL)
def c03(spark, sf_dir):
    return cluster.rain_known(_known(spark, sf_dir), 4).where("cluster is not null")


@query("c03b_rain_guided_counts", "cluster:i n:i", "SELECT cluster, count(*) AS n FROM (SELECT cluster FROM parted WHERE cluster IS NOT NULL UNION ALL SELECT arg_min(c.cluster, round(pow(f1 - c1, 2) + pow(f2 - c2, 2), 6)) FROM parted p, centres c WHERE p.cluster IS NULL GROUP BY idx) GROUP BY 1", CTES + MANUAL)
def c03b(spark, sf_dir):
    return cluster.rain_guided(_known(spark, sf_dir), 4)[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query("c03c_rain_ranges", "cluster:i low:d6 high:d6", "SELECT cluster, min(rain) AS low, max(rain) AS high FROM parted WHERE cluster IS NOT NULL GROUP BY 1", CTES + MANUAL)
def c03c(spark, sf_dir):
    return cluster.rain_ranges(cluster.rain_known(_known(spark, sf_dir), 4))


@query("c04_threshold_clusters", "station_id:s window_index:i total:d6 cluster:i", "SELECT station_id, window_index, wsum AS total, cluster FROM samples", CTES)
def c04(spark, sf_dir):
    return base.samples(spark, sf_dir).withColumn("total", F.col("wsum"))


EMBEDDED = """
e AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS f, label FROM embeddings),
pairs AS (SELECT a.idx AS i, b.idx AS j, a.label AS li, b.label AS lj, list_distance(a.f, b.f) AS d FROM e a JOIN e b ON a.idx < b.idx),"""


@query(
    "c05_nearest_centroid",
    "idx:i cluster:i",
    "SELECT e.idx, arg_min(c.label, list_distance(e.f, c.c)) AS cluster FROM e, (SELECT label, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(f[p]) AS m FROM e, (SELECT unnest(generate_series(1, 64)) AS p) GROUP BY ALL) GROUP BY 1) c GROUP BY 1",
    EMBEDDED,
)
def c05(spark, sf_dir):
    rows = adapters.features(spark, sf_dir)
    return cluster.nearest(rows, distance.centroids(rows))


@query("c06_affinity", "i:i j:i w:d6", "SELECT i, j, exp(-d * d / 2) AS w FROM pairs", EMBEDDED)
def c06(spark, sf_dir):
    return distance.affinity(adapters.features(spark, sf_dir), 1.0)


@query(
    "c07_normalized_affinity",
    "i:i j:i w:d9",
    "SELECT i, j, w / sqrt(a.s) / sqrt(b.s) AS w FROM (SELECT i, j, exp(-d * d / 2) AS w FROM pairs) p JOIN deg a ON a.k = i JOIN deg b ON b.k = j",
    EMBEDDED + "deg AS (SELECT k, sum(w) AS s FROM (SELECT i AS k, exp(-d * d / 2) AS w FROM pairs UNION ALL SELECT j, exp(-d * d / 2) FROM pairs) GROUP BY 1),",
)
def c07(spark, sf_dir):
    return distance.normalized_affinity(adapters.features(spark, sf_dir), 1.0)


@query("c10_train_assign", "split:s cluster:i n:i", "SELECT split, arg_min_c AS cluster, count(*) AS n FROM (SELECT s.station_id, s.window_index, s.split, arg_min(c.cluster, round(pow(wsum - c1, 2) + pow(wmax - c2, 2), 6)) AS arg_min_c FROM samples s, (SELECT cluster, avg(wsum) AS c1, avg(wmax) AS c2 FROM samples WHERE split = 'train' GROUP BY 1) c GROUP BY ALL) GROUP BY ALL", CTES)
def c10(spark, sf_dir):
    rows = base.samples(spark, sf_dir).withColumn("features", F.array("wsum", "wmax")).drop("win")
    # A rain level that no train window has (as where every day has orders) has no centroid, and no row goes to it.
    centres = distance.centroids(rows.where("split = 'train'"), "cluster")
    return cluster.nearest(rows.drop("cluster"), centres).groupBy("split", "cluster").agg(F.count("*").alias("n"))


@query("c11_feature_matrix", "station_id:s window_index:i features:a6", "SELECT station_id, window_index, features FROM (SELECT station_id, row_idx AS window_index, flatten(list([tmax, rain]) OVER (PARTITION BY station_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS features FROM filled) WHERE len(features) = 6", CTES)
def c11(spark, sf_dir):
    return windows.sliding(base.filled(spark, sf_dir), 3, ["tmax", "rain"]).withColumn("features", windows.flat(F.col("win")))


@query("c12_pipeline_features", "station_id:s window_index:i features:a6", "SELECT station_id, window_index, features FROM (SELECT station_id, row_idx AS window_index, flatten(list([(tmax - m) / s, rain]) OVER (PARTITION BY station_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) AS features FROM split, (SELECT avg(tmax) AS m, stddev_pop(tmax) AS s FROM split WHERE split = 'train') WHERE split = 'train') WHERE len(features) = 4", CTES)
def c12(spark, sf_dir):
    rows = scaling.scale_split(base.split(spark, sf_dir), ["tmax", "rain"], "standard", None, "rain").where("split = 'train'")
    return windows.sliding(rows, 2, ["tmax", "rain"]).withColumn("features", windows.flat(F.col("win")))


@query("c13_pairwise_distances", "i:i j:i distance:d6", "SELECT i, j, d AS distance FROM pairs", EMBEDDED)
def c13(spark, sf_dir):
    return distance.pairs(adapters.features(spark, sf_dir))


ORDERED = EMBEDDED + "ordered AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM pairs),"


def _sigmas_sql(n: int, low: float, high: float) -> str:
    return f"SELECT k, CASE WHEN a + k * (b - a) / {max(n - 1, 1)} = 0 THEN 0.01 ELSE a + k * (b - a) / {max(n - 1, 1)} END AS sigma FROM (SELECT max(d) FILTER (WHERE r = least(floor({low}::DOUBLE * n), n - 1)) AS a, max(d) FILTER (WHERE r = least(floor({high}::DOUBLE * n), n - 1)) AS b FROM ordered), (SELECT unnest(generate_series(0, {n - 1})) AS k)"


@query("c14_sigma_candidates", "k:i sigma:d6", _sigmas_sql(20, 0.01, 0.2), ORDERED)
def c14(spark, sf_dir):
    return distance.sigma_candidates(adapters.features(spark, sf_dir))


@query("c15_sigma_values", "k:i sigma:d6", _sigmas_sql(5, 0.1, 0.5), ORDERED)
def c15(spark, sf_dir):
    return distance.sigma_candidates(adapters.features(spark, sf_dir), 5, 0.1, 0.5)


SILHOUETTE = (
    EMBEDDED
    + """
sides AS (SELECT i AS idx, lj AS other, d FROM pairs UNION ALL SELECT j, li, d FROM pairs),
means AS (SELECT b.idx, e.label, other, avg(d) AS m FROM sides b JOIN e USING (idx) GROUP BY ALL),
sil AS (SELECT idx, label, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM (SELECT idx, label, max(m) FILTER (WHERE other = label) AS a, min(m) FILTER (WHERE other <> label) AS b FROM means GROUP BY ALL)),"""
)


@query("c22_silhouette", "scope:s cluster:i n:i mean:d6 min:d6 max:d6 status:s", "SELECT 'overall' AS scope, NULL::INT AS cluster, count(*) AS n, avg(s) AS mean, min(s) AS min, max(s) AS max, 'ok' AS status FROM sil UNION ALL SELECT 'cluster', label, count(*), avg(s), min(s), max(s), 'ok' FROM sil GROUP BY label", SILHOUETTE)
def c22(spark, sf_dir):
    return distance.silhouette_summary(adapters.features(spark, sf_dir))


HIGH = """
hi AS (SELECT *, label >= 5 AS high FROM e),
cell AS (SELECT idx, high, p, f[p] AS x FROM hi, (SELECT unnest(generate_series(1, 64)) AS p)),
cent AS (SELECT high, p, avg(x) AS m FROM cell GROUP BY ALL),"""


def _high(spark, sf_dir):
    return adapters.features(spark, sf_dir).withColumn("high", F.col("label") >= 5)


@query(
    "c23_centroid_gap",
    "centroid_distance:d6 mean_distance_high:d6 mean_distance_low:d6 n_high:i n_low:i",
    """SELECT (SELECT sqrt(sum(pow(a.m - b.m, 2))) FROM cent a JOIN cent b USING (p) WHERE a.high AND NOT b.high) AS centroid_distance, avg(d) FILTER (WHERE high) AS mean_distance_high, avg(d) FILTER (WHERE NOT high) AS mean_distance_low,
    count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE NOT high) AS n_low FROM (SELECT idx, c.high, sqrt(sum(pow(x - m, 2))) AS d FROM cell c JOIN cent USING (high, p) GROUP BY ALL)""",
    EMBEDDED + HIGH,
)
def c23(spark, sf_dir):
    return distance.centroid_gap(_high(spark, sf_dir))


@query("c23b_feature_gaps", "pos:i mean_high:d6 mean_low:d6 difference:d6 rank:i", "SELECT p - 1 AS pos, a AS mean_high, b AS mean_low, abs(a - b) AS difference, row_number() OVER (ORDER BY abs(a - b) DESC, p) AS rank FROM (SELECT p, max(m) FILTER (WHERE high) AS a, max(m) FILTER (WHERE NOT high) AS b FROM cent GROUP BY 1)", EMBEDDED + HIGH)
def c23b(spark, sf_dir):
    return distance.feature_gaps(_high(spark, sf_dir))


@query("c24_high_only_spread", "pos:i n:i mean:d6 std:d6 min:d6 max:d6 mean_deviation:d6", "SELECT c.p - 1 AS pos, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, avg(abs(x - m)) AS mean_deviation FROM cell c JOIN cent USING (high, p) WHERE high GROUP BY 1", EMBEDDED + HIGH)
def c24(spark, sf_dir):
    return distance.feature_spread(_high(spark, sf_dir).where("high"))


@query(
    "c25_pooled_feature_gaps",
    "cluster:i feature:s mean_high:d4 mean_low:d4 difference:d4",
    """SELECT * FROM (SELECT *, abs(mean_high - mean_low) AS difference FROM (SELECT cluster, feature, avg(v) FILTER (WHERE high) AS mean_high, avg(v) FILTER (WHERE NOT high) AS mean_low FROM
    (SELECT s.cluster, s.y1 >= t.q AS high, unnest(['tmax', 'rain']) AS feature, unnest([f.tmax, f.rain]) AS v FROM samples s JOIN split f ON f.station_id = s.station_id AND f.split = s.split AND f.row_idx BETWEEN s.window_index AND s.window_index + 6,
    (SELECT quantile_cont(y1, 0.75) AS q FROM samples WHERE y1 > 0) t) GROUP BY ALL))""",
    CTES,
)
def c25(spark, sf_dir):
    rows = base.samples(spark, sf_dir).withColumn("next", F.col("y_by_lead")[0])
    return evaluate.pooled_gaps(rows, {"tmax": 0, "rain": 2})


@query("r01_model_comparison", "idx:i test_cluster:i model:i is_same_cluster:b actual:d6 prediction:d8 squared_error:d8 absolute_error:d8 squared_log_error:d8 absolute_percent_error:d4", "SELECT * FROM compared", ROUTES)
def r01(spark, sf_dir):
    return routing.comparison(base.model_predictions(spark, sf_dir))


@query("r03_oracle_selection", "idx:i test_cluster:i metric:s selected_model_cluster:i selected_is_same_cluster:b actual:d6 selected_prediction:d8 same_cluster_prediction:d8 selected_absolute_error:d8 same_cluster_absolute_error:d8", "SELECT * FROM selected", ROUTES)
def r03(spark, sf_dir):
    return base.selected(spark, sf_dir)


SUMMARY = ["mse", "rmse", "mae", "rmsle", "mape"]


@query(
    "r04_metric_summary",
    "metric:s n_test:i switched_samples:i switched_percent:d4 r2_improvement:d4 " + " ".join(f"{m}_original:d4 {m}_selected:d4 {m}_improvement:d4 {m}_improvement_percent:d4" for m in SUMMARY),
    "SELECT *, r2_selected - r2_original AS r2_improvement, switched_samples / n_test * 100 AS switched_percent, " + ", ".join(f"{m}_original - {m}_selected AS {m}_improvement, ({m}_original - {m}_selected) / nullif({m}_original, 0) * 100 AS {m}_improvement_percent" for m in SUMMARY)
    + f" FROM (SELECT metric, count(*) AS n_test, count(*) FILTER (WHERE NOT selected_is_same_cluster) AS switched_samples, {metrics_sql('actual', 'same_cluster_prediction', 'true', '_original')}, {metrics_sql('actual', 'selected_prediction', 'true', '_selected')} FROM selected GROUP BY 1)",
    ROUTES,
)
def r04(spark, sf_dir):
    return routing.metric_summary(base.selected(spark, sf_dir))


@query("r05_transfer_matrix", "assigned_test_cluster:i LSTM_0:i LSTM_1:i LSTM_2:i LSTM_3:i", "SELECT test_cluster AS assigned_test_cluster, " + ", ".join(f'count(*) FILTER (WHERE selected_model_cluster = {k}) AS "LSTM_{k}"' for k in range(4)) + " FROM selected WHERE metric = 'RMSE' GROUP BY 1", ROUTES)
def r05(spark, sf_dir):
    return routing.transfer_matrix(base.selected(spark, sf_dir), "rmse", [0, 1, 2, 3])


GAIN = "avg(same_cluster_absolute_error - selected_absolute_error) AS mae_improvement, avg(pow(same_cluster_absolute_error, 2) - pow(selected_absolute_error, 2)) AS mean_squared_error_improvement, avg(same_cluster_absolute_error) AS same_cluster_mae, avg(selected_absolute_error) AS oracle_mae, avg(actual) AS mean_actual_precipitation_mm"


@query(
    "r06_routing_summary",
    "assigned_test_cluster:i n_test:i oracle_switched_samples:i oracle_switched_percent:d4 same_cluster_rmse:d4 oracle_rmse:d4 rmse_improvement:d4 same_cluster_mae:d4 oracle_mae:d4 mae_improvement:d4 mean_squared_error_improvement:d4 median_absolute_error_improvement:d4 mean_actual_precipitation_mm:d4",
    f"SELECT *, oracle_switched_samples / n_test * 100 AS oracle_switched_percent, same_cluster_rmse - oracle_rmse AS rmse_improvement FROM (SELECT test_cluster AS assigned_test_cluster, count(*) AS n_test, count(*) FILTER (WHERE NOT selected_is_same_cluster) AS oracle_switched_samples, sqrt(avg(pow(same_cluster_absolute_error, 2))) AS same_cluster_rmse, sqrt(avg(pow(selected_absolute_error, 2))) AS oracle_rmse, quantile_cont(same_cluster_absolute_error - selected_absolute_error, 0.5) AS median_absolute_error_improvement, {GAIN} FROM selected WHERE metric = 'MAE' GROUP BY 1)",
    ROUTES,
)
def r06(spark, sf_dir):
    return routing.cluster_summary(base.selected(spark, sf_dir), "mae")


@query(
    "r06b_pair_summary",
    "assigned_test_cluster:i oracle_selected_model_cluster:i n_test:i percent_of_assigned_cluster:d4 mean_actual_precipitation_mm:d4 same_cluster_mae:d4 oracle_mae:d4 mae_improvement:d4 mean_squared_error_improvement:d4",
    f"SELECT test_cluster AS assigned_test_cluster, selected_model_cluster AS oracle_selected_model_cluster, count(*) AS n_test, count(*) / sum(count(*)) OVER (PARTITION BY test_cluster) * 100 AS percent_of_assigned_cluster, {GAIN} FROM selected WHERE metric = 'MAE' GROUP BY test_cluster, selected_model_cluster",
    ROUTES,
)
def r06b(spark, sf_dir):
    return routing.pair_summary(base.selected(spark, sf_dir), "MAE")


@query("r07_oracle_predictions", "idx:i actual:d6 selected_model_cluster:i selected_prediction:d8 same_cluster_prediction:d8", "SELECT idx, actual, selected_model_cluster, selected_prediction, same_cluster_prediction FROM selected WHERE metric = 'RMSE'", ROUTES)
def r07(spark, sf_dir):
    own = base.model_predictions(spark, sf_dir).where("model = test_cluster").select("idx", "actual")
    return routing.aligned(own, base.selected(spark, sf_dir), "RMSE")


@query("r02_metric_winners", "metric:s test_cluster:i selected_model_cluster:i n:i", "SELECT metric, test_cluster, selected_model_cluster, count(*) AS n FROM selected GROUP BY ALL", ROUTES)
def r02(spark, sf_dir):
    return base.selected(spark, sf_dir).groupBy("metric", "test_cluster", "selected_model_cluster").agg(F.count("*").alias("n"))


def _windowed_sigmas(rows: str, width: int) -> str:
    cells = f"list([(tmax - m) / s, (radiation - rm) / rs]) OVER (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)"
    scale = f"(SELECT avg(tmax) AS m, stddev_pop(tmax) AS s, avg(radiation) AS rm, stddev_pop(radiation) AS rs FROM {rows})"
    return f"""win AS (SELECT * FROM (SELECT row_idx AS i, flatten({cells}) AS f FROM {rows}, {scale}) WHERE len(f) = {2 * width}),
ordered AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM (SELECT list_distance(a.f, b.f) AS d FROM win a JOIN win b ON a.i < b.i)),"""


@query("c16_sigma_full_frame", "k:i sigma:d4", _sigmas_sql(20, 0.01, 0.2), base.CTES_ALL + _windowed_sigmas("filled_all", 5))
def c16(spark, sf_dir):
    rows = base.filled(spark, sf_dir, False)
    return _window_sigmas(scaling.apply(rows, scaling.fit(rows, ["tmax", "radiation"], "standard"), ["tmax", "radiation"]), 5)


@query("c17_sigma_train_features", "k:i sigma:d4", _sigmas_sql(20, 0.01, 0.2), base.CTES_ALL + "tr AS (SELECT * FROM split_all WHERE split = 'train')," + _windowed_sigmas("tr", 4))
def c17(spark, sf_dir):
    rows = scaling.scale_split(base.split(spark, sf_dir, False), ["tmax", "radiation"], "standard", None, "rain").where("split = 'train'")
    return _window_sigmas(rows, 4)


def _window_sigmas(rows, width):
    found = windows.sliding(rows, width, ["tmax", "radiation"]).select(F.col("window_index").alias("idx"), windows.flat(F.col("win")).alias("features"))
    return distance.sigma_candidates(found)


@query("a19_metrics_by_cluster_and_lead", "cluster:i lead_day:i n:i " + MEASURES, f"SELECT cluster, lead_day, count(*) AS n, {metrics_sql('actual', 'predicted')} FROM long WHERE split = 'test' GROUP BY cluster, lead_day", LONG)
def a19(spark, sf_dir):
    return metrics.by(base.long_table(spark, sf_dir).where("split = 'test'"), "cluster", "lead_day")
