"""What most queries start from, in DataFrames and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, evaluate, frame, routing, windows
from ..sources import adapters
from ..sources.station import fill_missing

WINDOW, HORIZON = 7, 3
TRAIN, VAL = 0.6, 0.2
FEATURES = ["tmax", "tmin", "rain", "radiation"]
#: Rain levels of a window that part the clusters.
LEVELS = [0.0, 5.0, 40.0]


def daily(spark: SparkSession, sf_dir: str, by_nation: bool = True) -> DataFrame:
    rows = adapters.daily(spark, sf_dir, by_nation)
    return rows.select("station_id", "Data", F.col("TEMPERATURA_MAXIMA").alias("tmax"), F.col("TEMPERATURA_MIN").alias("tmin"), F.col("PRECIPITACAO_TOTAL").alias("rain"), F.col("RADIACAO").alias("radiation"), "row_idx")


def filled(spark: SparkSession, sf_dir: str, by_nation: bool = True) -> DataFrame:
    return fill_missing(daily(spark, sf_dir, by_nation))


def split(spark: SparkSession, sf_dir: str, by_nation: bool = True) -> DataFrame:
    return frame.split(filled(spark, sf_dir, by_nation), TRAIN, VAL)


def samples(spark: SparkSession, sf_dir: str, by_nation: bool = True) -> DataFrame:
    """Supervised samples with wmean, wmax, wsum of the window's rain, cluster by rain level and persistence forecasts."""
    rows = windows.supervised(split(spark, sf_dir, by_nation), WINDOW, HORIZON, "rain", FEATURES)
    rain = F.transform("win", lambda day: day[FEATURES.index("rain")])
    total = F.aggregate(rain, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({"wsum": total, "wmean": total / WINDOW, "wmax": F.array_max(rain), "yhat_by_lead": F.array_repeat("current", HORIZON), "predicted": F.col("current")})
    return rows.withColumn("cluster", cluster.threshold_labels(F.col("wsum"), LEVELS))


def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.lead_long(samples(spark, sf_dir), ["station_id", "split", "window_index", "cluster"])


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, test_cluster, actual, model, prediction): test samples under four simple models, one per cluster."""
    rows = samples(spark, sf_dir).where("split = 'test'")
    rows = rows.withColumn("idx", F.col("station_id").cast("long") * 100000 + F.col("window_index"))
    models = F.array(F.col("current"), F.col("wmean"), F.col("wmax") / 2, F.lit(1.0))
    rows = rows.select("idx", F.col("cluster").alias("test_cluster"), F.col("y").alias("actual"), F.posexplode(models).alias("model", "prediction"))
    return rows


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.selection(routing.comparison(model_predictions(spark, sf_dir)))


def _daily_sql(station: str, name: str) -> str:
    return f"""
obs{name} AS (SELECT {station} AS station_id, o_orderdate::DATE AS "Data", o_totalprice AS tmax, c_acctbal AS tmin,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 10000 END AS rain, o_totalprice / 10000 AS radiation
  FROM orders JOIN customer ON o_custkey = c_custkey),
cal{name} AS (SELECT station_id, unnest(generate_series(min("Data"), max("Data"), INTERVAL 1 DAY))::DATE AS "Data" FROM obs{name} GROUP BY station_id),
agg{name} AS (SELECT station_id, "Data", avg(tmax) AS tmax, avg(tmin) AS tmin, sum(rain) AS rain, sum(radiation) AS radiation FROM obs{name} GROUP BY ALL),
daily{name} AS (SELECT c.station_id, c."Data", tmax, tmin, coalesce(rain, 0) AS rain, coalesce(radiation, 0) AS radiation,
  row_number() OVER (PARTITION BY c.station_id ORDER BY c."Data") - 1 AS row_idx FROM cal{name} c LEFT JOIN agg{name} a ON a.station_id = c.station_id AND a."Data" = c."Data"),
filled{name} AS (SELECT station_id, "Data", coalesce(tmax, 0) AS tmax, coalesce(tmin, 0) AS tmin, rain, radiation, row_idx FROM daily{name}),
bounds{name} AS (SELECT *, count(*) OVER (PARTITION BY station_id) AS n, floor(count(*) OVER (PARTITION BY station_id) * 0.6::DOUBLE) AS a FROM filled{name}),
split{name} AS (SELECT station_id, "Data", tmax, tmin, rain, radiation, row_idx, CASE WHEN row_idx < a THEN 'train' WHEN row_idx < a + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split,
  (CASE WHEN row_idx < a THEN 0 WHEN row_idx < a + floor(n * 0.2::DOUBLE) THEN a ELSE a + floor(n * 0.2::DOUBLE) END)::BIGINT AS split_offset FROM bounds{name}),
lagged{name} AS (SELECT station_id, split, row_idx AS window_index, lead(rain, 6) OVER w AS current, lead(rain, 7) OVER w AS y1, lead(rain, 8) OVER w AS y2, lead(rain, 9) OVER w AS y3,
  lead("Data", 7) OVER w AS d1, lead("Data", 8) OVER w AS d2, lead("Data", 9) OVER w AS d3, avg(rain) OVER f AS wmean, max(rain) OVER f AS wmax, sum(rain) OVER f AS wsum
  FROM split{name} WINDOW w AS (PARTITION BY station_id, split ORDER BY row_idx), f AS (PARTITION BY station_id, split ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
samples{name} AS (SELECT *, (wsum > 0)::INT + (wsum > 5)::INT + (wsum > 40)::INT AS cluster FROM lagged{name} WHERE y3 IS NOT NULL),"""


#: One station per nation.
CTES = _daily_sql("c_nationkey::VARCHAR", "")
#: The whole company as one station.
CTES_ALL = _daily_sql("'ALL'", "_all")
LONG = (
    CTES
    + """
long AS (SELECT station_id, split, window_index, cluster, k AS lead_day, [d1, d2, d3][k] AS target_date, [y1, y2, y3][k] AS actual, current AS predicted
  FROM samples, (SELECT unnest([1, 2, 3]) AS k)),"""
)
ROUTES = (
    CTES
    + """
preds AS (SELECT station_id::BIGINT * 100000 + window_index AS idx, cluster AS test_cluster, y3 AS actual, k AS model, [current, wmean, wmax / 2, 1.0::DOUBLE][k + 1] AS prediction
  FROM samples, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE split = 'test'),
compared AS (SELECT *, model = test_cluster AS is_same_cluster, (actual - prediction) * (actual - prediction) AS squared_error, abs(actual - prediction) AS absolute_error,
  pow(ln(1 + greatest(actual, 0)) - ln(1 + greatest(prediction, 0)), 2) AS squared_log_error, CASE WHEN actual <> 0 THEN abs((actual - prediction) / actual) * 100 END AS absolute_percent_error FROM preds),
errors AS (SELECT idx, test_cluster, actual, model, prediction, m AS metric, CASE m WHEN 'MAE' THEN absolute_error WHEN 'RMSLE' THEN squared_log_error WHEN 'MAPE' THEN coalesce(absolute_percent_error, absolute_error) ELSE squared_error END AS e
  FROM compared, (SELECT unnest(['MSE', 'RMSE', 'MAE', 'RMSLE', 'MAPE']) AS m)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY idx, metric ORDER BY e, model) AS r FROM errors),
selected AS (SELECT r.idx, r.test_cluster, r.metric, r.model AS selected_model_cluster, r.model = r.test_cluster AS selected_is_same_cluster, r.actual, r.prediction AS selected_prediction, p.prediction AS same_cluster_prediction,
  abs(r.actual - r.prediction) AS selected_absolute_error, abs(r.actual - p.prediction) AS same_cluster_absolute_error
  FROM ranked r JOIN preds p ON p.idx = r.idx AND p.model = r.test_cluster WHERE r.r = 1),"""
)


def metrics_sql(actual: str, predicted: str, where: str = "true", suffix: str = "") -> str:
    """The six measures as DuckDB aggregates."""
    f = f"FILTER (WHERE {actual} IS NOT NULL AND {predicted} IS NOT NULL AND {where})"
    e = f"({actual} - {predicted})"
    mse = f"avg({e} * {e}) {f}"
    return f"""{mse} AS mse{suffix}, sqrt({mse}) AS rmse{suffix}, avg(abs{e}) {f} AS mae{suffix},
  sqrt(avg(pow(ln(1 + greatest({actual}, 0)) - ln(1 + greatest({predicted}, 0)), 2)) {f}) AS rmsle{suffix},
  CASE WHEN count(*) {f} < 2 THEN NULL WHEN var_pop({actual}) {f} = 0 THEN CASE WHEN {mse} = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - {mse} / var_pop({actual}) {f} END AS r2{suffix},
  avg(CASE WHEN {actual} <> 0 THEN abs({e} / {actual}) END) {f} * 100 AS mape{suffix}"""
