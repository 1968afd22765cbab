"""End-to-end runs over a daily frame: clustering, sigma and eigengap tools, network and ARMA sweeps, and their command line.

python -m daywheel.plans.experiments {cluster,auto-sigma,eigengap,network,arma} --root DIR --state S --station ID ...
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import arma, cluster, distance, evaluate, frame, network, reduce, routing, scaling, windows
from ..operators.cluster import assign_splits
from ..sources.schema import DATE, RAIN, STATION
from ..sources.station import load_station, rain_series
from . import outputs, report, sweep


log = logging.getLogger("daywheel")


def measure_columns(daily: DataFrame) -> list[str]:
    return frame.numeric_columns(daily, (DATE, "row_idx", "split_row", "split_offset"))


def window_features(daily: DataFrame, window: int, train: float | None = None, covariates: str | None = "standard", rain_scaler: str | None = None, rain: str = RAIN, pca: float | None = None) -> DataFrame:
    """(idx, features) of one station's windows: of the train prefix only, or of the whole frame, scaled by the same rows."""
    columns = measure_columns(daily)
    rows = frame.train_prefix(daily, train, window, check=True) if train else daily
    rows = scaling.scale_split(rows.withColumn("split", F.lit("train")), columns, covariates, rain_scaler, rain)
    found = windows.sliding(rows, window, columns, check=True).select(F.col("window_index").alias("idx"), windows.flat(F.col("win")).alias("features"))
    return reduce.fit(found, pca).apply(found) if pca else found


def component_count(daily: DataFrame, window: int, threshold: float, train: float | None = None) -> int:
    """How many components of a raw frame's scaled windows explain the threshold's share of their variance."""
    return reduce.fit(window_features(daily, window, train), threshold).components.shape[1]


def run_clustering(daily: DataFrame, window: int = 4, k: int = 3, sigma: float = 1.0, algorithm: str = "spectral") -> DataFrame:
    """(cluster, n, percent) of the whole frame's windows."""
    rows = window_features(daily, window, rain_scaler="standard")
    return evaluate.cluster_shares(cluster.cluster(rows, k, algorithm, sigma))


def run_auto_sigma(daily: DataFrame, window: int = 5, train: float = 0.6, n: int = 20) -> DataFrame:
    """(k, sigma) from the train windows' pairwise distances."""
    return distance.sigma_candidates(window_features(daily, window, train), n)


def run_eigengap(daily: DataFrame, sizes: list[int], train: float = 0.6, points: int = 40, budget: int = 300, max_gaps: int = 20) -> list[dict]:
    """Of each window size: the best sigma between its candidates, its eigengaps and best k."""
    out = []
    for window in sizes:
        rows = window_features(daily, window, train)
        ends = [r.sigma for r in distance.sigma_candidates(rows).orderBy("k").collect()]
        out.append({"window": window} | cluster.best_row_sigma(rows, ends[0], ends[-1], points, budget, max_gaps))
    return out


def network_samples(daily: DataFrame, config: sweep.Config, horizon: int, train: float, val: float, algorithm: str, pca: float | None, rain: str) -> DataFrame:
    """Supervised samples with cluster: scaled inputs, targets in their own unit."""
    columns = measure_columns(daily)
    rows = frame.split(daily, train, val, check=True).withColumn("_y", F.col(rain))
    scaled = scaling.scale_split(rows, columns, "standard", None, rain)
    found = windows.supervised(scaled, config.window, horizon, "_y", columns).withColumn("rain", F.col("y"))
    found = reduce.route(found.drop("win"), pca, "clustering_only").withColumn("idx", F.col("window_index"))
    inputs = found.withColumn("_inputs", F.col("features")).withColumn("features", F.col("cluster_features"))
    return assign_splits(inputs, config.k, algorithm, config.sigma).withColumn("features", F.col("_inputs")).drop("_inputs")


def run_network(daily: DataFrame, config: sweep.Config, horizon: int = 5, train: float = 0.6, val: float = 0.1, algorithm: str = "kmeans", pca: float | None = None, rain: str = RAIN, oracle: bool = False, folder: str | None = None, units: tuple[int, int] = (32, 16), **options: object) -> dict:
    """Train a model per cluster and evaluate it; returns the run's row. folder: where its tables go."""
    samples = network_samples(daily, config, horizon, train, val, algorithm, pca, rain).persist()
    models = network.train_clusters(samples, horizon, units, **options).persist()
    ids = [STATION, "split", "window_index"]
    found = network.predict(samples, models, ids, horizon, units).drop("model_cluster")
    full = samples.join(found, ids).withColumn("predicted", F.col("yhat_by_lead")[horizon - 1])
    selected = compared = None
    if oracle:
        every = network.predict(samples.where("split = 'test'"), models, ["window_index"], horizon, units, every=True)
        rows = samples.where("split = 'test'").select("window_index", F.col("cluster").alias("test_cluster"), F.col("y").alias("actual")).join(every, "window_index")
        rows = rows.select(F.col("window_index").alias("idx"), "test_cluster", "actual", F.col("model_cluster").alias("model"), F.col("yhat_by_lead")[horizon - 1].alias("prediction"))
        compared = routing.comparison(rows)
        selected = routing.selection(compared)
    if folder:
        about = {"name": config.name, "window_size": config.window, "n_clusters": config.k, "algorithm": algorithm, "sigma": config.sigma, "forecast_horizon": horizon, "pca_variance_threshold": pca, "pca_for_clustering_only": pca is not None, "lstm_units": units[0], "dense_units": units[1]} | options
        report.save_run(f"{folder}/{config.name}", full, network.history_table(models), selected)
        row = outputs.save_run(f"{folder}/{config.name}", full, about, horizon, selected, compared) | {"window_size": config.window, "n_clusters": config.k, "sigma": config.sigma}
        outputs.write_report(f"{folder}/{config.name}", about)
    else:
        got = {r.split: r for r in metrics.by(full, "split", actual="y").collect()}
        row = {f"{s}_{m}": got[s][m] for s in frame.SPLITS if s in got for m in ("rmse", "mae", "r2")}
    samples.unpersist()
    models.unpersist()
    return row


def run_arma(daily: DataFrame, config: sweep.ArmaConfig, train: float = 0.6, val: float = 0.1, rain: str = RAIN, folder: str | None = None) -> dict:
    """Fit on the train days, forecast at every day with fixed parameters, evaluate on whole lead-day rows. folder: where its files go."""
    rows = frame.split(rain_series(daily, rain, check=True), train, val, check=True).persist()
    fitted = arma.fit_stations(rows.where("split = 'train'"), [(config.p, config.q)], rain).first()
    if fitted.error:
        raise ValueError(fitted.error)
    whole = arma.arma_residuals(rows.drop("split", "split_offset", "split_row"), fitted.mean, list(fitted.ar), list(fitted.ma), rain)
    ahead = arma.forecasts(whole, fitted.mean, list(fitted.ar), list(fitted.ma), config.horizon, rain=rain)
    arma.check_forecasts(ahead)
    targets = windows.supervised(rows, config.window, config.horizon, rain, [rain], need_current=True)
    both = targets.join(ahead.select(F.col("row_idx").alias("origin_index"), "yhat_by_lead"), "origin_index").withColumn("predicted", F.col("yhat_by_lead")[config.horizon - 1])
    if folder:
        facts = {"aic": fitted.aic, "bic": fitted.bic, "hqic": fitted.hqic}
        text = "\n".join(["ARMA MODEL", f"order: ({config.p}, {config.q})", f"mean: {report.number(fitted.mean)}", f"ar: {list(fitted.ar)}", f"ma: {list(fitted.ma)}", *[f"{k}: {report.number(v)}" for k, v in facts.items()]]) + "\n"
        row = outputs.save_run(f"{folder}/{config.name}", both, {"name": config.name, "window_size": config.window, "forecast_horizon": config.horizon}, config.horizon, model_summary=text, facts=facts)
        rows.unpersist()
        return row | {"window_size": config.window}
    got = {r.split: r for r in metrics.by(both, "split", actual="y").collect()}
    rows.unpersist()
    return {"aic": fitted.aic, "bic": fitted.bic, "hqic": fitted.hqic} | {f"{s}_{m}": got[s][m] for s in frame.SPLITS if s in got for m in ("rmse", "mae", "r2")}


def run_sweep(daily: DataFrame, grid: list, run, **options: object) -> tuple[DataFrame | None, list[dict]]:
    """(ranked results, failures) of a grid; daily is kept for all of its runs."""
    daily = daily.persist()
    done, failed = sweep.run_all(grid, lambda config: run(daily, config, **options))
    daily.unpersist()
    if not done:
        return None, failed
    names = list(dict.fromkeys(n for r in done for n in r))
    whole = {n: all(isinstance(r.get(n), int) for r in done) for n in names}
    kinds = ", ".join(f"{n} {'string' if n == 'run_name' else 'long' if whole[n] else 'double'}" for n in names)
    cell = lambda n, v: v if n == "run_name" or v is None or whole[n] else float(v)
    table = daily.sparkSession.createDataFrame([tuple(cell(n, r.get(n)) for n in names) for r in done], kinds)
    return sweep.rank(table), failed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="daywheel")
    kinds = top.add_subparsers(dest="kind", required=True)
    for name in ("cluster", "auto-sigma", "eigengap", "network", "arma"):
        one = kinds.add_parser(name)
        one.add_argument("--root", required=True)
        one.add_argument("--state", required=True)
        one.add_argument("--station", required=True)
        one.add_argument("--windows", type=int, nargs="+", default=[5])
        one.add_argument("--k", type=int, nargs="+", default=[3])
        one.add_argument("--sigma", type=float, default=1.0)
        one.add_argument("--algorithm", choices=cluster.ALGORITHMS, default="kmeans")
        one.add_argument("--horizon", type=int, default=5)
        one.add_argument("--orders", type=arma.parse_orders, default=[(1, 0), (2, 1), (5, 1)])
        one.add_argument("--epochs", type=int, default=250)
        one.add_argument("--oracle", action="store_true")
        one.add_argument("--out")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("daywheel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    section(f"{args.kind}: station {args.state}/{args.station}")
    daily = frame_of(load_station(spark, args.state, args.station, args.root))
    if args.kind == "cluster":
        print(report.text_table(report.rows_of(run_clustering(daily, args.windows[0], args.k[0], args.sigma, args.algorithm).orderBy("cluster")), ["cluster", "n", "percent"]))
    elif args.kind == "auto-sigma":
        print(report.text_table(report.rows_of(run_auto_sigma(daily, args.windows[0]).orderBy("k")), ["k", "sigma"]))
    elif args.kind == "eigengap":
        for row in run_eigengap(daily, args.windows):
            print(json.dumps({k: v for k, v in row.items() if k not in ("eigenvalues", "gaps")}, default=float))
    else:
        if args.kind == "network":
            ranked, failed = run_sweep(daily, sweep.configurations(args.windows, args.k, [args.sigma] if args.algorithm == "spectral" else None), run_network, horizon=args.horizon, algorithm=args.algorithm, oracle=args.oracle, folder=args.out, epochs=args.epochs)
        else:
            ranked, failed = run_sweep(daily, sweep.arma_configurations(args.windows, args.horizon, args.orders), run_arma, folder=args.out)
        if ranked is not None:
            print(report.text_table(report.rows_of(ranked.orderBy("rank")), ["rank", "run_name", "test_rmse", "test_mae"]))
            if args.out:
                outputs.save_sweep(args.out, report.rows_of(ranked), failed, {"Station": f"{args.state}/{args.station}", "Window sizes": args.windows, "Forecast horizon": args.horizon})
        for f in failed:
            print(f"failed {f['run_name']}: {f['error']}")
    return 0


def section(title: str) -> None:
    """A heading on the log."""
    log.info("%s", "=" * 72)
    log.info("%s", title)


def frame_of(daily: DataFrame) -> DataFrame:
    """A loaded station's frame with unknown means filled, as the models need."""
    return daily.fillna(0.0, subset=[c for c in measure_columns(daily)])


if __name__ == "__main__":
    raise SystemExit(main())
