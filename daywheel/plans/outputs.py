"""Files of runs and sweeps: CSV tables, text summaries and a LaTeX report over a run's folder.

Tables are aggregated by Spark; a file is written row by row as Spark hands rows over, so the driver holds no table.
Folders are those of the driver's own file system, as reports are.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import distance, evaluate, frame, routing
from . import report

LINE = "=" * 72
#: Tables of a run, by what they hold.
METRICS, CLUSTERS, PREDICTIONS, SUMMARY = "metrics_summary.csv", "cluster_model_metrics.csv", "test_predictions.csv", "summary.txt"
HORIZON = "forecast_horizon_diagnostics"
ROUTING = {
    "summary": "test_model_metric_summary.csv",
    "matrix": "oracle_model_selection_matrix.csv",
    "clusters": "oracle_cluster_routing_summary.csv",
    "pairs": "oracle_cluster_pair_summary.csv",
}

# Configuration entries and their labels, in the order they are listed.
ABOUT = {"state": "State", "station_id": "Station ID", "window_size": "Window Size", "n_clusters": "Number of Clusters", "algorithm": "Algorithm", "sigma": "Sigma", "normalize": "Normalize"}
LATER = {"target_scale": "LSTM Target Scale", "forecast_horizon": "Forecast Horizon", "manual_zero_tolerance": "Manual Zero Tolerance", "test_all_models": "Test Samples on All Models"}
NETWORK = {
    "lstm_units": "LSTM layer 1 units", "lstm_units_2": "LSTM layer 2 units", "dense_units": "Dense layer units", "output_units": "Output units", "dropout_rate": "Dropout rate", "learning_rate": "Learning rate",
    "weight_decay": "Weight decay", "epochs": "Epochs", "batch_size": "Batch size", "early_stopping": "Early stopping", "patience": "Patience", "optimizer": "Optimizer", "loss": "Loss",
    "loss_quantiles": "Loss quantiles", "loss_quantile_weights": "Loss quantile weights", "metrics": "Metrics",
}
DATASET = {"dataset_start_date": "Start date", "dataset_end_date": "End date", "features": "Features", "n_samples": "Input samples"}
SCALERS = {"scaler_type": "Covariate Scaler", "precipitation_scaler_type": "Precipitation Scaler"}
#: Sections of figures: title, glob of the files in the run's folder.
FIGURES = {
    "Cluster Diagnostics": "cluster_diagnostics/*.png",
    "Prediction Overview": "prediction_overview/*.png",
    "Residual Diagnostics": "residual_diagnostics/*.png",
    "Forecast Horizon": f"{HORIZON}/*.png",
    "Oracle Transfer Diagnostics": "oracle_model_selection_diagnostics/*.png",
    "Prediction Time Series Splits": "prediction_timeseries_splits/**/*.png",
    "Cluster Prediction Time Series": "cluster_prediction_timeseries/*.png",
    "Cluster Prediction Scatter": "cluster_prediction_scatter/*.png",
}


def write_csv(rows: DataFrame | Iterable[dict], path: Path, columns: list[str] | None = None) -> None:
    """One CSV file with a header; unknown values are empty."""
    if isinstance(rows, DataFrame):
        columns, rows = rows.columns, (r.asDict() for r in rows.toLocalIterator())
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as file:
        out = csv.DictWriter(file, columns or [], extrasaction="ignore")
        out.writeheader()
        out.writerows({k: "" if v is None else v for k, v in r.items()} for r in rows)


def read_csv(path: Path) -> list[dict]:
    """Rows of a small CSV file, numbers as numbers; none if there is no such file."""
    if not path.exists():
        return []
    with path.open(newline="", encoding="utf-8") as file:
        return [{k: _value(v) for k, v in r.items()} for r in csv.DictReader(file)]


def _value(text: str | None) -> object:
    for kind in (int, float):
        try:
            return kind(text)
        except (TypeError, ValueError):
            pass
    return text or None


def named_measures(table: DataFrame) -> DataFrame:
    """A table of measures with their names in capitals."""
    return table.withColumnsRenamed({m.lower(): m for m in metrics.METRICS})


# Tables of a run.


def by_window(test: DataFrame, horizon: int) -> DataFrame:
    """A row for each test window: its facts, and target, forecast and residual of every lead day."""
    leads = []
    for d in range(1, horizon + 1):
        a, p = F.col("y_by_lead")[d - 1], F.col("yhat_by_lead")[d - 1]
        leads += [F.col("date_by_lead")[d - 1].alias(f"target_date_lead_day_{d}"), a.alias(f"actual_lead_day_{d}"), p.alias(f"predicted_lead_day_{d}"), (a - p).alias(f"residual_lead_day_{d}")]
    own = [c for c in ("station_id", "window_index", "cluster", "current") if c in test.columns]
    return test.select(*own, F.col("y").alias("actual"), "predicted", (F.col("y") - F.col("predicted")).alias("residual"), *leads).orderBy("window_index")


def save_run(folder: str | Path, samples: DataFrame, config: dict, horizon: int, selected: DataFrame | None = None, compared: DataFrame | None = None, model_summary: str | None = None, facts: dict | None = None) -> dict:
    """Write a run's tables and texts; returns its row of a sweep.

    samples: split, window_index, current, y, predicted, y_by_lead, yhat_by_lead, date_by_lead, and cluster where there are
    clusters. facts: further columns of the row, such as information criteria.
    """
    folder = Path(folder)
    test = samples.where("split = 'test'")
    splits = report.rows_of(named_measures(metrics.by(samples, "split", actual="y")))
    splits.sort(key=lambda r: frame.SPLITS.index(r["split"]))
    write_csv(splits, folder / METRICS, ["split", "n", *metrics.METRICS])
    write_csv(by_window(test, horizon), folder / PREDICTIONS)
    lead = evaluate.lead_long(test, ["window_index"])
    write_csv(lead.orderBy("lead_day", "window_index"), folder / HORIZON / "test_prediction_by_lead_day.csv")
    write_csv(named_measures(metrics.by(lead, "lead_day")).orderBy("lead_day"), folder / HORIZON / "test_prediction_metrics_by_lead_day.csv")
    diagnostics = evaluate.horizon_diagnostics(samples)
    (folder / HORIZON / "forecast_horizon_behavior_report.txt").write_text(report.horizon_report(diagnostics), encoding="utf-8")
    parts = report.rows_of(test.agg(*metrics.dry_and_rainy(F.col("y"), F.col("predicted"))))
    clusters = []
    if "cluster" in samples.columns:
        clusters = report.rows_of(named_measures(metrics.by(test, "cluster", actual="y")).orderBy("cluster"))
        write_csv(clusters, folder / CLUSTERS, ["cluster", "n", *metrics.METRICS])
    if model_summary is not None:
        (folder / "arma_model_summary.txt").write_text(model_summary, encoding="utf-8")
    routes = save_routing(folder, selected, compared) if selected is not None else []
    (folder / SUMMARY).write_text(run_summary(config, splits, parts[0] if parts else {}, clusters, routes, facts), encoding="utf-8")
    row = {"run_name": config.get("name", folder.name)} | (facts or {})
    row |= {f"{r['split']}_{m.lower()}": r[m] for r in splits for m in metrics.METRICS}
    return row | {f"cluster_{r['cluster']}_{m.lower()}": r[m] for r in clusters for m in metrics.METRICS}


def run_summary(config: dict, splits: list[dict], parts: dict, clusters: list[dict], routes: list[dict], facts: dict | None = None) -> str:
    """What a run was and how it did, as text."""
    threshold = config.get("pca_variance_threshold")
    about = [(label, config[k]) for k, label in (ABOUT | LATER).items() if k in config] + [("PCA variance threshold", "not used" if threshold is None else f"{threshold:.2f}"), ("PCA mode", pca_mode(config))]
    out = ["RUN SUMMARY", LINE, "", *[f"{label}: {value}" for label, value in about], *[f"{k.upper()}: {report.number(v)}" for k, v in (facts or {}).items()]]
    shown = ["RMSE", "MAE", "R2", "RMSLE"]
    out += ["", "Metrics", report.text_table(splits, ["split", "n", *shown]), "", "Dry and rainy days of the test set", *[f"{k}: {report.number(v)}" for k, v in parts.items()]]
    if clusters:
        out += ["", "Test metrics by cluster", report.text_table(clusters, ["cluster", "n", "MSE", *shown])]
    if routes:
        out += ["", "Transfer between clusters (oracle diagnostic; chosen after the target was seen)", report.text_table(routes, ["metric", "n_test", "switched_samples", "rmse_original", "rmse_selected", "rmse_improvement"])]
    return "\n".join(out) + "\n"


def save_routing(folder: str | Path, selected: DataFrame, compared: DataFrame | None = None, metric: str = "RMSE", interval: DataFrame | None = None) -> list[dict]:
    """Write the oracle's tables and its text; returns the summary's rows. interval: a row of `evaluate.bootstrap_ci` over the squared error's gain."""
    folder = Path(folder)
    if compared is not None:
        write_csv(compared.orderBy("idx", "model"), folder / "test_model_comparison.csv")
    write_csv(selected.orderBy("idx", "metric"), folder / "test_model_selection.csv")
    routes = report.rows_of(routing.metric_summary(selected).orderBy("metric"))
    renamed = {"metric": "metric_selection", "switched_percent": "switched_samples_percent"}
    table = [{renamed.get(k, k): v for k, v in r.items()} for r in routes]
    write_csv(table, folder / ROUTING["summary"], list(table[0]) if table else ["metric_selection"])
    tables = {"matrix": routing.transfer_matrix(selected, metric).orderBy("assigned_test_cluster"), "clusters": routing.cluster_summary(selected, metric).orderBy("assigned_test_cluster"), "pairs": routing.pair_summary(selected, metric).orderBy("assigned_test_cluster", "oracle_selected_model_cluster")}
    found = {k: report.rows_of(t) for k, t in tables.items()}
    for k, t in tables.items():
        write_csv(found[k], folder / ROUTING[k], t.columns)
    (folder / "test_model_selection_report.txt").write_text(selection_report(routes, metric, report.rows_of(interval)[0] if interval is not None else None), encoding="utf-8")
    text = ["TRANSFER BETWEEN CLUSTERS", LINE, "", f"Rows: assigned cluster; columns: the model that would have been best by {metric}."]
    text += [report.text_table(found[k], tables[k].columns) + "\n" if found[k] else "no test samples\n" for k in tables]
    (folder / "oracle_vs_same_cluster_summary.txt").write_text("\n".join(text), encoding="utf-8")
    return routes


def selection_report(routes: list[dict], metric: str, interval: dict | None = None) -> str:
    """The choice among all clusters' models, metric by metric, as text."""
    out = ["TEST CLUSTER MODEL SELECTION REPORT", LINE, "", "Every test sample was forecast by every cluster's model, and for each metric the best of these was picked", "with the target in view: the gains are an upper bound of better routing, not an estimate of performance.", ""]
    first = [r for r in routes if r["metric"] == metric]
    for r in first:
        out += [f"Primary metric: {metric}", *[f"{m}: {report.number(r[f'{m.lower()}_original'])} -> {report.number(r[f'{m.lower()}_selected'])} (improvement {report.number(r[f'{m.lower()}_improvement'])})" for m in ("RMSE", "MAE", "MSE")]]
    if interval:
        out += [f"Mean gain in squared error, 95% interval: [{report.number(interval['low'])}, {report.number(interval['high'])}], positive with probability {report.number(interval['p_positive'], 3)}"]
    out += ["", "By selection metric"]
    for r in routes:
        out.append(f"{r['metric']}: switched {r['switched_samples']} of {r['n_test']} samples ({report.number(r['switched_percent'], 1)}%)")
        for m in metrics.METRICS:
            name = m.lower()
            percent = f", {report.number(r[f'{name}_improvement_percent'], 2)}%" if f"{name}_improvement_percent" in r else ""
            out.append(f"  {m}: {report.number(r[f'{name}_original'])} -> {report.number(r[f'{name}_selected'])} (change {report.number(r[f'{name}_improvement'])}{percent})")
    return "\n".join(out if routes else [*out, "no test samples"]) + "\n"


# Distances between windows before much and little rain.


def distance_report(rows: DataFrame, names: list[str], about: dict) -> str:
    """Markdown: how windows before much rain differ from the others, cluster by cluster.

    rows: idx, cluster, high, features (as named). A cluster without windows of either kind has no distances.
    """
    counts = report.rows_of(rows.groupBy("cluster").agg(F.count("*").alias("n"), F.count(F.when(F.col("high"), 1)).alias("high")).orderBy("cluster"))
    percent = lambda part, whole: f"{part} ({100 * part / max(whole, 1):.1f}%)"
    total, high = sum(r["n"] for r in counts), sum(r["high"] for r in counts)
    out = ["# Cluster Distance Analysis: windows before much and little rain", "", "## Configuration", "", *[f"- **{k}:** {v}" for k, v in about.items()]]
    out += [f"- **High Precipitation Windows:** {percent(high, total)}", f"- **Total Features:** {len(names)}", f"- **Features:** {', '.join(names)}", "", "## Detailed Cluster Analysis", ""]
    spread = []
    for r in counts:
        own = rows.where(F.col("cluster") == r["cluster"])
        out += [f"### Cluster {r['cluster']}", "", f"- **Total Windows:** {r['n']}", f"- **High Precipitation:** {percent(r['high'], r['n'])}", f"- **Low Precipitation:** {percent(r['n'] - r['high'], r['n'])}", ""]
        if 0 < r["high"] < r["n"]:
            gap = report.rows_of(distance.centroid_gap(own))[0]
            out += ["**Distance Metrics:**", f"- Centroid Distance: {report.number(gap['centroid_distance'])}", f"- Mean Distance from High Centroid: {report.number(gap['mean_distance_high'])}", f"- Mean Distance from Low Centroid: {report.number(gap['mean_distance_low'])}", ""]
            ranked = [g | {"feature": names[g["pos"]]} for g in report.rows_of(distance.feature_gaps(own).orderBy("rank"))]
            out += ["**All Features Ranked by Distance:**", "", markdown_table(ranked, ["rank", "feature", "difference", "mean_high", "mean_low"]), ""]
        spread += [f"### Cluster {r['cluster']}", "", f"- **High Precipitation Windows:** {r['high']}", ""]
        if r["high"]:
            found = sorted(report.rows_of(distance.feature_spread(own.where("high"))), key=lambda g: (-g["mean_deviation"], g["pos"]))
            spread += [markdown_table([g | {"rank": i, "feature": names[g["pos"]]} for i, g in enumerate(found, 1)], ["rank", "feature", "mean_deviation", "mean", "std", "min", "max"]), ""]
    return "\n".join([*out, "## High Precipitation Windows Only", "", *spread])


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    lines = [columns, ["---"] * len(columns), *[[report.number(r.get(c)) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


# Sweeps.


def save_sweep(folder: str | Path, results: list[dict], failed: list[dict], about: dict, measures: tuple[str, ...] = ("RMSE", "MAE", "R2")) -> None:
    """Write a sweep's tables and texts. results: rows of `save_run` with window_size, n_clusters and sigma where they have them."""
    folder = Path(folder)
    order = lambda r: tuple(float("inf") if r.get(k) is None else r[k] for k in ("test_rmse", "test_mae"))
    results = sorted(results, key=order)
    columns = list(dict.fromkeys(k for r in results for k in r))
    write_csv(results, folder / "sweep_results.csv", columns)
    if failed:
        write_csv(failed, folder / "failed_runs.csv", list(failed[0]))
    shown = [c for c in ("window_size", "n_clusters", "sigma", "run_name") if c in columns] + [f"test_{m.lower()}" for m in measures]
    (folder / "overleaf_table.txt").write_text(report.latex_table(results, shown, "Test measures by configuration", "tab:sweep") + "\n", encoding="utf-8")
    counts = sorted({r["n_clusters"] for r in results if r.get("n_clusters") is not None})
    (folder / "overleaf_cluster_metric_tables.txt").write_text("\n".join(cluster_count_table(results, k, measures) for k in counts), encoding="utf-8")
    text = ["SWEEP SUMMARY", LINE, "", *[f"{k}: {v}" for k, v in about.items()], f"Successful runs: {len(results)}", f"Failed runs: {len(failed)}", ""]
    if results:
        text += ["Best configuration by test RMSE", *[f"{k}: {report.number(v)}" for k, v in results[0].items()], "", "All", *[f"{r['run_name']}: RMSE={report.number(r.get('test_rmse'))}, MAE={report.number(r.get('test_mae'))}" + (f", AIC={report.number(r['aic'])}" if "aic" in r else "") for r in results]]
    text += [f"failed {f['run_name']}: {f['error']}" for f in failed]
    (folder / "sweep_summary.txt").write_text("\n".join(text) + "\n", encoding="utf-8")


def cluster_count_table(results: list[dict], k: int, measures: tuple[str, ...] = ("RMSE", "MAE", "R2")) -> str:
    """A LaTeX table of the runs of k clusters: overall test measures, then those of each cluster."""
    rows = sorted((r for r in results if r.get("n_clusters") == k), key=lambda r: (r["window_size"], r.get("sigma") is not None, r.get("sigma") or 0))
    cells = {"Window": "window_size", "Sigma": "sigma"} | {f"{m} all": f"test_{m.lower()}" for m in measures} | {f"{m} {c}": f"cluster_{c}_{m.lower()}" for m in measures for c in range(k)}
    body = [{label: "N/A" if label == "Sigma" and r.get(key) is None else r.get(key) for label, key in cells.items()} for r in rows]
    return report.latex_table(body, list(cells), f"Overall and cluster test measures of models with K={k}", f"tab:lstm_cluster_metrics_k{k}") + "\n"


# The LaTeX report of a run's folder.


def pca_mode(config: dict) -> str:
    if config.get("pca_variance_threshold") is None:
        return "disabled"
    return "clustering only" if config.get("pca_for_clustering_only") else "clustering and LSTM"


def bullets(entries: list[tuple[str, object]], otherwise: str = "") -> str:
    if not entries:
        return rf"\textit{{{report.escape(otherwise)}}}" if otherwise else ""
    shown = lambda v: f"{v:.4g}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    return "\n".join([r"\begin{itemize}", *[rf"\item \textbf{{{report.escape(k)}:}} {report.escape(shown(v))}" for k, v in entries], r"\end{itemize}"])


def config_entries(config: dict) -> list[tuple[str, object]]:
    """Labels and values of what a configuration says, scalers and projection in words."""
    found = [(label, config[k]) for k, label in ABOUT.items() if k in config]
    if "pca_variance_threshold" in config or "pca_for_clustering_only" in config:
        threshold = config.get("pca_variance_threshold")
        found += [("PCA Variance Threshold", "not used" if threshold is None else threshold), ("PCA Mode", pca_mode(config))]
    for k, label in SCALERS.items():
        if k in config:
            named = str(config[k] or "").strip()
            found.append((label, "none" if config.get("normalize") is False or named.lower() in ("", "none") else named))
    return found + [(label, config[k]) for k, label in LATER.items() if k in config]


def dataset_entries(config: dict) -> list[tuple[str, object]]:
    found = [(label, config[k]) for k, label in DATASET.items() if config.get(k) is not None]
    for name, part in (config.get("splits") or {}).items():
        found.append((f"{name} split", f"{part.get('samples')} ({part.get('percent')}%)" if isinstance(part, dict) else part))
    return found


def table_section(folder: Path, name: str, columns: list[str], caption: str) -> str:
    rows = read_csv(folder / name)
    shown = [c for c in columns if rows and c in rows[0]] if columns else list(rows[0]) if rows else []
    return report.latex_table(rows, shown, caption, f"tab:{Path(name).stem}") if shown else ""


def transfer_section(folder: Path) -> str:
    """The oracle's tables; nothing without them."""
    rows = read_csv(folder / ROUTING["summary"])
    if not rows:
        return ""
    note = (
        "The main test metrics, predictions, and plots come from the model of each window's own cluster. The tables here are an oracle's: every test window "
        "was forecast by every model and the best was picked with the target known. They bound what better routing could gain and predict nothing."
    )
    body = []
    for r in sorted(rows, key=lambda r: str(r["metric_selection"])):
        gain = lambda m, r=r: f"{report.number(r[f'{m}_improvement'])} ({report.number(r[f'{m}_improvement_percent'], 2)}%)"
        body.append({"Selection": r["metric_selection"], "Changed Samples": f"{r['switched_samples']}/{r['n_test']} ({report.number(float(r['switched_samples_percent']), 1)}%)", "RMSE Change": gain("rmse"), "MAE Change": gain("mae"), "R2 Change": report.number(r["r2_improvement"])})
    parts = [
        r"\section*{Análise de transferência entre clusters}",
        report.escape(note),
        report.latex_table(body, list(body[0]), "Oracle and own cluster", "tab:oracle"),
        table_section(folder, ROUTING["matrix"], [], "Oracle Transfer Matrix (rows: assigned cluster; columns: selected LSTM)"),
        table_section(folder, ROUTING["clusters"], ["assigned_test_cluster", "n_test", "oracle_switched_percent", "same_cluster_mae", "oracle_mae", "mae_improvement", "rmse_improvement"], "Oracle Routing Summary by Assigned Cluster"),
        table_section(folder, ROUTING["pairs"], ["assigned_test_cluster", "oracle_selected_model_cluster", "n_test", "percent_of_assigned_cluster", "mae_improvement", "mean_squared_error_improvement"], "Oracle Routing Summary by Transfer Pair"),
    ]
    return "\n".join(p for p in parts if p)


def horizon_section(folder: Path) -> str:
    file = folder / HORIZON / "forecast_horizon_behavior_report.txt"
    text = file.read_text(encoding="utf-8").strip() if file.exists() else ""
    return "\n".join([r"\section*{Forecast Horizon Behavior}", r"\begin{verbatim}", text, r"\end{verbatim}"]) if text else ""


def figure_sections(folder: Path) -> list[str]:
    out = []
    for title, pattern in FIGURES.items():
        files = sorted(folder.glob(pattern))
        if files:
            out.append(rf"\section*{{{title}}}")
            out += ["\n".join([r"\begin{figure}[H]", r"\centering", rf"\includegraphics[width=\linewidth]{{{f.relative_to(folder).as_posix()}}}", rf"\caption{{{report.escape(report.humanized(f.stem))}}}", r"\end{figure}"]) for f in files]
    return out


def render(folder: str | Path, config: dict | None = None) -> str:
    """The LaTeX report of a run's folder: what it was, its tables, its figures. Whatever isn't there is left out."""
    folder, config = Path(folder), config or {}
    where = f"{config['state']} - {config['station_id']}" if config.get("state") and config.get("station_id") else folder.name.replace("_", " ")
    measures = ["MSE", "RMSE", "MAE", "R2"]
    parts = [
        r"\documentclass[11pt]{article}", *[rf"\usepackage{p}" for p in ("[margin=0.7in]{geometry}", "{float}", "{graphicx}", "[T1]{fontenc}", "[utf8]{inputenc}")], r"\begin{document}",
        rf"\title{{{report.escape('Run report - ' + where)}}}", r"\date{}", r"\maketitle",
        r"\section*{Dataset}", bullets(dataset_entries(config), "Dataset metadata was not provided."),
        r"\section*{Configuration}", bullets(config_entries(config)),
        r"\section*{LSTM Configs}", bullets([(label, config[k]) for k, label in NETWORK.items() if config.get(k) is not None], "LSTM configuration was not provided."),
        r"\section*{Metrics}", table_section(folder, METRICS, ["split", *measures], "General Metrics"), table_section(folder, CLUSTERS, ["cluster", *measures], "Cluster Metrics"),
        horizon_section(folder), transfer_section(folder), *figure_sections(folder), r"\end{document}", "",
    ]
    return "\n".join(p for p in parts if p) + "\n"


def write_report(folder: str | Path, config: dict | None = None, compile_pdf: bool = True) -> tuple[Path, Path | None]:
    """Write the report into the folder, and its PDF if a LaTeX tool is installed."""
    path = Path(folder) / "report.tex"
    path.write_text(render(folder, config), encoding="utf-8")
    return path, report.compile_tex(path) if compile_pdf else None
