"""Files of runs and sweeps."""

import csv
import datetime

from daywheel.operators import routing
from daywheel.plans import outputs

DAY = datetime.date(2025, 2, 1)


def samples(spark):
    rows = []
    for split, first, n in (("train", 0, 4), ("val", 10, 2), ("test", 20, 6)):
        for i in range(n):
            y = [float(first + i), float(first + i + 1)]
            rows.append((split, first + i, i % 2, y[0] - 1, y[-1], y[-1] + 0.2, y, [v + 0.2 for v in y], [DAY + datetime.timedelta(i), DAY + datetime.timedelta(i + 1)]))
    return spark.createDataFrame(rows, "split string, window_index int, cluster int, current double, y double, predicted double, y_by_lead array<double>, yhat_by_lead array<double>, date_by_lead array<date>")


def read(path):
    with open(path, newline="") as file:
        return list(csv.DictReader(file))


def test_run_files(spark, tmp_path):
    config = {"name": "RS_A801_w03_arma_p01_q00", "state": "RS", "station_id": "A801", "window_size": 3, "forecast_horizon": 2}
    row = outputs.save_run(tmp_path, samples(spark).drop("cluster"), config, 2, model_summary="ARMA summary", facts={"aic": 100.0, "bic": 110.0, "hqic": 105.0})
    assert row["run_name"] == "RS_A801_w03_arma_p01_q00" and row["aic"] == 100.0 and abs(row["test_rmse"] - 0.2) < 1e-9
    assert [r["split"] for r in read(tmp_path / "metrics_summary.csv")] == ["train", "val", "test"]
    assert "predicted_lead_day_2" in read(tmp_path / "test_predictions.csv")[0] and len(read(tmp_path / "test_predictions.csv")) == 6
    lead = read(tmp_path / outputs.HORIZON / "test_prediction_by_lead_day.csv")
    assert lead[0]["target_date"] == "2025-02-01" and len(lead) == 12
    assert [r["lead_day"] for r in read(tmp_path / outputs.HORIZON / "test_prediction_metrics_by_lead_day.csv")] == ["1", "2"]
    assert (tmp_path / "arma_model_summary.txt").read_text() == "ARMA summary" and "AIC: 100.0000" in (tmp_path / "summary.txt").read_text()
    assert not (tmp_path / "cluster_model_metrics.csv").exists()


def test_routing_files_and_report(spark, tmp_path):
    found = samples(spark).where("split = 'test'")
    pairs = spark.createDataFrame([(r.window_index, r.cluster, r.y, m, r.y + (0.5 if m == r.cluster else 0.1 * m)) for r in found.collect() for m in (0, 1)], "idx int, test_cluster int, actual double, model int, prediction double")
    compared = routing.comparison(pairs)
    config = {"window_size": 3, "n_clusters": 2, "name": "w3"}
    row = outputs.save_run(tmp_path, samples(spark), config, 2, routing.selection(compared), compared)
    assert "cluster_1_rmse" in row
    assert len(read(tmp_path / "test_model_comparison.csv")) == 12 and len(read(tmp_path / "test_model_selection.csv")) == 30
    assert "switched" in (tmp_path / "test_model_selection_report.txt").read_text()
    (tmp_path / "cluster_diagnostics").mkdir()
    (tmp_path / "cluster_diagnostics" / "08_silhouette_analysis.png").write_bytes(b"plot")
    tex = outputs.render(tmp_path, config)
    for part in (r"\section*{Análise de transferência entre clusters}", "Oracle Transfer Matrix", "Oracle Routing Summary by Assigned Cluster", "Oracle Routing Summary by Transfer Pair", "main test metrics, predictions, and plots", r"\section*{Cluster Diagnostics}", "cluster_diagnostics/08_silhouette_analysis.png", "General Metrics", "Cluster Metrics", r"\section*{Forecast Horizon Behavior}"):
        assert part in tex
    path, pdf = outputs.write_report(tmp_path, config, compile_pdf=False)
    assert path.read_text() == tex and pdf is None


def test_report_of_a_configuration(tmp_path):
    config = {"state": "RS", "station_id": "A801", "window_size": 8, "normalize": True, "scaler_type": "standard", "precipitation_scaler_type": "minmax", "target_scale": "normalized", "optimizer": "AdamW", "weight_decay": 1e-4, "pca_variance_threshold": 0.9, "pca_for_clustering_only": True}
    tex = outputs.render(tmp_path / "none", config)
    for label, value in (("Covariate Scaler", "standard"), ("Precipitation Scaler", "minmax"), ("LSTM Target Scale", "normalized"), ("Optimizer", "AdamW"), ("Weight decay", "0.0001"), ("PCA Variance Threshold", "0.9"), ("PCA Mode", "clustering only")):
        assert rf"\item \textbf{{{label}:}} {value}" in tex
    off = outputs.bullets(outputs.config_entries(config | {"normalize": False, "pca_variance_threshold": None}))
    assert r"\textbf{Covariate Scaler:} none" in off and "minmax" not in off and r"\textbf{PCA Mode:} disabled" in off and r"Threshold:} not used" in off
    assert r"\textbf{PCA Mode:} clustering and LSTM" in outputs.bullets(outputs.config_entries(config | {"pca_for_clustering_only": False}))


def test_sweep_files(tmp_path):
    rows = [{"run_name": f"w{w}_k{k}", "window_size": w, "n_clusters": k, "sigma": None if k == 2 else 0.5, "test_rmse": w + k / 10, "test_mae": 1.0, "test_r2": 0.5} | {f"cluster_{c}_rmse": float(c) for c in range(k)} for w in (5, 4) for k in (2, 3)]
    outputs.save_sweep(tmp_path, rows, [{"run_name": "bad", "error": "ValueError: x"}], {"Station": "RS/A801"})
    assert [r["run_name"] for r in read(tmp_path / "sweep_results.csv")] == ["w4_k2", "w4_k3", "w5_k2", "w5_k3"]
    assert read(tmp_path / "failed_runs.csv") == [{"run_name": "bad", "error": "ValueError: x"}]
    text = (tmp_path / "sweep_summary.txt").read_text()
    assert "Station: RS/A801" in text and "Failed runs: 1" in text and "w4_k2: RMSE=4.2000" in text
    tables = (tmp_path / "overleaf_cluster_metric_tables.txt").read_text()
    assert tables.count(r"\begin{table}") == 2 and "tab:lstm_cluster_metrics_k3" in tables and "N/A" in tables


def test_distance_report(spark):
    rows = spark.createDataFrame([(i, i % 2, i >= 6 and i % 2 == 0, [float(i), float(i % 3)]) for i in range(10)], "idx int, cluster int, high boolean, features array<double>")
    text = outputs.distance_report(rows, ["rain", "tmax"], {"Station": "RS/A801"})
    assert "- **Station:** RS/A801" in text and "### Cluster 0" in text and "Centroid Distance: 5.0" in text
    assert text.count("Centroid Distance") == 1 and "| 1 | rain | 5.0000 | 7.0000 | 2.0000 |" in text
