"""End-to-end runs over a station file."""

import datetime

import numpy as np
import pytest

from daywheel.plans import experiments, sweep
from daywheel.sources import station


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    (folder / "RS" / "A801").mkdir(parents=True)
    rng = np.random.default_rng(0)
    lines, rain = ["DATA;TEMPERATURA_MAXIMA;PRECIPITACAO_TOTAL"], 0.0
    for i in range(160):
        rain = max(0.0, 0.6 * rain + rng.normal(0.5, 2))
        lines.append(f"{datetime.date(2024, 1, 1) + datetime.timedelta(i)};{20 + 8 * np.sin(i / 9):.2f};{rain:.2f}".replace(".", ","))
    (folder / "RS" / "A801" / "A801_2024_2024_daily.csv").write_text("\n".join(lines))
    return str(folder)


@pytest.fixture(scope="module")
def daily(spark, root):
    return experiments.frame_of(station.load_station(spark, "RS", "A801", root))


def test_network_run(spark, daily, tmp_path):
    row = experiments.run_network(daily, sweep.Config(4, 2), horizon=2, val=0.2, oracle=True, folder=str(tmp_path), units=(6, 4), epochs=4)
    assert set(row) >= {"train_rmse", "val_mae", "test_rmse"} and row["test_rmse"] > 0
    names = {p.name for p in (tmp_path / "w4_k2").iterdir()}
    assert {"predictions.parquet", "lead_day_metrics.csv", "oracle_transfer_matrix.parquet", "training_history.parquet"} <= names
    assert {"metrics_summary.csv", "test_predictions.csv", "summary.txt", "test_model_selection_report.txt", "report.tex"} <= names
    assert {"predictions.parquet", "cluster_series.parquet"} <= {p.name for p in (tmp_path / "w4_k2" / "oracle_model").iterdir()}
    series = spark.read.parquet(str(tmp_path / "w4_k2" / "test_series.parquet")).collect()
    assert {r.part for r in series} == {1, 2, 3, 4} and series[0].target_date is not None
    assert row["n_clusters"] == 2 and "cluster_0_rmse" in row
    lead = spark.read.parquet(str(tmp_path / "w4_k2" / "lead_day_metrics.parquet"))
    assert lead.where("lead_day = 2").first().rmse == pytest.approx(row["test_rmse"])
    oracle = spark.read.parquet(str(tmp_path / "w4_k2" / "oracle_metric_summary.parquet")).where("metric = 'RMSE'").first()
    assert oracle.rmse_selected <= oracle.rmse_original + 1e-12 and oracle.rmse_original == pytest.approx(row["test_rmse"])


def test_arma_sweep(daily):
    ranked, failed = experiments.run_sweep(daily, sweep.arma_configurations([5], 2, [(1, 0), (120, 1)]), experiments.run_arma)
    assert [r.run_name for r in ranked.collect()] == ["arma_p1_q0_w5_h2"] and failed[0]["run_name"] == "arma_p120_q1_w5_h2"


def test_arma_files(spark, root, tmp_path, capsys):
    out = tmp_path / "sweep"
    assert experiments.main(["arma", "--root", root, "--state", "RS", "--station", "A801", "--windows", "5", "--horizon", "2", "--orders", "1,0", "--out", str(out)], spark) == 0
    assert {"sweep_results.csv", "sweep_summary.txt", "overleaf_table.txt"} <= {p.name for p in out.iterdir()}
    run = out / "arma_p1_q0_w5_h2"
    assert {"metrics_summary.csv", "test_predictions.csv", "summary.txt", "arma_model_summary.txt"} <= {p.name for p in run.iterdir()}


def test_tools(spark, root, daily, capsys):
    assert experiments.run_auto_sigma(daily, 4, n=5).count() == 5
    assert 1 <= experiments.component_count(daily, 4, 0.5) <= experiments.component_count(daily, 4, 0.99) <= 8
    gaps = experiments.run_eigengap(daily, [3], points=4, budget=6, max_gaps=5)
    assert gaps[0]["window"] == 3 and len(gaps[0]["gaps"]) == 5
    assert experiments.main(["cluster", "--root", root, "--state", "RS", "--station", "A801", "--k", "2", "--windows", "4"], spark) == 0
    assert "percent" in capsys.readouterr().out
