"""Clustering, distances, models, evaluation and routing: pinned values and NumPy twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywheel.functions import metrics
from daywheel.operators import arma, cluster, distance, evaluate, network, reduce, routing
from daywheel.plans import report, sweep


def points(spark, features, **extra):
    names = "".join(f", {k} {'double' if k == 'rain' else 'int'}" for k in extra)
    return spark.createDataFrame([(i, [float(v) for v in f], *[c[i] for c in extra.values()]) for i, f in enumerate(features)], f"idx long, features array<double>{names}")


def labels(rows, column="cluster"):
    return [r[column] for r in rows.orderBy("idx").collect()]


def test_rain_guided(spark):
    rain = [0.0, 0.0, 1.0, 2.0, 20.0, 30.0]
    rows = points(spark, [(i, i) for i in range(6)], rain=rain)
    assert labels(cluster.cluster(rows, 3, "manual")) == [0, 0, 1, 1, 2, 2]
    got = {r.cluster: (r.low, r.high) for r in cluster.rain_ranges(cluster.rain_known(rows, 3)).collect()}
    assert got == {0: (0, 0), 1: (1, 2), 2: (20, 30)}
    unknown = points(spark, [(0,), (0.1,), (5,), (5.1,), (9,), (9.1,), (0.05,), (9.05,)], rain=[0.0, 0.0, 1.0, 2.0, 20.0, 30.0, None, None])
    assert labels(cluster.cluster(unknown, 3, "manual"))[-2:] == [0, 2]
    for bad, k in (([1.0] * 6, 3), ([0.0] * 6, 3), ([0.0, -1.0, 1.0, 2.0, 3.0, 4.0], 3), (rain, 1)):
        with pytest.raises(ValueError):
            cluster.cluster(points(spark, [(i,) for i in range(6)], rain=bad), k, "manual")
    with pytest.raises(ValueError):
        cluster.cluster(rows, 3, "other")
    with pytest.raises(ValueError):
        cluster.cluster(rows, 3, "spectral")


def test_thresholds(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (5.0,), (5.1,)], "x double")
    assert [r.c for r in rows.select(cluster.threshold_labels(F.col("x"), [0, 5]).alias("c")).collect()] == [0, 1, 1, 2]
    with pytest.raises(ValueError):
        cluster.threshold_labels(F.col("x"), [1.0])


def test_nearest_and_splits(spark):
    rows = points(spark, [(0, 0), (0.2, 0), (10, 0), (10.2, 0), (1, 0), (9, 0)]).withColumn("split", F.when(F.col("idx") < 4, "train").otherwise("test"))
    found = labels(cluster.assign_splits(rows, 2, "kmeans"))
    assert found[:2] == [0, 0] and found[2:4] == [1, 1] and found[4:] == [0, 1]
    tie = spark.createDataFrame([(1, [2.0]), (0, [0.0])], "cluster int, centroid array<double>")
    assert labels(cluster.nearest(points(spark, [(1,)]), tie)) == [0]
    with pytest.raises(ValueError):
        cluster.assign_splits(rows, 5, "kmeans")


def test_sigmas(spark, monkeypatch):
    three = points(spark, [(0,), (1,), (3,)])
    got = [r.sigma for r in distance.sigma_candidates(three, 3, 0.0, 1.0).orderBy("k").collect()]
    assert got == [1, 2, 3]
    assert cluster.merged_sigmas([0.1, 1], [1, 2, 0.1]) == [0.1, 1, 2]
    for bad in (dict(n=0), dict(low=0.5, high=0.1)):
        with pytest.raises(ValueError):
            distance.sigma_candidates(three, **bad)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    far = np.sort(np.sqrt(((x[:, None] - x) ** 2).sum(2))[np.triu_indices(40, 1)])
    monkeypatch.setattr(distance, "BUCKETS", 4)
    monkeypatch.setattr(distance, "FEW", 5)
    monkeypatch.setattr(distance, "BLOCK_ROWS", 16)
    assert distance.order_statistics(points(spark, x), [0, 100, 779]) == pytest.approx([far[0], far[100], far[779]])
    assert distance.order_statistics(points(spark, [(1,)] * 30 + [(2,)]), [0, 400, 464]) == [0.0, 0.0, 1.0]


def test_silhouette(spark):
    rows = points(spark, [(0, 0), (0, 0.2), (5, 5), (5, 5.2)], label=[0, 0, 1, 1])
    got = distance.silhouette_summary(rows).where("scope = 'overall'").first()
    assert got["mean"] == pytest.approx(0.9717157310, abs=1e-9)
    assert distance.silhouette_summary(points(spark, [(0,), (1,)], label=[0, 0])).first().status == "at least two clusters are required"


def test_spectral_and_eigengap(spark):
    x = [(0,), (0.01,), (0.02,), (10,), (10.01,), (10.02,)]
    got = cluster.eigengaps(np.array(x), 0.1, 4)
    assert got["best_k"] == 2 and got["gaps"][1] > got["gaps"][0] and got["gaps"][1] > got["gaps"][2]
    assert "degenerate" in cluster.eigengaps(np.array([[0.0], [10], [20]]), 1e-12)["warning"]
    assert cluster.best_sigma(np.array(x), 0.05, 2.0, points=6, budget=12)["best_k"] == 2
    found = labels(cluster.spectral(points(spark, x), 0.1, 2))
    assert len(set(found[:3])) == len(set(found[3:])) == 1 and found[0] != found[3]
    rng = np.random.default_rng(1)
    y = rng.normal(size=(30, 2))
    idx, vectors, values = cluster.embedding(points(spark, y), 1.0, 3)
    w = np.exp(-((y[:, None] - y) ** 2).sum(2) / 2)
    np.fill_diagonal(w, 0)
    root = 1 / np.sqrt(w.sum(1))
    assert values == pytest.approx(np.linalg.eigvalsh(root[:, None] * w * root)[::-1][:3], abs=1e-9)
    edges = distance.normalized(distance.affinity(points(spark, y), 1.0))
    loose, _ = cluster.subspace(edges, idx, 2, turns=40, tol=1e-6)
    assert loose == pytest.approx(values[:2], abs=1e-3)


def test_eigengaps_beyond_the_dense_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, size=(60, 3)) for c in (0, 2, 4)])
    rows = points(spark, x)
    dense = cluster.embedding(rows, 0.7, 3)
    monkeypatch.setattr(cluster, "DENSE_ROWS", 50)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 64)
    found = {(r.sigma, r.k): r for r in cluster.eigengap_table(rows, [0.3, 0.7], 6).collect()}
    assert len(found) == 12
    for sigma in (0.3, 0.7):
        want = cluster.eigengaps(x, sigma, 6)
        for k, gap in enumerate(want["gaps"], 1):
            assert found[sigma, k].gap == pytest.approx(gap, abs=1e-8) and found[sigma, k].best == (want["best_k"] == k)
    idx, vectors, values = cluster.embedding(rows, 0.7, 3)
    assert values == pytest.approx(dense[2], abs=1e-8) and vectors == pytest.approx(dense[1], abs=1e-4)
    assert cluster.row_eigengaps(rows, [1e-12], 6)[0]["warning"] == cluster.NO_EDGES
    whole, blocks = cluster.best_sigma(x, 0.3, 1.0, points=4, budget=8), cluster.best_row_sigma(rows, 0.3, 1.0, points=4, budget=8)
    assert (whole["sigma"], whole["best_k"]) == (pytest.approx(blocks["sigma"], abs=1e-9), blocks["best_k"])


def test_an_iteration_tells_that_it_did_not_converge(spark):
    y = np.random.default_rng(1).normal(size=(60, 2))
    edges = distance.normalized(distance.affinity(points(spark, y), 0.3))
    with pytest.warns(UserWarning, match="not converged"):
        cluster.subspace(edges, list(range(60)), 2, turns=1)


def test_pca(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [5, 2, 0.5, 0.1]
    model = reduce.fit(points(spark, x), 0.9)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    share = values[::-1] / values.sum()
    k = int(np.argmax(np.cumsum(share) >= 0.9)) + 1
    assert len(model.ratios) == k and model.ratios == pytest.approx(share[:k])
    got = np.array([r.features for r in model.apply(points(spark, x)).orderBy("idx").collect()])
    assert np.abs(got) == pytest.approx(np.abs((x - x.mean(0)) @ vectors[:, ::-1][:, :k]))
    assert (model.components[np.abs(model.components).argmax(0), np.arange(k)] > 0).all()
    with pytest.raises(ValueError):
        reduce.components_for(share, 1.0)


def test_metrics(spark):
    rng = np.random.default_rng(3)
    y, p = rng.gamma(1, 3, 50), rng.gamma(1, 3, 50)
    y[:10] = 0
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)] + [(None, 1.0), (1.0, None)], "actual double, predicted double")
    got = metrics.by(rows).first()
    assert got.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean())) and got.mae == pytest.approx(np.abs(y - p).mean())
    assert got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.mape == pytest.approx(np.abs((y - p) / np.where(y, y, 1))[y != 0].mean() * 100)
    assert got.rmsle == pytest.approx(np.sqrt(((np.log1p(y) - np.log1p(p)) ** 2).mean()))
    assert metrics.by(rows.where("actual < 0")).first().rmse is None
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "actual double, predicted double")
    assert metrics.by(flat).first().r2 == 1.0
    with pytest.raises(ValueError):
        metrics.weight_of(F.col("actual"), [1.0], [1.0])


def test_bins_and_weights(spark):
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "y double")
    for empty in ([], [0, 0]):
        assert [r.edge for r in evaluate.bin_edges(frame(empty)).orderBy("edge_index").collect()] == [0, 1]
    rng = np.random.default_rng(4)
    v = rng.gamma(1, 4, 300)
    edges = [r.edge for r in evaluate.bin_edges(frame(v)).orderBy("edge_index").collect()]
    n = max(8, min(len(np.histogram_bin_edges(v, "fd")) - 1, 35))
    assert edges == pytest.approx(np.linspace(0, v.max(), n + 1))
    counts = {r.bin: r["count"] for r in evaluate.histogram(frame(v), ()).collect()}
    assert [counts.get(i + 1, 0) for i in range(n)] == np.histogram(v, edges)[0].tolist()
    got = evaluate.quantile_weights(frame([0, 0, 1, 5, 20, 50]), [0.5, 0.75]).orderBy("bin").collect()
    assert [r.threshold for r in got] == [3.0, 16.25, None] and got[-1].weight > got[0].weight
    for bad in ([], [1.2], [0.5, 0.5]):
        with pytest.raises(ValueError):
            evaluate.quantile_weights(frame([1]), bad)


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(1, 2, 400)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "idx long, value double")
    got = evaluate.bootstrap_ci(rows, resamples=300).first()
    half = 1.96 * v.std() / 20
    assert got["mean"] == pytest.approx(v.mean())
    assert got.low == pytest.approx(v.mean() - half, abs=0.06) and got.high == pytest.approx(v.mean() + half, abs=0.06)


SELECTED = "test_cluster int, metric string, selected_model_cluster int, selected_is_same_cluster boolean, actual double, selected_absolute_error double, same_cluster_absolute_error double"


def test_routing(spark):
    rows = spark.createDataFrame([(0, "RMSE", 0, True, 1.0, 1.0, 1.0), (0, "RMSE", 1, False, 2.0, 1.0, 5.0), (1, "rmse", 1, True, 3.0, 2.0, 2.0), (1, "MAE", 0, False, 3.0, 0.0, 9.0)], SELECTED)
    got = {r.assigned_test_cluster: r for r in routing.cluster_summary(rows, "rmse").collect()}
    assert (got[0].n_test, got[0].oracle_switched_samples, got[0].oracle_switched_percent, got[0].mae_improvement) == (2, 1, 50.0, 2.0)
    pair = routing.pair_summary(rows, "RMSE").where("assigned_test_cluster = 0 and oracle_selected_model_cluster = 1").first()
    assert (pair.percent_of_assigned_cluster, pair.mae_improvement) == (50.0, 4.0)
    matrix = routing.transfer_matrix(rows, "RMSE").orderBy("assigned_test_cluster")
    assert matrix.columns == ["assigned_test_cluster", "LSTM_0", "LSTM_1"] and [r.LSTM_1 for r in matrix.collect()] == [1, 1]


def test_selection_prefers_the_lowest_model(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0, 2.0), (1, 0, 0.0, 1, 2.0), (2, 1, 4.0, 0, None), (2, 1, 4.0, 1, 9.0)], "idx long, test_cluster int, actual double, model int, prediction double")
    got = {(r.idx, r.metric): r.selected_model_cluster for r in routing.selection(routing.comparison(rows)).collect()}
    assert set(got.values()) == {0, 1} and got[1, "MAPE"] == 0 and got[2, "RMSE"] == 1
    summary = routing.metric_summary(routing.selection(routing.comparison(rows)))
    assert summary.where("metric = 'MAE'").first().mae_improvement == 0


def test_batches(spark):
    data = [(c, s) for s, cs in (("train", [0, 0, 0, 1, 1]), ("val", [0, 1]), ("test", [0, 0, 1])) for c in cs]
    got = evaluate.batch_statistics(spark.createDataFrame(data, "cluster int, split string"), 2).orderBy("cluster").collect()
    assert [r.n_train for r in got] == [3, 2] and [r.batches_per_epoch for r in got] == [2, 1]


def test_arma(spark):
    rng = np.random.default_rng(6)
    e = rng.normal(size=1500)
    y = np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    got = arma.fit(y + 5, 1, 1)
    assert got["ar"][0] == pytest.approx(0.6, abs=0.08) and got["ma"][0] == pytest.approx(0.3, abs=0.08)
    assert got["mean"] == pytest.approx(5, abs=0.4) and got["variance"] == pytest.approx(1, abs=0.1)
    # The exact likelihood of an AR(1), written out.
    z, phi = np.array([0.5, -0.2, 0.9, 0.1]), 0.5
    ll, s2 = arma._log_likelihood(z, np.array([phi]), np.zeros(0))
    sse = (1 - phi**2) * z[0] ** 2 + ((z[1:] - phi * z[:-1]) ** 2).sum()
    assert s2 == pytest.approx(sse / 4) and ll == pytest.approx(-0.5 * (4 * np.log(2 * np.pi * sse / 4) - np.log(1 - phi**2) + 4))
    with pytest.raises(ValueError):
        arma.fit(np.arange(3.0), 2, 1)
    assert arma.parse_orders("1,0;(2,1)") == [(1, 0), (2, 1)]
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y[:60])], "station_id string, row_idx long, rain double")
    out = arma.arma_residuals(rows, 0.1, [0.5, 0.1], [0.4], "rain")
    got = out.orderBy("row_idx").collect()
    want = arma.residuals(y[:60], 0.1, [0.5, 0.1], [0.4])
    assert [r.residual for r in got] == pytest.approx(want)
    ahead = arma.forecasts(out, 0.1, [0.5, 0.1], [0.4], 2, clip=False, rain="rain").orderBy("row_idx").collect()
    f1 = 0.1 + 0.5 * (y[50] - 0.1) + 0.1 * (y[49] - 0.1) + 0.4 * want[50]
    assert ahead[50].yhat_by_lead == pytest.approx([f1, 0.1 + 0.5 * (f1 - 0.1) + 0.1 * (y[50] - 0.1)])


def test_network():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(64, 3))
    y = np.stack([x[:, 0] * 2, np.abs(x[:, 1])], 1)
    net = network.GatedNetwork(3, 2, (6, 5), dropout=0.0)
    out, tape = net.forward(x)
    grads = net.backward(2 * (out - y) / out.size, tape)
    for name in ("i0.w", "g0.b", "o1.w", "g1.w", "d0.w", "d1.b", "out.w"):
        at = (0,) * net.w[name].ndim
        old, step = net.w[name][at], 1e-6
        net.w[name][at] = old + step
        up = ((net.predict(x) - y) ** 2).mean()
        net.w[name][at] = old - step
        down = ((net.predict(x) - y) ** 2).mean()
        net.w[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-6)
    history = net.fit(x, y, x, y, epochs=60, patience=60, rate=0.01)
    assert history[-1]["loss"] < history[0]["loss"] / 2
    assert np.allclose(network.GatedNetwork(3, 2, (6, 5)).load(net.dump()).predict(x), net.predict(x))
    a, b = network.sequences(x, y, 4)
    assert a.shape == (60, 4, 3) and (b[0] == y[4]).all() and network.one_step(x).shape == (64, 1, 3)
    with pytest.raises(ValueError):
        network.check_loss("other")


def test_sweep_and_reports(spark, tmp_path):
    grid = sweep.configurations([5], [2, 3], [0.5])
    assert [c.name for c in grid] == ["w5_k2_s0p5", "w5_k3_s0p5"]
    done, failed = sweep.run_all(grid, lambda c: {"test_rmse": 1 / (c.k - 2)})
    assert [d["run_name"] for d in done] == ["w5_k3_s0p5"] and "ZeroDivisionError" in failed[0]["error"]
    ranked = sweep.rank(spark.createDataFrame([("a", 2.0, 1.0), ("b", None, 1.0), ("c", 1.0, 3.0)], "run string, test_rmse double, test_mae double"))
    assert [r.run for r in ranked.orderBy("rank").collect()] == ["c", "a", "b"]
    assert report.escape("a_b & 50%") == r"a\_b \& 50\%" and report.number(float("nan")) == "-"
    assert r"\begin{tabular}{lr}" in report.latex_table([{"a": 1, "b": 0.5}], ["a", "b"], "x", "t")
    for name in ("clusters/a_plot.png", "top.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).touch()
    deck = report.deck("Run", tmp_path)
    assert "clusters/a_plot.png" in deck and r"\section{Other}" in deck
    assert [p.name for p in report.selected_plots(report.discover(tmp_path), tmp_path, ["*.png", "top"])] == ["a_plot.png", "top.png"]
    with pytest.raises(ValueError):
        report.selected_plots(report.discover(tmp_path), tmp_path, ["none"])


@pytest.mark.parametrize(("ar", "ma"), [([0.4], [0.3]), ([], [0.5, -0.2]), ([0.5, 0.1, -0.2], [0.4, 0.2])])
def test_arma_residuals_over_chunks(spark, ar, ma):
    y = np.random.default_rng(3).gamma(0.5, 4.0, 230)
    y[200] = np.nan
    rows = spark.createDataFrame([(s, i, float(v) * k) for s, k in (("a", 1), ("b", 2), (None, 3)) for i, v in enumerate(y) if s != "b" or i % 5], "station_id string, row_idx long, rain double")
    got = arma.arma_residuals(rows, 1.5, ar, ma, "rain", chunk=16)
    assert got.columns == [*rows.columns, "residual"]
    found = got.orderBy("row_idx").collect()
    for s, k in (("a", 1), ("b", 2), (None, 3)):
        own = y * k if s != "b" else np.array([v * k for i, v in enumerate(y) if i % 5])
        np.testing.assert_allclose([np.nan if r.residual is None else r.residual for r in found if r.station_id == s], arma.residuals(own, 1.5, ar, ma), atol=1e-9)


def test_arma_residuals_of_a_long_series(spark):
    """A million days of one key, in 8 tasks or more."""
    rows = spark.range(1_000_000).select(F.lit("a").alias("station_id"), F.col("id").alias("row_idx"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 50).alias("rain"))
    got = arma.arma_residuals(rows, 9.0, [0.4, 0.1], [0.3, -0.2], "rain", chunk=125_000).orderBy("row_idx").toPandas()
    np.testing.assert_allclose(got["residual"], arma.residuals(got["rain"].to_numpy(), 9.0, [0.4, 0.1], [0.3, -0.2]), atol=1e-9)


def test_grid_sizes(spark):
    rows = spark.createDataFrame([("a", i) for i in range(6)] + [("b", i) for i in range(4)], "station_id string, row_idx long")
    found = sweep.sized(sweep.grid_table(spark, sweep.configurations([3, 5, 9], [2])), rows)
    assert {(r.window, r.stations, r.windows) for r in found.collect()} == {(3, 2, 6), (5, 1, 2), (9, 0, 0)}
