"""Queries on tables that differ from the given ones: more orders a day, more rows, ties of rounding."""

import datetime
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from daywheel.operators import cluster, distance
from daywheel.plans import catalog, registry


def star(spark, folder, orders):
    """Tables of one customer whose orders are (day, price, priority)."""
    first = datetime.datetime(1996, 1, 1)
    rows = [(i, 1, "O", float(price), first + datetime.timedelta(days=day), priority) for i, (day, price, priority) in enumerate(orders)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "c", 7, 100.0, "m")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")


def test_train_assign_without_a_rain_level(spark, tmp_path):
    """Every window is wet: only one rain level has train rows (an error before)."""
    star(spark, tmp_path, [(day, 90_000 + 1000 * (day % 7), "1-URGENT") for day in range(100)])
    got = catalog.queries()["c10_train_assign"](spark, str(tmp_path)).collect()
    assert {(r.split, r.cluster, r.n) for r in got} == {("train", 3, 51), ("val", 3, 11), ("test", 3, 11)}


def test_daily_means_are_exact(spark, tmp_path):
    """A mean of 32 prices that lies half between two values of six decimals, wherever the rows stand."""
    prices = [201_226.35, 198_063.33, 204_094.67, 0.1, 0.7, 399_000.01] * 5 + [0.02, 0.03]
    cents = sum(round(100 * x) for x in prices)
    prices[-1] += (64 + 1 - cents % 64) % 64 / 100
    cents = sum(round(100 * x) for x in prices)
    assert cents % 2 == 1
    star(spark, tmp_path, [(day, x, "5-LOW") for day in range(40) for x in np.random.default_rng(day).permutation(prices)])
    got = catalog.queries()["c11_feature_matrix"](spark, str(tmp_path)).collect()
    right = float((Decimal(cents) / 3200).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    assert len(got) == 38 and {x for r in got for x in r.features[::2]} == {right}


def test_pairs_send_each_row_a_number_of_times_that_does_not_grow(spark):
    x = np.random.default_rng(0).normal(size=(8000, 3))

    def rows(n):
        return spark.createDataFrame([(i, v) for i, v in enumerate(x[:n].tolist())], "idx long, features array<double>")

    assert distance._met(rows(8000)).count() == 2 * distance._met(rows(4000)).count()
    far = np.sort(np.sqrt(((x[:900, None] - x[None, :900]) ** 2).sum(2))[np.triu_indices(900, 1)])
    assert distance.order_statistics(rows(900), [0, 70_000, len(far) - 1]) == [far[0], far[70_000], far[-1]]


def test_best_sigma_of_many_rows_leaves_sigmas_that_cannot_win(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(90, 4))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "idx long, features array<double>")
    want = cluster.best_sigma(x, 0.05, 2.0, points=8, budget=14, max_gaps=5)
    monkeypatch.setattr(cluster, "DENSE_ROWS", 10)
    got = cluster.best_row_sigma(rows, 0.05, 2.0, points=8, budget=14, max_gaps=5)
    assert got["evaluations"] == want["evaluations"] and got["best_k"] == want["best_k"]
    assert abs(got["sigma"] - want["sigma"]) < 1e-5 and abs(got["best_gap"] - want["best_gap"]) < 1e-6
    raced = cluster.row_eigengaps(rows, [0.05, 0.5, 1.0], 5, race=True)
    full = cluster.row_eigengaps(rows, [0.05, 0.5, 1.0], 5)
    best = max(full, key=lambda r: r["best_gap"] or 0.0)
    assert abs(next(r for r in raced if r["sigma"] == best["sigma"])["best_gap"] - best["best_gap"]) < 1e-6


def test_spectral_clusters_of_many_rows_stay_off_the_driver(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(5).normal(c, 0.3, size=(50, 3)) for c in (0, 2, 4)])
    rows = spark.createDataFrame([(7 * i, v) for i, v in enumerate(x.tolist())], "idx long, features array<double>")
    want = [r.cluster for r in cluster.spectral(rows, 0.7, 3).orderBy("idx").collect()]
    monkeypatch.setattr(cluster, "DENSE_ROWS", 50)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 64)
    monkeypatch.setattr(cluster, "embedding", None)  # gives vectors of all rows to the driver
    got = [r.cluster for r in cluster.spectral(rows, 0.7, 3).orderBy("idx").collect()]
    assert len({(a, b) for a, b in zip(want, got, strict=True)}) == 3


def test_products_are_in_single_precision_until_the_last(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(150, 4))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "idx long, features array<double>")
    want = cluster.eigengaps(x, 0.8, 5)["eigenvalues"]
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 64)
    kinds, times = [], cluster._Pairs.times
    monkeypatch.setattr(cluster._Pairs, "times", lambda self, sides, sigmas, kind: kinds.append(kind) or times(self, sides, sigmas, kind))
    [(values, _, short)] = cluster.block_spectra(rows, [0.8], 6)
    assert not short and np.abs(values - want).max() < 1e-10
    assert kinds[0] is np.float64 and kinds[1:].count(np.float32) > kinds[1:].count(np.float64) > 0 and kinds[-1] is np.float64


def test_a_sigma_is_one_task_while_rows_are_few(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(90, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, features array<double>")
    whole = cluster.row_eigengaps(rows, [0.4, 0.9], 5)
    want = cluster.best_sigma(x, 0.2, 1.5, points=6, budget=20, max_gaps=5)
    dense = cluster.spectral(rows, 0.9, 2).orderBy("idx").collect()
    monkeypatch.setattr(cluster, "DENSE_ROWS", 50)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 32)
    spread = cluster.block_spectra
    monkeypatch.setattr(cluster, "block_spectra", None)  # shuffles rows and vectors for each product
    for kept in (1 << 28, 1 << 13, 0):
        monkeypatch.setattr(cluster, "KEPT_BYTES", kept)
        for a, b in zip(whole, cluster.row_eigengaps(rows, [0.4, 0.9], 5), strict=True):
            assert np.allclose(a["gaps"], b["gaps"], atol=1e-8) and a["best_k"] == b["best_k"] and not b["warning"]
    asked = []
    evaluate = cluster.row_eigengaps
    monkeypatch.setattr(cluster, "row_eigengaps", lambda rows, sigmas, *other: asked.append(len(sigmas)) or evaluate(rows, sigmas, *other))
    got = cluster.best_row_sigma(rows, 0.2, 1.5, points=6, budget=20, max_gaps=5)
    assert got["sigma"] == want["sigma"] and got["evaluations"] == want["evaluations"] and abs(got["best_gap"] - want["best_gap"]) < 1e-8
    assert len(asked) < 1 + (20 - 6) / 1.5  # some steps of the search are evaluated at once
    local = cluster.spectral(rows, 0.9, 2).orderBy("idx").collect()
    assert [r.cluster for r in local] == [r.cluster for r in dense]
    monkeypatch.setattr(cluster, "block_spectra", spread)
    monkeypatch.setattr(cluster, "LOCAL_ROWS", 50)
    for a, b in zip(whole, evaluate(rows, [0.4, 0.9], 5), strict=True):
        assert np.allclose(a["gaps"], b["gaps"], atol=1e-8)


def test_rounding_equals_sparks_to_the_bit(spark):
    rng = np.random.default_rng(11)
    near = np.round(rng.normal(size=2000) * 1e3, 6) + 5e-7
    some = np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-9, 14, 2000), near, np.nextafter(near, np.inf), np.nextafter(near, -np.inf), [0.0, -0.0, 1e300, -1e-300, np.nan, np.inf, -np.inf]])
    rows = spark.createDataFrame([(float(v),) for v in some] + [(None,)], "x double").repartition(2)
    for digits in (2, 6, 9):
        own = registry.rounded(F.col("x"), digits)
        off = rows.select((own + 0.0).alias("a"), (F.round("x", digits) + 0.0).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
        assert off.count() == 0
    assert "rint" in str(registry._column("x", "d6")).lower()  # decimal text, some 0.7 microseconds a number, for few only


def test_pairs_are_numbered_without_a_look_up_for_each(spark):
    x = np.random.default_rng(2).normal(size=(1300, 3))
    rows = spark.createDataFrame([(int(i), v.tolist(), int(i) % 3) for i, v in zip(np.random.default_rng(4).permutation(1300) * 5, x, strict=True)], "idx long, features array<double>, label int")
    at = {r.idx: (np.array(r.features), r.label) for r in rows.collect()}
    found = distance.pairs(rows, ("label",)).toPandas()
    assert len(found) == 1300 * 1299 // 2 == len(found[["i", "j"]].drop_duplicates()) and (found.i < found.j).all()
    for r in found.sample(500, random_state=1).itertuples():
        assert (r.label_i, r.label_j) == (at[r.i][1], at[r.j][1]) and abs(r.distance - np.linalg.norm(at[r.i][0] - at[r.j][0])) < 1e-12
