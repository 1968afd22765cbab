"""Registered queries take all rows of their tables."""

import os

import numpy as np
import pytest

from daywheel.operators import cluster, network
from daywheel.plans import base, catalog
from daywheel.sources import adapters

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def train_days(spark):
    return base.split(spark, SF_DIR, False).where("split = 'train'").count()


def test_arma_fits_take_all_train_days(spark):
    days = train_days(spark)
    found = catalog.queries()["m08_arma_fits"](spark, SF_DIR).collect()
    assert days > 400 and {(r.p, r.q, r.n) for r in found} == {(1, 0, days), (2, 1, days)}


def test_eigengaps_by_window_take_all_train_days(spark, monkeypatch):
    seen, table = [], cluster.eigengap_table

    def counted(rows, sigmas, max_gaps):
        seen.append(rows.count())
        return table(rows.limit(20), sigmas, max_gaps)

    monkeypatch.setattr(cluster, "eigengap_table", counted)
    catalog.queries()["c21_eigengap_by_window"](spark, SF_DIR)
    days = train_days(spark)
    assert seen == [days - 2, days - 4]


def test_best_sigma_searches_all_embeddings(spark):
    x = np.array([r.features for r in adapters.features(spark, SF_DIR).orderBy("idx").collect()])
    want = cluster.best_sigma(x, 0.1, 1.0)
    got = catalog.queries()["c20_best_sigma"](spark, SF_DIR).first()
    assert (got.sigma, got.best_k, got.evaluations) == (pytest.approx(want["sigma"], abs=1e-5), want["best_k"], want["evaluations"])
    assert got.evaluations > 40 and got.best_gap == pytest.approx(want["best_gap"], abs=1e-6)


def test_models_train_with_the_operators_defaults(spark, monkeypatch):
    asked = []

    def stop(*args, **options):
        asked.append(options)
        raise StopIteration

    monkeypatch.setattr(network, "train_clusters", stop)
    monkeypatch.setattr(cluster, "kmeans", stop)
    for name in ("m01_cluster_networks", "m02_training_history", "c01_kmeans"):
        with pytest.raises(StopIteration):
            catalog.queries()[name](spark, SF_DIR)
    assert asked == [{}, {}, {}]
