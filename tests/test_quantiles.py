"""Exact grouped quantiles and distributed ranks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywheel.operators import cluster, quantiles, ranks

QS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]


def found(df):
    return {r.g: r.q for r in df.collect()}


def same(a, b):
    return a is b is None or math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300)


@pytest.mark.parametrize("few", [100_000, 40, 2])
def test_many_groups(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", 64)
    rnd = random.Random(few)
    groups = {
        "hot": [rnd.gauss(0, 1) for _ in range(4000)],
        "steep": [10.0 ** rnd.uniform(-300, 300) * rnd.choice([-1, 1]) for _ in range(300)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0],
        "ties": [rnd.choice([0.0, 0.1, 0.1, 7.0]) for _ in range(500)],
        "next": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)] * 20,
        "one": [3.5],
        None: [float(i) for i in range(101)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(g, None) for g in groups] + [("nothing", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = found(quantiles.grouped(df, "v", QS, ["g"]))
    want = found(df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in QS])).alias("q")))
    assert got.keys() == want.keys() and got["nothing"] == [None] * len(QS)
    for g, q in got.items():
        assert all(map(same, q, want[g] or [None] * len(QS))), (g, q, want[g])


def test_nan_aggregates_and_no_keys(spark):
    df = spark.createDataFrame([(v,) for v in [2.0, math.nan, 1.0, None, 3.0]], "v double")
    [row] = quantiles.grouped(df, "v", [0.0, 1 / 3, 0.5, 1.0], (), [F.count("*").alias("n"), F.sum(F.nanvl("v", F.lit(0.0))).alias("s")]).collect()
    assert (row.n, row.s, row.q[0], row.q[1]) == (5, 6.0, 1.0, 2.0) and row.q[2] == 2.5 and math.isnan(row.q[3])
    [row] = quantiles.grouped(df.limit(0), "v", [0.5]).collect()
    assert row.q == [None]
    assert quantiles.grouped(df.limit(0).withColumn("g", F.lit(1)), "v", [0.5], ["g"]).count() == 0


def test_five_million_values_of_one_group(spark):
    """All distinct; they'd be one aggregation buffer of some 400 MB. Only counts are shuffled until FEW are left."""
    n = 5_000_000
    df = spark.range(0, n, 1, 16).select(((F.col("id") * 2_654_435_761) % n).cast("double").alias("v"))
    df = df.withColumn("v", F.col("v") * F.col("v"))
    [row] = quantiles.grouped(df, "v", [0.25, 0.5]).collect()
    want = np.quantile(np.arange(n, dtype=float) ** 2, [0.25, 0.5])
    assert np.allclose(row.q, want, rtol=1e-12)


def test_ranks_across_partitions(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([0.0, 1.0, 1.0, None, 2.5]), i) for i in range(997)]
    got = ranks.ranked(spark.createDataFrame(rows, "y double, idx long").repartition(7), ["y", "idx"]).collect()
    order = [(r.y, r.idx) for r in sorted(got, key=lambda r: r.rank)]
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(997))
    assert order == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))


@pytest.mark.parametrize("k", [2, 4, 9])
def test_even_parts_of_tied_rain(spark, k):
    """As one ntile over all rows; ties lie on both sides of partitions and of parts."""
    rnd = random.Random(k)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([0.0, 1.0, 1.0, 1.0, 2.0, 7.5, None])) for i in range(600)] + [(1000, "few", 3.0), (1001, "few", 1.0)]
    df = spark.createDataFrame(rows, "idx long, g string, rain double").repartition(6)
    for keys in ((), ("g",)):
        got = {r.idx: r.cluster for r in cluster.rain_known(df, k, keys=keys).collect()}
        wet = {}
        for i, g, y in rows:
            if y:
                wet.setdefault(g if keys else 0, []).append((y, i))
        want = {i: 0 if y == 0 else None for i, _, y in rows}
        for group in wet.values():
            for part, chunk in enumerate(np.array_split(np.arange(len(group)), k - 1), 1):
                want |= {sorted(group)[int(j)][1]: part for j in chunk}
        assert got == want


def test_no_window_over_all_rainy_rows(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "idx long, rain double")
    plan = cluster.rain_known(df, 3)._jdf.queryExecution().toString()
    assert "ntile" not in plan and "SinglePartition" not in plan
