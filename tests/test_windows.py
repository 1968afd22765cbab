"""Splits, windows, targets, scaling: pinned values."""

import datetime

import pytest
from pyspark.sql import functions as F

from daywheel.operators import frame, scaling, windows

DAY = datetime.date(2025, 1, 1)


def daily(spark, n, **columns):
    rows = [("a", DAY + datetime.timedelta(i), i, *[f(i) for f in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "station_id string, Data date, row_idx long, " + ", ".join(f"{c} double" for c in columns))


def thirty(spark, gap=None):
    return daily(spark, 30, tmax=float, tmin=lambda i: i / 2, rain=lambda i: None if i == gap else float(i % 5))


def samples(spark, horizon, gap=None):
    split = frame.split(thirty(spark, gap), 0.5, 0.2)
    return windows.supervised(split, 4, horizon, "rain", ["tmax", "tmin", "rain"])


def test_split(spark):
    rows = frame.split(thirty(spark), 0.5, 0.2)
    got = {r.split: (r.n, r.o, r.a, r.b) for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.first("split_offset").alias("o"), F.min("Data").alias("a"), F.max("Data").alias("b")).collect()}
    day = lambda i: DAY + datetime.timedelta(i - 1)
    assert got == {"train": (15, 0, day(1), day(15)), "val": (6, 15, day(16), day(21)), "test": (9, 21, day(22), day(30))}
    for bad in ((0.0, 0.2), (0.5, 0.5), (0.9, 0.3), (0.5, -0.1)):
        with pytest.raises(ValueError):
            frame.split(thirty(spark), *bad)
    with pytest.raises(ValueError):
        frame.split(daily(spark, 2, rain=float), 0.5, 0.2, check=True)
    # 100 * 0.29 is below 29 in double arithmetic.
    assert frame.train_prefix(daily(spark, 100, rain=float), 0.29).count() == 28
    with pytest.raises(ValueError):
        frame.train_prefix(daily(spark, 10, rain=float), 0.3, 4, check=True)


def test_windows_stay_in_their_split(spark):
    rows = samples(spark, 1).collect()
    index = lambda s: sorted(r.window_index for r in rows if r.split == s)
    assert (index("train"), index("val"), index("test")) == (list(range(11)), [15, 16], list(range(21, 26)))


def test_two_lead_days(spark):
    rows = samples(spark, 2)
    test = rows.where("split = 'test'").orderBy("window_index").collect()
    assert {s: rows.where(f"split = '{s}'").count() for s in frame.SPLITS} == {"train": 10, "val": 1, "test": 4}
    assert [r.y for r in test] == [1, 2, 3, 4] and [r.current for r in test] == [4, 0, 1, 2]
    assert [r.y_by_lead for r in test] == [[0, 1], [1, 2], [2, 3], [3, 4]]
    assert [str(d) for d in test[0].date_by_lead + test[-1].date_by_lead] == ["2025-01-26", "2025-01-27", "2025-01-29", "2025-01-30"]


def test_unknown_targets_are_left_out(spark):
    # Row 4 is unknown: a target of window 0, and its first lead day of window 0.
    got = sorted(r.window_index for r in samples(spark, 2, gap=4).where("split = 'train'").collect())
    assert got == list(range(1, 10))


def test_scalers(spark):
    rows = frame.split(thirty(spark), 0.5, 0.2)
    top = {r.split: r.m for r in scaling.scale_split(rows, ["tmax"], "minmax").groupBy("split").agg(F.max("tmax").alias("m")).collect()}
    assert top["train"] <= 1 < min(top["val"], top["test"])
    data = samples(spark, 2)
    scaled = scaling.scale_targets(data, scaling.fit_targets(data, "minmax"))
    both = scaled.select("window_index", F.col("y_by_lead").alias("z")).join(data, "window_index").collect()
    assert all(z == y / 4 for r in both for z, y in zip(r.z, r.y_by_lead))
    back = scaling.scale_targets(scaled, scaling.fit_targets(data, "minmax"), inverse=True)
    assert sorted(map(tuple, (r.y_by_lead for r in back.collect()))) == sorted(map(tuple, (r.y_by_lead for r in data.collect())))
    constant = scaling.fit(daily(spark, 3, rain=lambda i: 7.0), ["rain"], "standard").first()
    assert constant.rain_scale == 1.0
    assert scaling.scaler_kind(" None ") is None and scaling.scaler_kind("MinMax") == "minmax"
    with pytest.raises(ValueError):
        scaling.scaler_kind("robust")


def test_sliding_windows(spark):
    rows = daily(spark, 20, tmax=lambda i: 20.0 + i, tmin=lambda i: 10.0 + i)
    assert windows.sliding(rows, 4).count() == 17 and windows.sliding(rows, 3).count() == 18
    with pytest.raises(ValueError):
        windows.sliding(rows, 100, check=True)
    with pytest.raises(ValueError):
        windows.sliding(rows.select("station_id", "Data", "row_idx"), 3)
    wide = windows.wide(windows.sliding(rows, 4), ["tmax", "tmin"], 4)
    assert wide.columns[2:] == [f"{c}_day{d}" for c in ("tmax", "tmin") for d in range(4)]
    first = wide.where("window_index = 0").first()
    assert first.tmax_day3 == 23.0 and first.tmin_day0 == 10.0
    gap = daily(spark, 3, x=lambda i: None if i == 1 else float(i))
    assert windows.sliding(gap, 3).first().win == [[0.0], [None], [2.0]]


def test_day_major_features(spark):
    rows = frame.train_prefix(daily(spark, 10, tmax=float, rain=lambda i: 10.0 + i), 0.6)
    scaled = scaling.apply(rows, scaling.fit(rows, ["tmax"], "standard"), ["tmax"])
    got = windows.sliding(scaled, 2, ["tmax", "rain"]).orderBy("window_index").select(windows.flat(F.col("win")).alias("f")).collect()
    assert len(got) == 5 and got[0].f[1] == 10 and got[0].f[3] == 11
    assert got[0].f[0] == pytest.approx(-2.5 / (35 / 12) ** 0.5)


def test_arma_targets(spark):
    rows = daily(spark, 8, rain=float).withColumn("row_idx", F.col("row_idx") + 10).withColumn("split", F.lit("test"))
    got = windows.supervised(rows, 3, 2, "rain", ["rain"], need_current=True).orderBy("window_index").collect()
    assert [r.window_index for r in got] == [10, 11, 12, 13] and [r.origin_index for r in got] == [12, 13, 14, 15]
    assert [r.y_by_lead for r in got] == [[3, 4], [4, 5], [5, 6], [6, 7]]
    assert [str(d) for d in got[0].date_by_lead] == ["2025-01-04", "2025-01-05"]


def test_horizon_targets(spark):
    over = windows.by_row()
    rows = daily(spark, 5, rain=float)
    target = lambda h: [r.t for r in rows.select("row_idx", windows.horizon_target(F.col("rain"), 2, h, over).alias("t")).orderBy("row_idx").collect()][:4]
    assert target(1) == [2, 3, 4, None] and target(2) == [3, 4, None, None]
    known = windows.targets(daily(spark, 5, rain=lambda i: None if i == 2 else float(i)), 2, rain="rain").orderBy("window_index").collect()
    assert [(r.window_index, r.target) for r in known] == [(1, 3), (2, 4)]
    with pytest.raises(ValueError):
        windows.targets(rows, 0, rain="rain")


def test_compressed_axis(spark):
    rows = spark.createDataFrame([("a", i) for i in (2, 3, 30, 32, 100)], "station_id string, window_index long")
    got = windows.compressed_positions(rows, 5).orderBy("window_index").collect()
    assert [r.position for r in got] == [0, 1, 6, 8, 13] and [r.after_gap for r in got] == [False, False, True, False, True]
    with pytest.raises(ValueError):
        windows.compressed_positions(rows.union(rows), 5, check=True)


def test_events(spark):
    rows = daily(spark, 10, rain=float)
    events = spark.createDataFrame([("a", DAY + datetime.timedelta(i)) for i in (2, 5, 40)], "station_id string, event_date date")
    got = {str(r.event_date): r.window_index for r in windows.window_before(events, rows, 3).collect()}
    assert got == {"2025-01-03": None, "2025-01-06": 2, "2025-02-10": None}
    assert {r.window_index for r in windows.window_before_asof(events, rows, 3).collect()} == {None, 2, 7}
