"""Streams against the same aggregation in batch."""

import os

import pytest
from pyspark.sql import functions as F

from daywheel.streaming import daily

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def batch(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_daily(spark):
    got = {(r.event_type, r.day): (r.n, round(r.total, 6)) for r in daily.run_daily(spark, SF_DIR).collect()}
    rows = batch(spark).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert got == {(r.event_type, r.day): (r.n, round(r.total, 6)) for r in rows.collect()}


def test_sliding(spark):
    got = {(r.event_type, r.day): r.n for r in daily.run_sliding(spark, SF_DIR).collect()}
    rows = batch(spark).select("event_type", F.explode(F.sequence(F.date_sub(F.to_date("ts"), 2), F.to_date("ts"))).alias("day")).groupBy("event_type", "day").count()
    assert got == {(r.event_type, r.day): r["count"] for r in rows.collect()}


def test_sessions_and_online_clusters(spark):
    stream = daily.event_stream(spark, SF_DIR)
    found = daily.drained(daily.sessions(stream, "2 hours"), "append")
    assert 0 < found.agg(F.sum("n")).first()[0] <= batch(spark).count()
    centres = spark.createDataFrame([(0, [0.0]), (1, [100.0])], "cluster int, centroid array<double>")
    rows = stream.select(F.col("event_id").alias("idx"), F.array("value").alias("features"))
    got = daily.drained(daily.assign_online(rows, centres), "append")
    assert {(r.idx, r.cluster) for r in got.collect()} == {(r.event_id, int(abs(r.value - 100) < abs(r.value))) for r in batch(spark).collect()}


def test_batches_go_on_from_their_log(spark, tmp_path):
    """Files that arrive between two runs of one stream; days come again in the second and replace their rows."""
    rows = batch(spark).select("event_type", "ts", "value")
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    halves = [rows.where(F.pmod(F.xxhash64("ts"), F.lit(2)) == i) for i in (0, 1)]
    stream = lambda: daily.daily(spark.readStream.schema(rows.schema).parquet(source), delay="60 days")
    halves[0].coalesce(1).write.parquet(source)
    first = daily.drained(stream(), "update", ("event_type", "day"), path)
    assert first.agg(F.sum("n")).first()[0] == halves[0].count()
    halves[1].coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second time nothing is new
        found = daily.drained(stream(), "update", ("event_type", "day"), path)
        got = {(r.event_type, r.day): (r.n, round(r.total, 6)) for r in found.collect()}
    want = rows.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert got == {(r.event_type, r.day): (r.n, round(r.total, 6)) for r in want.collect()}


def test_a_stream_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    for mode in ("complete", "update"):
        assert daily.drained(daily.daily(rows), mode, ("event_type", "day"), str(tmp_path / mode)).count() == 0
    assert daily.drained(rows, "append", path=str(tmp_path / "append")).count() == 0
