"""The driver contract, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["a06_horizon_diagnostics", "a08_bin_edges", "a15_nonzero_stats", "a16_box_summary", "c03_rain_guided_known", "c07_normalized_affinity", "c25_pooled_feature_gaps", "m05_quantile_weights", "s07_daily_resample", "p02_split", "w08_supervised", "a03_metrics_by_sets", "a11_error_by_magnitude", "c03b_rain_guided_counts", "c22_silhouette", "m10_multi_step_forecasts", "r04_metric_summary", "r06_routing_summary", "st02_streaming_sliding", "m09b_arma_residuals", "m13_config_grid"]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_query_has_a_name_and_sql_matches_some():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    found = entry.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    result = con.sql(entry.oracle_sql()[name])
    at = [result.columns.index(c) for c in columns]
    want = sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
    got = sorted(str([plain(v) for v in r]) for r in found.select(*columns).collect())
    assert got == want
