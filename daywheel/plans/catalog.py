"""The registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import metrics
from . import base, queries_evaluate, queries_frame, queries_models  # noqa: F401  they register themselves
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series, split, windows, targets, and the persistence forecast's measures by split."""
    return metrics.by(base.samples(spark, sf_dir), "split", actual="y", predicted="predicted")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
