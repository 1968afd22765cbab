"""Tables between the steps of an operator that runs in several jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured bytes stay under this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder; a local one in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.gettempdir() + "/daywheel-shared"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder: what follows needs none of its steps again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(left: DataFrame, right: DataFrame, keys: list[str], small: bool, how: str = "inner") -> DataFrame:
    """left joined to right on keys, null meeting null; right is broadcast if it is small. right's keys go."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(F.broadcast(renamed) if small else renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def counted(df: DataFrame, row_bytes: int | Column) -> int:
    """The bytes of df's rows."""
    size = F.sum(row_bytes) if isinstance(row_bytes, Column) else F.count("*") * row_bytes
    return int(df.agg(size.alias("n")).first()["n"] or 0)
