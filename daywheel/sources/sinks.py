"""Writers of result tables: Parquet first, CSV as an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, folder: str, name: str, csv: bool = True, summary: bool = True) -> None:
    """name.parquet, and name.csv as an export: in one part if the table is a summary, else in as many as it has."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    if csv:
        flat = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
        (df.select(*flat).coalesce(1) if summary else df.select(*flat)).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a run, read back from its CSV export."""
    return spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=True)
