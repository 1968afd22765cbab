"""The star schema read as station series: nations are stations, orders are observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import DATE, RAIN, STATION
from .station import resample_daily

#: Whole company as one station.
ALL = "ALL"
#: Prices have two decimals, and a ten thousandth of them six.
DECIMALS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, by_nation: bool = True) -> DataFrame:
    """(station_id, Data, measures) of each order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    station = F.col("c_nationkey").cast("string") if by_nation else F.lit(ALL)
    rain = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 10000)
    return rows.select(
        station.alias(STATION),
        F.to_date("o_orderdate").alias(DATE),
        F.col("o_totalprice").alias("TEMPERATURA_MAXIMA"),
        F.col("c_acctbal").alias("TEMPERATURA_MIN"),
        rain.alias(RAIN),
        (F.col("o_totalprice") / 10000).alias("RADIACAO"),
    )


def daily(spark: SparkSession, sf_dir: str, by_nation: bool = True) -> DataFrame:
    return resample_daily(observations(spark, sf_dir, by_nation), decimals=DECIMALS)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, features, label) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("features"), "label")
