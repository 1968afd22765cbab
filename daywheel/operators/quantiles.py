"""Exact quantiles of many groups, by histograms that narrow.

Of each group the wanted places of its order are looked for in ranges of values, first that from its least to its
greatest. A range of more than FEW rows is parted into BUCKETS even buckets; counts, least and greatest values of the
buckets are summed before and after a shuffle, and the bucket that holds the place is the next range. Only the rows of
ranges of at most FEW rows are sorted. So no task holds a group's values, and only counts are shuffled until few are left.

A bucket's number never falls as the value grows, whatever is rounded, so a bucket is exactly the rows between its least
and greatest value; one of two turns parts every range of different values, so the search ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, beside, cut

BUCKETS, FEW = 1024, 100_000


def _place(q: float) -> tuple[Column, Column, Column]:
    """(position, place below, place above) of a quantile among _all values."""
    at = (F.col("_all") - 1) * F.lit(float(q))
    return at, F.floor(at), F.ceil(at)


def _in_range(rows: DataFrame, ranges: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """rows that lie in a range (keys, lo, hi) of their group, with lo and hi. Ranges of a group don't overlap."""
    lists = ranges.select(*keys, "lo", "hi").distinct().groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges"))
    met = beside(rows, lists, keys, small).select(*keys, "_v", F.inline("_ranges"))
    return met.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))


def _share(steep: bool) -> Column:
    """How far _v lies from lo (0) to hi (1): evenly, or evenly in its logarithm, which parts values of many magnitudes."""
    half = lambda c: F.col(c) * 0.5
    # A range may be wider than the largest number.
    even = F.when(F.col("hi") - F.col("lo") < math.inf, (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise((half("_v") - half("lo")) / (half("hi") - half("lo")))
    if not steep:
        return even
    # 745 lifts the logarithm of the least positive number above 0.
    t = {c: F.signum(c) * F.coalesce(F.log(F.when(F.col(c) != 0, F.abs(c))) + 745, F.lit(0.0)) for c in ("_v", "lo", "hi")}
    return F.when(t["hi"] > t["lo"], (t["_v"] - t["lo"]) / (t["hi"] - t["lo"])).otherwise(even)


def _narrowed(rows: DataFrame, wide: DataFrame, keys: list[str], small: bool, steep: bool) -> DataFrame:
    """The places of wide (keys, place, k, lo, hi, n) in the buckets of their ranges."""
    bucket = F.least(F.floor(_share(steep) * BUCKETS), F.lit(BUCKETS - 1))
    counts = _in_range(rows, wide, keys, small).groupBy(*keys, "lo", bucket.alias("b")).agg(F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("z"))
    upto = Window.partitionBy(*keys, "lo").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(*keys, F.col("lo"), "c", "a", "z", F.sum("c").over(upto).alias("upto"))
    met = beside(wide, counts, [*keys, "lo"], False).where("k < upto AND k >= upto - c")
    return met.select(*keys, "place", (F.col("k") - F.col("upto") + F.col("c")).alias("k"), F.col("a").alias("lo"), F.col("z").alias("hi"), F.col("c").alias("n"))


def grouped(rows: DataFrame, value: Column | str, quantiles: Sequence[float], keys: Sequence[str] = (), aggregates: Sequence[Column] = (), persist: bool = True) -> DataFrame:
    """keys, the aggregates, and q: the exact quantiles of value in each group, interpolated between neighbours.

    Null values don't count; NaN stands above all. A group without values has null quantiles. The aggregates, of the same
    rows, are summed in the first pass. Without keys all rows are one group, and there is one row even of no rows.
    """
    names = list(keys) or ["_all_rows"]
    value = F.col(value) if isinstance(value, str) else value
    rows = rows.withColumn("_v", value.cast("double"))
    if not keys:
        rows = rows.withColumn("_all_rows", F.lit(0))
    if persist:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    number = F.when(~F.isnan("_v"), F.col("_v"))
    measures = [*aggregates, F.count("_v").alias("_all"), F.count(number).alias("_n"), F.min(number).alias("_lo"), F.max(number).alias("_hi")]
    head = rows.groupBy(*names).agg(*measures) if keys else rows.agg(*measures).withColumn("_all_rows", F.lit(0))
    head = cut(head)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(*_place(q)[1:]) for q in quantiles])))
    places = head.where("_n > 0").select(*names, F.explode(wanted).alias("place"), "_n", F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).where("place < _n")
    places = places.select(*names, "place", F.col("place").alias("k"), "lo", "hi", F.col("_n").alias("n"))
    values = rows.where("_v IS NOT NULL AND NOT isnan(_v)").select(*names, "_v")
    wide = F.col("n") > FEW
    done = F.col("lo") == F.col("hi")
    groups, largest = head.agg(F.count("*"), F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_n")))).first()
    small = groups * (64 + 32 * len(quantiles)) <= BROADCAST_BYTES
    turn = 0
    while (largest or 0) > FEW:
        found = _narrowed(values, places.where(wide & ~done), names, small, turn % 2 == 1)
        turn += 1
        places = cut(places.where(~wide | done).unionByName(found))
        largest = places.agg(F.max(F.when(~done, F.col("n")))).first()[0]
    rest = _in_range(values, places.where(~done), names, small)
    rest = rest.withColumn("k", (F.row_number().over(Window.partitionBy(*names, "lo").orderBy("_v")) - 1).cast("long"))
    sorted_ = beside(places.where(~done), rest.select(*names, "lo", "k", "_v"), [*names, "lo", "k"], False).select(*names, "place", "_v")
    found = places.where(done).select(*names, "place", F.col("lo").alias("_v")).unionByName(sorted_)
    found = cut(found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("place", "_v"))).alias("_at")))
    if persist:
        rows.unpersist()

    def one(q: float) -> Column:
        at, low, high = _place(q)
        a, b = (F.coalesce(F.col("_at")[p], F.lit(math.nan)) for p in (low, high))
        return F.when(F.col("_all") > 0, F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b))

    result = beside(head, found, names, small, "left").withColumn("_at", F.coalesce("_at", F.create_map().cast("map<bigint,double>")))
    return result.withColumn("q", F.array(*[one(q) for q in quantiles])).drop("_at", "_all", "_n", "_lo", "_hi", *([] if keys else ["_all_rows"]))
