"""Places in an order over all partitions, without a window over all rows.

Rows are range-partitioned by the order, so that partition by partition they are in order; each partition's rows are
counted, and the counts of the partitions before are added to the numbers within. Rows that tie may lie in different
partitions: their order is as arbitrary there as within one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, beside, counted, cut


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 0."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # The upper bits are the partition. Once written, rows can't come out in other ranges.
    placed = cut(placed).withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # One row for each partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def part_starts(rows: DataFrame, parts: int, order: list[str], keys: list[str]) -> tuple[DataFrame, bool]:
    """(keys, starts; whether they are few): the first row of the second and each later of `parts` even parts of each group, as structs of `order`.

    The first parts are longer by one where they can't be equal. Groups of fewer rows than parts have fewer starts.
    """
    # Ranges are cut by a sample first: without this, the rows' steps would be done twice.
    rows = rows.select(*keys, *order).persist()
    placed = ranked(rows, [*keys, *order])
    rows.unpersist()
    groups = cut(placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("rank").alias("_first")))
    small = counted(groups, 64) <= BROADCAST_BYTES
    each, more = F.floor(F.col("_n") / parts), F.col("_n") % parts
    wanted = F.transform(F.sequence(F.lit(1), F.lit(max(parts - 1, 1))), lambda j: j * each + F.least(j, more))
    here = beside(placed, groups.withColumn("_wanted", wanted), keys, small).where(F.array_contains("_wanted", F.col("rank") - F.col("_first")))
    starts = here.where("rank > _first").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("starts"))
    return cut(starts), small
