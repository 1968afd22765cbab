"""Mixing sources to target weights, with DataFrame functions only.

Per source the words are summed; weights turn into word targets by water filling (a target stops at
`max_repeat` times its source's words, the excess goes to the others by weight); the repetition rate of a source is
target / words, and each document is emitted floor(rate) times plus one more time with probability frac(rate), drawn
from a hash of its id, so that reruns and retried tasks agree.

Defined results: a null text has size 0 and adds nothing; a null source is a source of its own, last in order; rows that
repeat a doc_id share one draw; sources of no words have target 0 and rate 0; an empty table gives an empty result;
further columns pass through `mix` unchanged (internal columns start with `__mix_`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, salted_join, row_bytes, small_side, word_count

#: The draw uses 52 bits of an MD5 of seed and id: the same on every engine.
DRAW_SEED = "mix-1"


def source_targets(docs: DataFrame, source: str = "source", size: Column | None = None, cycle: int = 3, max_repeat: float = 3.0) -> DataFrame:
    """One row per source: __mix_key, source_size, weight, target (words), rate. Weights are 1..cycle by code point order, null last."""
    size = word_count(F.col("text")) if size is None else size
    per = docs.groupBy(F.col(source).alias("__mix_key")).agg(F.sum(size).alias("source_size"))
    # One row per source from here on; windows without partitions run over sources, never over documents.
    order = Window.orderBy(F.col("__mix_key").asc_nulls_last())
    per = per.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("double"))
    per = per.withColumn("__cap", F.col("source_size") * F.lit(float(max_repeat)))
    # Water filling in closed form: sources with the smallest cap / weight stop first; level = rest / weights left.
    by_ratio = Window.orderBy((F.col("__cap") / F.col("weight")).asc(), F.col("__mix_key").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("__left", F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / F.col("__weights"))
        .withColumn("__open", F.col("__cap") >= F.col("weight") * F.col("__level"))
    )
    level = F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("weight"), F.col("__level")))).over(everything)["__level"]
    per = per.withColumn("__final", level)
    target = F.least(F.col("__cap"), F.coalesce(F.col("weight") * F.col("__final"), F.col("__cap")))
    per = per.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    return per.select("__mix_key", "source_size", "weight", "target", rate.alias("rate"))


def draw(doc_id: Column, seed: str = DRAW_SEED) -> Column:
    """A number in [0, 1) that depends on seed and id only."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: str = DRAW_SEED, cycle: int = 3, max_repeat: float = 3.0) -> DataFrame:
    """docs with __mix_size, __mix_source_size, __mix_target, __mix_rate and __mix_copies: how often the mix takes each row."""
    rates = source_targets(docs, source, word_count(F.col(text)), cycle, max_repeat)
    rates = cut(rates.select("__mix_key", *[F.col(c).alias(f"__mix_{c}") for c in ("source_size", "target", "rate")]))
    side, small = small_side(rates, row_bytes(rates))
    rows = docs.withColumn("__mix_size", word_count(F.col(text)))
    if small:
        rows = rows.join(side, rows[source].eqNullSafe(side["__mix_key"]), "left").drop("__mix_key")
    else:
        rows = salted_join(rows, rates.withColumnRenamed("__mix_key", source), source)
    whole = F.floor("__mix_rate")
    extra = (draw(F.col(doc_id), seed) < F.col("__mix_rate") - whole).cast("int")
    return rows.withColumn("__mix_copies", (whole + extra).cast("int"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, with the columns of docs."""
    rows = with_copies(docs, **options).where("__mix_copies > 0")
    return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
