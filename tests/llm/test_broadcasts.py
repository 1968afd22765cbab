"""Broadcast decisions by measured bytes, and the same results where nothing is broadcast."""

import collections
import random

import pytest

pytest.importorskip("daywheel.llm")
from pyspark.sql import functions as F

from daywheel.llm import common, decontaminate, mixing, urls


def test_row_bytes_follow_the_values(spark):
    rows = [("a" * 100, ["b" * 50, None, "c"], (1, "d" * 30), [1, 2, 3]), ("", [], (None, None), []), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, many array<string>, s struct<n:int,t:string>, k array<bigint>")
    full, empty, null = [r[0] for r in df.select(common.row_bytes(df)).collect()]
    assert full - empty == 100 + (3 * 16 + 51) + 30 + 24 and null >= 16
    multibyte = spark.createDataFrame([("é" * 10,), ("e" * 10,)], "t string")
    two, one = [r[0] for r in multibyte.select(common.row_bytes(multibyte)).collect()]
    assert two - one == 10


def test_long_items_are_not_broadcast(spark):
    """Few rows of some 60 kB each: by their number alone they would look small."""
    words = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.lit("w"), F.hex(F.xxhash64("id", i)).substr(1, 6)))
    items = spark.range(800, numPartitions=4).select(F.col("id").alias("item_id"), F.array_join(words, " ").alias("text"))
    index = decontaminate.item_index(items).select("__dc_key", "item_id", "shingles", "n", "need")
    assert index.count() * 4096 < common.BROADCAST_BYTES
    side, small = common.small_side(index)
    assert not small and "rightHint" not in side._jdf.queryExecution().logical().toString() and "ResolvedHint" not in side._jdf.queryExecution().analyzed().toString()
    assert common.small_side(index.where("item_id < 100"))[1]


def test_leaks_and_verdicts_without_any_broadcast(spark, monkeypatch):
    rng = random.Random(9)
    passages = [" ".join(f"q{k}_{i}" for i in range(20 + k)) for k in range(6)]
    rows = [(i, " ".join([f"p{rng.randrange(300)}" for _ in range(60)] + [passages[i % 9] if i % 9 < 6 else ""])) for i in range(60)] + [(None, passages[0]), (60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(passages)] + [(None, passages[1])], "item_id long, text string")
    pages = spark.createDataFrame([(i, f"http://h{i}.net/p", f'<link rel="canonical" href="http://{"example.org/en/1" if i % 3 == 0 else f"h{i + 1}.net/p"}">') for i in range(40)] + [(40, None, None)], "page_id long, url string, html string")
    sources = spark.createDataFrame([(i, "w " * (i + 1), None if i == 7 else f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")

    def results():
        pairs = collections.Counter((r.doc_id, r.item_id, r.matched) for r in decontaminate.leaks(docs, items).collect())
        verdicts = sorted((r.page_id, r.verdict) for r in urls.judge(pages).collect())
        return pairs, verdicts, collections.Counter(r.doc_id for r in mixing.mix(sources).collect())

    want = results()
    assert len(want[0]) > 40 and {v for _, v in want[1]} == {"allow", "block"}
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert results() == want
