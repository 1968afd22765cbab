"""The classifier learns from all labelled rows, whatever their number and lengths."""

import numpy as np
from pyspark.sql import functions as F

from daywheel.llm import toxicity

from .test_operators import CLASH, docs, toxic_corpus


def test_rows_beyond_a_shard_are_learned_from(spark, monkeypatch):
    """In shards as in one task; a text of 270,000 characters takes part."""
    rows, labels = toxic_corpus(1200)
    rows.append((9001, "ka " * 90_000 + "grumok", "en", None))
    labels.append((9001, 1, 1))
    table = docs(spark, rows, CLASH)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen, step = [], toxicity.labelled
    monkeypatch.setattr(toxicity, "labelled", lambda *a: seen.append(step(*a)) or seen[-1])
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 300)
    monkeypatch.setattr(toxicity, "BATCH", 16)
    net, limits = toxicity.train(table, known)
    want = known.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert seen[0].count() == want > 3 * toxicity.SHARD_ROWS
    truth = {i: t for i, _, t in labels}
    got = toxicity.score(table, (net, limits)).select("doc_id", "tox_score", "tox_flag", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    held = [(r.tox_score >= 0.5) == truth[r.doc_id] and r.tox_flag == truth[r.doc_id] for r in got if r.h and r.doc_id in truth]
    assert np.mean(held) > 0.95
    assert set(limits) == {"de", "en"}
    none = toxicity.train(table, known.withColumn("toxic", F.lit(0)))
    assert 0 < none[0].prior < 0.01 and none[1] == {}
