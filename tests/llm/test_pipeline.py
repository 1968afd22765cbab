"""The pipeline against a brute-force version, stage by stage and as a whole."""

import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("daywheel.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from daywheel.llm import mixing, tokenfile, toxicity

from .test_operators import DOCS, linked_components, shingles, words


def corpus():
    rng = random.Random(12)
    calm = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "se", "ti") for c in ("vo", "zu", "na", "pe")]
    text = lambda n: [rng.choice(calm) for _ in range(n)]
    items = [" ".join(text(24)) for _ in range(3)]
    rows, toxic = [], {}
    for i in range(500):
        own = text(rng.randint(8, 60))
        kind = rng.random()
        if kind < 0.2:
            own.insert(rng.randrange(len(own)), rng.choice(["grumok", "blarfed"]))
            toxic[i] = 1
        elif kind < 0.35 and rows:
            own = rows[rng.randrange(len(rows))][1].split()
            if rng.random() < 0.6:
                own[rng.randrange(len(own))] = "edited"
            toxic[i] = int("grumok" in own or "blarfed" in own)
        elif kind < 0.42:
            own = own[:10] + rng.choice(items).split() + own[10:]
            toxic[i] = 0
        else:
            toxic[i] = 0
        rows.append((i, " ".join(own), "en", rng.choice(["a", "b", "c", None])))
    rows += [(600, None, None, "a"), (601, "", "en", "b")]
    return rows, toxic, items


def brute(rows, model, items):
    """The pipeline in plain Python; the classifier's scores are its own."""
    net, limits = model
    scores = net.score([r[1] for r in rows])
    rows = [r for r, s in zip(rows, scores) if s < limits.get(r[2], 0.5)]
    part = linked_components([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if part[r[0]][1] == r[0]]
    sets = [shingles(t) for t in items]
    rows = [r for r in rows if not any(len(s & shingles(r[1])) >= 0.8 * len(s) - 1e-9 for s in sets)]
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight, open_, rest, target = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order), sum(size.values()), {}
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else share
        rest -= sum(3.0 * size[s] for s in over)
        open_ = open_ - over if over else set()
    out, at, plain = [], 0, tokenfile.Encoder(tokenfile.default_vocabulary()).tokenizer
    import hashlib

    for r in sorted(rows, key=lambda r: r[0]):
        rate = min(target[r[3]] / size[r[3]], 3.0) if size[r[3]] else 0.0
        draw = int(hashlib.md5(f"{mixing.DRAW_SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        for _ in range(math.floor(rate) + (draw < rate - math.floor(rate))):
            ids = np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            out.append((r[0], at, len(ids) // 4, zlib.crc32(ids)))
            at += len(ids) // 4
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, toxic, items = corpus()
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    known = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for name, frame in (("documents", table), ("labels", known), ("benchmark", bench)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    want = brute(rows, toxicity.train(table, known), items)
    got = sorted(tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert 100 < len(want) and got == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, toxic, items = corpus()
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows[:60]], DOCS)
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "token_files"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
        assert stage(spark, table.where("false"), str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Clashing columns, a very long text, nulls and repeated rows; a benchmark and labels without rows."""
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, long, "en", "a"), (2, None, None, None), (2, None, None, None), (3, "", "en", "a"), (None, "some words", "en", "b"), (4, long + " end", "en", "a"), (5, "short", "de", "b")]
    table = spark.createDataFrame([(*r, 0, "x", "y", 1) for r in rows], DOCS + ", node string, label string, hash int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = table
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, found, str(tmp_path))
        assert found.columns == table.columns
        ids = sorted((r.doc_id or 0) for r in found.select("doc_id").collect())
        if name in ("near_copies", "decontamination"):
            # The long text and its near copy are one; nulls and empty texts are copies of nothing.
            assert ids == [0, 1, 2, 3, 5] or ids == [0, 1, 2, 2, 3, 5]
    end = pipeline.STAGES[-1][1](spark, found, str(tmp_path))
    assert end.count() == found.count()
