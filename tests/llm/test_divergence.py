"""Source divergence against a plain-Python count, on odd rows, and against its SQL."""

import collections
import random
import re

import duckdb
import pytest

pytest.importorskip("daywheel.llm")
from daywheel.llm import catalog, divergence

SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, at int, wide int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs, top):
    docs, counts, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= min_docs]
        share = lambda n: {t: 1 + 10**9 * (c + 5) // (sum(n.values()) + 5 * len(kept)) for t, c in n.items()}  # noqa: E731, B023
        n = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p, q = {s: share(n[s]) for s in sources}, share({t: sum(n[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def sample(seed, sources=7):
    rnd = random.Random(seed)
    words = ["the", "The", "THE", "é", "É", "x1y", "a_b", "don't", "日本", "😀", "K", "ß", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(400):
        text = None if i % 50 == 0 else "" if i % 50 == 1 else rnd.choice([" ", ",", "\x00", "\n"]).join(rnd.choices(words, k=rnd.randint(1, 30)))
        lang = rnd.choice(["en", "en", "en", "de", None, ""])
        rows.append((rnd.choice([i, None, 3]), text, lang, "src0" if rnd.random() < 0.4 else rnd.choice([None, "", "é", *(f"src{k}" for k in range(sources))]), 1, "t", 2, 3))
    rows += rows[:20]
    rows += [(1, "one source only", "fr", "src1", 1, "t", 2, 3), (1, "rare", "es", "src1", 1, "t", 2, 3), (2, None, "es", "src2", 1, "t", 2, 3), (3, "words here", "es", None, 1, "t", 2, 3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rows = sample(seed)
    got = found(divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=6, top=5))
    assert got == brute(rows, 6, 5)
    assert any(r[0] == "es" and r[2] == "pair" and r[4] == 0 for r in got)


def test_more_sources_than_a_part(spark, monkeypatch):
    rows = sample(3, sources=9)
    monkeypatch.setattr(divergence, "WIDTH", 4)
    assert found(divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=4, top=50)) == brute(rows, 4, 50)


def test_counts_are_handed_on_when_full(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 16)
    rows = [(lang, s, text or "") for _, text, lang, s, *_ in sample(4) if lang]
    places = {s: i for i, s in enumerate(sorted({s or "" for _, s, _ in rows}))}
    counts, got, held = divergence.Counts(len(places), len(places)), collections.Counter(), collections.Counter()
    for k, (lang, s, text) in enumerate(rows):
        counts.add(lang, places[s or ""], text)
        for batch in counts.batches() if k % 37 == 0 or k == len(rows) - 1 else ():
            for r in batch.to_pylist():
                held[r["lang"], r["term"]] += r["docs"]
                got.update({(r["lang"], r["term"], i): r[f"c{i}"] for i in range(len(places))})
    want, docs = collections.Counter(), collections.Counter()
    for lang, s, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        want.update((lang, t, places[s or ""]) for t in terms)
        docs.update((lang, t) for t in set(terms))
    assert +got == want and held == docs


def test_large_counts_are_exact(spark):
    n = 3 * 10**13 + 1
    df = spark.createDataFrame([(n, 10**15 + 7, 12345)], "c long, n long, v long")
    from pyspark.sql import functions as F

    assert df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 5) // (10**15 + 7 + 5 * 12345)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = con.sql(catalog.OP13_SQL)
    at = [result.columns.index(c) for c in ("lang", "source", "part", "item", "value", "rank")]
    got = found(catalog.op13_source_divergence(spark, folder))
    assert got and got == sorted(tuple(r[i] for i in at) for r in result.fetchall())
