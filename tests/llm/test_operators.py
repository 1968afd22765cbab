"""The operators against brute force, and their defined results on odd input."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("daywheel.llm")
from pyspark.sql import functions as F

from daywheel.llm import anntree, catalog, components, decontaminate, jaccard, language, mixing, pii, quality, textnum, tokenfile, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names the operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, target string, rate string, node string, token string, hash string, tox_score string, label string, size string"


def docs(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *([None] * (width - len(r)))) for r in rows], schema)


def words(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (text or "").translate(fold).encode().split()


def shingles(text, k=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def linked_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def random_corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 90))] for _ in range(8)]
    out = []
    for i in range(n):
        text = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("heavy,stars,block", [(64, 3, 512), (1, 1, 4), (1, 0, 4)])
def test_jaccard_matches_brute_force(spark, monkeypatch, heavy, stars, block):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEVELS", ((2, max(stars, 1)), (1, 1)))
    rows = random_corpus(heavy * 10 + stars)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, rows)).collect()}
    assert got == linked_components(rows)


def test_jaccard_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (5, text), (2, text.upper()), (None, text), (7, None), (8, ""), (9, " \n "), (10, "short text"), (11, "short  text"), (12, "short text too")]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, rows, CLASH)).collect())
    assert got == collections.Counter({(5, 6, 2): 2, (2, 6, 2): 1, (None, 6, 2): 1, (7, 0, 7): 1, (8, 0, 8): 1, (9, 0, 9): 1, (10, 1, 10): 1, (11, 1, 10): 1, (12, 1, 12): 1})
    kept = jaccard.deduplicate(docs(spark, rows, CLASH))
    assert kept.columns == docs(spark, [], CLASH).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 7, 8, 9, 10, 12]
    assert jaccard.join(docs(spark, [])).count() == 0


def test_a_repeated_id_loses_only_the_row_that_is_a_copy(spark):
    copied, clean = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    got = jaccard.deduplicate(docs(spark, [(1, copied), (5, copied), (5, clean)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, copied), (5, clean)]


def test_jaccard_long_text(spark):
    rng = random.Random(3)
    long = " ".join(f"t{rng.randrange(10**6)}" for _ in range(300_000))
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(spark, [(1, long), (2, long + " tail"), (3, "x " * 700_000)])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert components.components(edges.where("false")).count() == 0


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["a", "b", "é", None])) for i in range(3000)] + [(9000, None, "en", "empty"), (9001, "x y", None, "b")]
    table = docs(spark, rows, CLASH)
    got = mixing.with_copies(table).select("doc_id", "source", "__mix_size", "__mix_source_size", "__mix_target", "__mix_copies").collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    taken = collections.Counter()
    for r in got:
        size[r.source] += r.__mix_size if hasattr(r, "__mix_size") else r["__mix_size"]
        taken[r["source"]] += r["__mix_size"] * r["__mix_copies"]
        assert r["__mix_copies"] <= 3
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(size.values())
    while open_:  # reshare until none is above its limit
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        open_ -= over
    for r in got:
        assert math.isclose(r["__mix_target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.15 * max(target[s], 1)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    assert mixed.count() == sum(r["__mix_copies"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    item = " ".join(f"q{i}" for i in range(30))
    prose = lambda n: " ".join(f"p{rng.randrange(500)}" for _ in range(n))
    most = item.replace("q0 ", "zz ").replace(" q29", "")
    rows = [(1, prose(800) + " " + item + " " + prose(50)), (2, prose(100)), (3, prose(20) + " " + most.upper()), (4, " ".join(item.split()[:20])), (5, None), (6, ""), (7, "alpha beta"), (7, "alpha beta gamma"), (None, item)]
    items = spark.createDataFrame([(10, item), (11, "Alpha beta"), (12, None), (13, " "), (14, "a b c d e f")], "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id) for r in decontaminate.leaks(docs(spark, rows, CLASH), items).collect())
    want = []
    for i, t in rows:
        for r in items.collect():
            s, d = shingles(r.text), shingles(t)
            if s and len(s & d) >= 0.8 * len(s) - 1e-9:
                want.append((i or 0, r.item_id))
    assert got == sorted(want) and (1, 10) in got and (3, 10) in got
    kept = decontaminate.decontaminate(docs(spark, rows, CLASH), items)
    assert kept.columns == docs(spark, [], CLASH).columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for i, t in rows if (i or 0, t) not in {(1, rows[0][1]), (3, rows[2][1]), (0, item), (7, "alpha beta")})
    assert decontaminate.leaks(docs(spark, rows), items.where("false")).count() == 0
    assert decontaminate.leaks(docs(spark, []), items).count() == 0


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(12))
    long = " ".join(f"p{i % 997}" for i in range(400_000))
    rows = [(1, f"{long} {item}"), (2, item), (2, item), (None, item), (3, long)]
    items = spark.createDataFrame([(None, item, "x"), (5, item, "y"), (6, long, "z")], "item_id long, text string, doc_id string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows, CLASH), items).collect())
    want = collections.Counter({(i, j): 1 for i in (1, None) for j in (None, 5)} | {(2, j): 2 for j in (None, 5)} | {(1, 6): 1, (3, 6): 1})
    assert got == want
    assert decontaminate.decontaminate(docs(spark, [*rows, (4, "clean")]), items.where("item_id is null")).count() == 2


def test_mixing_of_many_sources(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 7)), "en", None if i % 50 == 0 else f"s{i % 40}") for i in range(2000)] + [(5, "a b", "en", "s5"), (9000, "word " * 500_000, "en", "s1")]
    table = docs(spark, rows, CLASH).withColumn("key", F.lit("x")).withColumn("__salt", F.lit(1))
    plan = lambda: sorted((r.doc_id, r["__mix_size"], r["__mix_copies"], r["key"]) for r in mixing.with_copies(table).collect())
    plain = plan()
    monkeypatch.setattr(mixing, "small_side", lambda df, n: (df, False))
    assert plan() == plain and len(plain) == 2002
    assert mixing.mix(table).columns == table.columns


def test_pii(spark):
    text = "mail a@b.c+d@e.f now é 10.0.0.256 1.2.3.4.5.6.7.8 card 4111-1111 1111 1111 tel +1 (555) 123-4567 ssn 123-45-6789 or 123-45-6780 DE89 3704 0044 0532 0130 00 x@y@z.com. 001.02.3.0255"
    found = pii.spans(docs(spark, [(1, text), (2, None), (3, ""), (4, "9" * 200_000 + "@" * 1000 + "a" * 200_000 + " +1" + "(" * 50_000), (1, text)], CLASH))
    rows = found.select("doc_id", pii.joined(F.col("pii")).alias("s"), "pii").collect()
    assert len(rows) == 5 and [r.s for r in rows if r.doc_id != 1] == ["", "", ""]
    hits = collections.defaultdict(list)
    for x in rows[0].pii:
        hits[x.kind].append(text[x.start : x.end])
    assert hits["email"] == ["a@b.c", "+d@e.f", "y@z.com"]
    assert hits["ip"] == ["1.2.3.4", "5.6.7.8"] + ["001.02.3.0255"]
    assert hits["card"] == ["4111-1111 1111 1111"]
    assert hits["phone"] == ["+1 (555) 123-4567"]
    assert hits["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert hits["ssn"][0] == "123-45-6789"


def test_url_rules_and_aliases(spark):
    link = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head></html>'
    refresh = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    rows = [
        (1, "https://A.Example.org/es/x?q#f", None),
        (2, "http://mirror.net/a", link("https://a.example.org/es/x?q")),
        (3, "http://mirror.net/b", refresh("/a")),
        (4, "http://shop.com/fr/1", link("http://mirror.net/a")),
        (5, "http://free.net/", ""),
        (6, None, None),
        (7, "no scheme", link("http://shop.com/de/1")),
        (8, "http://example.org", None),
        (9, "http://shop.com/de/1", None),
        (10, "http://alias.net/1", link("http://shop.com/de/1")),
        (10, "http://alias.net/1", link("http://shop.com/de/1")),
        (11, "http://notexample.org/en/1", None),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("shop.com", "/fr/1", "com/fr/", "allow")
    # Its class holds an explicitly allowed page, which takes precedence over the blocked one.
    assert got[2] == ("mirror.net", "/a", None, "allow") and got[3][3] == "allow"
    assert got[10] == ("alias.net", "/1", None, "block")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("example.org", "", None, "allow")
    assert got[11] == ("notexample.org", "/en/1", "org/", "allow")
    assert urls.judge(pages).count() == len(rows) and urls.judge(pages.where("false")).count() == 0
    many = urls.RULES + tuple(("block", f"h{i}.test", "/") for i in range(100))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, many).collect()} == got


def in_duckdb(sql, **tables):
    """Rows of an SQL twin over tables given as (columns, rows)."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (schema.count(',') + 1))})", rows)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()), key=repr)


def in_spark(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_pii_equals_its_sql(spark, tmp_path):
    texts = [
        "my tax id: 123-45-6789", "123-45-6789 is my ssn", "ssn _123-45-6789_ and x123-45-6789-1", "ssn 0123-45-6789", "no word 123-45-6789",
        "DE89370400440532013000", "_DE89370400440532013000_", "xDE89370400440532013000", "é DE89 3704 0044 0532 0130 00é GB29 NWBK 6016 1331 9268 19, DE89 3704 0044 0532 0130 01",
        "call +1 555 123 4567 ext", "é" * 60 + " visa 4111 1111 1111 1111" + "é" * 60 + "pay 5500005555555559 card", "a@b.co c@d.co mail e@f.co" * 30, "1.2.3.4 server 5.6.7.8 host", None, "", "advisa 4111111111111111", "4111111111111111 credit",
        'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "04dbebab91ab85687d33eeaaf9ac699e1188f962", "key 0" + "a" * 80, "key " + "1" * 40, "x04dbebab91ab85687d33eeaaf9ac699e1188f962 token",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = in_spark(catalog.op8_personal_data(spark, str(tmp_path)))
    assert got == in_duckdb(catalog.OP8_SQL, documents=("doc_id BIGINT, text VARCHAR", rows))
    found = {r.doc_id: (r.spans, r.scores) for r in catalog.op8_personal_data(spark, str(tmp_path)).collect()}
    assert found[0] == ("ssn:11:22", "0.80") and found[1] == ("ssn:0:11", "0.80") and found[3] == ("", "") and found[4] == ("", "")
    assert [found[i][0] for i in range(17, 22)] == ["secret:13:53", "", "", "", ""]
    assert found[9][1] == "0.90" and found[15][1] == "0.80" and found[16][1] == "1.00"


def test_pii_of_many_hits(spark):
    """One valid card among very many short numbers, and very many valid hits: linear in both."""
    short = " ".join(["12 x"] * 100_000)
    text = f"{short} card 4111 1111 1111 1111 x {short}"
    mails = "a@b.co " * 60_000
    got = {r.doc_id: r.pii for r in pii.spans(docs(spark, [(1, text), (2, mails)])).collect()}
    at = len(short) + 6
    assert [(x.kind, x.start, x.end) for x in got[1]] == [("card", at, at + 19)]
    assert [(x.start, x.end) for x in got[2]] == [(7 * i, 7 * i + 6) for i in range(60_000)]


def test_urls_equal_their_sql(spark, tmp_path):
    rng = random.Random(9)
    hosts = ["a.example.org", "shop.com", "mirror.net", "x.test", "Y.Test", "free.net", "notexample.org"]
    paths = ["", "/", "/es/x", "/de/1", "/fr/2", "/en/1", "/a/b/c", "/a/./b/../b/c", "/q?x=1&y=2", "/a/b/"]
    targets = [*[f"http://{h}{p}" for h in hosts for p in paths], "../c", "./c", "?z=1", "#top", "mailto:me@x.test", "//x.test/de/1", "/de/1", "c", "..", "/q?x=1&amp;y=2", "HTTP://SHOP.com/de/1#f", "javascript:void(0)"]
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' class=x rel=canonical />", '<meta http-equiv="refresh" content="0; url={}">', "<Meta Content='5;URL={}' Http-Equiv=Refresh>", '<a rel="canonical" href="{}">', '<link data-rel="canonical" href="{}">']
    rows = []
    for i in range(150):
        html = "".join(rng.choice(forms).format(rng.choice(targets)) for _ in range(rng.choice([0, 0, 1, 1, 2])))
        rows.append((i, rng.choice(["http://", "https://"]) + rng.choice(hosts) + rng.choice(paths), html))
    rows += [(200, None, "<link rel=canonical href=http://shop.com/de/1>"), (201, "no scheme", ""), (202, "http://x.test/only", None), (3, rows[3][1], rows[3][2])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = in_spark(catalog.op9_url_filter(spark, str(tmp_path)))
    assert got == in_duckdb(catalog.OP9_SQL, pages=("page_id BIGINT, url VARCHAR, html VARCHAR", rows))
    plain = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), html=None).collect()}
    assert any(plain[r[1]] != r[-1] for r in got)


def test_url_rules_of_equal_length(spark):
    rules = (("block", "x.test", "/a"), ("allow", "x.test", "/a"), ("block", "test", "/ab/c"), ("allow", "y.x.test", "/"))
    long = "<p>" + "<link rel=next href=/q>" * 200_000 + "<link rel=canonical href='/ab/c'>"
    rows = [(1, "http://x.test/a", ""), (2, "http://y.x.test/ab/c", ""), (3, "http://z.test/ab/cd", ""), (4, "http://z.test/long", long)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    # Of the rules on page 2 the longest have nine characters each.
    assert got == {1: ("x.test/a", "allow"), 2: ("y.x.test/", "allow"), 3: ("test/ab/c", "block"), 4: (None, "block")}


def test_urls_given_edges_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 500)
    pages = spark.createDataFrame([(i, f"http://h{i}.net/") for i in range(3000)], "page_id long, url string")
    edges = spark.createDataFrame([(f"http://h{i}.net/", "http://shop.com/de/1") for i in range(0, 3000, 2)] + [(None, "http://h1.net/"), ("http://h3.net/", "http://h3.net/#x")], "src string, dst string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, html=None, edges=edges).collect()}
    assert got == {i: "block" if i % 2 == 0 else "allow" for i in range(3000)}
    # The hub as the largest and as the smallest node.
    for hub in (10**9, -1):
        star = spark.range(100_000).select(F.col("id").alias("src"), F.lit(hub).cast("long").alias("dst"))
        found = components.components(star).agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).first()
        assert tuple(found) == (100_001, min(hub, 0), min(hub, 0))


def test_language_of_open_tags(spark):
    assert language.visible("a<script>x</script >b<!-- <p> -->c<nav>d<p>e</NAV>f<script>g<p>h") == "a b c f g h"
    assert language.visible("x < y <!-- z <div class=\"ad\">q</div>&amp;&#999999999999999999;") == "x < y <!-- z  &\ufffd"
    for page in ("<script" * 300_000, "<!--" * 500_000, "<nav>" * 400_000, "<script>a</nav>" * 140_000, "<" * 2_000_000):
        assert len(language.visible(page)) <= len(page)


ODD = ["", " ", "a  b", "a   b ", "x\n \ny", "a\n\n b", "it's 's ' s", "a \nb", "\t\n b", " a", "a ", "é  b", "a\x1cb .\x1c.", "x<|endoftext|>y", "1 2 3,4", "\n \n", "naïve café ¡olé!", "word," * 50]


def test_token_files(spark, tmp_path):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab1.' \n\té-") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "long words " * 260_000]
    rows = [(i * 7 % 400, t) for i, t in enumerate(texts)]
    manifest = tokenfile.write(docs(spark, rows, CLASH), path=f"file://{tmp_path}/t", files=5)
    got = tokenfile.read(manifest).collect()
    plain = tokenfile.Encoder(tokenfile.default_vocabulary()).tokenizer
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        want.append((i, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    some = tokenfile.read(manifest, [7, 14]).collect()
    assert {r.doc_id for r in some} == {7, 14}
    assert tokenfile.digest(docs(spark, [])).count() == 0
    # A damaged frame is noticed.
    name = manifest.select("file").first().file.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[12] ^= 255
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception):
        list(tokenfile.Reader(f"file://{name}").documents())


def test_token_files_without_ids(spark):
    rows = [(None, "b c"), (3, "x"), (None, None), (3, "a x"), (None, "b a")]
    got = [(r.doc_id, r.start, r.n_tokens) for r in tokenfile.digest(docs(spark, rows, CLASH)).orderBy("start").collect()]
    assert [i for i, _, _ in got] == [None, None, None, 3, 3] and got[0][2] == 1
    assert [s for _, s, _ in got] == [sum(n for _, _, n in got[:i]) for i in range(5)]


def thue_morse(n):
    """Two words of 2**n letters on which every polynomial hash mod 2**64 agrees from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse(10)
    hashes, _ = textnum.word_hashes([one.encode(), two.encode()])
    assert hashes[0] != hashes[1]
    encoder = tokenfile.Encoder(tokenfile.default_vocabulary())
    texts = [one, two, f"x {one} y {two}"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(spark, [(1, one), (2, two), (3, f"{one} a b c d e"), (4, f"{two} a b c d e")])).collect()}
    assert got == {i: i for i in range(1, 5)}


def test_word_hash_of_the_same_words_anywhere():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 64, 65, 130, 700]))) for _ in range(60)]
    alone = [int(textnum.word_hashes([w.encode()])[0][0]) for w in words]
    together, bounds = textnum.word_hashes([" ".join(words).encode(), ("\n" + "\t ".join(words).upper().replace("É", "é")).encode()])
    assert together.tolist() == alone + alone and bounds.tolist() == [0, 60, 120]
    assert len(set(alone)) == len(set(words))


def test_frames_are_independent(tmp_path):
    out = tokenfile.Writer(f"file://{tmp_path}/one.dwt", frame_ids=8)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (1, 3, 20, 5, 4, 2)]
    for i, x in enumerate(ids):
        out.add(None if i == 0 else i, x)
    out.close()
    file = tokenfile.Reader(f"file://{tmp_path}/one.dwt")
    assert len(file.frames) > 2 and [x for _, x in file.documents()] == ids
    assert [x for _, x in file.documents([3])] == [ids[3]]


def toxic_corpus(n=1500, seed=4):
    rng = random.Random(seed)
    calm = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "se", "ti", "vo", "zu", "na")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(calm) for _ in range(rng.randint(1, 80))]
        bad = rng.random() < 0.25
        if bad:
            text.insert(rng.randrange(len(text) + 1), rng.choice(["grumok", "blarfed", "blarfing"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de", None]), "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    table = docs(spark, rows + [(5000, None, None, None), (5001, "", "xx", None), (5002, "ka " * 500_000 + "grumok", "en", None), (3, rows[3][1], "en", "s")], CLASH)
    known = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(table, toxicity.train(table, known))
    assert sorted(scored.columns) == sorted(table.columns + ["tox_flag"])
    got = scored.select("doc_id", "tox_score", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.tox_score <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    held = [(r.tox_score >= 0.5) == truth[r.doc_id] for r in got if r.h and r.doc_id in truth]
    assert np.mean(held) > 0.95
    assert next(r.tox_score for r in got if r.doc_id == 5002) >= 0.5
    kept = toxicity.keep_clean(table, known)
    assert kept.columns == table.columns
    assert np.mean([truth[r.doc_id] == 0 for r in kept.collect() if r.doc_id in truth]) > 0.95
    none = toxicity.score(table, toxicity.train(table, known.where("false")))
    assert {(r.tox_score, r.tox_flag) for r in none.collect()} == {(0.5, False)}
    assert toxicity.keep_clean(table, known.where("false")).count() == table.count()
    assert toxicity.keep_clean(docs(spark, []), known).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, leaf string")


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[700:1100] = x[0]
    x[5] *= 30
    rows = [(i, v.tolist(), 0, None, None) for i, v in enumerate(x)]
    odd = [(2000, None, 0, None, None), (2001, [0.0] * 8, 0, None, None), (2002, [float("nan")] * 8, 0, None, None), (2003, [1.0, None] * 4, 0, None, None), (2004, [1.0] * 3, 0, None, None), (2006, [float("inf")] + [0.0] * 7, 0, None, None), (2007, [1.0] * 4000, 0, None, None), (2005, [], 0, None, None), (None, [1.0] * 8, 0, None, None), (3, x[3].tolist(), 0, None, None)]
    got = collections.defaultdict(list)
    for r in anntree.search(vectors(spark, rows + odd), F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    d = np.concatenate([x, x[3:4]]).astype(float)
    ids = np.array([*range(1500), 3])
    hit = total = 0
    for q, found in got.items():
        s = np.where(ids == q, -np.inf, (d * d[q]).sum(1))
        top = np.lexsort((ids, -s))[:10]
        assert len(found) == 10 and all(np.isclose(v, s[ids == i][0], rtol=1e-12) for i, v in found)
        if 700 <= q < 1100:
            assert [i for i, _ in found if i == 0 or 700 <= i < 1100] == sorted(i for i, _ in found if i == 0 or 700 <= i < 1100)
        want = collections.Counter(ids[top].tolist())
        hit += sum((want & collections.Counter(i for i, _ in found)).values())
        total += 10
    assert hit / total >= 0.9
    assert anntree.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = anntree.search(vectors(spark, rows[:3]), F.col("vec_id") == 0, k=20)
    assert few.count() == 2


def test_calibration_covers_all_ids(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(1000, 4)).astype(np.float32)
    x[:500] = x[0]
    picked, exact = [], anntree.exact
    monkeypatch.setattr(anntree, "exact", lambda rows, q, own, k: picked.extend(own.tolist()) or exact(rows, q, own, k))
    anntree.search(vectors(spark, [(i, v.tolist(), 0, None, None) for i, v in enumerate(x)]), F.col("vec_id") == 0, k=5)
    assert len(picked) == anntree.CALIBRATION and 0.35 < np.mean(np.array(picked) >= 500) < 0.65


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(["plain", "words", "here", "and", "there"]) + ("" if good else rng.choice(["%%%", "$$$"])) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, "en", "bad-site" if not good and rng.random() < 0.8 else f"site{i % 9}"))
        labels.append((i, int(good), 0))
    table = docs(spark, rows + [(5000, None, None, None), (5001, "", None, "bad-site"), (5002, "plain words here", "en", "bad-site"), (5003, "plain words here", "en", "site1")], CLASH)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(table, known).collect()}
    truth = {i: q for i, q, _ in labels}
    assert len(got) == 904
    assert np.mean([got[i].keep == bool(truth[i]) for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95
    assert got[5002].score < got[5003].score and got[5002].host_rate < got[5003].host_rate
    assert {r.evidence for r in quality.score(table, known.where("false")).collect()} == {0.5}
    assert quality.score(docs(spark, []), known).count() == 0


def test_language(spark):
    rng = random.Random(8)
    say = {"aa": ["kora", "mila", "tesa"], "bb": ["vung", "drok", "blem"]}
    text = lambda k, n: " ".join(rng.choice(say[k]) for _ in range(n))
    taught = docs(spark, [(i, text(k, 30), k, "s") for i, k in enumerate(["aa", "bb"] * 40)])
    page = lambda k, t, d="": f"<html{d}><script>vung</script><p>{t}</p></html>"
    rows = [(i, f"http://{k}{i % 3}.site.{k}/{k}/{i}", page(k, text(k, 40), f' lang="{k}"')) for i, k in enumerate(["aa", "bb"] * 30)]
    rows += [(100, "http://aa0.site.aa/aa/9", ""), (101, "http://new.test/bb/9", page("bb", "")), (102, None, None), (102, None, None), (103, "broken", page("aa", text("aa", 20), " lang=bb"))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string")
    got = {r.page_id: r.lang for r in language.identify(pages, taught).collect()}
    assert all(got[i] == k for i, k in enumerate(["aa", "bb"] * 30))
    assert got[100] == "aa" and got[101] == "bb" and got[103] == "aa" and got[102] in say
    assert language.identify(pages, taught).count() == len(rows)
    assert language.identify(pages.where("false"), taught).count() == 0
    assert {r.lang for r in language.identify(pages, docs(spark, [])).collect()} == {None}
