"""The learnt operators against plain-Python scoring with the same fitted weights: every row's score is compared."""

import collections
import html
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("daywheel.llm")
from daywheel.llm import language, quality, toxicity

from .test_operators import CLASH, docs, toxic_corpus

MASK = 2**64 - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def value(place, byte):
    byte = byte + 32 if 65 <= byte <= 90 else byte
    return mix((place % 64 * 257 + byte + 2) * 0x9E3779B97F4A7C15 & MASK)


def word_hash(word):
    total = 0
    for j, a in enumerate(range(0, len(word), 64)):
        total += mix((sum(value(i, b) for i, b in enumerate(word[a : a + 64])) + j * 0xD1342543DE82EF95) & MASK)
    return mix((total + len(word) * 0xA24BAED4963EE407) & MASK)


def letter_runs(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())


def test_toxicity_scores(spark):
    rows, labels = toxic_corpus(400)
    rows += [(7000, None, None, None), (7001, "", "en", None), (7002, "x" * 300 + " GRUMOK " + "é" * 90, "en", None), (7003, " ,. ", "xx", None), (3, rows[3][1], "de", None)]
    table = docs(spark, rows, CLASH)
    net, limits = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = collections.Counter()
    for i, text, lang, _ in rows:
        vectors = []
        for w in letter_runs(text or ""):
            keys = [word_hash(w)] + [mix((sum(value(p, b) for p, b in enumerate(w[:k])) + k) & MASK) for k in (4, 5)]
            vectors.append(sum(net.embed[k >> 49].astype(float) for k in keys))
        logit = float(net.bias[0])
        for a, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(vectors)):
                    got = float(net.shift[width][f])
                    for j in range(width):
                        if at + j < len(vectors):
                            got += float(vectors[at + j] @ net.filters[width][j][:, f])
                    best = max(best, got)
                logit += best * float(net.out[a * toxicity.FILTERS + f])
        score = 1 / (1 + math.exp(-max(-30, min(30, logit))))
        want[i, round(score, 4), score >= limits.get(lang, 0.5)] += 1
    got = collections.Counter((r.doc_id, round(r.tox_score, 4), r.tox_flag) for r in toxicity.score(table, (net, limits)).select("doc_id", "tox_score", "tox_flag").collect())
    near = {(i, b): s for i, s, b in want}
    assert sum(got.values()) == len(rows) and all(abs(near[i, b] - s) <= 2e-3 for i, s, b in got)


def shape(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * quality.N_FEATURES
    kinds = [range(97, 123), range(65, 91), range(48, 58), b".,;:!?'\"", b"#$%&*|<>{}[]\\/=_^~@+-()", b" ", b"\n", range(128, 256)]
    count = [sum(b in k for b in data) for k in kinds]
    words = [w.lower() for w in data.split()]
    n, lines = max(len(words), 1), data.count(b"\n") + 1
    return [*[c / len(data) for c in (len(data) - sum(count), *count)], math.log1p(len(data)) / 10, math.log1p(n) / 10, len(data) / n / 20, len(set(words)) / n, math.log1p(n / lines) / 5]


def test_quality_scores(spark, monkeypatch):
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(["plain", "words", "Here", "and", "é"]) + ("" if good else rng.choice(["%%%", "$", "9"])) for _ in range(rng.randint(1, 30)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b\x01", None]) if good else "c"))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, None), (901, "", "\x00", "a"), (902, "long " * 200_000, "\x01b", "b"), (5, rows[5][1], rows[5][2], rows[5][3])]
    labels += [(6, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 0)]
    kept, fit = [], quality.fit_logistic
    monkeypatch.setattr(quality, "fit_logistic", lambda x, y, *a: kept.append((fit(x, y, *a), y)) or kept[-1][0])
    got = quality.score(docs(spark, rows, CLASH), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    weights, y = kept[0]
    known = collections.defaultdict(list)
    for i, q, _ in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            known[i].append(q)
    label = {i: sum(q) / len(q) for i, q in known.items()}
    x = {r[1]: np.array(shape(r[1])) for r in rows}
    taught = np.stack([x[r[1]] for r in rows if r[0] in label])
    mean, spread = taught.mean(0), np.where(taught.std(0) > 1e-9, taught.std(0), 1)
    rate = min(max((sum(y) + 1) / (len(y) + 2), 0.01), 0.99)
    own, host, path = [], collections.defaultdict(lambda: [0.0, 0.0]), collections.defaultdict(lambda: [0.0, 0.0])
    for i, text, lang, source in rows:
        z = (x[text] - mean) / spread
        p = 1 / (1 + math.exp(-max(-12, min(12, float(np.concatenate([z, z * z, [1]]) @ weights)))))
        w = 1.0 if i in label else quality.SOFT
        s = w * label.get(i, p)
        own.append((i, p, w, s, source, (source, lang)))
        for site, key in ((host, source), (path, (source, lang))):
            site[key][0] += w
            site[key][1] += s

    def strength(sites):
        n, k = sum(a for a, _ in sites.values()), len(sites)
        ss, nn, noise = sum(a * (b / a - rate) ** 2 for a, b in sites.values()), sum(a * a for a, _ in sites.values()), rate * (1 - rate)
        between = (ss - (k - 1) * noise) / max(n - nn / n, 1e-9)
        return min(max(noise / between - 1 if between > 0 else quality.STRENGTH[1], quality.STRENGTH[0]), quality.STRENGTH[1])

    k_host, k_path = strength(host), strength(path)
    want = collections.Counter()
    for i, p, w, s, source, site in own:
        h = (max(host[source][1] - s, 0) + k_host * rate) / (max(host[source][0] - w, 0) + k_host)
        q = min(max((max(path[site][1] - s, 0) + k_path * h) / (max(path[site][0] - w, 0) + k_path), 0.001), 0.999)
        logit = math.log(p / (1 - p)) - math.log(rate / (1 - rate)) + math.log(q / (1 - q))
        want[i, round(p, 6), round(h, 6), round(1 / (1 + math.exp(-logit)), 6)] += 1
    assert collections.Counter((r.doc_id, round(r.evidence, 6), round(r.host_rate, 6), round(r.score, 6)) for r in got) == want


def test_language_scores(spark):
    rng = random.Random(18)
    say = {"aa": ["kora", "mila", "tesa"], "bb": ["vung", "drok", "blem"], "cc": ["kora", "drok", "zuza"]}
    text = lambda k, n: " ".join(rng.choice(say[k]) for _ in range(n))
    taught = docs(spark, [(i, text(k, rng.randint(1, 30)), k, "s") for i, k in enumerate(["aa", "bb", "cc"] * 20)])
    rows = []
    for i in range(120):
        k = rng.choice(list(say))
        said = rng.choice(["", ' lang="aa"', " LANG=bb", f" lang='{k}'"])
        where = rng.choice([f"http://{k}.site.{k}/x", f"https://www.big.org/{k}/1", "http://single/p", None, "no scheme", f"http://h{i % 7}.big.org"])
        rows.append((i, where, f"<html{said}><script>vung</script><!-- kora --><p>{text(k, rng.randint(0, 25))}&amp;</p><nav>mila</nav></html>"))
    rows += [(500, "http://www.big.org/aa/1", None), (501, None, None), (502, "http://www.big.org/aa/1", ""), (5, rows[5][1], rows[5][2])]
    got = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), taught).collect()
    langs, table = language.fit(taught)
    n = len(langs)
    drop = re.compile(r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>")
    soft = lambda v: [math.exp(a - max(v)) / sum(math.exp(b - max(v)) for b in v) for a in v]
    facts = []
    for i, url, page in rows:
        data = html.unescape(drop.sub(" ", page or "")).encode()
        padded = b" " + data.lower() + b" "
        grams = [mix((padded[a] | padded[a + 1] << 8 | padded[a + 2] << 16) + 1) for a in range(len(padded) - 2)]
        keys = [word_hash(w) >> 50 for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)] + [g >> 50 for g in grams]
        l = [sum(table[a][k] for k in keys) / len(keys) ** language.TEMPER if len(keys) > 2 else 0.0 for a in range(n)]  # noqa: E741
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        first = re.match(r"/([a-z]{2})(?:/|$)", re.match("[^/?#]*([^?#]*)", rest)[1])
        suffix = first[1] if first else "." + host.rpartition(".")[2] if host else ""
        domain = ".".join(host.split(".")[-2:])
        said = re.search(r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", page or "")
        facts.append((i, host, domain, suffix, said[1].lower() if said else "", l, soft(l)))
    base = [(sum(f[6][a] for f in facts) + 1) / (len(facts) + n) for a in range(n)]

    def pooled(at, drawn, weight):
        found = {}
        for key in {f[at] for f in facts}:
            own = [f for f in facts if f[at] == key]
            found[key] = [(sum(f[6][a] for f in own) + weight * drawn(own[0])[a]) / (len(own) + weight) for a in range(n)]
        return found

    domains = pooled(2, lambda f: base, language.DOMAIN_STRENGTH)
    hosts = pooled(1, lambda f: domains[f[2]], language.HOST_STRENGTH)
    cues = [pooled(at, lambda f: base, language.CUE_STRENGTH) for at in (3, 4)]
    want = collections.Counter()
    for i, host, _, suffix, said, l, t in facts:  # noqa: E741
        fused = [l[a] + math.log(hosts[host][a] if host else base[a]) for a in range(n)]
        for key, cue in ((suffix, cues[0]), (said, cues[1])):
            fused = [fused[a] + (math.log(cue[key][a] / base[a]) if key else 0.0) for a in range(n)]
        post = soft(fused)
        want[i, langs[post.index(max(post))], round(max(post), 6)] += 1
    assert collections.Counter((r.page_id, r.lang, round(r.score, 6)) for r in got) == want
