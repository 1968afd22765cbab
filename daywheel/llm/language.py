"""Language ID of web pages by Bayesian fusion of text, declared markup language, address suffix and host priors.

Text likelihoods come from hashed letter trigrams and short words, counted on a bounded sample of labelled documents.
How far a declared language or an address suffix (the first path segment of two letters, else the last host label) speaks
for a language is learnt from the pages themselves: grouped aggregations of the text posteriors, smoothed. A host's
prior is its pages' mean posterior drawn towards its domain's, a domain's towards the global one.

Markup is taken out by one scan of its tags, so time is linear in the page however many of them stay open.

Defined results: null or empty HTML has a flat text likelihood, null or broken URLs an empty host and no suffix, pages
without a declaration none: such evidence says nothing (without a host the global prior holds); numeric character
references of eight or more digits are U+FFFD; ties go to the language first in code point order; rows that
repeat give a row each; an empty pages table gives an empty result, without labelled documents lang is null; further
columns aren't read.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import cut, salted_join, small_side, text_batches
from .urls import host_of, path_of

MAX_ROWS = 8_000
#: Longer documents aren't used to fit.
FIT_CHARS = 20_000
BUCKETS = 1 << 14
SMOOTH = 0.5
#: Pages that a prior weighs.
HOST_STRENGTH, DOMAIN_STRENGTH, CUE_STRENGTH = 5.0, 20.0, 10.0
#: Log-likelihoods are divided by words ** TEMPER: neighbouring trigrams aren't independent.
TEMPER = 0.5

_OPEN = re.compile(r"(?i)<(?:(script|style|nav|footer)\b|(!--)|(div class=\"ad\">))|<[^<>]*>")
_TAG = re.compile(r"<[^<>]*>")
_CLOSE = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "nav", "footer")} | {"!--": re.compile("-->"), 'div class="ad">': re.compile("(?i)</div>")}
_DECLARED = re.compile(r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


def visible(page: str | None) -> str:
    """The page's text: tags, comments and the insides of scripts, styles, navigation and advertisements are blanks; what isn't closed is a tag only."""
    page, out, at, ends = page or "", [], 0, {}
    while m := _OPEN.search(page, at):
        out.append(page[at : m.start()])
        kind, at = (m[1] or m[2] or m[3] or "").lower(), m.end()
        if kind:
            # The ends of each kind are found once, and those before here are passed for good.
            if kind not in ends:
                ends[kind] = deque((x.start(), x.end()) for x in _CLOSE[kind].finditer(page))
            while ends[kind] and ends[kind][0][0] < m.end():
                ends[kind].popleft()
            if ends[kind]:
                at = ends[kind][0][1]
            elif tag := _TAG.match(page, m.start()):
                at = tag.end()
            else:
                out.append("<")
                at = m.start() + 1
                continue
        out.append(" ")
    out.append(page[at:])
    return entities.unescape(_LONG_NUMBER.sub("\ufffd", "".join(out)))


def buckets(texts: list[str]) -> list[np.ndarray]:
    """Hashed words and letter trigrams of each text."""
    out = []
    for group in textnum.batches(texts):
        words, bounds = textnum.word_hashes(group, textnum.LETTERS)
        for i, data in enumerate(group):
            raw = np.frombuffer(b" " + data.lower() + b" ", np.uint8).astype(np.uint64)
            grams = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)
            both = np.concatenate([words[bounds[i] : bounds[i + 1]], textnum.mix64(grams + np.uint64(1))])
            out.append((both >> np.uint64(64 - 14)).astype(np.int64))
    return out


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods: languages x buckets) from labelled documents."""
    known = docs.where("lang is not null and text is not null").where(F.length("text") <= FIT_CHARS)
    n = known.count()
    part = min(1.0, max_rows / max(n, 1))
    rows = known.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < int(part * (1 << 30))).select("doc_id", "lang", "text").toArrow().sort_by("doc_id")
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.full((len(langs), BUCKETS), SMOOTH)
    at = {x: i for i, x in enumerate(langs)}
    for lang, found in zip(rows.column("lang").to_pylist(), buckets(rows.column("text").to_pylist()), strict=True):
        counts[at[lang]] += np.bincount(found, minlength=BUCKETS)
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def text_posteriors(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(page_id, host, domain, suffix, declared, l: log-likelihood of each language)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for part in parts:
            raw = part.column(1).to_pylist()
            said = [m[1].lower() if (m := _DECLARED.search(x or "")) else None for x in raw]
            found = []
            for one in buckets([visible(x) for x in raw]):
                n = max(len(one), 1)
                found.append(table[:, one].sum(1) / n**TEMPER if len(one) > 2 else np.zeros(len(langs)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), part.column(3), pa.array(said, pa.string()), pa.array(found, pa.list_(pa.float64()))], ["page_id", "host", "path", "declared", "l"])

    rows = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.mapInArrow(run, "page_id long, host string, path string, declared string, l array<double>")
    first = F.regexp_extract("path", r"^/([a-z]{2})(?:/|$)", 1)
    suffix = F.when(first != "", first).when(F.col("host") != "", F.concat(F.lit("."), F.regexp_extract("host", r"([^.]*)$", 1))).otherwise("")
    domain = F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)
    return rows.select("page_id", "host", F.when(domain != "", domain).otherwise(F.col("host")).alias("domain"), suffix.alias("suffix"), F.coalesce("declared", F.lit("")).alias("declared"), "l")


def softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, pages, sums of posteriors); combined before the shuffle, so a hot key costs a row per task."""
    got = rows.groupBy(key).agg(F.count("*").alias("pages"), *[F.sum(F.col("t")[i]).alias(f"s{i}") for i in range(n)])
    return got.select(key, "pages", F.array(*[f"s{i}" for i in range(n)]).alias("s"))


def _attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    table = cut(table)
    side, small = small_side(table)
    return rows.join(side, key, "left") if small else salted_join(rows, table, key)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, score, text_lang, declared, host) of each page; docs (doc_id, text, lang) teach the text model."""
    text_batches(pages.sparkSession)
    langs, table = fit(docs)
    n = len(langs)
    if not n:
        return pages.select(F.col("page_id").cast("long"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), host_of(F.col("url")).alias("host"))
    rows = cut(text_posteriors(pages, (langs, table)).withColumn("t", softmax(F.col("l"))))
    total = rows.agg(F.count("*"), *[F.coalesce(F.sum(F.col("t")[i]), F.lit(0.0)) for i in range(n)]).first()
    base = [float((total[i + 1] + 1) / (total[0] + n)) for i in range(n)]
    prior = F.array(*[F.lit(x) for x in base])
    domains = _sums(rows, "domain", n).select("domain", F.zip_with("s", prior, lambda s, b: (s + DOMAIN_STRENGTH * b) / (F.col("pages") + DOMAIN_STRENGTH)).alias("d"))
    hosts = rows.groupBy("host").agg(F.first("domain").alias("domain"), F.count("*").alias("pages"), *[F.sum(F.col("t")[i]).alias(f"s{i}") for i in range(n)])
    hosts = _attach(hosts, domains, "domain")
    hosts = hosts.select("host", F.zip_with(F.array(*[f"s{i}" for i in range(n)]), "d", lambda s, d: (s + HOST_STRENGTH * d) / (F.col("pages") + HOST_STRENGTH)).alias("h"))
    rows = _attach(rows, hosts, "host").withColumn("h", F.when(F.col("host") != "", F.col("h")).otherwise(prior))
    for cue, name in (("declared", "c"), ("suffix", "u")):
        # P(cue | language) / P(cue): how much likelier a language is under this cue than at all.
        cues = _sums(rows, cue, n).select(cue, F.zip_with("s", prior, lambda s, b: (s + CUE_STRENGTH * b) / (F.col("pages") + CUE_STRENGTH) / b).alias(name))
        rows = _attach(rows, cues, cue)
    fused = F.transform(F.arrays_zip("l", "h", "c", "u"), lambda x: x["l"] + F.log(x["h"]) + F.when(F.col("declared") != "", F.log(x["c"])).otherwise(0.0) + F.when(F.col("suffix") != "", F.log(x["u"])).otherwise(0.0))
    rows = rows.withColumn("post", softmax(fused))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: names[(F.array_position(c, F.array_max(c)) - 1).cast("int")]
    return rows.select("page_id", best(F.col("post")).alias("lang"), F.array_max("post").alias("score"), best(F.col("t")).alias("text_lang"), F.nullif(F.col("declared"), F.lit("")).alias("declared"), "host")
