"""Quality by hierarchical empirical Bayes: a document's own evidence, combined with its host's and path's posteriors.

A logistic model of the text's shape (fitted on at most MAX_ROWS labelled rows) gives each document evidence. Labels,
and with a smaller weight the evidence of unlabelled documents, are summed by path and host in grouped aggregations;
a path's rate is drawn towards its host's, a host's towards the global one, by strengths estimated from the spread
between sites (method of moments), so sparse sites fall back to the prior. A document's own share is taken out of its
site's sums before they judge it.

Defined results: null and empty texts have all features 0; null hosts and paths are sites of their own; without labels of
both kinds the evidence is the prior; null labels are ignored, repeated ones averaged; rows that repeat give a row each;
empty tables give empty results; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import cut, salted_join, small_side, text_batches

MAX_ROWS = 20_000
#: What an unlabelled document's evidence counts for in its site, against 1 for a label.
SOFT = 0.1
#: Bounds of the strength of a prior, in documents.
STRENGTH = (2.0, 500.0)

_CLASS = np.zeros(256, np.int64)
for _at, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:!?'\"", b"#$%&*|<>{}[]\\/=_^~@+-()", b" ", b"\n", range(128, 256))):
    _CLASS[list(_bytes)] = _at + 1
N_FEATURES = 14


def features(texts: list[str | None]) -> np.ndarray:
    """Shape of each text: shares of character classes, length, words and lines; all 0 if it is empty."""
    out = np.zeros((len(texts), N_FEATURES))
    at = 0
    for group in textnum.batches(texts):
        words, bounds = textnum.word_hashes(group)
        for i, data in enumerate(group):
            if data:
                share = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9) / len(data)
                own = words[bounds[i] : bounds[i + 1]]
                n = max(len(own), 1)
                lines = data.count(b"\n") + 1
                out[at] = [*share, np.log1p(len(data)) / 10, np.log1p(n) / 10, len(data) / n / 20, len(np.unique(own)) / n, np.log1p(n / lines) / 5]
            at += 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, turns: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias last) by Newton steps on standardised features; features come as [x, x**2]."""
    z = np.concatenate([x, x**2, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(z) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) / len(z) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _named(site: Column) -> Column:
    """A site's name; null is no name that another could have."""
    return F.coalesce(F.concat(F.lit("+"), site), F.lit("-"))


def evidence(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> tuple[DataFrame, float]:
    """((doc_id, host, path, label, p), global rate): each row's label, if it may be learnt from, and classifier evidence p."""
    text_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    rows = docs.select("doc_id", "text", _named(host).alias("host"), _named(path).alias("path"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = features(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), part.column(3), pa.array(list(found))], ["doc_id", "host", "path", "x"])

    shaped = cut(rows.mapInArrow(run, "doc_id long, host string, path string, x array<double>"))
    shaped = shaped.join(known, "doc_id", "left")
    n = shaped.where("label is not null").count()
    part = min(1.0, MAX_ROWS / max(n, 1))
    sample = shaped.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(part * (1 << 30)))).select("doc_id", "x", "label").toArrow().sort_by("doc_id")
    y = np.array(sample.column("label").to_pylist() or [0.5])
    rate = float(np.clip((y.sum() + 1) / (len(y) + 2), 0.01, 0.99))
    if len(sample) == 0 or y.min() == y.max():
        return cut(shaped.select("doc_id", "host", "path", "label", F.lit(rate).alias("p"))), rate
    x = np.array(sample.column("x").to_pylist())
    mean, spread = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1)
    w = fit_logistic((x - mean) / spread, y)
    d = x.shape[1]
    logit = F.lit(float(w[-1]))
    for i in range(d):
        z = (F.col("x")[i] - float(mean[i])) / float(spread[i])
        logit = logit + z * float(w[i]) + z * z * float(w[d + i])
    p = 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-12.0)), F.lit(12.0))))
    return cut(shaped.select("doc_id", "host", "path", "label", p.alias("p"))), rate


def strength(sites: DataFrame, mean: float) -> float:
    """Documents a prior weighs, from the spread of sites' rates beyond what their sizes explain (beta-binomial moments)."""
    got = sites.where("n > 0").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("ss"), F.sum(F.col("n") ** 2).alias("nn"), F.count("*").alias("k")).first()
    if not got["k"] or got["k"] < 2 or got["n"] <= 0:
        return STRENGTH[1]
    noise = mean * (1 - mean)
    between = (got["ss"] - (got["k"] - 1) * noise) / max(got["n"] - got["nn"] / got["n"], 1e-9)
    return float(np.clip(noise / between - 1 if between > 0 else STRENGTH[1], *STRENGTH))


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, keep) of each row; keep: score >= 0.5. Host and path default to source and lang."""
    rows, rate = evidence(docs, labels, F.col("source") if host is None else host, F.col("lang") if path is None else path)
    rows = rows.withColumn("w", F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT)).withColumn("y", F.col("w") * F.coalesce("label", "p"))
    rows = rows.withColumn("site", F.concat(F.length("host").cast("string"), F.lit(":"), "host", "path"))
    paths = cut(rows.groupBy("host", "site").agg(F.sum("w").alias("n"), F.sum("y").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    k_host, k_path = strength(hosts, rate), strength(paths, rate)
    sites = cut(paths.select("site", "host", F.col("n").alias("n_p"), F.col("s").alias("s_p")).join(hosts.select("host", F.col("n").alias("n_h"), F.col("s").alias("s_h")), "host").drop("host"))
    side, small = small_side(sites)
    rows = rows.join(side, "site", "left") if small else salted_join(rows, sites, "site")
    host_rate = (F.greatest(F.col("s_h") - F.col("y"), F.lit(0.0)) + k_host * rate) / (F.greatest(F.col("n_h") - F.col("w"), F.lit(0.0)) + k_host)
    rows = rows.withColumn("host_rate", host_rate)
    path_rate = (F.greatest(F.col("s_p") - F.col("y"), F.lit(0.0)) + k_path * F.col("host_rate")) / (F.greatest(F.col("n_p") - F.col("w"), F.lit(0.0)) + k_path)
    rows = rows.withColumn("path_rate", F.least(F.greatest(path_rate, F.lit(0.001)), F.lit(0.999)))
    odds = lambda c: F.log(c / (1 - c))
    logit = odds(F.col("p")) - float(np.log(rate / (1 - rate))) + odds(F.col("path_rate"))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-logit)))
    return rows.select("doc_id", F.col("p").alias("evidence"), "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("keep"))
