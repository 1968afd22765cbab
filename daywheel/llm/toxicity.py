"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first four and five bytes (runs of letters and
digits, A-Z lower-cased). Filters of one to three words run over the whole text, their largest values feed a logistic
layer. Embeddings times filters are tables, so scoring a text costs look-ups and maxima only.

The model is fitted on all labelled rows that aren't held out, whole texts of any length. Up to SHARD_ROWS rows and
SHARD_CHARS characters are one task. More are dealt into shards by a hash of doc_id: in each round every shard trains one
epoch from the common weights, and the shards' changes are averaged (those of a word's vector over the shards that have
the word); changes are summed on the executors, one set of weights goes to the driver a round. Scoring runs over every
whole text. Thresholds are calibrated by language on the tenth of all these rows that training leaves out, from counts by
language, and drawn towards 0.5 where a language has few rows; language, source, id and labels aren't inputs of the score.

Defined results: null, empty and blank texts have no windows: all filters give 0 and the score comes from the bias; null
labels are ignored, repeated ones count as toxic if any is; without labels of both kinds the score is the prior, (toxic +
1) / (rows + 2), and nothing is flagged; an unknown or null language has the threshold 0.5; rows that repeat give a row each; empty tables give
empty results; further columns pass through `score` unchanged (it adds tox_score and tox_flag).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .common import release, small_side, text_batches, tidy

#: Rows and characters that one task trains on.
SHARD_ROWS, SHARD_CHARS = 12_000, 24_000_000
#: Parts of the embeddings that shards' changes are summed in, and thresholds that are tried.
CHUNKS, GRID = 16, np.linspace(0.2, 0.8, 25)
#: Mean loss at which training ends.
ENOUGH = 0.003
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 16
EPOCHS, BATCH, RATE = 4, 128, 0.015
#: Part of the words that is left out of a text at each training step, so that no telling word hides behind another.
DROP = 0.3
#: Positions that are convolved at a time.
BLOCK = 1 << 16
PAD = max(WIDTHS) - 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def word_features(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket rows of the distinct words: U x 3, their places in order, bounds of the texts among the places)."""
    keys, parts, bounds, at = [], [], [0], 0
    for data in group:
        for piece in textnum._pieces(data, textnum.LETTERS, textnum.PIECE):
            starts, ends, sums, full = textnum.piece_words(piece, textnum.LETTERS)
            rows = [full]
            for k in (4, 5):
                stop = np.minimum(starts + k, ends)
                rows.append(textnum.mix64(sums[stop] - sums[starts] + np.uint64(k)))
            keys.append(full)
            parts.append((np.stack(rows, 1) >> np.uint64(64 - 15)).astype(np.int32))
            at += len(full)
        bounds.append(at)
    key, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return np.concatenate(parts)[first], place.astype(np.int32), np.array(bounds)


def _grouped(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_features of texts that together are short: one pass over their joined bytes."""
    if sum(map(len, group)) > 2 * textnum.PIECE:
        return word_features(group)
    lengths = np.fromiter((len(x) + 1 for x in group), np.int64, len(group))
    rows, place, _ = word_features([b" ".join(group) + b" "])
    data = b" ".join(group) + b" "
    starts = textnum.piece_words(data, textnum.LETTERS)[0] if len(group) > 1 else np.empty(0)
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths)))) if len(group) > 1 else np.array([0, len(place)])
    return rows, place, bounds


class Network:
    """Weights, scoring and training."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.shift = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.prior: float | None = None

    def _laid_out(self, place: np.ndarray, bounds: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with PAD empty words after each text, and where each text starts."""
        texts = len(bounds) - 1
        starts = bounds[:-1] + PAD * np.arange(texts)
        laid = np.full(len(place) + PAD * texts, unknown, np.int64)
        laid[np.arange(len(place)) + PAD * np.repeat(np.arange(texts), np.diff(bounds))] = place
        return laid, starts

    def pooled(self, rows: np.ndarray, place: np.ndarray, bounds: np.ndarray, where: bool = False, rng: np.random.Generator | None = None):
        """Largest filter values of each text (B x filters), and at which laid-out position, if where."""
        words = np.concatenate([self.embed[rows].sum(1), np.zeros((1, DIM), np.float32)])
        laid, starts = self._laid_out(place, bounds, len(words) - 1)
        if rng is not None:
            laid[rng.random(len(laid)) < DROP] = len(words) - 1
        ends = starts + np.diff(bounds)
        texts = len(starts)
        top = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        spot = np.zeros((texts, len(WIDTHS) * FILTERS), np.int64) if where else None
        for i, w in enumerate(WIDTHS):
            tables = [words @ self.filters[w][j] for j in range(w)]
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            for a in range(0, len(laid), BLOCK):
                b = min(a + BLOCK, len(laid))
                value = tables[0][laid[a:b]] + self.shift[w]
                for j in range(1, w):
                    after = laid[a + j : b + j]
                    value[: len(after)] += tables[j][after]
                lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)
                some = [t for t in range(lo, hi) if max(starts[t], a) < min(ends[t], b)]
                if not some:
                    continue
                some = np.array(some)
                begin, stop = np.maximum(starts[some], a) - a, np.minimum(ends[some], b) - a
                cuts = np.stack([begin, stop], 1).ravel()
                padded = np.concatenate([value, np.zeros((1, FILTERS), np.float32)])
                most = np.maximum.reduceat(padded, cuts, axis=0)[::2]
                if where:
                    for k, t in enumerate(some):
                        seg = value[begin[k] : stop[k]]
                        at = seg.argmax(0)
                        better = most[k] > top[t, cols]
                        spot[t, cols] = np.where(better, at + begin[k] + a, spot[t, cols])
                top[some, cols] = np.maximum(top[some, cols], most)
        return (top, spot, laid, words) if where else top

    def logits(self, rows: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.pooled(rows, place, bounds) @ self.out + self.bias[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        found = [self.logits(*_grouped(group)) for group in textnum.batches(texts)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(found).astype(np.float64), -30, 30))) if found else np.empty(0)

    def fit(self, texts: list[str | None], labels: np.ndarray, seed: int = 7) -> None:
        labels = np.asarray(labels, np.float32)
        if not len(labels) or labels.min() == labels.max():
            self.prior = float((labels.sum() + 1) / (len(labels) + 2))
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(texts))
        batches = []
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            batches.append((*_grouped([(texts[i] or "").encode("utf-8", "surrogatepass") for i in some]), labels[some]))
        weight = self.begin(labels.mean())
        adam = _Adam(self)
        for _ in range(EPOCHS):
            loss = sum(adam.step(batches[k], weight, rng) for k in rng.permutation(len(batches)))
            if loss / len(batches) < ENOUGH:
                break

    def begin(self, rate: float) -> float:
        """Start from the share of toxic rows; the weight of a toxic row."""
        self.bias[0] = np.log(rate / (1 - rate))
        return float(np.sqrt((1 - rate) / rate))

    def dense(self) -> dict[str, np.ndarray]:
        """All weights but the embeddings."""
        return {"out": self.out, "bias": self.bias} | {f"f{w}": self.filters[w] for w in WIDTHS} | {f"s{w}": self.shift[w] for w in WIDTHS}


class _Adam:
    """Training of a network in place, a batch (rows, places, bounds, labels) at a time."""

    def __init__(self, net: Network) -> None:
        self.net, self.dense, self.steps = net, net.dense(), 0
        self.first = {k: np.zeros_like(v) for k, v in self.dense.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.dense.items()}
        self.e1, self.e2 = np.zeros_like(net.embed), np.zeros_like(net.embed)

    def step(self, batch: tuple, weight: float, rng: np.random.Generator) -> float:
        """Train on a batch; its mean loss before."""
        net, e1, e2 = self.net, self.e1, self.e2
        rows, place, bounds, y = batch
        self.steps += 1
        top, spot, laid, words = net.pooled(rows, place, bounds, where=True, rng=rng)
        p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.bias[0], -30, 30)))
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        g = (p - y) * np.where(y == 1, weight, 1).astype(np.float32) / len(y)
        grads = {"out": g @ top + 1e-4 * net.out, "bias": g.sum(keepdims=True)}
        inner = (g[:, None] * net.out[None]) * (top > 0)
        moved = np.zeros_like(words)
        for i, w in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            gi, at = inner[:, cols], spot[:, cols]
            grads[f"s{w}"] = gi.sum(0)
            gw = np.empty_like(net.filters[w])
            for j in range(w):
                who = laid[np.minimum(at + j, len(laid) - 1)]
                gw[j] = np.einsum("bf,bfd->df", gi, words[who])
                np.add.at(moved, who.ravel(), (gi[:, :, None] * net.filters[w][j].T[None]).reshape(-1, DIM))
            grads[f"f{w}"] = gw
        touched = np.flatnonzero(np.abs(moved[:-1]).sum(1))
        bucket, back = np.unique(rows[touched], return_inverse=True)
        ge = np.zeros((len(bucket), DIM), np.float32)
        np.add.at(ge, back.reshape(-1), np.repeat(moved[touched], 3, 0))
        c1, c2 = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for name, grad in grads.items():
            self.first[name] += 0.1 * (grad - self.first[name])
            self.second[name] += 0.001 * (grad * grad - self.second[name])
            self.dense[name] -= RATE * (self.first[name] / c1) / (np.sqrt(self.second[name] / c2) + 1e-8)
        e1[bucket] += 0.1 * (ge - e1[bucket])
        e2[bucket] += 0.001 * (ge * ge - e2[bucket])
        net.embed[bucket] -= RATE * (e1[bucket] / c1) / (np.sqrt(e2[bucket] / c2) + 1e-8)
        return loss


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows to fit on, never held-out ones: (doc_id, text, lang, toxic)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    # Texts are shuffled for the join only where the labels are too many to send.
    rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", lang.alias("lang")).join(small_side(known, 48)[0], "doc_id")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.col("toxic").cast("int").alias("toxic"))


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], weight: float = 50.0) -> dict[str, float]:
    """A threshold for each language: the best F1 on its rows, drawn towards 0.5 as if by `weight` rows."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        s, y = scores[own], labels[own]
        out[lang] = _threshold(len(s), np.array([(y == 1).sum()] * len(GRID)), np.array([(s >= t).sum() for t in GRID]), np.array([((s >= t) & (y == 1)).sum() for t in GRID]), weight)
    return out


def _threshold(n: int, toxic: np.ndarray, flagged: np.ndarray, right: np.ndarray, weight: float = 50.0) -> float:
    """The threshold of n rows of a language, from how many are toxic, flagged and both at each of GRID."""
    f1 = 2 * right / np.maximum(1, flagged + toxic)
    best = np.flatnonzero(np.isclose(f1, max(f1)))
    near = float(GRID[best[np.argmin(np.abs(GRID[best] - 0.5))]])
    return (n * near + weight * 0.5) / (n + weight)


def fitted(rows: pa.Table) -> tuple[Network, dict[str, float]]:
    """The network and the thresholds by language of labelled rows (doc_id, text, lang, toxic)."""
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, langs, y = rows.column("text").to_pylist(), rows.column("lang").to_pylist(), np.array(rows.column("toxic").to_pylist() or [], np.float32)
    net = Network()
    check = np.arange(len(y)) % 10 == 0
    if len(y) < 50:
        check[:] = False
    net.fit([t for t, c in zip(texts, check, strict=True) if not c], y[~check])
    at = np.flatnonzero(check)
    limits = thresholds(net.score([texts[i] for i in at]), y[at], [langs[i] for i in at]) if len(at) else {}
    return net, limits


def train(docs: DataFrame, labels: DataFrame) -> tuple[Network, dict[str, float]]:
    """The fitted network and the thresholds by language, from all labelled rows: in one task if they are few, else in shards."""
    text_batches(docs.sparkSession)
    rows = labelled(docs, labels)
    sizes = labelled(docs.withColumn("text", F.length("text")), labels)
    n, chars = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("text").cast("long")), F.lit(0))).first()
    shards = max(-(-n // SHARD_ROWS), -(-chars // SHARD_CHARS))
    if shards > 1:
        return _train_shards(rows, shards)
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "toxic": pa.int32()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([part]) for part in parts]
        model = fitted(pa.concat_tables(held) if held else pa.schema(kinds).empty_table())
        held.clear()
        tidy()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fitted(pa.schema(kinds).empty_table())


def _train_shards(rows: DataFrame, shards: int) -> tuple[Network, dict[str, float]]:
    """As fitted, of rows in any number: rounds of one epoch in every shard, whose changes are averaged."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    check = F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(10)) == 0
    dealt = rows.where(~check).select("text", "toxic", F.xxhash64("doc_id").alias("_h")).repartitionById(shards, F.pmod("_h", F.lit(shards)).cast("int"))
    dealt = dealt.sortWithinPartitions(F.xxhash64("_h"), "text").select("text", "toxic").persist(StorageLevel.DISK_ONLY)
    n, toxic = dealt.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    release(spark)
    net = Network()
    if toxic in (0, n):
        dealt.unpersist()
        net.prior = float((toxic + 1) / (n + 2))
        return net, {}
    weight = net.begin(toxic / n)
    names = list(net.dense())
    for turn in range(EPOCHS):
        shared = sc.broadcast(net)

        def run(parts: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            start = shared.value
            own = pickle.loads(pickle.dumps(start))
            adam, rng, loss, done = _Adam(own), np.random.default_rng(turn), 0.0, 0
            for part in parts:
                for a in range(0, len(part), BATCH):
                    some = part.slice(a, BATCH)
                    y = some.column("toxic").to_numpy().astype(np.float32)
                    texts = [(t or "").encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()]
                    loss += adam.step((*_grouped(texts), y), weight, rng) * len(y)
                    done += len(y)
            if not done:
                return
            moved = adam.e2.any(1)
            change = np.concatenate([(own.embed - start.embed).astype(float), moved[:, None]], 1) * moved[:, None]
            sums = [*np.split(change, CHUNKS), np.concatenate([[done, loss], *[v.ravel() * float(done) for v in own.dense().values()]])]
            tidy()
            for key, value in enumerate(sums):
                yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "value": pa.array([value.tobytes()], pa.binary())})

        changes = dealt.mapInArrow(run, "key int, value binary").rdd.map(lambda r: (r.key, np.frombuffer(r.value)))
        found = dict(changes.reduceByKey(np.add, CHUNKS + 1).collect())
        change = np.concatenate([found[key].reshape(-1, DIM + 1) for key in range(CHUNKS)])
        net.embed += (change[:, :DIM] / np.maximum(change[:, DIM:], 1)).astype(np.float32)
        done, loss, at = found[CHUNKS][0], found[CHUNKS][1], 2
        for name in names:
            v = net.dense()[name]
            v[...] = (found[CHUNKS][at : at + v.size] / done).reshape(v.shape)
            at += v.size
        shared.destroy()
        if loss / done < ENOUGH:
            break
    dealt.unpersist()
    scored = score(rows.where(check & F.col("lang").isNotNull()).select("text", "lang", "toxic"), (net, {}))
    over = [F.col("tox_score") >= float(t) for t in GRID]
    wrong = F.col("toxic") == 1
    counts = scored.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(wrong).alias("toxic"), F.array(*[F.count_if(o) for o in over]).alias("flagged"), F.array(*[F.count_if(o & wrong) for o in over]).alias("right"))
    return net, {r.lang: _threshold(r.n, np.full(len(GRID), r.toxic), np.array(r.flagged), np.array(r.right)) for r in counts.collect()}


def score(docs: DataFrame, model: tuple[Network, dict[str, float]], names: tuple[str, str] = ("tox_score", "tox_flag")) -> DataFrame:
    """docs with tox_score (0 to 1) and tox_flag (score at or above the language's threshold), in place of columns of these names."""
    net, limits = model
    text_batches(docs.sparkSession)
    added, docs = names, docs.drop(*names)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((net, limits))
    text_at, lang_at = names.index("text"), names.index("lang") if "lang" in names else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by_lang = shared.value
        for part in parts:
            found = own.score(part.column(text_at).to_pylist())
            langs = part.column(lang_at).to_pylist() if lang_at is not None else [None] * len(found)
            limit = np.array([by_lang.get(x, 0.5) if own.prior is None else np.inf for x in langs])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64()), pa.array(found >= limit)], [*part.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.BooleanType())])
    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows the classifier rejects."""
    return score(docs, train(docs, labels), ("__tox_score", "__tox_flag")).where(~F.col("__tox_flag")).select(*[F.col(f"`{c}`") for c in docs.columns])
