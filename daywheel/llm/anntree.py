"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is then placed in a leaf. A query walks the tree with a priority
queue of nodes, ordered by the centre's inner product widened by the node's spread along the query (the strict bound,
with the node's radius, is too loose to order anything), and yields leaves best first.
How many leaves a query visits is calibrated: over a bounded set of calibration queries, whose exact neighbours are
computed against all rows in blocks, visits widen until their recall reaches TARGET. Leaves are searched in chunks of
at most CHUNK rows, so a leaf that holds a third of all rows is many tasks' work.

Nearness is the inner product in double precision; ties go to the smaller id. Defined results: vectors that are null,
zero, empty, of another length than most, or hold null or non-finite components take no part; rows that repeat an id are
candidates each, but never of their own id, and the smallest of their vectors asks; fewer candidates than k give all of them; an empty table gives an empty
result; further columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side

#: Rows the tree is fitted on, at most; every row is indexed.
FIT_ROWS = 20_000
#: Rows a leaf may hold: this many times the root of all rows, so that leaves and visits grow as the root; children of a node.
LEAF_ROOTS, FANOUT = 8.0, 8
MAX_LEAVES = 4096
#: Calibration queries (picked by a hash of their id) and the recall their visits must reach.
CALIBRATION, TARGET = 192, 0.95
CHUNK = 4096
#: Chunks of a leaf that are searched together; a larger leaf is dealt to several such parts.
PART = 64
QUERY_BLOCK = 1024


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").limit(1).collect()
    return rows.where(F.size("v") == (width[0]["w"] if width else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """An array<double> column as rows of a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 12) -> np.ndarray:
    """Labels of x in at most k clusters."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    labels = np.zeros(len(x), np.int64)
    for _ in range(turns):
        near = x @ centres.T - 0.5 * (centres**2).sum(1)
        new = near.argmax(1)
        if (new == labels).all() and _:
            break
        labels = new
        sums = np.zeros_like(centres)
        np.add.at(sums, labels, x)
        count = np.bincount(labels, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return labels


class Tree:
    """Centres and spreads of the nodes; children of each; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, seed: int = 11) -> None:
        self.centre: list[np.ndarray] = []
        self.spread: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, leaf_rows, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, leaf_rows: float, rng: np.random.Generator) -> int:
        node = len(self.centre)
        centre = x.mean(0)
        self.centre.append(centre)
        self.spread.append(float(np.sqrt(((x - centre) ** 2).sum(1).mean() / x.shape[1])))
        self.children.append([])
        self.leaf.append(-1)
        if len(x) > leaf_rows:
            labels = kmeans(x, FANOUT, rng)
            groups = [x[labels == g] for g in np.unique(labels)]
            if len(groups) > 1:
                self.children[node] = [self._grow(g, leaf_rows, rng) for g in groups]
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child, from the root down."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
                continue
            centres = np.stack([self.centre[c] for c in below])
            near = (x[rows] @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            todo += [(c, rows[near == i]) for i, c in enumerate(below) if (near == i).any()]
        return out

    def order(self, q: np.ndarray, limit: int) -> list[int]:
        """The first `limit` leaves of a best-bin-first walk."""
        length = float(np.sqrt(q @ q))
        queue, out = [(0.0, 0)], []
        while queue and len(out) < limit:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                out.append(self.leaf[node])
            for c in below:
                heapq.heappush(queue, (-float(q @ self.centre[c]) - length * self.spread[c], c))
        return out


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Tree | None:
    """A tree of a bounded sample; None without rows."""
    n = rows.count()
    if not n:
        return None
    part = min(1.0, fit_rows / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < max(int(part * (1 << 30)), 1)) if part < 1 else rows
    x = matrix(sample.select("vec_id", "v").toArrow().sort_by("vec_id").column("v").combine_chunks())
    x = x if len(x) else matrix(rows.limit(fit_rows).toArrow().column("v").combine_chunks())
    return Tree(x, max(LEAF_ROOTS * len(x) / np.sqrt(n), len(x) / MAX_LEAVES, 4))


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows with leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.place(matrix(part.column(1))), pa.int64())], ["vec_id", "v", "leaf"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, leaf long")


def parts_of(counts: DataFrame) -> DataFrame:
    """(leaf, part) of every part of every leaf; counts: leaf, c."""
    last = F.ceil(F.ceil(F.col("c") / CHUNK) / PART).cast("int") - 1
    return counts.select("leaf", F.explode(F.sequence(F.lit(0), last)).alias("part"))


def chunked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(leaf, part, ids, vs): the rows of each leaf in chunks of about CHUNK, vectors packed; counts: leaf, c (at most MAX_LEAVES rows).

    Chunks are dealt by a hash of the id, as many as the leaf's count asks for, so no task gathers a whole hot leaf.
    """
    rows = rows.join(F.broadcast(counts), "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.ceil(F.col("c") / CHUNK)))
    packed = rows.groupBy("leaf", "chunk").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
    return packed.select("leaf", F.floor(F.col("chunk") / PART).cast("int").alias("part"), F.transform("rows", lambda r: r["vec_id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("vs"))


def best_of(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, ids, scores) of the k best rows of x for each query, never the query's own id; scores in double precision.

    A fast product selects, with slack for rounding; what it selects is summed again in one order, so that equal vectors
    score equally wherever they stand.
    """
    for a in range(0, len(q), QUERY_BLOCK):
        rough = q[a : a + QUERY_BLOCK] @ x.T
        for i, row in enumerate(rough):
            row = np.where(ids == own[a + i], -np.inf, row)
            m = min(k, len(row))
            edge = np.partition(row, len(row) - m)[len(row) - m]
            slack = 1e-10 * (1 + abs(edge)) if np.isfinite(edge) else 0
            some = np.flatnonzero((row >= edge - slack) & np.isfinite(row))
            score = (x[some] * q[a + i]).sum(1)
            top = some[np.lexsort((ids[some], -score))[:k]]
            yield a + i, ids[top], np.sort(score)[::-1][: len(top)]


def _search(chunks: DataFrame, walks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best rows of each visited chunk. walks: leaf, part, own (query ids), qs (their vectors)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):
                ids, x, own, q = (part.column(c)[i].values.to_numpy() for c in range(4))
                x, q = x.reshape(len(ids), -1), q.reshape(len(own), -1)
                out = [(np.full(len(found), own[row]), found, score) for row, found, score in best_of(q, own, ids, x, k)]
                if out:
                    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    met = chunks.join(walks, ["leaf", "part"]).select("ids", "vs", "own", "qs")
    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, queries: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """The exact neighbours of a bounded set of queries over all rows, block by block."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, own))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, who = shared.value
        for part in parts:
            if len(part):
                for row, found, score in best_of(q, who, part.column(0).to_numpy(), matrix(part.column(1)), k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), who[row])), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return ranked(rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def calibrate(index: DataFrame, tree: Tree, k: int, target: float = TARGET, queries: int = CALIBRATION) -> tuple[int, float]:
    """(leaves to visit, recall of the calibration queries at that many)."""
    n = index.count()
    part = min(1.0, 2 * queries / max(n, 1))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1 << 30))
    # In the order of the draw, not of the id, so that the limit leaves queries from all over the ids.
    some = index.where(drawn < int(part * (1 << 30))).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(drawn, "vec_id").limit(queries).toArrow()
    if not len(some):
        return tree.leaves, 1.0
    q, own = matrix(some.column("v").combine_chunks()), some.column("vec_id").to_numpy()
    truth = exact(index, q, own, k).join(index.select("vec_id", "leaf").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "leaf").toArrow()
    at = {int(o): {leaf: i for i, leaf in enumerate(tree.order(x, tree.leaves))} for o, x in zip(own, q, strict=True)}
    need = np.sort([at[a][b] + 1 for a, b in zip(truth.column("query_id").to_pylist(), truth.column("leaf").to_pylist(), strict=True)])
    if not len(need):
        return tree.leaves, 1.0
    # Visits widen until `target` of all exact neighbours lie in visited leaves.
    visits = int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])
    return visits, float((need <= visits).mean())


def search(vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score, visits, calibrated_recall): the k nearest found of each row that is_query selects."""
    rows = cut(usable(vectors))
    spark = vectors.sparkSession
    tree = fit(rows)
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visits int, calibrated_recall double")
    index = cut(placed(rows, tree))
    visits, recall = calibrate(index, tree, k, target)
    shared = spark.sparkContext.broadcast(tree)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, len(part), QUERY_BLOCK):
                some = part.slice(a, QUERY_BLOCK)
                own, q = some.column(0).to_numpy(), matrix(some.column(1))
                leaves = [shared.value.order(x, visits) for x in q]
                who, leaf = np.repeat(np.arange(len(q)), [len(x) for x in leaves]), np.concatenate(leaves)
                # One row for each leaf that some query of the block visits, with all of these queries.
                groups = [(x, who[leaf == x]) for x in np.unique(leaf)]
                columns = [pa.array([int(x) for x, _ in groups], pa.int64()), pa.array([own[g] for _, g in groups], pa.list_(pa.int64())), pa.array([q[g].ravel() for _, g in groups], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["leaf", "own", "qs"])

    # Of an id that repeats the smallest vector asks, so that reruns agree.
    chosen = index.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    walks = cut(chosen.mapInArrow(run, "leaf long, own array<bigint>, qs array<double>"))
    counts = cut(index.groupBy("leaf").agg(F.count("*").alias("c")))
    side, _ = small_side(cut(parts_of(counts)), 16)  # a row for each leaf and for every CHUNK * PART rows
    walks = walks.join(side, "leaf")
    found = ranked(_search(chunked(index, counts), walks, k), k)
    return found.withColumn("visits", F.lit(visits)).withColumn("calibrated_recall", F.lit(recall))
