"""Window clustering: k-means, rain-guided, thresholds, spectral; held-out rows go to the nearest train centroid.

Rows are (idx, features: array<double>, ...). Labels are columns; fitted state is a small table (cluster, centroid).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Generator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, inheritable_thread_target
from pyspark.core.broadcast import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distance import BLOCK_ROWS, GROUP_BYTES, centroids, normalized_affinity, squared_distance
from .ranks import part_starts
from .shared import beside, shared_dir

N_INIT, SEED = 10, 42
#: Runs of k-means that go side by side.
TOGETHER = 10
#: Up to so many rows an affinity matrix is decomposed on the driver.
DENSE_ROWS = 4096
#: Up to so many rows, whose features are at most GROUP_BYTES, a sigma is one task: shuffles of each product would cost more than the product.
LOCAL_ROWS = 1 << 14
#: Bytes of the affinity's blocks that such a task keeps from one product to the next; it computes the others anew.
KEPT_BYTES = 1 << 28
#: Products with the affinity before an iteration is reported as not converged, and the residual it must reach.
TURNS, RESIDUAL = 300, 1e-6
#: Numbers of the vectors in a task where two groups of rows meet, for sigmas that are iterated together.
SIGMA_NUMBERS = 1 << 24
#: Columns of a block at least: a product costs mostly the affinity. A group's rows are at most those whose features would have STATE_WIDTH numbers.
BLOCK_WIDTH, STATE_WIDTH = 16, 64
#: Squared lengths, in units of 2 sigma**2, up to which single precision is tried first; what Ritz values may be off then.
FAST_LENGTH, FAST_OFF = 500.0, 1e-4
#: Products without half the residual before that end single precision.
STALLED = 10
#: Products after which the vectors' lineage is cut.
CUT_TURNS = 3
#: Sigmas whose vectors a search keeps, to start from.
WARM = 4
NO_EDGES = "degenerate affinity: no edges"


def nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows with cluster: the nearest centroid by squared distance, the lowest id on ties. centres: (cluster, centroid), k rows."""
    all_centres = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("_centres"))
    rows = rows.crossJoin(F.broadcast(all_centres))
    ranked = F.transform("_centres", lambda c: F.struct(squared_distance(F.col("features"), c["centroid"]).alias("d"), c["cluster"].alias("cluster")))
    return rows.withColumn("cluster", F.array_min(ranked)["cluster"]).drop("_centres")


def kmeans(rows: DataFrame, k: int, n_init: int = N_INIT, seed: int = SEED) -> tuple[DataFrame, float]:
    """(centroids, cost) of the best of n_init runs; clusters are numbered by their centroids' order.

    Runs go side by side: their many short jobs share the cores.
    """
    data = rows.select(array_to_vector("features").alias("features")).cache()
    data.count()

    def fit(turn: int) -> tuple[float, int, list]:
        model = KMeans(k=k, seed=seed + turn, maxIter=100, tol=1e-6).fit(data)
        return model.summary.trainingCost, turn, model.clusterCenters()

    with ThreadPool(max(1, min(n_init, TOGETHER))) as pool:
        cost, _, best = min(pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(n_init)), key=lambda run: run[:2])
    data.unpersist()
    found = sorted([float(x) for x in c] for c in best)
    return rows.sparkSession.createDataFrame(list(enumerate(found)), "cluster int, centroid array<double>"), cost


def threshold_labels(level: Column, thresholds: list[float]) -> Column:
    """The number of thresholds below a level."""
    if not thresholds or thresholds[0] != 0:
        raise ValueError("the first threshold must be 0")
    return sum((F.when(level > float(t), 1).otherwise(0) for t in thresholds), F.lit(0)).cast("int")


def check_rain(rows: DataFrame, k: int, tolerance: float = 0.0, rain: str = "rain") -> None:
    if k < 2:
        raise ValueError("at least two clusters are needed")
    if tolerance < 0:
        raise ValueError("the tolerance can't be negative")
    y = F.col(rain)
    negative, zero, wet, bad = rows.agg(
        F.count(F.when(y < 0, 1)),
        F.count(F.when(F.abs(y) <= tolerance, 1)),
        F.count(F.when(y > tolerance, 1)),
        F.count(F.when(F.exists("features", lambda x: x.isNull() | F.isnan(x)), 1)),
    ).first()
    if bad:
        raise ValueError("features must be finite")
    if negative:
        raise ValueError("known rain can't be negative")
    if not zero:
        raise ValueError("at least one known dry row is needed")
    if wet < k - 1:
        raise ValueError(f"at least {k - 1} known rainy rows are needed, there are {wet}")


def rain_known(rows: DataFrame, k: int, tolerance: float = 0.0, rain: str = "rain", keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with cluster: 0 for known dry rows, 1..k-1 for known rainy ones in even parts by rain, then idx (one for each row of a group); null where rain is unknown."""
    y = F.col(rain)
    group = list(keys) or ["_every"]
    rows_ = rows if keys else rows.withColumn("_every", F.lit(0))
    starts, few = part_starts(rows_.where(y > tolerance), k - 1, [rain, "idx"], group)
    met = beside(rows_, starts, group, few, "left")
    own = F.struct(rain, "idx")
    part = 1 + F.coalesce(F.size(F.filter("starts", lambda s: s <= own)), F.lit(0))
    wet = F.coalesce(y > tolerance, F.lit(False))
    part = F.when(F.abs(y) <= tolerance, 0).when(wet, F.when(F.col("starts").isNull(), 1).otherwise(part)).cast("int")
    return met.withColumn("cluster", part).drop("starts", *([] if keys else ["_every"]))


def rain_guided(rows: DataFrame, k: int, tolerance: float = 0.0, rain: str = "rain") -> tuple[DataFrame, DataFrame]:
    """(rows with cluster, centroids): as rain_known, rows of unknown rain going to the nearest centroid of the known ones."""
    labelled = rain_known(rows, k, tolerance, rain)
    centres = centroids(labelled.where("cluster is not null"), "cluster")
    guess = nearest(labelled.withColumnRenamed("cluster", "_known"), centres)
    return guess.withColumn("cluster", F.coalesce("_known", "cluster")).select(*labelled.columns), centres


def rain_ranges(labelled: DataFrame, rain: str = "rain") -> DataFrame:
    return labelled.where(F.col(rain).isNotNull()).groupBy("cluster").agg(F.min(rain).alias("low"), F.max(rain).alias("high"))


def train_centroids(train: DataFrame, k: int, label: str = "cluster") -> DataFrame:
    """Mean centroids of labelled train rows; every cluster must have some."""
    centres = centroids(train, label)
    if centres.count() < k:
        raise ValueError("a cluster has no train rows")
    return centres


def embedding(rows: DataFrame, sigma: float, k: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(idx, row-normalised top-k eigenvectors, eigenvalues) of the normalised affinity; rows of zeros stay."""
    idx = [r.idx for r in rows.select("idx").orderBy("idx").collect()]
    n = len(idx)
    if not 0 < k <= n:
        raise ValueError("k must lie between 1 and the number of rows")
    if n <= DENSE_ROWS:
        edges = normalized_affinity(rows, sigma)
        at = {v: i for i, v in enumerate(idx)}
        found = edges.toArrow()
        i = np.fromiter((at[v] for v in found.column("i").to_pylist()), np.int64, len(found))
        j = np.fromiter((at[v] for v in found.column("j").to_pylist()), np.int64, len(found))
        matrix = np.zeros((n, n))
        matrix[i, j] = matrix[j, i] = found.column("w").to_numpy()
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    else:
        [(values, made, short)] = block_spectra(rows, [sigma], k, vectors=True)
        if made is None:
            raise ArithmeticError(short)
        parts = _points(made).values().collect()
        order = np.argsort(np.concatenate([i for i, _ in parts]), kind="stable")
        return idx, np.concatenate([v for _, v in parts])[order], values
    return idx, _unit(signed(vectors)), values


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest magnitude is positive."""
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def _leading(n: int, k: int, turns: int, tol: float, seed: int = 0, ritz: list[np.ndarray] | None = None, start: np.ndarray | None = None) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, str]]:
    """Top k eigenpairs of a symmetric n x n matrix: yields blocks, is sent the matrix's products with them; returns (values, vectors, why not converged).

    Block Lanczos with full orthogonalisation, restarted from the leading Ritz vectors. It ends when the residuals of all
    k pairs, which bound the errors of the values, are under tol. ritz gets the values after each product: none is over its
    eigenvalue. start: vectors to begin with, such as those of a matrix nearby.
    """
    width = min(n, k + 4)
    limit = min(n, 12 * width)
    first = np.random.default_rng(seed).normal(size=(n, width))
    if start is not None:
        first[:, : start.shape[1]] = start
    q, _ = np.linalg.qr(first)
    basis, images, far = np.empty((n, 0)), np.empty((n, 0)), np.inf
    for _ in range(turns):
        y = yield q
        basis, images = np.hstack([basis, q]), np.hstack([images, y])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn[:, :k]
        if ritz is not None:
            ritz.append(values[:k])
        far = float(np.linalg.norm(images @ turn[:, :k] - vectors * values[:k], axis=0).max())
        if far < tol or basis.shape[1] == n:
            return values[:k], vectors, ""
        for _ in range(2):
            y = y - basis @ (basis.T @ y)
        u, size, _ = np.linalg.svd(y, full_matrices=False)
        q = u[:, size > 1e-12][:, : n - basis.shape[1]]
        if not q.shape[1]:  # the blocks span an invariant subspace: go on from another start outside it
            q = np.random.default_rng(seed + basis.shape[1]).normal(size=(n, min(width, n - basis.shape[1])))
        for _ in range(2):
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        # Not before q: it has to be orthogonal to what is let go as well.
        if basis.shape[1] + width > limit and limit < n:
            kept = turn[:, : limit // 2]
            basis, images = basis @ kept, images @ kept
    return values[:k], vectors, f"not converged: residual {far:.1e} after {turns} products"


def subspace(edges: DataFrame, idx: list[int], k: int, turns: int = TURNS, tol: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """Top eigenpairs by block iteration: the product with the matrix is a grouped sum, only n x k numbers meet on the driver."""
    spark = edges.sparkSession
    at = {v: i for i, v in enumerate(idx)}
    both = edges.union(edges.select("j", "i", "w")).persist()
    run, y = _leading(len(idx), k, turns, tol), None
    try:
        while True:
            q = run.send(y)
            side = spark.createDataFrame([(v, q[i].tolist()) for v, i in at.items()], "j long, q array<double>")
            parts = both.join(F.broadcast(side), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col("q")[c]).alias(f"y{c}") for c in range(q.shape[1])])
            y = np.zeros_like(q)
            for r in parts.toLocalIterator():
                y[at[r[0]]] = r[1:]
    except StopIteration as end:
        values, vectors, short = end.value
    both.unpersist()
    if short:
        warnings.warn(short, stacklevel=2)
    return values, vectors


def _own(key: int) -> int:
    """Partition of a key that numbers it."""
    return key


def _in_groups(rows: DataFrame, groups: int) -> RDD:
    """(group, (idx, features)) of each group of rows, in order of idx."""
    dealt = rows.select(F.col("idx").cast("long").alias("idx"), "features", F.pmod(F.xxhash64("idx"), F.lit(groups)).cast("int").alias("_g"))

    def pack(parts):
        held = list(parts)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        group, idx = table.column("_g").to_numpy(), table.column("idx").to_numpy()
        x = np.asarray(table.column("features").combine_chunks().flatten(), np.float64).reshape(len(table), -1)
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(group)], strict=True):
            yield pa.RecordBatch.from_pydict({"g": pa.array(group[a : a + 1]), "idx": pa.array([idx[a:b].tobytes()], pa.binary()), "x": pa.array([x[a:b].tobytes()], pa.binary())})

    def unpacked(row) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
        idx = np.frombuffer(row.idx, np.int64)
        return row.g, (idx, np.frombuffer(row.x, np.float64).reshape(len(idx), -1))

    return dealt.repartitionById(groups, "_g").sortWithinPartitions("_g", "idx").mapInArrow(pack, "g int, idx binary, x binary").rdd.map(unpacked)


def _tile_sums(x: list[np.ndarray], sides: list[dict[int, np.ndarray]], same: bool, scales: list[float], kind: type, kept: dict | None = None) -> list[dict[int, np.ndarray]]:
    """The affinity between two groups of rows (or within one) times the sides of each, at each scale, a pair of blocks at a time.

    kept: blocks of the first scale, up to KEPT_BYTES, for further calls with the same rows, scale and kind.
    """
    first, alone = scales[min(sides[0])], len(sides[0]) == 1
    # A product whose two last columns take the squared lengths off: the exponents at the first scale. Both sides are rounded alike.
    x = [(v * np.sqrt(-2 * first)).astype(kind) for v in x]
    low = [-0.5 * (v.astype(np.float64) ** 2).sum(1)[:, None].astype(kind) for v in x]
    one = np.hstack([x[0], low[0], np.ones_like(low[0])])
    two = np.ascontiguousarray(np.hstack([x[1], np.ones_like(low[1]), low[1]]).T)
    sides = [{s: q.astype(kind) for s, q in side.items()} for side in sides]
    out = [{s: np.zeros((len(x[i]), q.shape[1])) for s, q in sides[1 - i].items()} for i in (0, 1)]
    for at in range(0, len(x[0]), BLOCK_ROWS):
        a = slice(at, at + BLOCK_ROWS)
        for other in range(at if same else 0, len(x[1]), BLOCK_ROWS):
            b = slice(other, other + BLOCK_ROWS)
            w = kept.get((at, other)) if kept else None
            if w is None:
                far = one[a] @ two[:, b]
                np.minimum(far, 0, out=far)
            for s in sides[0]:
                if w is None or not alone:
                    w = far if alone else far * kind(scales[s] / first)
                    np.exp(w, out=w)
                    if same and at == other:
                        np.fill_diagonal(w, 0)
                    if kept is not None and alone and (len(kept) + 1) * w.nbytes <= KEPT_BYTES:
                        kept[at, other] = w
                if not (same and at == other):
                    out[1][s][b] += w.T @ sides[0][s][a]
                out[0][s][a] += w @ sides[1][s][b]
    return [{s: out[0][s] + out[1][s] for s in out[0]}] if same else out


class _Pairs:
    """Rows of a table in groups, each sent once to every task where two groups meet; products with their affinities.

    Features and vectors stay on the executors, a block for each group; the driver sees counts only.
    """

    def __init__(self, rows: DataFrame) -> None:
        self.spark = rows.sparkSession
        sc = self.spark.sparkContext
        square = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
        n, width, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
        self.n, self.longest = n, longest
        self.groups = max(1, min(-(-n // BLOCK_ROWS), int(np.ceil(np.sqrt(8 * sc.defaultParallelism)))), -(-n * max(width, STATE_WIDTH) * 8 // GROUP_BYTES))
        self.home = _in_groups(rows, self.groups).persist(StorageLevel.MEMORY_AND_DISK)
        groups = self.groups
        self.met = self.home.flatMap(lambda item: [(t, (side, item[0], -1, item[1][1])) for t, side in _meetings(item[0], groups)]).partitionBy(groups * (groups + 1) // 2, _own)

    def times(self, sides: RDD, sigmas: list[float], kind: type) -> RDD:
        """sides: (group * number of sigmas + sigma's place, vectors); the affinity at each sigma times its vectors, keyed the same."""
        groups, many = self.groups, len(sigmas)
        scales = [-0.5 / s**2 for s in sigmas]

        def run(items):
            x, q = {}, {}
            for t, (side, group, s, value) in items:
                if s < 0:
                    x.setdefault(t, {})[side] = group, value
                else:
                    q.setdefault(t, {}).setdefault(side, {})[s] = value
            for t in q:
                own = [2, 2] if 2 in x[t] else [0, 1]
                if not all(side in x[t] and side in q[t] for side in own):
                    continue
                found = _tile_sums([x[t][side][1] for side in own], [q[t][side] for side in own], own[0] == 2, scales, kind)
                for side, sums in zip(own, found, strict=False):
                    for s, y in sums.items():
                        yield x[t][side][0] * many + s, y

        sent = sides.flatMap(lambda item: [(t, (side, item[0] // many, item[0] % many, item[1])) for t, side in _meetings(item[0] // many, groups)]).partitionBy(groups * (groups + 1) // 2, _own)
        both = self.met.union(sent)
        # Partitioned alike, both are read side by side: features aren't shuffled again.
        assert both.getNumPartitions() == self.met.getNumPartitions()
        return both.mapPartitions(run).reduceByKey(np.add, groups * many, _own)

    def close(self) -> None:
        self.home.unpersist()


def _meetings(group: int, groups: int) -> list[tuple[int, int]]:
    """(task, side) of each task that a group is sent to; side 2: it meets itself."""
    out = []
    for other in range(groups):
        p, q = min(group, other), max(group, other)
        out.append((p * groups - p * (p - 1) // 2 + q - p, 2 if p == q else 0 if p == group else 1))
    return out


class _Ritz:
    """The driver's part of a block Lanczos run on vectors that lie in groups: only their inner products are known here.

    basis (b) and images (A b) are columns on the executors. step gets the products of the newest block with all columns
    and returns what the executors shall do next. Overlaps are measured, so bases needn't be orthogonal to the last digit.
    Products are in single precision (fast) until the residual is under a quarter of tol; then the vectors are the start
    of a run in double precision, whose own residual must be under tol: the result never hangs on single precision.
    """

    def __init__(self, n: int, k: int, turns: int, tol: float, fast: bool) -> None:
        self.n, self.k, self.turns, self.tol, self.fast = n, k, turns, tol, fast
        self.width = min(n, max(k + 4, BLOCK_WIDTH))
        self.limit = min(n, 8 * self.width)
        self.made, self.newest = 0, self.width
        self.values, self.short = np.empty(0), ""
        self.least, self.tol_fast = (np.inf, 0), tol / 4
        self.reset()

    def reset(self) -> None:
        self.s = self.h = self.i = np.empty((0, 0))

    def step(self, s: np.ndarray, h: np.ndarray, i: np.ndarray, back: np.ndarray) -> dict:
        """s, h, i, back: basis' q, basis' y, images' y and images' q for the newest q and y = A q, with themselves last."""
        self.made += 1
        m, w = s.shape
        # basis' y and images' q differ by what single precision is off; their mean keeps the residual's squares exact.
        for name, new in (("s", s), ("h", (h + back) / 2), ("i", i)):
            both = np.zeros((m, m))
            both[: m - w, : m - w] = getattr(self, name)
            both[:, m - w :] = new
            both[m - w :, :] = new.T
            both[m - w :, m - w :] = (new[m - w :] + new[m - w :].T) / 2
            setattr(self, name, both)
        size, turn = np.linalg.eigh(self.s)
        sure = size > 1e-10 * size[-1]
        white = turn[:, sure] / np.sqrt(size[sure])
        values, turn = np.linalg.eigh(white.T @ self.h @ white)
        values, coef = values[::-1], (white @ turn)[:, ::-1]
        top = coef[:, : self.k]
        self.values = values[: self.k]
        square = (top * (self.i @ top)).sum(0) - 2 * self.values * (top * (self.h @ top)).sum(0) + self.values**2 * (top * (self.s @ top)).sum(0)
        far = float(np.sqrt(np.maximum(square, 0)).max())
        if far < self.least[0] / 2:
            self.least = far, self.made
        # Single precision may leave more than that: where the residual no longer falls, double has to go on.
        if self.fast and far < FAST_OFF and self.made - self.least[1] >= STALLED:
            self.tol_fast = np.inf
        near = len(self.values) == self.k and (far < (self.tol_fast if self.fast else self.tol) or m >= self.n)
        if near and not self.fast:
            return {"done": top}
        if self.made >= self.turns:
            self.short = f"not converged: residual {far:.1e} after {self.turns} products"
            return {"done": top}
        image = h
        inside = white @ (white.T @ image)
        rest = self.i[m - w :, m - w :] - image.T @ inside
        size, turn = np.linalg.eigh((rest + rest.T) / 2)
        # What is less is lost in the digits of these differences.
        sure = size > max(1e-13 * np.abs(np.diag(self.i)[m - w :]).max(), 1e-26)
        if near or (self.fast and not sure.any()):
            self.fast = False
            self.reset()
            return {"start": coef[:, : self.width]}
        if not sure.any():
            self.short = f"not converged: residual {far:.1e}, and no direction left to go"
            return {"done": top}
        turn = (turn[:, sure] / np.sqrt(size[sure]))[:, ::-1][:, : self.n - m]
        plan = {"image": turn, "basis": -inside @ turn}
        if m + turn.shape[1] > self.limit and self.limit < self.n:
            plan["kept"] = kept = coef[:, : self.limit // 2]
            self.s, self.h, self.i = (kept.T @ g @ kept for g in (self.s, self.h, self.i))
        return plan


def _moved(state: tuple, plan: dict) -> tuple:
    """(root, basis with the next block, images) of a group by the driver's plan."""
    root, basis, images = state
    if "start" in plan:
        return root, basis @ plan["start"], images[:, :0]
    w = plan["image"].shape[0]
    q = images[:, images.shape[1] - w :] @ plan["image"] + basis @ plan["basis"]
    if "kept" in plan:
        basis, images = basis @ plan["kept"], images @ plan["kept"]
    return root, np.hstack([basis, q]), images


def _inner(basis: np.ndarray, images: np.ndarray, newest: int) -> tuple[np.ndarray, ...]:
    """What _Ritz.step is told, of some rows."""
    y, q = images[:, images.shape[1] - newest :], basis[:, basis.shape[1] - newest :]
    return basis.T @ q, basis.T @ y, images.T @ y, images.T @ q


def local_spectrum(x: np.ndarray, sigma: float, k: int, turns: int = TURNS, tol: float = RESIDUAL, lead: float = 0.0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, str]:
    """As block_spectra at one sigma, of rows that lie in one place; lead: the largest gap of other sigmas, which ends one that can't reach it."""
    n, scale = len(x), -0.5 / sigma**2
    degree = _tile_sums([x, x], [{0: np.ones((n, 1))}] * 2, True, [scale], np.float64)[0][0]
    root = np.divide(1, np.sqrt(degree), out=np.zeros_like(degree), where=degree > 0)
    if not root.any():
        return np.zeros(k), None, NO_EDGES
    run = _Ritz(n, k, turns, tol, (x * x).sum(1).max() * 0.5 / sigma**2 < FAST_LENGTH)
    q = np.random.default_rng(0).normal(size=(n, run.width)) / np.sqrt(n)
    if start is not None:
        q[:, : start.shape[1]] = start
    state, kept = (root, q, np.empty((n, 0))), {}
    while True:
        _, basis, images = state
        kept = kept if run.fast else None
        q = root * basis[:, images.shape[1] :]
        y = root * _tile_sums([x, x], [{0: q}] * 2, True, [scale], np.float32 if run.fast else np.float64, kept)[0][0]
        images = np.hstack([images, y])
        plan = run.step(*_inner(basis, images, y.shape[1]))
        if "done" in plan:
            return run.values, None if run.short else basis @ plan["done"], run.short
        if lead and _behind(run, lead):
            return np.zeros(k), None, _left(run, lead)
        state = _moved((root, basis, images), plan)


def _behind(run: _Ritz, lead: float) -> bool:
    """No gap of a sigma is over 1 less its last Ritz value: whether that is under the largest gap found."""
    return len(run.values) == run.k and 1 - run.values[-1] + (FAST_OFF if run.fast else 2 * run.tol) < lead


def _left(run: _Ritz, lead: float) -> str:
    return f"no gap is over {1 - run.values[-1]:.1e}, another sigma has {lead:.1e}"


def _is_local(n: int, width: int) -> bool:
    return n <= LOCAL_ROWS and n * width * 8 <= GROUP_BYTES


def _matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(idx, features) in order of idx."""
    table = rows.select(F.col("idx").cast("long").alias("idx"), "features").toArrow().sort_by("idx").combine_chunks()
    return table.column("idx").to_numpy(), np.asarray(table.column("features").combine_chunks().flatten(), np.float64).reshape(len(table), -1)


def local_spectra(sc: SparkContext, shared: Broadcast, sigmas: list[float], k: int, race: bool = False, warm: dict[float, np.ndarray] | None = None) -> list[tuple[np.ndarray, str]]:
    """(top k eigenvalues, why not) at each sigma, each a task over the broadcast features. race: as block_spectra.

    warm, if given, holds vectors of sigmas to start from, and gets those found.
    """
    order, found, lead = sorted(sigmas, reverse=True), {}, 0.0
    together = max(1, sc.defaultParallelism) if race else max(1, len(sigmas))
    for at in range(0, len(order), together):
        part = order[at : at + together]
        starts = {s: warm[min(warm, key=lambda other: abs(other - s))] for s in part} if warm else {}
        sent = sc.broadcast(starts)
        back = warm is not None

        def run(sigma, sent=sent, lead=lead, back=back):
            values, vectors, short = local_spectrum(shared.value, sigma, k, lead=lead, start=sent.value.get(sigma))
            return values, vectors.astype(np.float32) if back and vectors is not None else None, short

        for sigma, (values, vectors, short) in zip(part, sc.parallelize(part, len(part)).map(run).collect(), strict=True):
            found[sigma] = values, short
            if vectors is not None:
                warm.pop(sigma, None)
                warm[sigma] = vectors
            if race and not short:
                lead = max(lead, gaps(values, k - 1)[2] or 0.0)
        sent.unpersist()
        while warm and len(warm) > max(WARM, len(part)):
            warm.pop(next(iter(warm)))
    return [found[s] for s in sigmas]


def block_spectra(rows: DataFrame, sigmas: list[float], k: int, turns: int = TURNS, tol: float = RESIDUAL, race: bool = False, held: dict | None = None, vectors: bool = False) -> list[tuple[np.ndarray, RDD | None, str]]:
    """(top k eigenvalues, vectors, why not) of the normalised affinity at each sigma; vectors, if asked for: (group, (idx, n x k numbers)).

    race: only the sigma of the largest gap is asked for. No eigenvalue is over 1 nor under its Ritz value, so no gap of a
    sigma is over 1 less its last Ritz value: one that can't reach the largest gap found is left. Large sigmas, which
    converge soon, come first. held keeps, from one call to the next, the rows in groups and the last vectors, which the
    nearest sigmas start from.

    The matrix is never held: each product computes it anew, a pair of blocks of BLOCK_ROWS at a time, once for all sigmas.
    Vectors are spread by group like the rows; the driver gets inner products of columns, whose number doesn't grow with
    the rows. Without edges the values are 0.
    """
    held = {} if held is None else held
    keep = bool(held)
    if "pairs" not in held:
        held["pairs"] = _Pairs(rows)
    pairs, warm = held["pairs"], held.setdefault("warm", {})
    shared_dir(pairs.spark)
    n, width = pairs.n, min(pairs.n, max(k + 4, BLOCK_WIDTH))
    together = max(1, SIGMA_NUMBERS // (-(-n // pairs.groups) * 4 * width))
    order, lead = sorted(sigmas, reverse=True) if race else sigmas, 0.0
    found: dict[float, tuple[np.ndarray, RDD | None, str]] = {}
    for at in range(0, len(sigmas), together):
        part = order[at : at + together]
        many = len(part)
        ones = pairs.home.flatMap(lambda item, many=many: [(item[0] * many + s, np.ones((len(item[1][0]), 1))) for s in range(many)])
        degree = pairs.times(ones, part, np.float64)
        root = degree.mapValues(lambda d: np.divide(1, np.sqrt(d), out=np.zeros_like(d), where=d > 0)).persist(StorageLevel.MEMORY_AND_DISK)
        edged = {e % many for e, some in root.mapValues(lambda x: bool(x.any())).collect() if some}
        runs = {s: _Ritz(n, k, turns, tol, pairs.longest * 0.5 / part[s] ** 2 < FAST_LENGTH) for s in edged}
        for s in set(range(many)) - edged:
            found[part[s]] = np.zeros(k), None, NO_EDGES

        def first(items, many=many, width=width):
            roots, starts = {}, {}
            for e, (name, value) in items:
                (roots if name == "root" else starts)[e] = value
            for e, x in roots.items():
                q = np.random.default_rng([0, e // many]).normal(size=(len(x), width)) / np.sqrt(n)
                if e in starts:
                    q[:, : starts[e].shape[1]] = starts[e]
                yield e, (x, q, np.empty((len(x), 0)))

        parts = root.getNumPartitions()
        begin = root.mapValues(lambda x: ("root", x))
        for s in edged if warm else ():
            near = warm[min(warm, key=lambda other: abs(other - part[s]))]
            begin = begin.union(near.map(lambda item, s=s, many=many: (item[0] * many + s, ("start", item[1][1]))).partitionBy(pairs.groups * many, _own))
            assert begin.getNumPartitions() == parts
        state, last = begin.mapPartitions(first, True), None
        while runs:
            going, fast = set(runs), {s for s in runs if runs[s].fast}
            images = None
            for some, kind in ((fast, np.float32), (going - fast, np.float64)):
                if some:
                    sides = state.filter(lambda item, some=some, many=many: item[0] % many in some).mapValues(lambda v: v[0] * v[1][:, v[2].shape[1] :])
                    made = pairs.times(sides, part, kind)
                    images = made if images is None else images.union(made)

            def merged(items):
                states, products = {}, {}
                for e, value in items:
                    (states if isinstance(value, tuple) else products)[e] = value
                for e, (root, basis, images) in states.items():
                    if e in products:
                        yield e, (root, basis, np.hstack([images, root * products[e]]))

            both = state.union(images)
            assert both.getNumPartitions() == parts
            now = both.mapPartitions(merged, True).persist(StorageLevel.MEMORY_AND_DISK)
            if max(run.made for run in runs.values()) % CUT_TURNS == CUT_TURNS - 1:
                now.checkpoint()

            sums: dict[int, list[np.ndarray]] = {}
            newest = {s: run.newest for s, run in runs.items()}
            for s, inners in now.map(lambda item, newest=newest, many=many: (item[0] % many, _inner(*item[1][1:], newest[item[0] % many]))).collect():
                sums[s] = [a + b for a, b in zip(sums[s], inners, strict=True)] if s in sums else list(inners)
            if last is not None:
                last.unpersist()
            last, plans = now, {}
            for s, inners in sums.items():
                run = runs[s]
                plan = run.step(*inners)
                sigma = part[s]
                if "done" in plan:
                    made = None
                    if not run.short and (vectors or race or keep):
                        own = now.filter(lambda item, s=s, many=many: item[0] % many == s).map(lambda item, top=plan["done"], many=many: (item[0] // many, item[1][1] @ top))
                        made = pairs.home.mapValues(lambda v: v[0]).union(own).groupByKey(pairs.groups, _own).mapValues(_beside).persist(StorageLevel.MEMORY_AND_DISK)
                        made.count()
                    found[sigma] = run.values, made, run.short
                    if not run.short:
                        if race or keep:
                            warm.pop(sigma, None)
                            warm[sigma] = made
                            while len(warm) > WARM:
                                warm.pop(next(iter(warm))).unpersist()
                        lead = max(lead, gaps(run.values, k - 1)[2] or 0.0)
                    del runs[s]
                else:
                    plans[s] = plan
                    run.newest = (plan["start"] if "start" in plan else plan["image"]).shape[1]
            for s in [s for s in runs if race and _behind(runs[s], lead)]:
                found[part[s]] = np.zeros(k), None, _left(runs[s], lead)
                del runs[s], plans[s]
            state = now.filter(lambda item, plans=plans, many=many: item[0] % many in plans).map(lambda item, plans=plans, many=many: (item[0], _moved(item[1], plans[item[0] % many])), True)
        if last is not None:
            last.unpersist()
        root.unpersist()
    if not keep and not vectors:
        pairs.close()
    return [found[s] for s in sigmas]


def _beside(values) -> tuple[np.ndarray, np.ndarray]:
    """(idx, vectors) of a group from both in any order."""
    one, two = values
    return (one, two) if one.ndim == 1 else (two, one)


def _points(made: RDD) -> RDD:
    """(idx, vectors) of each group, columns signed and rows normalised, from those of block_spectra."""

    def largest(item):
        v = item[1][1]
        return v[np.abs(v).argmax(0), np.arange(v.shape[1])]

    top = made.map(largest).reduce(lambda a, b: np.where((np.abs(a) > np.abs(b)) | ((np.abs(a) == np.abs(b)) & (a > b)), a, b))
    sign = np.where(top < 0, -1.0, 1.0)
    return made.mapValues(lambda v: (v[0], _unit(v[1] * sign)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def spectral(rows: DataFrame, sigma: float, k: int, seed: int = SEED) -> DataFrame:
    """rows with cluster: k-means on the spectral embedding; up to DENSE_ROWS rows it is made on the driver, else it stays spread."""
    spark = rows.sparkSession
    if rows.count() <= DENSE_ROWS:
        idx, vectors, _ = embedding(rows, sigma, k)
        points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(idx, vectors, strict=True)], "idx long, features array<double>")
    else:
        points = spread_embedding(rows, sigma, k)
    centres, _ = kmeans(points, k, seed=seed)
    return rows.join(nearest(points, centres).select("idx", "cluster"), "idx")


def spread_embedding(rows: DataFrame, sigma: float, k: int) -> DataFrame:
    """(idx, features): rows of embedding, of any number; their vectors don't go through the driver."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    if _is_local(n, width):
        sc = rows.sparkSession.sparkContext
        shared = sc.broadcast(_matrix(rows))

        def solved(sigma):
            idx, x = shared.value
            _, vectors, short = local_spectrum(x, sigma, k)
            return (idx.tobytes(), _unit(signed(vectors)).tobytes(), "") if vectors is not None else (b"", b"", short)

        packed = sc.parallelize([float(sigma)], 1).map(solved).persist(StorageLevel.MEMORY_AND_DISK)
        [short] = packed.map(lambda item: item[2]).collect()
        packed = packed.map(lambda item: item[:2])
    else:
        [(_, made, short)] = block_spectra(rows, [sigma], k, vectors=True)
        packed = None if made is None else _points(made).map(lambda item: (item[1][0].tobytes(), item[1][1].tobytes()))
    if short:
        raise ArithmeticError(short)

    def run(parts):
        for part in parts:
            for idx, x in zip(part.column("idx"), part.column("x"), strict=True):
                idx, x = np.frombuffer(idx.as_py(), np.int64), np.frombuffer(x.as_py(), np.float64)
                for a in range(0, len(idx), 1 << 14):
                    some = idx[a : a + (1 << 14)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * k), pa.array(x[a * k : (a + len(some)) * k]))
                    yield pa.RecordBatch.from_arrays([pa.array(some), lists], ["idx", "features"])

    return rows.sparkSession.createDataFrame(packed, "idx binary, x binary").mapInArrow(run, "idx long, features array<double>")


ALGORITHMS = ("kmeans", "spectral", "manual")


def cluster(rows: DataFrame, k: int, algorithm: str = "kmeans", sigma: float | None = None, tolerance: float = 0.0, rain: str = "rain", seed: int = SEED) -> DataFrame:
    """rows with cluster, by the algorithm's name."""
    if algorithm == "kmeans":
        return nearest(rows, kmeans(rows, k, seed=seed)[0])
    if algorithm == "spectral":
        if sigma is None:
            raise ValueError("spectral clustering needs sigma")
        return spectral(rows, sigma, k, seed)
    if algorithm == "manual":
        if rain not in rows.columns:
            raise ValueError("manual clustering needs the horizon's rain")
        check_rain(rows, k, tolerance, rain)
        return rain_guided(rows, k, tolerance, rain)[0]
    raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")


def assign_splits(samples: DataFrame, k: int, algorithm: str = "kmeans", sigma: float | None = None, tolerance: float = 0.0, rain: str = "rain", seed: int = SEED) -> DataFrame:
    """samples (with split) with cluster: fitted on train rows, held-out rows at the nearest train centroid."""
    train = samples.where("split = 'train'")
    if train.count() < k:
        raise ValueError("fewer train rows than clusters")
    if algorithm == "kmeans":
        return nearest(samples, kmeans(train, k, seed=seed)[0])
    labelled = cluster(train, k, algorithm, sigma, tolerance, rain, seed)
    held = nearest(samples.where("split != 'train'"), train_centroids(labelled, k))
    return labelled.unionByName(held.select(*labelled.columns))


# Bandwidth selection by eigengap.


def merged_sigmas(*lists: list[float]) -> list[float]:
    """The values in order of size, without repeats to a relative 1e-12."""
    out: list[float] = []
    for v in sorted(float(x) for values in lists for x in values):
        if not np.isfinite(v) or v <= 0:
            raise ValueError("sigmas must be positive and finite")
        if not out or abs(v - out[-1]) > 1e-12 * max(abs(v), abs(out[-1])):
            out.append(v)
    return out


def gaps(eigenvalues: np.ndarray, max_gaps: int = 20) -> tuple[list[float], int | None, float | None, str]:
    """(gaps, best k, best gap, warning): gap k lies between the k-th and the next eigenvalue; k = 1 doesn't count."""
    values = np.asarray(eigenvalues, float)
    count = min(max_gaps, len(values) - 1)
    found = [float(values[i] - values[i + 1]) for i in range(count)]
    if len(found) < 2:
        return found, None, None, "only one gap is available"
    best = int(np.argmax(found[1:])) + 1
    return found, best + 1, found[best], ""


def eigengaps(features: np.ndarray, sigma: float, max_gaps: int = 20) -> dict:
    """Gaps of the normalised affinity of a small matrix of rows."""
    x = np.asarray(features, float)
    n = len(x)
    count = min(max_gaps, n - 1)
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    square = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)
    w = np.exp(-square / (2 * sigma**2))
    np.fill_diagonal(w, 0)
    degree = w.sum(1)
    if not (w > 0).any():
        return {"sigma": sigma, "eigenvalues": [0.0] * (count + 1), "gaps": [0.0] * count, "best_k": None, "best_gap": None, "warning": NO_EDGES}
    root = np.divide(1, np.sqrt(degree), out=np.zeros(n), where=degree > 0)
    values = np.linalg.eigvalsh(root[:, None] * w * root)[::-1][: count + 1]
    found, best, gap, warning = gaps(values, max_gaps)
    return {"sigma": sigma, "eigenvalues": values.tolist(), "gaps": found, "best_k": best, "best_gap": gap, "warning": warning}


def row_eigengaps(rows: DataFrame, sigmas: list[float], max_gaps: int = 20, race: bool = False, held: dict | None = None) -> list[dict]:
    """As eigengaps, of any number of rows at each sigma: dense, a task per sigma, up to DENSE_ROWS, else block by block: a task per sigma up to LOCAL_ROWS.

    Where the block iteration doesn't converge, or a sigma is surely not that of the largest gap and race is set, values
    and gaps are 0 and the warning says so.
    """
    held = {} if held is None else held
    keep, sc = bool(held), rows.sparkSession.sparkContext
    if "n" not in held:
        held["n"], held["width"] = rows.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    n = held["n"]
    if (n <= DENSE_ROWS or _is_local(n, held["width"])) and "shared" not in held:
        held["shared"] = sc.broadcast(_matrix(rows)[1])
    shared = held.get("shared")
    if n <= DENSE_ROWS:
        return sc.parallelize([float(s) for s in sigmas], len(sigmas)).map(lambda s: eigengaps(shared.value, s, max_gaps)).collect()
    if any(s <= 0 for s in sigmas):
        raise ValueError("sigma must be positive")
    out, count, sigmas = [], min(max_gaps, n - 1), [float(s) for s in sigmas]
    if shared:
        spectra = local_spectra(sc, shared, sigmas, count + 1, race, None if race or not keep else held.setdefault("vectors", {}))
    else:
        spectra = [(values, short) for values, _, short in block_spectra(rows, sigmas, count + 1, race=race, held=held)]
    for sigma, (values, short) in zip(sigmas, spectra, strict=True):
        if short:
            out.append({"sigma": sigma, "eigenvalues": [0.0] * (count + 1), "gaps": [0.0] * count, "best_k": None, "best_gap": None, "warning": short})
            continue
        found, best, gap, warning = gaps(values, max_gaps)
        out.append({"sigma": sigma, "eigenvalues": values.tolist(), "gaps": found, "best_k": best, "best_gap": gap, "warning": warning})
    return out


def best_sigma(features: np.ndarray, low: float, high: float, points: int = 40, budget: int = 300, max_gaps: int = 20) -> dict:
    """The sigma of the largest eigengap: evenly spaced scouts, then a golden-section search between the best one's neighbours."""
    return _search(lambda sigmas: [eigengaps(features, s, max_gaps) for s in sigmas], low, high, points, budget)


def best_row_sigma(rows: DataFrame, low: float, high: float, points: int = 40, budget: int = 300, max_gaps: int = 20) -> dict:
    """As best_sigma, of any number of rows: scouts are evaluated together, then, where a sigma is a task, some steps ahead, else one sigma after the other."""
    held: dict = {"kept": True}
    scouted = []

    def evaluate(sigmas: list[float]) -> list[dict]:
        found = row_eigengaps(rows, sigmas, max_gaps, not scouted and len(sigmas) > 1, held)
        scouted.append(True)
        return found

    try:
        # The ways that so many steps may go are 2**steps - 1 sigmas, a core for each.
        cores = rows.sparkSession.sparkContext.defaultParallelism
        return _search(evaluate, low, high, points, budget, lambda: max(1, (cores + 1).bit_length() - 1) if "shared" in held else 1)
    finally:
        if "shared" in held:
            held["shared"].unpersist()
        for made in held.get("warm", {}).values():
            made.unpersist()
        if "pairs" in held:
            held["pairs"].close()


def _search(evaluate: Callable[[list[float]], list[dict]], low: float, high: float, points: int, budget: int, ahead: Callable[[], int] = lambda: 1) -> dict:
    """ahead: how many steps of the golden section are evaluated in one call; only what a step asked for is counted or can be the best."""
    scouts = [float(s) for s in np.linspace(low, high, max(1, min(points, budget)))]
    todo = list(dict.fromkeys(scouts))
    seen: dict[float, dict] = dict(zip(todo, evaluate(todo), strict=True))
    known = dict(seen)
    ratio = (np.sqrt(5) - 1) / 2

    def value(sigma: float) -> float:
        if sigma not in seen:
            seen[sigma] = known[sigma]
        return seen[sigma]["best_gap"] or 0.0

    def left(a: float, b: float, c: float, d: float) -> tuple[float, ...]:
        return a, d, d - ratio * (d - a), c

    def right(a: float, b: float, c: float, d: float) -> tuple[float, ...]:
        return c, b, d, c + ratio * (b - c)

    def wanted(at: tuple[float, ...], steps: int) -> list[float]:
        """What the next steps from here may ask for, wherever they go."""
        if not steps or at[1] - at[0] <= 1e-6 * max(at[1], 1e-12):
            return []
        return [*at[2:], *wanted(left(*at), steps - 1), *wanted(right(*at), steps - 1)]

    top = max(range(len(scouts)), key=lambda i: value(scouts[i]))
    a, b = scouts[max(top - 1, 0)], scouts[min(top + 1, len(scouts) - 1)]
    if budget - len(seen) >= 3 and b > a:
        at = a, b, b - ratio * (b - a), a + ratio * (b - a)
        while budget > len(seen) and at[1] - at[0] > 1e-6 * max(at[1], 1e-12):
            if any(s not in known for s in at[2:]):
                todo = [s for s in dict.fromkeys(wanted(at, ahead())) if s not in known]
                known |= dict(zip(todo, evaluate(todo), strict=True))
            at = left(*at) if value(at[2]) >= value(at[3]) else right(*at)
    best = max(seen, key=lambda s: (seen[s]["best_gap"] or 0.0, -s))
    return seen[best] | {"evaluations": len(seen)}


def eigengap_table(rows: DataFrame, sigmas: list[float], max_gaps: int = 20) -> DataFrame:
    """(sigma, k, gap, ignored, best): gaps of the rows at each sigma (that of k = 1 counts for nothing); up to DENSE_ROWS rows sigmas are parallel tasks over a broadcast matrix, beyond that see block_spectra."""
    n = rows.count()
    spark = rows.sparkSession
    if n > DENSE_ROWS:
        found = row_eigengaps(rows, merged_sigmas(sigmas), max_gaps)
        for got in found:
            if got["warning"]:
                warnings.warn(f"sigma {got['sigma']:g}: {got['warning']}", stacklevel=2)
        table = spark.createDataFrame([(got["sigma"], k, float(gap), got["best_k"] == k) for got in found for k, gap in enumerate(got["gaps"], 1)], "sigma double, k int, gap double, best boolean")
        return table.withColumn("ignored", F.col("k") == 1)
    x = np.array([r.features for r in rows.orderBy("idx").select("features").collect()])
    shared = spark.sparkContext.broadcast(x)

    def run(parts):
        for part in parts:
            for sigma in part["sigma"]:
                got = eigengaps(shared.value, float(sigma), max_gaps)
                yield __import__("pandas").DataFrame({"sigma": sigma, "k": range(1, len(got["gaps"]) + 1), "gap": got["gaps"], "best": [got["best_k"] == k for k in range(1, len(got["gaps"]) + 1)]})

    grid = spark.createDataFrame([(float(s),) for s in merged_sigmas(sigmas)], "sigma double").repartition(len(sigmas))
    return grid.mapInPandas(run, "sigma double, k int, gap double, best boolean").withColumn("ignored", F.col("k") == 1)
