"""The per-cluster forecaster: two gated layers and a dense head in NumPy, one task per cluster.

Sequences are one step long, so recurrent weights and forget gates never act: a layer is
h = sigmoid(Wo x + bo) * relu(sigmoid(Wi x + bi) * relu(Wg x + bg)).
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSSES = ("mse", "quantile_weighted_mse")


def check_loss(name: str) -> str:
    name = name.strip().lower()
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {', '.join(LOSSES)}")
    return name


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedNetwork:
    """Gated layers of `units`, then dense layers of 16 and 8, then `horizon` linear outputs."""

    def __init__(self, n_in: int, horizon: int, units: tuple[int, int] = (32, 16), dropout: float = 0.1, seed: int = 42) -> None:
        self.rng = np.random.default_rng(seed)
        self.dropout, self.w = dropout, {}
        widths = (n_in, *units)
        for layer in range(2):
            for gate in "iog":
                self._dense(f"{gate}{layer}", widths[layer], widths[layer + 1])
        for name, a, b in (("d0", units[1], 16), ("d1", 16, 8), ("out", 8, horizon)):
            self._dense(name, a, b)

    def _dense(self, name: str, a: int, b: int) -> None:
        limit = np.sqrt(6 / (a + b))
        self.w[f"{name}.w"] = self.rng.uniform(-limit, limit, (a, b))
        self.w[f"{name}.b"] = np.zeros(b)

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        tape, w = [], self.w
        for layer in range(2):
            i, o = (_sigmoid(x @ w[f"{g}{layer}.w"] + w[f"{g}{layer}.b"]) for g in "io")
            g = np.maximum(x @ w[f"g{layer}.w"] + w[f"g{layer}.b"], 0)
            c = np.maximum(i * g, 0)
            h = o * c
            mask = self._mask(h.shape) if train else 1.0
            tape.append((x, i, o, g, c, mask))
            x = h * mask
        for name in ("d0", "d1"):
            h = np.maximum(x @ w[f"{name}.w"] + w[f"{name}.b"], 0)
            mask = self._mask(h.shape) if train and name == "d0" else 1.0
            tape.append((x, h, mask))
            x = h * mask
        tape.append((x,))
        return x @ w["out.w"] + w["out.b"], tape

    def _mask(self, shape: tuple) -> np.ndarray:
        return (self.rng.random(shape) >= self.dropout) / (1 - self.dropout)

    def backward(self, grad: np.ndarray, tape: list) -> dict[str, np.ndarray]:
        g, w = {}, self.w
        (x,) = tape[-1]
        g["out.w"], g["out.b"] = x.T @ grad, grad.sum(0)
        grad = grad @ w["out.w"].T
        for name, (x, h, mask) in (("d1", tape[3]), ("d0", tape[2])):
            grad = grad * mask * (h > 0)
            g[f"{name}.w"], g[f"{name}.b"] = x.T @ grad, grad.sum(0)
            grad = grad @ w[f"{name}.w"].T
        for layer in (1, 0):
            x, i, o, gate, c, mask = tape[layer]
            grad = grad * mask
            inner = grad * o * (c > 0)
            parts = {"o": grad * c * o * (1 - o), "i": inner * gate * i * (1 - i), "g": inner * i * (gate > 0)}
            grad = 0
            for name, d in parts.items():
                g[f"{name}{layer}.w"], g[f"{name}{layer}.b"] = x.T @ d, d.sum(0)
                grad = grad + d @ w[f"{name}{layer}.w"].T
        return g

    def fit(self, x, y, x_val, y_val, epochs: int = 250, batch: int = 64, patience: int = 50, rate: float = 1e-3, decay: float = 1e-4, thresholds: list[float] = (), weights: list[float] = ()) -> list[dict]:
        """Train with AdamW, stop early on the validation loss and restore the best weights; returns the history."""
        weigh = lambda t: np.asarray(weights)[np.searchsorted(thresholds, t, "left")] if len(weights) else np.ones_like(t)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        best, best_w, since, step, history = np.inf, None, 0, 0, []
        for epoch in range(epochs):
            order = self.rng.permutation(len(x))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                out, tape = self.forward(x[rows], train=True)
                grads = self.backward(2 * weigh(y[rows]) * (out - y[rows]) / out.size, tape)
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7) + decay * self.w[k])
            row = {"epoch": epoch} | self.evaluate(x, y, weigh) | {f"val_{k}": v for k, v in self.evaluate(x_val if len(x_val) else x, y_val if len(x_val) else y, weigh).items()}
            history.append(row)
            if row["val_loss"] < best:
                best, best_w, since = row["val_loss"], {k: v.copy() for k, v in self.w.items()}, 0
            else:
                since += 1
                if since >= patience:
                    break
        self.w = best_w or self.w
        return history

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def evaluate(self, x: np.ndarray, y: np.ndarray, weigh=np.ones_like) -> dict[str, float]:
        e = self.predict(x) - y
        mse = float((e * e).mean())
        return {"loss": float((weigh(y) * e * e).mean()), "mae": float(np.abs(e).mean()), "mse": mse, "rmse": mse**0.5}

    def dump(self) -> str:
        return json.dumps({k: v.tolist() for k, v in self.w.items()})

    def load(self, text: str) -> GatedNetwork:
        self.w = {k: np.array(v) for k, v in json.loads(text).items()}
        return self


def one_step(features: np.ndarray) -> np.ndarray:
    """(n, d) as sequences of one step: (n, 1, d)."""
    return np.asarray(features).reshape(len(features), 1, -1)


def sequences(x: np.ndarray, y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `length` rows and the target after each."""
    n = len(x) - length
    return np.stack([x[i : i + length] for i in range(max(n, 0))]) if n > 0 else np.empty((0, length, *x.shape[1:])), np.asarray(y)[length:]


MODEL_SCHEMA = "cluster int, weights string, history string, n_train long"


def train_clusters(samples: DataFrame, horizon: int, units: tuple[int, int] = (32, 16), **options: object) -> DataFrame:
    """A model per cluster with train samples: (cluster, weights, history, n_train). Clusters train in parallel, one task each.

    samples: split, window_index, cluster, features, y_by_lead.
    """
    empty = pa.schema([("cluster", pa.int32()), ("weights", pa.string()), ("history", pa.string()), ("n_train", pa.int64())]).empty_table()

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas()
        parts = {s: rows[rows["split"] == s].sort_values("window_index") for s in ("train", "val")}
        x = {s: np.stack(p["features"].to_numpy()) if len(p) else np.empty((0, 0)) for s, p in parts.items()}
        y = {s: np.stack(p["y_by_lead"].to_numpy()) if len(p) else np.empty((0, horizon)) for s, p in parts.items()}
        if not len(x["train"]):
            return empty
        net = GatedNetwork(x["train"].shape[1], horizon, units, seed=int(options.get("seed", 42)))
        settings = {k: v for k, v in options.items() if k != "seed"}
        history = net.fit(x["train"], y["train"], x["val"], y["val"], **settings)
        return pa.table([[int(rows["cluster"].iloc[0])], [net.dump()], [json.dumps(history)], [len(x["train"])]], schema=empty.schema)

    return samples.select("split", "window_index", "cluster", "features", "y_by_lead").groupBy("cluster").applyInArrow(run, MODEL_SCHEMA)


def predict(samples: DataFrame, models: DataFrame, ids: list[str], horizon: int, units: tuple[int, int] = (32, 16), every: bool = False) -> DataFrame:
    """ids, model_cluster, yhat_by_lead, clipped at 0: each sample by its own cluster's model, or by every model.

    Models are few and small: they are collected and broadcast. Samples of clusters without a model get zeros.
    """
    found = {r.cluster: r.weights for r in models.select("cluster", "weights").collect()}
    shared = samples.sparkSession.sparkContext.broadcast(found)
    schema = samples.select(*ids, F.col("cluster").alias("model_cluster"), F.array(F.lit(0.0)).alias("yhat_by_lead")).schema

    def run(parts):
        nets = {}
        for part in parts:
            x = np.stack(part["features"].to_numpy()) if len(part) else np.empty((0, 1))
            for k in shared.value:
                nets[k] = nets.get(k) or GatedNetwork(x.shape[1], horizon, units).load(shared.value[k])
            clusters = part["cluster"].to_numpy()
            if every:
                for k, net in nets.items():
                    yield part[ids].assign(model_cluster=k, yhat_by_lead=list(np.maximum(net.predict(x), 0)))
                continue
            out = np.zeros((len(part), horizon))
            for k, net in nets.items():
                own = clusters == k
                if own.any():
                    out[own] = np.maximum(net.predict(x[own]), 0)
            yield part[ids].assign(model_cluster=clusters, yhat_by_lead=list(out))

    return samples.select(*dict.fromkeys([*ids, "cluster", "features"])).mapInPandas(run, schema)


def history_table(models: DataFrame) -> DataFrame:
    """(cluster, epoch, loss, mae, mse, val_loss, val_mae, val_mse)."""
    kind = "array<struct<epoch:int,loss:double,mae:double,mse:double,val_loss:double,val_mae:double,val_mse:double>>"
    return models.select("cluster", F.explode(F.from_json("history", kind)).alias("h")).select("cluster", "h.*")
