"""ARMA baselines: exact Gaussian fits in NumPy, one task per station and order; residuals by a scan over chunks; forecasts by fixed parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import DATE, RAIN, STATION
from .shared import beside


def parse_orders(text: str) -> list[tuple[int, int]]:
    """"1,0;2,1" as [(1, 0), (2, 1)]."""
    out = []
    for part in text.split(";"):
        numbers = [int(x) for x in part.replace("(", "").replace(")", "").split(",")]
        if len(numbers) != 2 or min(numbers) < 0 or sum(numbers) == 0:
            raise ValueError(f"not an order: {part!r}")
        out.append((numbers[0], numbers[1]))
    return out


def _from_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary AR polynomial from partial autocorrelations."""
    phi = np.zeros(0)
    for x in r:
        phi = np.append(phi - x * phi[::-1], x)
    return phi


def _log_likelihood(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[float, float]:
    """(log-likelihood, innovation variance) of a zero-mean series, variance concentrated out, by a Kalman filter."""
    m = max(len(phi), len(theta) + 1)
    a = np.zeros((m, m))
    a[: len(phi), 0] = phi
    a[:-1, 1:] = np.eye(m - 1)
    r = np.zeros(m)
    r[0] = 1
    r[1 : len(theta) + 1] = theta
    rr = np.outer(r, r)
    # The stationary covariance, by doubling: p = sum of a^k rr a'^k.
    p, power = rr, a
    for _ in range(60):
        more = power @ p @ power.T
        p, power = p + more, power @ power
        if np.abs(more).max() <= 1e-15 * np.abs(p).max():
            break
    if not np.isfinite(p).all():
        raise np.linalg.LinAlgError("not stationary")
    state, total, logs, settled, f = np.zeros(m), 0.0, 0.0, False, 1.0
    gain = np.zeros(m)
    n = len(y)
    for value in y:
        if not settled:
            f = p[0, 0]
            gain = a @ p[:, 0] / f
        v = value - state[0]
        total += v * v / f
        logs += np.log(f)
        state = a @ state + gain * v
        if not settled:
            new = a @ p @ a.T - np.outer(gain, gain) * f + rr
            settled = bool(np.abs(new - p).max() < 1e-12)
            p = new
    variance = total / n
    return -0.5 * (n * np.log(2 * np.pi * max(variance, 1e-300)) + logs + n), variance


def _minimise(f, x: np.ndarray, turns: int = 400) -> np.ndarray:
    """Nelder-Mead."""
    d = len(x)
    points = np.vstack([x, x + 0.25 * np.eye(d)])
    values = np.array([f(p) for p in points])
    for _ in range(turns * d):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] < 1e-9 * (1 + abs(values[0])) and np.abs(points - points[0]).max() < 1e-6:
            break
        centre = points[:-1].mean(0)
        away = centre + (centre - points[-1])
        at = f(away)
        if at < values[0]:
            far = centre + 2 * (centre - points[-1])
            at_far = f(far)
            points[-1], values[-1] = (far, at_far) if at_far < at else (away, at)
        elif at < values[-2]:
            points[-1], values[-1] = away, at
        else:
            near = centre + 0.5 * ((away if at < values[-1] else points[-1]) - centre)
            at_near = f(near)
            if at_near < min(at, values[-1]):
                points[-1], values[-1] = near, at_near
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    return points[values.argmin()]


def fit(y: np.ndarray, p: int, q: int) -> dict:
    """Mean, coefficients, variance, log-likelihood and information criteria of the maximum-likelihood fit."""
    y = np.asarray(y, float)
    n = len(y)
    if n <= max(p, q) + 1:
        raise ValueError(f"{n} values are too few for order ({p}, {q})")

    def split(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return x[0] * scale + centre, _from_partial(np.tanh(x[1 : p + 1])), -_from_partial(np.tanh(x[p + 1 :]))

    centre, scale = y.mean(), y.std() or 1.0

    def cost(x: np.ndarray) -> float:
        mean, phi, theta = split(x)
        try:
            value = -_log_likelihood((y - mean) / scale, phi, theta)[0]
        except np.linalg.LinAlgError:
            return 1e12
        return value if np.isfinite(value) else 1e12

    start = np.zeros(1 + p + q)
    if p and n > 3:
        z = (y - centre) / scale
        start[1] = np.arctanh(np.clip(np.mean(z[1:] * z[:-1]), -0.9, 0.9))
    mean, phi, theta = split(_minimise(cost, start))
    loglik, variance = _log_likelihood((y - mean) / scale, phi, theta)
    loglik -= n * np.log(scale)
    k = p + q + 2
    return {"mean": float(mean), "ar": [float(v) for v in phi], "ma": [float(v) for v in theta], "variance": float(variance * scale**2), "loglik": float(loglik), "aic": float(2 * k - 2 * loglik), "bic": float(k * np.log(n) - 2 * loglik), "hqic": float(2 * k * np.log(np.log(max(n, 3))) - 2 * loglik), "n": n}


FIT_SCHEMA = f"{STATION} string, p int, q int, mean double, ar array<double>, ma array<double>, variance double, loglik double, aic double, bic double, hqic double, n long, error string"


def fit_stations(train: DataFrame, orders: list[tuple[int, int]], rain: str = RAIN) -> DataFrame:
    """A row per station and order; a failed fit is a row with its error. Each is one task's work over one station's series."""
    grid = train.sparkSession.createDataFrame(orders, "p int, q int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values(DATE)
        head = {STATION: own[STATION].iloc[0], "p": int(own["p"].iloc[0]), "q": int(own["q"].iloc[0])}
        try:
            found = fit(own[rain].to_numpy(), head["p"], head["q"]) | {"error": None}
        except ValueError as why:
            found = dict.fromkeys(("mean", "ar", "ma", "variance", "loglik", "aic", "bic", "hqic")) | {"n": len(own), "error": str(why)}
        return pd.DataFrame([head | found])

    rows = train.select(STATION, DATE, rain).crossJoin(F.broadcast(grid))
    return rows.groupBy(STATION, "p", "q").applyInPandas(run, FIT_SCHEMA)


def ar_residuals(series: DataFrame, mean: float, ar: list[float], rain: str = RAIN, keys: tuple[str, ...] = (STATION,)) -> DataFrame:
    """series with fitted and residual of a pure AR model; lags before the start are the mean."""
    over = Window.partitionBy(*keys).orderBy("row_idx")
    fitted = F.lit(float(mean))
    for lag, c in enumerate(ar, 1):
        fitted = fitted + float(c) * (F.coalesce(F.lag(rain, lag).over(over), F.lit(float(mean))) - float(mean))
    rows = series.withColumn("fitted", fitted)
    return rows.withColumn("residual", F.col(rain) - F.col("fitted"))


def residuals(y: np.ndarray, mean: float, ar: list[float], ma: list[float]) -> np.ndarray:
    """One-step residuals with fixed parameters; lags before the start are the mean, residuals 0."""
    out = np.zeros(len(y))
    for t in range(len(y)):
        guess = mean
        for k, c in enumerate(ar, 1):
            guess += c * ((y[t - k] if t >= k else mean) - mean)
        for k, c in enumerate(ma, 1):
            guess += c * (out[t - k] if t >= k else 0.0)
        out[t] = y[t] - guess
    return out


#: Days of a chunk of a series: what one task runs through, and what one row of the composition stands for.
CHUNK = 1 << 16


def run_from(y: np.ndarray, mean: float, ar: list[float], ma: list[float], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, state after them) of days that follow a state: the last p deviations from the mean, then the last q residuals, newest first."""
    p, q = len(ar), len(ma)
    dev = np.concatenate([state[:p][::-1], y - mean])
    left = y - mean
    for k, c in enumerate(ar, 1):
        left = left - c * dev[p - k : len(dev) - k]
    out = list(state[p:][::-1])
    lags = list(enumerate(ma, 1))
    for x in left.tolist():
        for k, c in lags:
            x -= c * out[-k]
        out.append(x)
    after = np.concatenate([dev[len(dev) - p :][::-1], np.array(out[len(out) - q :])[::-1]])
    return np.array(out[q:]), after


def transition(ar: list[float], ma: list[float]) -> np.ndarray:
    """How a state of run_from moves on by a day, apart from that day's own value."""
    p, q = len(ar), len(ma)
    move = np.zeros((p + q, p + q))
    if p:
        move[1:p, : p - 1] = np.eye(p - 1)
    move[p + 1 :, p : p + q - 1] = np.eye(q - 1)
    move[p] = -np.array([*ar, *ma])
    return move


def arma_residuals(series: DataFrame, mean: float, ar: list[float], ma: list[float], rain: str = RAIN, keys: tuple[str, ...] = (STATION,), chunk: int = CHUNK) -> DataFrame:
    """series with residual; a moving-average part makes it a recursion along each key's series, run as a scan.

    A chunk of days maps the state before it to the state after it: state -> move ** days @ state + shift. One pass finds
    each chunk's shift, the maps of a key are composed (a row per chunk), and a second pass runs every chunk from the state
    before it. So a key is as many tasks as it has chunks. Before the first day deviations and residuals are 0. An unknown
    value makes its residual null, and all that follow it.
    """
    if not ma:
        return ar_residuals(series, mean, ar, rain, keys).drop("fitted")
    mean, move, size = float(mean), transition(ar, ma), len(ar) + len(ma)
    rows = series.withColumn("_chunk", F.floor(F.col("row_idx") / chunk).cast("long"))
    head = [*keys, "_chunk"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in head)

    def shifts(part: pd.DataFrame) -> pd.DataFrame:
        own = part.sort_values("row_idx")
        after = run_from(own[rain].to_numpy(float), mean, ar, ma, np.zeros(size))[1]
        return own.iloc[:1][head].assign(_days=len(own), _state=[after])

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        own, state, before = part.sort_values("_chunk"), np.zeros(size), []
        for days, shift in zip(own["_days"], own["_state"], strict=True):
            before.append(state)
            state = np.linalg.matrix_power(move, int(days)) @ state + np.asarray(shift, float)
        return own[head].assign(_state=before)

    narrow = rows.select(*dict.fromkeys([*head, "row_idx", rain]))
    found = narrow.groupBy(*head).applyInPandas(shifts, f"{kinds}, _days long, _state array<double>")
    before = found.groupBy(*keys).applyInPandas(compose, f"{kinds}, _state array<double>")
    schema = series.withColumn("residual", F.lit(None).cast("double")).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = part.sort_values("row_idx")
        out = run_from(own[rain].to_numpy(float), mean, ar, ma, np.asarray(own["_state"].iloc[0], float))[0]
        return own.assign(residual=out)[schema.names]

    return beside(rows, before, head, False).groupBy(*head).applyInPandas(run, schema)


def forecasts(rows: DataFrame, mean: float, ar: list[float], ma: list[float], horizon: int, clip: bool = True, rain: str = RAIN, residual: str = "residual", keys: tuple[str, ...] = (STATION,)) -> DataFrame:
    """rows with yhat_by_lead: the 1..horizon day forecasts made at each row, unrolled into columns."""
    over = Window.partitionBy(*keys).orderBy("row_idx")
    mean = float(mean)
    values = [F.coalesce(F.lag(rain, k).over(over), F.lit(mean)) if k else F.col(rain) for k in range(max(len(ar), 1))]
    errors = [F.coalesce(F.lag(residual, k).over(over), F.lit(0.0)) if k else F.col(residual) for k in range(len(ma))]
    names = {}
    for k, v in enumerate(values):
        names[f"_v{k}"] = v
    for k, e in enumerate(errors):
        names[f"_e{k}"] = e
    rows = rows.withColumns(names)
    known: list[Column] = []
    for h in range(1, horizon + 1):
        guess = F.lit(mean)
        for k, c in enumerate(ar, 1):
            lagged = known[h - k - 1] if h > k else F.col(f"_v{k - h}")
            guess = guess + float(c) * (lagged - mean)
        for k, c in enumerate(ma, 1):
            if k >= h:
                guess = guess + float(c) * F.col(f"_e{k - h}")
        rows = rows.withColumn(f"_f{h}", guess)
        known.append(F.col(f"_f{h}"))
    out = F.array(*[F.greatest(f, F.lit(0.0)) if clip else f for f in known])
    return rows.withColumn("yhat_by_lead", out).drop(*names, *[f"_f{h}" for h in range(1, horizon + 1)])


def check_forecasts(rows: DataFrame, column: str = "yhat_by_lead") -> None:
    if rows.where(F.exists(column, lambda x: x.isNull() | F.isnan(x))).limit(1).count():
        raise ValueError("forecasts must be finite")
