"""Radial-basis machines of fixed size, fitted on all rows.

The kernel is approximated by random Fourier features (Rahimi and Recht, 2007), so a machine is one weight for each
feature. Its objective is minimised by L-BFGS; every step is one pass in which partitions return the sums of losses
and gradients of their rows. No row is left out, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.session import Scratch


@dataclass(frozen=True)
class RandomFeatures:
    """cos and sin of random directions: inner products approach exp(-gamma |a - b|^2)."""

    width: int
    gamma: float
    half: int = 200
    seed: int = 42

    def directions(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(0.0, np.sqrt(2 * self.gamma), (self.width, self.half))

    def map(self, x: np.ndarray, directions: np.ndarray | None = None) -> np.ndarray:
        z = x @ (self.directions() if directions is None else directions)
        return np.hstack([np.cos(z), np.sin(z)]) / np.sqrt(self.half)


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 60, memory: int = 10, tolerance: float = 1e-5) -> np.ndarray:
    """L-BFGS with backtracking on a function that gives value and gradient."""
    w = start.astype(float)
    f, g = value(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance * max(1.0, np.abs(f)):
            break
        q, steps = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            steps.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(steps), strict=True):
            q += (a - y @ q / (s @ y)) * s
        slope, rate = -(g @ q), 1.0
        if slope >= 0:
            q, slope, pairs = g / max(1.0, np.linalg.norm(g)), -(g @ g) / max(1.0, np.linalg.norm(g)), []
        for _ in range(12):
            new = w - rate * q
            f2, g2 = value(new)
            if f2 <= f + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = new - w, g2 - g
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, y)]
        done = abs(f - f2) <= 1e-9 * max(1.0, abs(f))
        w, f, g = new, f2, g2
        if done:
            break
    return w


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a vector of fixed length: batches are added up in their partition, partitions by Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            v = part(frame.to_numpy(float))
            total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    parts = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(len(parts))
    out[parts["i"].to_numpy()] = parts["v"].to_numpy()
    return out


def fit_sums(rows: DataFrame, size: int, loss: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]], penalty: Callable[[np.ndarray], tuple[float, np.ndarray]], n: int, start: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Weights that minimise penalty(w) + the mean over all rows of loss(batch, w), where the loss gives sums over a batch."""

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        def part(x: np.ndarray) -> np.ndarray:
            f, g = loss(x, w)
            return np.concatenate([[f], g])

        total = summed(rows, part) / max(n, 1)
        f, g = penalty(w)
        return f + float(total[0]), g + total[1:]

    return minimise(value, np.zeros(size) if start is None else start, rounds)


def _ridge(c: float, free: int = 1):
    """Half the squared weights over c, the last `free` of them (offsets) left out."""

    def penalty(w: np.ndarray) -> tuple[float, np.ndarray]:
        g = w.copy()
        g[len(w) - free :] = 0
        return float(g @ g) / (2 * c), g / c

    return penalty


@dataclass
class Machine:
    """`scale` features, map them, and take the inner product with the weights, the last of which is the offset."""

    features: RandomFeatures
    shift: np.ndarray
    weights: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.features.map(x - self.shift) @ self.weights[:-1] + self.weights[-1]


def _numbers(df: DataFrame, cols: Sequence[str], scratch: Scratch, y: str | None = None) -> tuple[DataFrame, int, np.ndarray, float]:
    """The columns as written numbers, their count, means and the variance of all cells together."""
    named = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    rows = scratch.save(df.select(*named, *([F.col(y).cast("double").alias("y")] if y else [])))
    stats = rows.agg(F.count("*"), *(F.avg(f"x{i}") for i in range(len(cols))), *(F.var_pop(f"x{i}") for i in range(len(cols)))).first()
    means = np.array([v or 0.0 for v in stats[1 : 1 + len(cols)]])
    spread = np.mean([v or 0.0 for v in stats[1 + len(cols) :]]) + means.var()
    return rows, stats[0], means, float(spread)


def default_gamma(width: int, spread: float) -> float:
    return 1.0 / max(width * spread, 1e-12)


def one_class(df: DataFrame, cols: Sequence[str], nu: float = 0.5, gamma: float | None = None, half: int = 200, rounds: int = 60) -> Machine:
    """The one-class machine: margins are negative for about the share `nu` of the fitted rows that are farthest out.

    1/2 |w|^2 + 1/nu mean(max(0, rho - w z)) - rho; the corner of the loss is rounded over 0.001 of the kernel's unit,
    and rho is set to the exact quantile of the fitted margins at the end.
    """
    from lodewright.operators.running import quantile_row

    scratch = Scratch(df.sparkSession)
    rows, n, means, spread = _numbers(df, cols, scratch)
    features = RandomFeatures(len(cols), default_gamma(len(cols), spread) if gamma is None else gamma, half)
    corner = 1e-3

    def loss(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        z = features.map(x - means)
        short = w[-1] - z @ w[:-1]
        slope = np.clip(short / corner, 0, 1)
        f = np.where(short > corner, short - corner / 2, np.where(short > 0, short**2 / (2 * corner), 0))
        return float(f.sum()) / nu, np.concatenate([-(slope @ z), [slope.sum()]]) / nu

    def penalty(w: np.ndarray) -> tuple[float, np.ndarray]:
        return float(w[:-1] @ w[:-1]) / 2 - float(w[-1]), np.concatenate([w[:-1], [-1.0]])

    first = summed(rows, lambda x: features.map(x - means).sum(0)) / max(n, 1)
    w = fit_sums(rows, 2 * half + 1, loss, penalty, n, np.concatenate([first, [float(first @ first)]]), rounds)
    machine = Machine(features, means, np.concatenate([w[:-1], [0.0]]))
    rho = quantile_row(rows.select(margin_column(machine, [f"x{i}" for i in range(len(cols))]).alias("m")), {"m": F.col("m")}, [nu]).get("m", [0.0])[0]
    machine.weights[-1] = -rho
    return machine


def margin_column(machine: Machine, cols: Sequence[str]):
    """Margins of rows in Arrow batches."""
    directions = machine.features.directions()

    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in xs])
        return pd.Series(machine.features.map(x - machine.shift, directions) @ machine.weights[:-1] + machine.weights[-1])

    return run(*(F.col(c).cast("double") for c in cols))


def support_classifier(df: DataFrame, cols: Sequence[str], y: str, c: float = 1.0, gamma: float | None = None, half: int = 200, rounds: int = 60) -> tuple[Machine, float, float]:
    """A machine for classes 0 and 1 by squared hinge loss, and slope and offset of the logistic that turns margins into
    probabilities."""
    scratch = Scratch(df.sparkSession)
    rows, n, means, spread = _numbers(df, cols, scratch, y)
    features = RandomFeatures(len(cols), default_gamma(len(cols), spread) if gamma is None else gamma, half)

    def loss(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        z, t = features.map(x[:, :-1] - means), np.where(x[:, -1] > 0.5, 1.0, -1.0)
        short = np.maximum(0, 1 - t * (z @ w[:-1] + w[-1]))
        slope = -2 * short * t
        return float((short**2).sum()), np.concatenate([slope @ z, [slope.sum()]])

    machine = Machine(features, means, fit_sums(rows, 2 * half + 1, loss, _ridge(c * max(n, 1)), n, rounds=rounds))

    def logistic(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        m, t = machine.margins(x[:, :-1]), (x[:, -1] > 0.5).astype(float)
        s = np.clip(w[0] * m + w[1], -30, 30)
        p = 1 / (1 + np.exp(-s))
        return float((np.log1p(np.exp(s)) - t * s).sum()), np.array([((p - t) * m).sum(), (p - t).sum()])

    slope, offset = fit_sums(rows, 2, logistic, _ridge(1e6, 0), n, np.array([1.0, 0.0]), rounds)
    return machine, float(slope), float(offset)


def support_regressor(df: DataFrame, cols: Sequence[str], y: str, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, half: int = 200, rounds: int = 60) -> Machine:
    """A machine for numbers: losses of less than `epsilon` are free, greater ones count by their size, rounded at the corner."""
    scratch = Scratch(df.sparkSession)
    rows, n, means, spread = _numbers(df, cols, scratch, y)
    features = RandomFeatures(len(cols), default_gamma(len(cols), spread) if gamma is None else gamma, half)
    corner = 0.05 * max(epsilon, 1e-3)

    def loss(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        z = features.map(x[:, :-1] - means)
        e = z @ w[:-1] + w[-1] - x[:, -1]
        over = np.maximum(np.abs(e) - epsilon, 0)
        slope = np.sign(e) * np.clip(over / corner, 0, 1)
        f = np.where(over > corner, over - corner / 2, over**2 / (2 * corner))
        return float(f.sum()), np.concatenate([slope @ z, [slope.sum()]])

    middle = rows.agg(F.avg("y")).first()[0] or 0.0
    start = np.concatenate([np.zeros(2 * half), [middle]])
    return Machine(features, means, fit_sums(rows, 2 * half + 1, loss, _ridge(c * max(n, 1)), n, start, rounds))


def perceptron(df: DataFrame, cols: Sequence[str], y: str, hidden: int = 150, alpha: float = 0.01, rounds: int = 100, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """One hidden layer of rectifiers for numbers, on standardised inputs, fitted on the sums over all rows."""
    scratch = Scratch(df.sparkSession)
    rows, n, _, _ = _numbers(df, cols, scratch, y)
    d = len(cols)
    names = [*(f"x{i}" for i in range(d)), "y"]
    row = rows.agg(*(F.avg(c) for c in names), *(F.stddev_pop(c) for c in names)).first()
    mean, scale = np.array([v or 0.0 for v in row[: d + 1]]), np.array([v or 1.0 for v in row[d + 1 :]])
    rng = np.random.default_rng(seed)
    shapes = [(d, hidden), (hidden,), (hidden,), (1,)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])

    def cut(w: np.ndarray) -> list[np.ndarray]:
        return [p.reshape(s) for p, s in zip(np.split(w, ends[:-1]), shapes, strict=True)]

    start = np.concatenate([rng.normal(0, np.sqrt(2 / max(1, d)), d * hidden), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), [0.0]])

    def loss(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        a, b, c, e = cut(w)
        v = (x - mean) / scale
        h = np.maximum(v[:, :-1] @ a + b, 0)
        r = h @ c + e - v[:, -1]
        dh = np.outer(r, c) * (h > 0)
        return float((r**2).sum()) / 2, np.concatenate([(v[:, :-1].T @ dh).ravel(), dh.sum(0), h.T @ r, [r.sum()]])

    w = fit_sums(rows, len(start), loss, lambda w: (alpha / max(n, 1) * float(w @ w) / 2, alpha / max(n, 1) * w), n, start, rounds)
    a, b, c, e = cut(w)

    def predict(q: np.ndarray) -> np.ndarray:
        return (np.maximum(((q - mean[:-1]) / scale[:-1]) @ a + b, 0) @ c + e) * scale[-1] + mean[-1]

    return predict
