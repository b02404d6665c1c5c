"""Second-order gradient boosting on histograms: trees that split each node for itself, or one level alike.

Features are cut at exact quantiles into at most `bins` bins once. Growing a level is one pass: partitions add up first
and second derivatives by node, feature and bin, Spark adds the partitions, and the driver, which sees histograms only,
picks the splits. Scores are written after each tree, so a pass follows one tree and not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.operators.running import quantile_row
from lodewright.session import Scratch


@dataclass
class Tree:
    """Splits in heap order: `feature` (-1 for a leaf), `cut` (bins at or above go right), and the leaves' `value`."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] >= self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]) if edges else np.zeros((len(x), 0), np.int64)


def _derivatives(score: np.ndarray, y: np.ndarray, classification: bool) -> tuple[np.ndarray, np.ndarray]:
    if not classification:
        return score - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


@dataclass
class Ensemble:
    """Fitted trees over bins: `predict` gives scores (numbers) or probabilities (classes) of feature rows."""

    edges: list[np.ndarray]
    trees: list[Tree]
    base: float
    classification: bool
    gains: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        return self.base + sum((t.scores(bins) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30))) if self.classification else raw


def _histograms(rows: DataFrame, tree: Tree, first: int, width: int, d: int, n_bins: int, classification: bool) -> np.ndarray:
    """Sums of both derivatives by node of the level, feature and bin."""
    size = width * d * n_bins

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size))
        for frame in frames:
            bins = np.stack(frame["bins"].to_numpy()).astype(np.int64).reshape(len(frame), d)
            at = tree.nodes(bins) - first
            live = at >= 0
            g, h = _derivatives(frame["score"].to_numpy(float), frame["y"].to_numpy(float), classification)
            place = ((at[live, None] * d + np.arange(d)) * n_bins + bins[live]).ravel()
            for k, v in enumerate((g, h)):
                total[k] += np.bincount(place, np.repeat(v[live], d), size)
        seen = np.flatnonzero(total[1])
        yield pd.DataFrame({"i": seen, "g": total[0, seen], "h": total[1, seen]})

    sums = rows.mapInPandas(run, "i long, g double, h double").groupBy("i").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros((2, size))
    out[:, sums["i"].to_numpy()] = sums[["g", "h"]].to_numpy().T
    return out.reshape(2, width, d, n_bins)


def boost(df: DataFrame, cols: Sequence[str], y: str, classification: bool, rounds: int = 100, rate: float = 0.3, depth: int = 6, l2: float = 1.0, symmetric: bool = False, least: float = 1.0, bins: int = 64) -> Ensemble:
    """Fit `rounds` trees of at most `depth` levels; `symmetric` uses one split for all nodes of a level, `least` is the
    least second derivative of a child, `l2` shrinks leaves. Rows with a missing feature must be filled before."""
    scratch = Scratch(df.sparkSession)
    d = len(cols)
    named = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)), F.col(y).cast("double").alias("y"))
    cuts = quantile_row(named, {f"x{i}": F.col(f"x{i}") for i in range(d)}, [j / bins for j in range(1, bins)])
    edges = [np.unique(cuts.get(f"x{i}", [])) for i in range(d)]
    mean = named.agg(F.avg("y")).first()[0] or 0.0
    base = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))) if classification else float(mean)
    n_bins = max((len(e) for e in edges), default=0) + 1

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame.to_numpy(float)
            yield pd.DataFrame({"bins": list(binned(x[:, :-1], edges).astype(np.int16)), "y": x[:, -1], "score": base})

    rows = scratch.save(named.mapInPandas(start, "bins array<smallint>, y double, score double"))
    trees, gains = [], np.zeros(d)
    for _ in range(rounds):
        n_nodes = 2 ** (depth + 1) - 1
        tree = Tree(np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.zeros(n_nodes))
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            if level and not (tree.feature[(first - 1) // 2 : first] >= 0).any():
                break
            g, h = _histograms(rows, tree, first, width, d, n_bins, classification)
            total_g, total_h = g[:, :1].sum(2, keepdims=True), h[:, :1].sum(2, keepdims=True)
            left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gain = _gain(left_g, left_h, l2) + _gain(total_g - left_g, total_h - left_h, l2) - _gain(total_g, total_h, l2)
            gain = np.where((left_h >= least) & (total_h - left_h >= least), gain, -np.inf if not symmetric else 0.0)
            if level == 0:
                tree.value[0] = -rate * total_g[0, 0, 0] / (total_h[0, 0, 0] + l2)
            if gain.shape[2] == 0:
                break
            joint = gain.sum(0, keepdims=True).repeat(width, 0) if symmetric else gain
            for node in range(width):
                if total_h[node, 0, 0] <= 0:
                    continue
                f, b = np.unravel_index(int(np.argmax(joint[node])), joint[node].shape)
                if not joint[node, f, b] > 1e-12:
                    continue
                at = first + node
                tree.feature[at], tree.cut[at] = f, b + 1
                gains[f] += max(float(gain[node, f, b]), 0.0)
                sides = (left_g[node, f, b], left_h[node, f, b]), (total_g[node, 0, 0] - left_g[node, f, b], total_h[node, 0, 0] - left_h[node, f, b])
                for side, (sg, sh) in enumerate(sides):
                    tree.value[2 * at + 1 + side] = -rate * sg / (sh + l2)
        trees.append(tree)

        def step(frames: Iterator[pd.DataFrame], tree: Tree = tree) -> Iterator[pd.DataFrame]:
            for frame in frames:
                at = np.stack(frame["bins"].to_numpy()).astype(np.int64).reshape(len(frame), d)
                yield frame.assign(score=frame["score"].to_numpy(float) + tree.scores(at))

        following = scratch.save(rows.mapInPandas(step, rows.schema))
        scratch.drop(rows)
        rows = following
    scratch.drop(rows)
    return Ensemble(edges, trees, base, classification, gains)
