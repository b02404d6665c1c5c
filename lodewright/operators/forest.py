"""Random forests whose trees grow in tasks and stay in a table.

Features are cut into at most `bins` bins once. A task grows a few whole trees on all rows, which it holds as one byte a
feature and eight for the target; a deep tree on many rows has about as many nodes as rows, so the driver never sees
trees that do not fit it: they are written, and rows are scored where groups of trees and blocks of rows meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.operators.boosting import binned
from lodewright.operators.running import even_quantile_row
from lodewright.session import Scratch

#: Tasks that grow trees, groups of trees in scoring, rows of a block that one of these meets: fixed values.
GROWERS, SCORERS, BLOCK = 25, 10, 1 << 18
#: Bytes of trees up to which they are sent to every task; more are joined.
SENT = 16_000_000

TREES = "tree int, feature binary, cut binary, value binary, gains array<double>"


def places(values: Sequence[float], bins: int) -> np.ndarray:
    """Where a feature is cut: between all its values, or, where they are more than `bins`, at strides of their counts."""
    u, c = np.unique(np.asarray(values, float), return_counts=True)
    between = (u[:-1] + u[1:]) / 2
    if len(between) < bins:
        return between
    stride, out = c.sum() / bins, []
    target, before = stride, c[0]
    for i in range(1, len(u)):
        now = before + c[i]
        if abs(before - target) < abs(now - target):
            out.append(between[i - 1])
            target += stride
        before = now
    return np.array(out[: bins - 1])


def _groups(key: np.ndarray, size: int, w: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur, in order, with the sums of both columns: by counting where keys are few, else by sorting."""
    if size <= 4 * len(key):
        n = np.bincount(key, w, size)
        seen = np.flatnonzero(n)
        return seen, n[seen], np.bincount(key, r, size)[seen]
    order = np.argsort(key)
    k = key[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(w[order], starts), np.add.reduceat(r[order], starts)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, tried: int, rng: np.random.Generator, n_bins: int, least: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree on rows of weight `w` > 0, level by level: feature (-1 for a leaf) and cut of its nodes, the leaves'
    values, and each feature's gain. `bins` has a row for each feature; each node tries `tried` features.

    Children of the j-th inner node are the nodes 1 + 2 j and 2 + 2 j. A split is the one that takes most off the sum of
    squares; for two classes that is the Gini split.
    """
    d, n = bins.shape
    row, node, m, gains = np.arange(n), np.zeros(n, np.int64), 1, np.zeros(d)
    features, cuts, values = [], [], []
    for level in range(depth + 1):
        wr, yr = w[row], y[row]
        total = np.bincount(node, wr, m)
        mean = np.bincount(node, wr * yr, m) / total
        r = yr - mean[node]
        spread = np.bincount(node, wr * r * r, m)
        live = spread > 1e-20 * total * mean * mean
        feature, cut, best = np.full(m, -1, np.int8), np.zeros(m, np.uint8), 1e-10 * spread
        if level < depth and live.any():
            keep = live[node]
            row, node, wr = row[keep], node[keep], wr[keep]
            r = wr * r[keep]
            picks = None if tried >= d else np.argsort(rng.random((m, d)), axis=1)[:, :tried]
            for f in range(d):
                b = bins[f]
                if picks is None:
                    at, key, wf, rf = node, node * n_bins + b[row], wr, r
                else:
                    some = (picks == f).any(1)[node]
                    at = node[some]
                    key, wf, rf = at * n_bins + b[row[some]], wr[some], r[some]
                if not len(at):
                    continue
                k, n_w, s = _groups(key, m * n_bins, wf, rf)
                of = k // n_bins
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                sizes = np.diff(starts, append=len(of))
                up_w, up_s = np.cumsum(n_w), np.cumsum(s)
                left = up_w - np.repeat(up_w[starts] - n_w[starts], sizes)
                sums = up_s - np.repeat(up_s[starts] - s[starts], sizes)
                right = total[of] - left
                ok = (left >= least) & (right >= least)
                ok[starts + sizes - 1] = False
                gain = np.where(ok, sums * sums * total[of] / np.where(ok, left * right, 1.0), -1.0)
                most = np.maximum.reduceat(gain, starts)
                better = most > best[of[starts]] * (1 + 1e-12)
                hit = np.flatnonzero((gain == np.repeat(most, sizes)) & np.repeat(better, sizes))[::-1]
                feature[of[hit]], cut[of[hit]] = f, k[hit] % n_bins + 1
                best[of[hit]] = gain[hit]
        inner = feature >= 0
        features.append(feature)
        cuts.append(cut)
        values.append(mean[~inner])
        if not inner.any():
            break
        np.add.at(gains, feature[inner], best[inner])
        keep = inner[node]
        row, node = row[keep], node[keep]
        node = 2 * (np.cumsum(inner) - 1)[node] + (bins[feature[node], row] >= cut[node])
        m = 2 * int(inner.sum())
    return np.concatenate(features), np.concatenate(cuts), np.concatenate(values), gains


@dataclass
class Tree:
    """A grown tree as `grow` gives it."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def read(cls, row) -> Tree:
        return cls(np.frombuffer(row["feature"], np.int8), np.frombuffer(row["cut"], np.uint8), np.frombuffer(row["value"], float))

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Values of rows; `bins` has a row for each feature."""
        inner = self.feature >= 0
        rank = np.cumsum(inner)
        at, going = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while len(going := going[inner[at[going]]]):
            a = at[going]
            at[going] = 2 * rank[a] - 1 + (bins[self.feature[a], going] >= self.cut[a])
        return self.value[at - rank[at]]


def _cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    if np.isnan(x).any():
        raise ValueError("a forest needs rows without missing values")
    return np.ascontiguousarray(binned(x, edges).astype(np.uint8).T)


def _joined(blobs: Sequence[bytes], d: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.uint8).reshape(d, -1) for b in blobs], axis=1)


def fit(df: DataFrame, cols: Sequence[str], y: str, numTrees: int = 100, maxDepth: int = 30, featureSubsetStrategy: str = "all", seed: int = 42, maxBins: int = 32, minInstancesPerNode: int = 1) -> dict:
    """The state of a forest: `edges` of bins, the table of `trees`, their number and bytes, and the features' `weights`.

    Each tree draws every row a Poisson number of times. Rows are put in an order of their own values first, so trees do
    not depend on how the table is cut.
    """
    scratch, d = Scratch(df.sparkSession), len(cols)
    if not d:
        raise ValueError("a forest needs features")
    tried = {"all": d, "auto": d, "sqrt": int(np.ceil(np.sqrt(d))), "onethird": -(-d // 3), "log2": int(np.log2(d))}[featureSubsetStrategy]
    names = [f"x{i}" for i in range(d)]
    named = scratch.save(df.select(*(F.col(c).cast("double").alias(x) for x, c in zip(names, cols, strict=True)), F.col(y).cast("double").alias("y")))
    found = even_quantile_row(named, {x: F.col(x) for x in names}, 1025)
    edges = [places(found.get(x, []), maxBins) for x in names]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame.to_numpy(float)
            if np.isnan(x[:, -1]).any():
                raise ValueError("a forest needs rows without missing values")
            if len(x):
                yield pd.DataFrame({"bins": [_cells(x[:, :-1], edges).tobytes()], "y": [x[:, -1].tobytes()]})

    growers = max(1, min(GROWERS, numTrees))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        bins, target, out = _joined(g["bins"], d), np.concatenate([np.frombuffer(b, float) for b in g["y"]]), []
        order = np.lexsort((*bins, target))
        bins, target = bins[:, order], target[order]
        for t in range(int(g["g"].iloc[0]), numTrees, growers):
            rng = np.random.default_rng([seed, t])
            times = rng.poisson(1.0, len(target))
            at = np.flatnonzero(times) if times.any() else np.arange(len(target))
            feature, cut, value, gains = grow(bins[:, at], target[at], np.maximum(times[at], 1).astype(float), maxDepth, max(1, tried), rng, maxBins, minInstancesPerNode)
            out.append((t, feature.tobytes(), cut.tobytes(), value.tobytes(), (gains / (gains.sum() or 1.0)).tolist()))
        return pd.DataFrame(out, columns=["tree", "feature", "cut", "value", "gains"])

    packed = scratch.save(named.mapInPandas(pack, "bins binary, y binary"))
    scratch.drop(named)
    spread = packed.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(growers - 1)))).repartitionByRange(growers, "g")
    trees = scratch.save(spread.groupBy("g").applyInPandas(run, TREES))
    scratch.drop(packed)
    small = trees.select(F.length("feature") * 2 + F.length("value"), "gains").collect()  # numbers of each tree only
    if not small:
        raise ValueError("a forest needs rows")
    weights = np.sum([r[1] for r in small], axis=0)
    weights = weights / (weights.sum() or 1.0)
    return {"edges": [e.tolist() for e in edges], "trees": trees, "n": numTrees, "bytes": sum(r[0] for r in small), "weights": dict(zip(cols, map(float, weights), strict=True))}


def means(rows: DataFrame, cols: Sequence[str], state: dict, name: str) -> DataFrame:
    """The rows with the mean of the trees' values."""
    edges, trees, n, d = [np.array(e) for e in state["edges"]], state["trees"], state["n"], len(cols)
    xs = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    if state["bytes"] <= SENT:
        sent = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in trees.select("feature", "cut", "value").orderBy("tree").collect()])

        @F.pandas_udf("double")
        def own(*parts: pd.Series) -> pd.Series:
            bins = _cells(np.column_stack([p.to_numpy(float) for p in parts]), edges)
            return pd.Series(sum((Tree.read(t).scores(bins) for t in sent.value), np.zeros(bins.shape[1])) / n)

        return rows.withColumn(name, own(*xs))
    scratch = Scratch(rows.sparkSession)
    kept = scratch.save(rows.withColumn("__row", F.monotonically_increasing_id()))
    blocks = max(1, -(-kept.count() // BLOCK))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                ids = frame["__row"].to_numpy(np.int64)
                yield pd.DataFrame({"first": [ids[0]], "ids": [ids.tobytes()], "bins": [_cells(frame.drop(columns="__row").to_numpy(float), edges).tobytes()]})

    def run(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(q):
            return pd.DataFrame({"__row": np.zeros(0, np.int64), "v": np.zeros(0)})
        bins = _joined(q["bins"], d)
        total = sum((Tree.read(r).scores(bins) for r in t.sort_values("tree").to_dict("records")), np.zeros(bins.shape[1]))
        return pd.DataFrame({"__row": np.concatenate([np.frombuffer(b, np.int64) for b in q["ids"]]), "v": total})

    packed = kept.select("__row", *xs).mapInPandas(pack, "first long, ids binary, bins binary").withColumn("s", F.pmod(F.xxhash64("first"), F.lit(blocks)))
    asked = packed.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(SCORERS - 1))))
    own_trees = trees.withColumn("g", F.col("tree") % SCORERS).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    sums = own_trees.groupBy("g", "s").cogroup(asked.groupBy("g", "s")).applyInPandas(run, "__row long, v double")
    return kept.join(sums.groupBy("__row").agg((F.sum("v") / n).alias(name)), "__row").select(*rows.columns, name)
