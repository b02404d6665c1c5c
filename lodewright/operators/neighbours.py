"""Exact nearest neighbours in blocks, and what builds on them: local outlier factors and the domain of application."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.functions import kernels
from lodewright.operators.running import quantile_row
from lodewright.session import Scratch

#: Rows of one block; a task holds one block of queries and one of fitted rows.
CHUNK = 4096


def _chunks(df: DataFrame) -> int:
    return max(1, -(-df.count() // CHUNK))


def chunked_pairs(queries: DataFrame, fitted: DataFrame, query_col: str, fitted_col: str, part: Callable, schema: str) -> DataFrame:
    """Run `part(query_block, fitted_block)` on every pair of blocks, so no task holds more than two blocks."""
    n_q, n_f = _chunks(queries), _chunks(fitted)
    q = queries.withColumn("__q", F.pmod(F.xxhash64(query_col), F.lit(n_q))).withColumn("__f", F.explode(F.sequence(F.lit(0), F.lit(n_f - 1)).cast("array<long>")))
    t = fitted.withColumn("__f", F.pmod(F.xxhash64(fitted_col), F.lit(n_f))).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<long>")))
    return q.groupBy("__q", "__f").cogroup(t.groupBy("__q", "__f")).applyInPandas(part, schema)


#: Blocks up to which each meets each; more are cut by place.
FEW = 8
PAIR = "query long, other long, d double"


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.array(rows["x"].tolist(), float), rows["id"].to_numpy()


def _none() -> pd.DataFrame:
    return pd.DataFrame({"query": [], "other": [], "d": []}).astype({"query": "int64", "other": "int64"})


def _best(a: np.ndarray, qi: np.ndarray, b: np.ndarray, ti: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """(`query`, `other`, `d`): the k nearest of the rows `b` to each of the rows `a`, ties by id."""
    d2 = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)
    if exclude_self:
        d2[qi[:, None] == ti[None, :]] = np.inf
    m = min(len(ti), k)
    # Expanded squares are off by rounding; every row within that of the k-th smallest stays, however many tie there.
    slack = 1e-12 * (a.shape[1] + 8) * ((a**2).sum(1)[:, None] + np.nan_to_num((b**2).sum(1)).max())
    limit = np.nan_to_num(np.partition(d2, m - 1, axis=1)[:, m - 1 : m] + slack, nan=np.inf, posinf=np.inf)
    near, some = np.isfinite(d2) & (d2 <= limit), max(1, (1 << 24) // (len(ti) * max(16, a.shape[1])))
    best = []
    for i in range(0, len(qi), some):
        row, col = np.nonzero(near[i : i + some])
        d = np.sqrt(((a[row + i] - b[col]) ** 2).sum(1))
        order = np.lexsort((ti[col], d, row))
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        best.append(pd.DataFrame({"query": qi[row[order] + i], "other": ti[col[order]], "d": d[order]}))
    return pd.concat(best)


def _planes(x: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Cuts in heap order, each at the middle of the feature that spreads most; feature -1 where nothing can be cut."""
    depth = max(1, int(np.ceil(np.log2(leaves))))
    out: list[tuple[int, float]] = [(-1, 0.0)] * (2**depth - 1)
    parts = {0: np.nan_to_num(x)}
    for i in range(len(out)):
        rows = parts.pop(i)
        if len(rows) > 1:
            spread = rows.std(0)
            for f in np.argsort(-spread, kind="stable"):
                cut = float(np.median(rows[:, f]))
                right = rows[:, f] > cut if (rows[:, f] > cut).any() else rows[:, f] >= cut
                if spread[f] > 0 and 0 < right.sum() < len(rows):
                    cut = float(rows[right, f].min())
                    out[i] = (int(f), cut)
                    break
        f, cut = out[i]
        right = rows[:, f] >= cut if f >= 0 else np.zeros(len(rows), bool)
        if 2 * i + 2 < len(out):
            parts[2 * i + 1], parts[2 * i + 2] = rows[~right], rows[right]
    return out


def _leaf_of(x: np.ndarray, planes: list[tuple[int, float]]) -> np.ndarray:
    f, cut = np.array([p[0] for p in planes]), np.array([p[1] for p in planes])
    at = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(len(planes) + 1))):
        g = f[at]
        at = 2 * at + 1 + ((g >= 0) & (x[np.arange(len(x)), np.maximum(g, 0)] >= cut[at]))
    return at - len(planes)


def _meet(asked: DataFrame, placed: DataFrame, sizes: dict[int, int], k: int, exclude_self: bool) -> DataFrame:
    """Pairs of queries (`id`, `x`, `leaf`) with the rows of their leaf. Large leaves, and those that many queries ask, are
    cut further by hashes, so no task holds more than a few blocks of either side."""
    asks = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}  # leaves, one row each
    cuts = [(leaf, -(-n // (2 * CHUNK)), max(1, -(-asks.get(leaf, 0) // (8 * CHUNK)))) for leaf, n in sizes.items()]
    parts = F.broadcast(asked.sparkSession.createDataFrame(cuts, "leaf long, n_t long, n_q long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    q = asked.join(parts, "leaf").select("id", "x", "leaf", F.pmod(F.xxhash64("id"), F.col("n_q")).alias("__q"), every(F.col("n_t")).alias("__t"))
    t = placed.join(parts, "leaf").select("id", "x", "leaf", F.pmod(F.xxhash64("id"), F.col("n_t")).alias("__t"), every(F.col("n_q")).alias("__q"))

    def part(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return _none()
        (x, qi), (y, ti) = _arrays(a), _arrays(b)
        some = max(1, (1 << 23) // len(y))
        return pd.concat([_best(x[i : i + some], qi[i : i + some], y, ti, k, exclude_self) for i in range(0, len(x), some)])

    return q.groupBy("leaf", "__t", "__q").cogroup(t.groupBy("leaf", "__t", "__q")).applyInPandas(part, PAIR)


def _placed_pairs(queries: DataFrame, fitted: DataFrame, k: int, exclude_self: bool, blocks: int) -> DataFrame:
    """Pairs that hold each query's k nearest rows. Queries meet the leaf they lie in first; the k-th distance there is a
    radius, and they meet the other leaves whose box is within it. Some rows decide where leaves are cut, not what is found."""
    scratch = Scratch(queries.sparkSession)
    share = max(1, fitted.count() // (64 * blocks))
    seen = fitted.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(share)) == 0).select("x").toPandas()
    planes = _planes(np.array(seen["x"].tolist(), float).reshape(len(seen), -1), blocks) if len(seen) else [(-1, 0.0)]

    @F.pandas_udf("long")
    def leaf(xs: pd.Series) -> pd.Series:
        return pd.Series(_leaf_of(np.array(xs.tolist(), float).reshape(len(xs), -1), planes), dtype="int64")

    placed = scratch.save(fitted.withColumn("leaf", leaf("x")))
    asked = scratch.save(queries.withColumn("leaf", leaf("x")))
    d = placed.select(F.size("x")).first()[0]
    ends = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.array(*(F.min(F.col("x")[i]) for i in range(d))).alias("low"), F.array(*(F.max(F.col("x")[i]) for i in range(d))).alias("high")).toPandas()
    sizes = dict(zip(ends["leaf"].tolist(), ends["n"].tolist(), strict=True))
    names = ends["leaf"].to_numpy()
    low, high = (np.nan_to_num(np.array(ends[c].tolist(), float), nan=v) for c, v in (("low", -np.inf), ("high", np.inf)))
    first = scratch.save(_meet(asked, placed, sizes, k, exclude_self))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "other"))
    radius = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("d").alias("radius"))

    @F.pandas_udf("array<long>")
    def others(xs: pd.Series, own: pd.Series, radii: pd.Series) -> pd.Series:
        x, r = np.array(xs.tolist(), float).reshape(len(xs), -1), radii.fillna(np.inf).to_numpy(float)
        near = np.zeros((len(x), len(names)), bool)
        for j in range(len(names)):
            gap = np.maximum(np.maximum(low[j] - x, x - high[j]), 0)
            near[:, j] = ~((gap**2).sum(1) > (r * (1 + 1e-9) + 1e-12) ** 2) & (names[j] != own.to_numpy())
        return pd.Series([names[m] for m in near])

    more = scratch.save(asked.join(radius, "id", "left").select("id", "x", F.explode(others("x", "leaf", "radius")).alias("leaf")))
    return first.unionByName(_meet(more, placed, sizes, k, exclude_self))


def knn(queries: DataFrame, fitted: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(`query`, `other`, `d`, `rank`): the k nearest rows by Euclidean distance, ties by id.

    Both inputs are (`id`, `x`) with `x` an array of numbers of one length; rows with a null array take no part.
    Each block yields its own k best, of which the k best overall are kept: a query has at most k rows per block. Many
    blocks are cut by place, and a query meets those only that can hold one of its k nearest.
    """

    q, t = queries.where("x is not null").select("id", "x"), fitted.where("x is not null").select("id", "x")
    blocks = _chunks(t)
    if blocks > FEW:
        found = _placed_pairs(q, t, k, exclude_self, blocks)
    else:
        found = chunked_pairs(q, t, "id", "id", lambda a, b: _best(*_arrays(a), *_arrays(b), k, exclude_self) if len(a) and len(b) else _none(), PAIR)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def local_outlier_factor(fitted: DataFrame, k: int = 20, queries: DataFrame | None = None) -> DataFrame:
    """(`id`, `lof`): in-sample factors, or those of new rows against the fitted ones."""
    near = knn(fitted, fitted, k, exclude_self=True)
    reach = near.groupBy(F.col("query").alias("other")).agg(F.max("d").alias("k_distance"))

    def density(pairs: DataFrame) -> DataFrame:
        return pairs.join(reach, "other").groupBy("query").agg((F.lit(1.0) / (F.avg(F.greatest("d", "k_distance")) + F.lit(1e-10))).alias("lrd"))

    own = density(near)
    asked = near if queries is None else knn(queries, fitted, k)
    of_asked = own if queries is None else density(asked)
    around = asked.join(own.withColumnRenamed("query", "other").withColumnRenamed("lrd", "other_lrd"), "other").groupBy("query").agg(F.avg("other_lrd").alias("around"))
    return around.join(of_asked, "query").select(F.col("query").alias("id"), (F.col("around") / F.col("lrd")).alias("lof"))


def knn_domain(fitted: DataFrame, queries: DataFrame, k: int = 10, rate: float = 0.05) -> DataFrame:
    """(`id`, `score`, `domain`): 1 / (mean distance to the k nearest + 1); `in` above the fitted rows' percentile."""

    def score(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(F.col("query").alias("id")).agg((F.lit(1.0) / (F.avg("d") + 1.0)).alias("score"))

    return _in_or_out(score(knn(queries, fitted, k)), score(knn(fitted, fitted, k, exclude_self=True)), rate)


def lof_domain(fitted: DataFrame, queries: DataFrame, k: int = 20, rate: float = 0.05) -> DataFrame:
    """(`id`, `score`, `domain`) with the negative local outlier factor as score."""
    own = local_outlier_factor(fitted, k, queries=None).select((-F.col("lof")).alias("score"))
    asked = local_outlier_factor(fitted, k, queries).select("id", (-F.col("lof")).alias("score"))
    return _in_or_out(asked, own, rate)


#: Widths of the kernel that are tried: powers of two, fixed values.
GAMMAS = tuple(2.0**k for k in range(-20, 11))


def best_gamma(fitted: DataFrame) -> float:
    """The width for which the kernel's values over all pairs of fitted rows vary most; (`id`, `x`), distances standardised.

    Blocks of pairs return counts, sums and squares for every width; nothing else leaves them.
    """

    def part(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"g": [], "n": [], "s": [], "ss": []})
        a, b = np.array(q["x"].tolist(), float), np.array(t["x"].tolist(), float)
        d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))
        d[q["id"].to_numpy()[:, None] == t["id"].to_numpy()[None, :]] = 0.0
        k = [np.exp(-g * d) for g in GAMMAS]
        return pd.DataFrame({"g": range(len(GAMMAS)), "n": d.size, "s": [v.sum() for v in k], "ss": [(v * v).sum() for v in k]})

    sums = chunked_pairs(fitted.select("id", "x"), fitted.select("id", "x"), "id", "id", part, "g int, n double, s double, ss double")
    rows = sums.groupBy("g").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()
    spread = {r["g"]: r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in rows}
    # Beyond some width only a row's value with itself is left and the spread no longer changes: the least such width.
    return GAMMAS[max(spread, key=lambda g: (round(spread[g], 12), -g))] if spread else 1.0


def machine_domain(fitted: DataFrame, queries: DataFrame, nu: float = 0.5, rate: float = 0.05) -> DataFrame:
    """(`id`, `score`, `domain`) with the margin of a one-class machine on standardised features as score."""
    n = fitted.select(F.size("x")).first()[0]
    cols = [f"x{i}" for i in range(n)]
    spread = lambda t: t.where("x is not null").select("id", *(F.col("x")[i].alias(c) for i, c in enumerate(cols)))
    own = spread(fitted)
    variances = seuclidean_variances(own, cols)
    both = [t.select("id", scaled(cols, variances).alias("x")).select("id", "x", *(F.col("x")[i].alias(c) for i, c in enumerate(cols))) for t in (own, spread(queries))]
    machine = kernels.one_class(both[0], cols, nu, best_gamma(both[0]))
    score = lambda t: t.select("id", kernels.margin_column(machine, cols).alias("score"))
    return _in_or_out(score(both[1]), score(both[0]), rate)


def _in_or_out(scores: DataFrame, own: DataFrame, rate: float) -> DataFrame:
    cut = quantile_row(own, {"score": F.col("score")}, [rate]).get("score", [None])[0]
    label = F.when(F.col("score") - F.lit(cut) > 0, F.lit("in")).otherwise(F.lit("out"))
    return scores.select("id", "score", label.alias("domain"))


def vote(queries: DataFrame, fitted: DataFrame, target: str, k: int = 5, classify: bool = True, mean: str | None = None) -> DataFrame:
    """(`id`, `predicted`): majority class (the smaller one on a tie) or mean of the k nearest fitted rows; the mean also
    under the name `mean`, where one is given."""
    pairs = knn(queries, fitted, k).join(fitted.select(F.col("id").alias("other"), F.col(target).alias("y")), "other")
    how = F.mode("y", True) if classify else F.avg("y")
    return pairs.groupBy(F.col("query").alias("id")).agg(how.alias("predicted"), *([F.avg("y").alias(mean)] if mean else []))


def tanimoto_links(rows: DataFrame, cutoff: float) -> DataFrame:
    """(`a`, `b`, `d`) with a < b: pairs of bit sets (`id`, `bits` array) at Tanimoto distance at most `cutoff`.

    Two sets that near share at least a given number of bits, so their prefixes in one fixed order of bits must meet;
    sets without bits meet nothing. Pairs are verified on the whole sets.
    """
    least = 1 - cutoff
    sets = rows.select("id", F.array_sort(F.array_distinct("bits")).alias("bits")).where(F.size("bits") > 0)
    n = F.size("bits")
    prefix = F.slice("bits", 1, n - F.ceil(F.lit(least) * n).cast("int") + 1)
    keyed = sets.select("id", "bits", n.alias("n"), F.explode(prefix).alias("bit"))
    a, b = (keyed.select(F.col("id").alias(c), F.col("bits").alias(f"b{c}"), F.col("n").alias(f"n{c}"), "bit") for c in ("a", "b"))
    common = F.size(F.array_intersect("ba", "bb"))
    joined = a.join(b, "bit").where((F.col("a") < F.col("b")) & (F.col("na") >= F.lit(least) * F.col("nb")) & (F.col("nb") >= F.lit(least) * F.col("na")))
    d = F.lit(1.0) - common / (F.col("na") + F.col("nb") - common)
    return joined.select("a", "b", d.alias("d")).where(F.col("d") <= cutoff + 1e-12).distinct()


def seuclidean_variances(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Sample variances that scale the standardised Euclidean distance."""
    row = df.agg(*(F.var_samp(c).alias(c) for c in cols)).first()
    return {c: row[c] for c in cols}


def scaled(cols: list[str], variances: dict[str, float]) -> Column:
    """The features as an array in which plain Euclidean distance is the standardised one."""
    return F.array(*(F.col(c) / F.lit((variances[c] or 0.0) ** 0.5 or 1.0) for c in cols))

