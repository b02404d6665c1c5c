"""A sample that meets target shares of categories (problem 2).

Inclusion probabilities are d * exp(X lambda), capped at 1, where lambda solves the dual of the exponential-tilting
calibration by Newton iterations. The iterations need only the number of rows in each cell of categories, one
distributed aggregate whose size is that of the category table. Rows are then drawn by the pivotal method, which gives
each cell its expected count up to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.session import Scratch

#: More cells than this would not be a category table; the counts of the cells are what the driver holds.
MAX_CELLS = 100_000


def tilted_rates(counts: np.ndarray, design: np.ndarray, targets: np.ndarray, rate: float, steps: int = 60) -> np.ndarray:
    """Probabilities for cells of `counts` rows with `design.T @ (counts * p) = targets` as far as p <= 1 allows.

    Cells that reach 1 are fixed there and the rest is solved again, so floors that need every row of a cell hold.
    """
    fixed = np.zeros(len(counts), bool)
    p = np.full(len(counts), rate, float)
    for _ in range(len(counts) + 1):
        free = ~fixed & (counts > 0)
        left = targets - design[fixed].T @ counts[fixed]
        x, n, lam = design[free], counts[free].astype(float), np.zeros(design.shape[1])
        for _ in range(steps):
            expected = n * rate * np.exp(np.clip(x @ lam, -50, 50))
            gap = x.T @ expected - left
            if np.all(np.abs(gap) <= 1e-12 * np.maximum(1, np.abs(left))):
                break
            hessian = x.T @ (x * expected[:, None]) + 1e-12 * np.eye(len(lam))
            lam -= np.clip(np.linalg.lstsq(hessian, gap, rcond=None)[0], -2, 2)
        p[free] = rate * np.exp(np.clip(x @ lam, -50, 50))
        over = free & (p > 1)
        if not over.any():
            break
        fixed |= over
        p[fixed] = 1.0
    return np.where(counts > 0, np.clip(p, 0, 1), 0)


def pivotal(ids: np.ndarray, weights: np.ndarray, uniforms: np.ndarray) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """Sequential pivotal method: ids drawn, and at most one id left with a probability between 0 and 1."""
    taken = []
    held, a = None, 0.0
    for unit, b, u in zip(ids.tolist(), weights.tolist(), uniforms.tolist(), strict=True):
        if b >= 1 - 1e-12:
            taken.append(unit)
        elif b > 1e-12:
            if held is None:
                held, a = unit, b
            elif (total := a + b) < 1 - 1e-12:
                if u * total >= a:
                    held = unit
                a = total
            else:
                if u * (2 - total) < 1 - b:
                    winner, loser = held, unit
                else:
                    winner, loser = unit, held
                taken.append(winner)
                held, a = (loser, total - 1) if total - 1 > 1e-12 else (None, 0.0)
    return np.array(taken, np.int64), [] if held is None else [(held, a)]


def _draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pivotal draws within one partition, cell by cell; what stays undecided comes last with its probability."""
    held: dict[int, list[tuple[int, float]]] = {}
    bands: dict[int, int] = {}
    for frame in frames:
        for cell, part in frame.groupby("cell", sort=True):
            before = held.get(cell, [])
            bands[cell] = int(part["band_id"].iloc[0])
            ids = np.array([*(i for i, _ in before), *part["id"]], np.int64)
            p = np.array([*(w for _, w in before), *part["p"]], float)
            u = np.array([0.5] * len(before) + part["u"].tolist(), float)
            taken, held[cell] = pivotal(ids, p, u)
            if len(taken):
                yield pd.DataFrame({"cell": cell, "band_id": bands[cell], "id": taken, "p": 1.0, "u": 0.0})
    rest = [(cell, bands[cell], i, w) for cell, xs in held.items() for i, w in xs]
    if rest:
        yield pd.DataFrame(rest, columns=["cell", "band_id", "id", "p"]).assign(u=0.0)


def _finish(frame: pd.DataFrame) -> pd.DataFrame:
    """The last round of one cell, on at most one row from each partition; a fraction left at the end is drawn itself."""
    frame = frame.sort_values("id")
    taken, rest = pivotal(frame["id"].to_numpy(), frame["p"].to_numpy(), frame["u"].to_numpy())
    last = [i for i, w in rest if w > 1 - 1e-3 or w > 1e-3 and frame["u"].iloc[0] < w]
    return pd.DataFrame({"band_id": frame["band_id"].iloc[0], "id": np.array([*taken, *last], np.int64)})


def band_plan(rows: DataFrame, bands: DataFrame, strata: DataFrame) -> DataFrame:
    """One row per band: `n_rows`, `wanted`, `floor_rows`, `rate`, `expected`, `shortfall`.

    `rows` (`id`, `stratum`, `value`; a null value is missing), `bands` (`band_id`, `stratum`, `low`, `below`,
    `target_pct`, `min_rows`), `strata` (`stratum`, `sample_pct`). With N rows that have a value and
    S = floor(sample_pct N / 100), a band wants max(min_rows, ceil(target_pct S / 100)) rows; `shortfall` is what it
    lacks of that. Bands of a stratum without rows have a shortfall of all they want. Null percentages and minima count
    as 0. No bands give no rows.
    """
    spark = rows.sparkSession
    if bands.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} bands")
    valued = rows.where("value is not null")
    sizes = valued.groupBy("stratum").agg(F.count("*").alias("n"))
    inside = valued.join(F.broadcast(bands), "stratum").where("value >= low and value < below").groupBy("band_id").agg(F.count("*").alias("n_rows"))
    plan = (
        bands.join(strata, "stratum", "left").join(sizes, "stratum", "left").join(inside, "band_id", "left")
        .select(
            "band_id", "stratum", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"),
            F.coalesce("target_pct", F.lit(0)).alias("target_pct"),
            F.floor(F.coalesce("sample_pct", F.lit(0)) * F.coalesce("n", F.lit(0)) / 100).alias("size"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
    cells = plan.toPandas().sort_values(["stratum", "band_id"], ignore_index=True)
    wanted = np.maximum(cells["min_rows"], -(-(cells["target_pct"] * cells["size"]) // 100)).to_numpy(float)
    counts, rate = cells["n_rows"].to_numpy(float), np.zeros(len(cells))
    targets = np.minimum(wanted, counts)
    for _, at in cells.groupby("stratum", dropna=False).groups.items():
        i = at.to_numpy()
        n, size = cells["n"][i[0]], cells["size"][i[0]]
        if n:
            rate[i] = tilted_rates(counts[i], np.eye(len(i)), targets[i], max(size / n, 1e-9))
            rate[i] = np.where(targets[i] > 0, rate[i], 0)
    out = cells.assign(
        wanted=wanted.astype("int64"), floor_rows=cells["min_rows"].astype("int64"), rate=rate, expected=counts * rate,
        shortfall=np.maximum(0, wanted - counts).astype("int64"),
    )[["band_id", "stratum", "n_rows", "wanted", "floor_rows", "rate", "expected", "shortfall"]]
    return spark.createDataFrame(
        out.astype(object).values.tolist(),
        "band_id long, stratum string, n_rows long, wanted long, floor_rows long, rate double, expected double, shortfall long",
    )


def draw(rows: DataFrame, bands: DataFrame, plan: DataFrame, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(`band_id`, `id`): the rows drawn with the rates of `plan`.

    A row takes part once for each band that holds it. Rows of no band, with a missing value or of an unknown stratum
    are not drawn. Where the plan has a `category`, rows are drawn by band and category. Each partition decides all
    its rows of a cell but one, whatever the size of the cell, and writes them, so that the second round, which
    decides those, and every reader see one and the same draw.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    crossed = "category" in plan.columns
    keys = ["band_id", "category"] if crossed else ["band_id"]
    chances = plan.where("rate > 0").select(*keys, "rate", F.xxhash64(*keys).alias("cell") if crossed else F.col("band_id").alias("cell"))
    units = rows.where("value is not null").join(F.broadcast(bands), "stratum").where("value >= low and value < below")  # bands: at most MAX_CELLS
    if crossed:
        units = units.withColumn("category", F.coalesce("category", F.lit("")))
    units = units.join(F.broadcast(chances), keys).select(
        "cell", "band_id", "id", F.col("rate").alias("p"), (F.shiftright(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53)) + F.lit(0.5)).alias("u")
    )
    schema = "cell long, band_id long, id long, p double, u double"
    first = scratch.save(units.sortWithinPartitions("cell", "u", "id").mapInPandas(_draw, schema))
    again = (F.shiftright(F.xxhash64(F.lit(seed + 1), "id"), 11) / F.lit(float(1 << 53)) + F.lit(0.5)).alias("u")
    decided = first.where("p = 1.0").select("band_id", "id")
    undecided = first.where("p < 1.0").select("cell", "band_id", "id", "p", again).groupBy("cell").applyInPandas(_finish, "band_id long, id long")
    return decided.unionByName(undecided)


def sample_report(rows: DataFrame, bands: DataFrame, strata: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The plan with `n_drawn`, the rows of each band in the sample, and `missed`, what the sample lacks of `wanted`."""
    scratch = scratch or Scratch(rows.sparkSession)
    plan = band_plan(rows, bands, strata)
    drawn = draw(rows, bands, plan, scratch=scratch).groupBy("band_id").agg(F.count("*").alias("n_drawn"))
    n = F.coalesce("n_drawn", F.lit(0))
    return plan.join(F.broadcast(drawn), "band_id", "left").withColumns({"n_drawn": n, "missed": F.greatest(F.lit(0), F.col("wanted") - n)})  # one row per band


def crossed_plan(rows: DataFrame, bands: DataFrame, strata: DataFrame) -> DataFrame:
    """One row per band and category: `n_rows`, `rate`, `expected`, for rows that also have a `category`.

    The bands of a stratum keep what `band_plan` wants of them, and at the same time the categories keep the shares
    they have among the stratum's banded rows: two crossing sets of targets, met by one Newton solution for each
    stratum as far as rows allow. A missing category is one more category. Bands of one stratum must not overlap.
    """
    rows = rows.withColumn("category", F.coalesce("category", F.lit("")))
    plan = band_plan(rows, bands, strata).toPandas()
    inside = (
        rows.where("value is not null").join(F.broadcast(bands), "stratum").where("value >= low and value < below")
        .groupBy("stratum", "band_id", "category").agg(F.count("*").alias("n_rows")).limit(MAX_CELLS + 1).toPandas()
    )
    if len(inside) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    out = []
    for stratum, cells in inside.groupby("stratum"):
        cells = cells.sort_values(["band_id", "category"], ignore_index=True)
        own = plan[plan["stratum"] == stratum].set_index("band_id")
        band_ids, kinds = sorted(cells["band_id"].unique()), sorted(cells["category"].unique())
        counts = cells["n_rows"].to_numpy(float)
        design = np.column_stack([*((cells["band_id"] == b).to_numpy(float) for b in band_ids), *((cells["category"] == c).to_numpy(float) for c in kinds)])
        by_band = np.array([own.loc[b, "expected"] for b in band_ids], float)
        share = np.array([counts[(cells["category"] == c).to_numpy()].sum() for c in kinds]) / max(counts.sum(), 1)
        targets = np.concatenate([by_band, by_band.sum() * share])
        rate = tilted_rates(counts, design, targets, max(by_band.sum() / max(counts.sum(), 1), 1e-9))
        out += [(stratum, int(b), c, int(n), float(r), float(n * r)) for b, c, n, r in zip(cells["band_id"], cells["category"], counts, rate, strict=True)]
    return rows.sparkSession.createDataFrame(out, "stratum string, band_id long, category string, n_rows long, rate double, expected double")
