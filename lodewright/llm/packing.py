"""Filling containers of fixed capacity (problem 7).

Pattern packing: the histogram of sizes is fitted by repeat counts of few-document patterns (non-negative least
squares), the counts are rounded down, and what is left is packed greedily. All planning works on the histogram, which
has at most `capacity` entries whatever the number of documents; documents then find their container by their rank
within their size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.session import Scratch

#: A token is a longest run of word characters or a longest run of other characters that are not white space.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f\x0B]+"

MAX_CAPACITY = 1 << 20
#: Places of recipes that may be sent to every task; more are joined.
MAX_SLOTS = 500_000
#: Ranks within a size are counted in shares of at most about this many documents, so that no size is one task.
RANK_ROWS = 200_000


def token_count(text: Column) -> Column:
    """Number of tokens of a text; null for null."""
    return F.regexp_count(text, F.lit(TOKEN))


def public_token_count(vocabulary: str):
    """Column function that counts the tokens of a public tokenizer file (`tokenizers` JSON format) in Arrow batches."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        some = texts.dropna()
        sizes = [len(e.ids) for e in tokenizer.encode_batch(some.tolist(), add_special_tokens=False)]
        return pd.Series(sizes, index=some.index).reindex(texts.index)

    return count


@dataclass
class Recipe:
    """`repeats` containers that each hold `uses[size]` documents of a size."""

    repeats: int
    uses: dict[int, int]

    @property
    def total(self) -> int:
        return sum(s * n for s, n in self.uses.items())


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.zeros(n)
            z[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z[at] > 1e-12).all():
                x = z
                break
            low = at[z[at] <= 1e-12]
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(bins: int, longest: int = 4, slack: int = 2) -> np.ndarray:
    """Multisets of at most `longest` bins, as counts, whose sum is within `slack` of a full container."""
    found: list[list[int]] = []

    def extend(chosen: list[int], least: int, total: int) -> None:
        if chosen and total >= bins - slack:
            found.append(list(chosen))
        if len(chosen) < longest:
            for b in range(least, bins - total + 1):
                extend([*chosen, b], b, total + b)

    extend([], 1, 0)
    out = np.zeros((bins + 1, len(found)))
    for j, chosen in enumerate(found):
        np.add.at(out[:, j], chosen, 1)
    return out


def _take(left: np.ndarray, room: int, top: int | None = None) -> dict[int, int]:
    """Largest sizes first into the room; `left` are the counts by size and stay as they are."""
    uses: dict[int, int] = {}
    limit = room if top is None else min(room, top)
    while room > 0 and limit > 0:
        there = np.flatnonzero(left[1 : limit + 1])
        if not len(there):
            break
        size = int(there[-1]) + 1
        n = min(int(left[size]), room // size)
        uses[size] = n
        room -= n * size
        limit = min(size - 1, room)
    return uses


def plan(counts: np.ndarray, capacity: int, bins: int = 40) -> list[Recipe]:
    """Recipes that use each size `s` exactly `counts[s]` times (sizes 1 to capacity) within the capacity.

    The number of recipes depends on the number of distinct sizes and of patterns, not on that of documents.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    recipes: list[Recipe] = []
    bins = min(bins, capacity)
    width = capacity / bins
    of = np.minimum(np.ceil(np.arange(capacity + 1) / width), bins).astype(int)
    histogram = np.bincount(of, left, bins + 1)
    shapes = patterns(bins)
    if left.sum() and shapes.shape[1]:
        scale = max(1.0, histogram.max())
        repeats = np.floor(nnls(shapes, histogram / scale) * scale + 1e-6).astype(int)
        by_bin = [np.flatnonzero(of == b)[::-1] for b in range(bins + 1)]
        for j in np.flatnonzero(repeats):
            need = [b for b in range(bins, 0, -1) for _ in range(int(shapes[b, j]))]
            todo = int(repeats[j])
            while todo > 0:
                uses: dict[int, int] = {}
                for b in need[:-1]:
                    size = next((int(s) for s in by_bin[b] if left[s] > uses.get(int(s), 0)), None)
                    if size is None:
                        break
                    uses[size] = uses.get(size, 0) + 1
                if sum(uses.values()) < len(need) - 1:
                    break
                # The last document closes the container: the longest one left that fits.
                room = capacity - sum(s * n for s, n in uses.items())
                fitting = [int(s) for s in np.flatnonzero(left[: room + 1])[::-1][: len(need)] if left[s] > uses.get(int(s), 0)]
                if not fitting:
                    break
                uses[fitting[0]] = uses.get(fitting[0], 0) + 1
                times = min(todo, *(int(left[s]) // n for s, n in uses.items()))
                for s, n in uses.items():
                    left[s] -= n * times
                recipes.append(Recipe(times, uses))
                todo -= times
    # Space above the documents of a pattern takes what the patterns left over, the tightest fit first.
    topped: list[Recipe] = []
    for recipe in sorted(recipes, key=lambda r: r.total):
        todo = recipe.repeats
        while todo > 0:
            extra = _take(left, capacity - recipe.total)
            times = min([todo, *(int(left[s]) // n for s, n in extra.items())])
            for s, n in extra.items():
                left[s] -= n * times
            uses = dict(recipe.uses)
            for s, n in extra.items():
                uses[s] = uses.get(s, 0) + n
            topped.append(Recipe(times, uses))
            todo -= times
    while left.any():
        uses = _take(left, capacity)
        times = min(int(left[s]) // n for s, n in uses.items())
        for s, n in uses.items():
            left[s] -= n * times
        topped.append(Recipe(times, uses))
    return topped


def slots(recipes: list[Recipe]) -> pd.DataFrame:
    """(`size`, `r0`, `r1`, `base`, `each`): ranks r0..r1-1 of a size go to containers base, base + 1, ..., `each` a piece."""
    rows, next_rank, base = [], {}, 0
    for recipe in recipes:
        for size, each in recipe.uses.items():
            r0 = next_rank.get(size, 0)
            next_rank[size] = r0 + recipe.repeats * each
            rows.append((size, r0, next_rank[size], base, each))
        base += recipe.repeats
    return pd.DataFrame(rows, columns=["size", "r0", "r1", "base", "each"]).astype("int64")


def pack(sizes: DataFrame, specs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id") -> DataFrame:
    """(`spec_id`, `doc_id`, `piece`, `n_pieces`, `tokens`, `container`) from `sizes` (`doc_id`, `n_tokens`).

    A text above the capacity fills whole containers of its own and leaves one last piece, which is packed like any
    other text; no other text is split. An empty text needs no room and goes to container 0 of its specification; a
    null size is no text and gets no row. Rows with equal ids are separate items. Specifications with a null or
    non-positive capacity get no rows. Containers are numbered from 1, those of split texts after all others.

    Specifications are a fixed table; capacities up to 2**20 are allowed, because the driver holds one histogram of
    `capacity` counts for each. Every row gets a number when it is written first, and shares are cut by it, so one size
    or one id may hold any part of the rows. Full pieces are numbered by sums over the shares.
    """
    spark = sizes.sparkSession
    scratch = scratch or Scratch(spark)
    wanted = specs.where("capacity_tokens > 0").select("spec_id", "capacity_tokens").limit(1001).collect()
    if len(wanted) > 1000 or any(r["capacity_tokens"] > MAX_CAPACITY for r in wanted):
        raise ValueError("at most 1000 specifications of at most 2**20 tokens")
    spec_list = F.array(*(F.struct(F.lit(r["spec_id"]).cast("long").alias("spec_id"), F.lit(r["capacity_tokens"]).cast("long").alias("capacity")) for r in wanted))
    if not wanted:
        spec_list = spec_list.cast("array<struct<spec_id:bigint,capacity:bigint>>")
    items = scratch.save(
        sizes.where("n_tokens is not null").select(F.col(id_col).alias("doc_id"), F.col("n_tokens").cast("long"), F.monotonically_increasing_id().alias("row"))
    )
    items = (
        items.select("doc_id", "n_tokens", "row", F.inline(spec_list))
        .withColumn("full", F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    )
    histogram = items.where("rest > 0").groupBy("spec_id", "capacity", F.col("rest").alias("size")).agg(F.count("*").alias("n")).toPandas()
    frames, shares, firsts = [], [], []
    for (spec, capacity), part in histogram.groupby(["spec_id", "capacity"]):
        counts = np.zeros(capacity + 1, np.int64)
        counts[part["size"].to_numpy()] = part["n"].to_numpy()
        recipes = plan(counts, int(capacity))
        frames.append(slots(recipes).assign(spec_id=spec))
        firsts.append((int(spec), sum(r.repeats for r in recipes)))
        shares += [(int(spec), int(s), int(-(-n // RANK_ROWS))) for s, n in zip(part["size"], part["n"], strict=True)]
    slot_table = spark.createDataFrame(
        pd.concat(frames)[["spec_id", "size", "r0", "r1", "base", "each"]] if frames else [],
        "spec_id long, size long, r0 long, r1 long, base long, each long",
    )
    share_table = spark.createDataFrame(shares, "spec_id long, size long, shares int")
    first_split = spark.createDataFrame([*firsts, *((int(r["spec_id"]), 0) for r in wanted if r["spec_id"] not in dict(firsts))], "spec_id long, packed long")
    parts = (
        items.where("rest > 0").withColumnRenamed("rest", "size")
        .join(F.broadcast(share_table), ["spec_id", "size"])  # at most the sum of the capacities
        .withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int"))
        .withColumn("in_share", F.row_number().over(Window.partitionBy("spec_id", "size", "share").orderBy("row")) - 1)
    )
    parts = scratch.save(parts.select("spec_id", "doc_id", "size", "full", "share", "in_share"))
    offsets = (
        parts.groupBy("spec_id", "size", "share").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("spec_id", "size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)))
        .select("spec_id", "size", "share", F.coalesce("before", F.lit(0)).alias("before"))
    )
    few = F.broadcast if sum(map(len, frames)) <= MAX_SLOTS else (lambda t: t)
    last = (
        parts.join(few(offsets) if len(shares) <= MAX_SLOTS else offsets, ["spec_id", "size", "share"]).withColumn("rank", F.col("before") + F.col("in_share"))
        .join(few(slot_table), ["spec_id", "size"]).where("rank >= r0 and rank < r1")
        .select(
            "spec_id", "doc_id", (F.col("full") + 1).alias("piece"), (F.col("full") + 1).alias("n_pieces"), F.col("size").alias("tokens"),
            (F.col("base") + F.floor((F.col("rank") - F.col("r0")) / F.col("each")) + 1).alias("container"),
        )
    )
    # Full pieces stand in containers of their own, numbered from the last packed one on: by shares of the split rows,
    # then within a share.
    split = items.where("full > 0").withColumn("n_pieces", F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0))
    n_split = {r["spec_id"]: r["n"] for r in split.groupBy("spec_id").agg(F.count("*").alias("n")).collect()}
    share_of = F.lit(1)
    for spec, n in n_split.items():
        share_of = F.when(F.col("spec_id") == spec, F.lit(-(-n // RANK_ROWS))).otherwise(share_of)
    shared = split.withColumn("share", F.pmod(F.xxhash64("row"), share_of).cast("int"))
    in_order = Window.partitionBy("spec_id", "share").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    shared = scratch.save(shared.withColumn("in_share", F.coalesce(F.sum("full").over(in_order), F.lit(0))))
    firsts_of = (
        shared.groupBy("spec_id", "share").agg(F.sum("full").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("spec_id").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(first_split), "spec_id").select("spec_id", "share", (F.col("packed") + F.col("before")).alias("first"))
    )
    whole = (
        shared.join(firsts_of, ["spec_id", "share"])
        .withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), "full")))
        .select("spec_id", "doc_id", "piece", "n_pieces", F.col("capacity").alias("tokens"), (F.col("first") + F.col("in_share") + F.col("piece")).alias("container"))
    )
    empty = items.where("n_tokens = 0").select(
        "spec_id", "doc_id", F.lit(1).cast("long").alias("piece"), F.lit(1).cast("long").alias("n_pieces"),
        F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("container"),
    )
    return last.unionByName(whole).unionByName(empty)
