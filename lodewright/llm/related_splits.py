"""Splits that keep related records together (problem 5).

A persisted table maps components to splits. New records extend it: components are merged by pointer jumping, those
that have a split keep it, new ones fill the deficits, and merges of components with different splits are quarantined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.llm.components import connected_components, jump_to_roots
from lodewright.operators.hotkeys import join_group
from lodewright.session import Scratch

#: Components with at least this share of the rows are placed one by one; there can be only 1 / LARGE of them.
LARGE = 1 / 1000
#: Resolution of the shares of small components: buckets of a component's hash in each stratum.
BUCKETS = 4096
QUARANTINE = "quarantine"


def _marked(df: DataFrame, id_col: str, keys: list[str], scratch: Scratch, more: list[str] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(`id`, `m0`, ...): each row with the smallest id of each of its key values; and by key (`k`, `m`, `n`)."""
    rows = scratch.save(df.select(F.col(id_col).alias("id"), *(more or []), *(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys))))
    heads = [scratch.save(rows.where(f"k{i} is not null").groupBy(f"k{i}").agg(F.min("id").alias(f"m{i}"), F.count("*").alias("n"))) for i in range(len(keys))]
    marked = rows
    for i, head in enumerate(heads):
        marked = join_group(marked, head, [f"k{i}"], "id", how="left")
    marked = scratch.save(marked.select("id", *(more or []), *(f"m{i}" for i in range(len(keys)))))
    return marked, [h.select(F.col(f"k{i}").alias("k"), F.col(f"m{i}").alias("m"), "n") for i, h in enumerate(heads)]


def _anchored(marked: DataFrame, roots: DataFrame, n_keys: int, scratch: Scratch) -> DataFrame:
    """Rows of `marked` with `group_id`: the root of their anchor, the smallest id of their first key value (or their own id)."""
    rows = marked.withColumn("anchor", F.coalesce(*(f"m{i}" for i in range(n_keys)), "id"))
    sizes = rows.groupBy("anchor").agg(F.count("*").alias("n"))
    groups = scratch.save(sizes.join(roots, F.col("anchor") == F.col("node"), "left").select("anchor", "n", F.coalesce("root", "anchor").alias("group_id")))
    return join_group(rows, groups, ["anchor"], "id").drop("anchor", *(f"m{i}" for i in range(n_keys)))


def _row_edges(marked: DataFrame, n_keys: int) -> DataFrame:
    ends = [F.col(f"m{i}") for i in range(n_keys)]
    anchor = F.coalesce(*ends, "id")
    return reduce(DataFrame.union, [marked.where(e != anchor).select(anchor.alias("a"), e.alias("b")).distinct() for e in ends])


def group_records(df: DataFrame, id_col: str, keys: list[str], scratch: Scratch | None = None) -> DataFrame:
    """(`id`, `group_id`) for every row: the smallest id that is linked to it through equal values of any key.

    A null key links nothing, so a row without keys is its own group. Repeated rows of an id stay repeated.

    Each key value stands for its smallest id, so rows become edges between those, and copies of a value or study
    collapse before any component is computed. Rows of frequent values are spread over parts (`join_group`).
    """
    scratch = scratch or Scratch(df.sparkSession)
    marked, _ = _marked(df, id_col, keys, scratch)
    roots = connected_components(_row_edges(marked, len(keys)), scratch)
    return _anchored(marked, roots, len(keys), scratch).select("id", "group_id")


class ComponentTable:
    """The persisted table of components: batches of records extend it, and only what a batch touches is written.

    In a folder that all executors share, each batch adds a part to `keys` (`kind`, `k`, `component`: values seen for
    the first time), `pointers` (`component`, `to`: components that merged into another), `components` (`component`,
    `n_rows`, `total`, `n_valued`, `split_name`, `status`: the state of those that changed) and `members` (`id`,
    `component`). A component is named by its smallest id. A part counts only once the batch's last table, `done`,
    is written, so a batch that failed can be repeated; batches come one at a time. Ids are new in each batch.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def n_batches(self) -> int:
        n = 0
        while self._exists(f"{self.root}/{n:05d}/done"):
            n += 1
        return n

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{b:05d}/{name}" for b in range(self.n_batches())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, (p.withColumn("batch", F.lit(b)) for b, p in enumerate(parts))) if name == "components" else reduce(DataFrame.unionByName, parts)

    def roots(self, scratch: Scratch) -> DataFrame:
        """(`node`, `root`) of every component that has merged into another, by jumping along the pointers of all batches."""
        if self.n_batches() < 2:  # a first batch merges nothing
            return self.spark.createDataFrame([], "node long, root long")
        pointers = self._read("pointers", "component long, to long").select(F.col("component").alias("node"), "to")
        return jump_to_roots(scratch.save(pointers), scratch).where("node <> root")

    def components(self) -> DataFrame:
        """(`component`, `n_rows`, `total`, `n_valued`, `split_name`, `status`): the latest state of each root."""
        schema = "component long, n_rows long, total double, n_valued long, split_name string, status string"
        if not self.n_batches():
            return self.spark.createDataFrame([], schema)
        state = self._read("components", schema)
        cols = ["n_rows", "total", "n_valued", "split_name", "status"]
        last = state.groupBy("component").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("component", "s.*")
        gone = self._read("pointers", "component long, to long").select("component").distinct()
        return last.join(gone, "component", "left_anti")

    def groups(self, scratch: Scratch | None = None) -> DataFrame:
        """(`id`, `group_id`) for all records of all batches."""
        scratch = scratch or Scratch(self.spark)
        members = scratch.save(self._read("members", "id long, component long"))
        sizes = members.groupBy("component").agg(F.count("*").alias("n"))
        roots = self.roots(scratch).withColumnRenamed("node", "component")
        named = scratch.save(sizes.join(roots, "component", "left").select("component", "n", F.coalesce("root", "component").alias("group_id")))
        return join_group(members, named, ["component"], "id").select("id", "group_id")

    def extend(self, df: DataFrame, id_col: str, keys: list[str], targets: Targets | None = None, value_col: str | None = None, scratch: Scratch | None = None) -> DataFrame:
        """Add a batch; gives (`component`, `n_rows`, `split_name`, `status`) of the components it touched.

        Key values of the batch that are known link its records to their components; merges are found by components
        over the batch's own edges and those links alone. With `targets`, a component that has a split keeps it
        (`kept`), a new one fills the deficits (`new`), and a merge of components with different splits is
        quarantined (`conflict`). Without, splits stay null. An empty batch changes nothing.
        """
        scratch = scratch or Scratch(self.spark)
        here = f"{self.root}/{self.n_batches():05d}"
        value = F.col(value_col).cast("double") if value_col else F.lit(None).cast("double")
        marked, heads = _marked(df.withColumn("__value", value), id_col, keys, scratch, ["__value"])
        first = not self.n_batches()
        before, merged, known = self._read("keys", "kind int, k string, component long"), self.roots(scratch), []
        for kind, head in enumerate(heads):
            if first:
                known.append(head.select(F.lit(kind).alias("kind"), "k", "m", F.lit(None).cast("long").alias("component")))
                continue
            old = before.where(F.col("kind") == kind).select("k", "component")
            seen = head.select("k", "m").join(old, "k", "left").join(merged, F.col("component") == F.col("node"), "left")
            known.append(scratch.save(seen.select(F.lit(kind).alias("kind"), "k", "m", F.coalesce("root", "component").alias("component"))))
        every = reduce(DataFrame.unionByName, known)
        links = every.where("component is not null").select(F.col("m").alias("a"), F.col("component").alias("b"))
        # Components keep a node of their own even where nothing else links them.
        edges = _row_edges(marked, len(keys))
        roots = connected_components(edges if first else edges.union(links), scratch)
        grouped = scratch.save(_anchored(marked, roots, len(keys), scratch))
        new_keys = every.where("component is null").join(roots, F.col("m") == F.col("node"), "left").select("kind", "k", F.coalesce("root", "m").alias("component"))
        new_keys.write.mode("overwrite").parquet(f"{here}/keys")
        touched = links.select(F.col("b").alias("component")).distinct()
        touched = touched.limit(0) if first else scratch.save(touched)
        moved = touched.join(roots, F.col("component") == F.col("node")).select("component", F.col("root").alias("to"))
        moved.where("component <> to").write.mode("overwrite").parquet(f"{here}/pointers")
        grouped.select("id", F.col("group_id").alias("component")).write.mode("overwrite").parquet(f"{here}/members")
        state = self.components() if first else scratch.save(self.components())
        old = state.join(moved, "component").select(F.col("to").alias("component"), "n_rows", "total", "n_valued", F.col("split_name").alias("low"), F.col("split_name").alias("high"))
        own = grouped.groupBy(F.col("group_id").alias("component")).agg(
            F.count("*").alias("n_rows"), F.coalesce(F.sum("__value"), F.lit(0.0)).alias("total"), F.count("__value").alias("n_valued")
        )
        none = F.lit(None).cast("string")
        changed = scratch.save(
            own.withColumns({"low": none, "high": none}).unionByName(old).groupBy("component")
            .agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total"), F.sum("n_valued").alias("n_valued"), F.min("low").alias("low"), F.max("high").alias("high"))
        )
        if targets is None:
            placed = changed.select("component", "n_rows", "total", "n_valued", none.alias("split_name"), none.alias("status"))
        else:
            rest = state.join(touched, "component", "left_anti")
            as_groups = lambda t, low, high: t.select(F.col("component").alias("group_id"), "n_rows", (F.col("total") / F.nullif("n_valued", F.lit(0))).alias("mean_value"), low.alias("low"), high.alias("high"))
            whole = as_groups(rest, F.col("split_name"), F.col("split_name")).withColumn("delta", F.lit(False)).unionByName(as_groups(changed, F.col("low"), F.col("high")).withColumn("delta", F.lit(True)))
            given = assign_groups(scratch.save(whole), targets, scratch=scratch).where("delta").select(F.col("group_id").alias("component"), "split_name", "status")
            placed = changed.join(given, "component").select("component", "n_rows", "total", "n_valued", "split_name", "status")
        placed.write.mode("overwrite").parquet(f"{here}/components")
        self.spark.range(1).write.mode("overwrite").parquet(f"{here}/done")
        return self.spark.read.parquet(f"{here}/components").select("component", "n_rows", "split_name", "status")


@dataclass(frozen=True)
class Targets:
    """Splits in order with their shares (summing to 1)."""

    names: tuple[str, ...]
    shares: tuple[float, ...]

    @staticmethod
    def of(table: DataFrame) -> Targets:
        """From (`split_name`, `target_pct`); splits are few, and more than 1000 are an error."""
        rows = table.where("split_name is not null").select("split_name", F.coalesce("target_pct", F.lit(0)).cast("double")).limit(1001).collect()
        if not 0 < len(rows) <= 1000:
            raise ValueError("between 1 and 1000 splits are needed")
        rows.sort(key=lambda r: (-r[1], r[0]))
        total = sum(r[1] for r in rows) or 1.0
        return Targets(tuple(r[0] for r in rows), tuple(r[1] / total for r in rows))


def assign(
    records: DataFrame, targets: Targets, persisted: DataFrame | None = None, seed: int = 42,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(`group_id`, `n_rows`, `split_name`, `status`) from `records` (`id`, `group_id`, `value`).

    `persisted` (`id`, `split_name`) holds records assigned before. A group whose assigned records agree keeps that
    split (`kept`); one whose records disagree gets the split `quarantine` (`conflict`); the rest is `new`.

    New groups fill what each split lacks of its share, within strata of equal mean value, so that values are similar
    in all splits: large groups go one by one to the split with the greatest deficit, small ones by thresholds on the
    hash of the group, which are read off a histogram so that the rows of each stratum divide as wanted. Only that
    histogram (11 strata x 4096 buckets) and at most 1000 large groups reach the driver.
    """
    scratch = scratch or Scratch(records.sparkSession)
    groups = records.groupBy("group_id").agg(F.count("*").alias("n_rows"), F.avg("value").alias("mean_value"))
    if persisted is not None:
        known = (
            records.select("id", "group_id").join(persisted.where("split_name is not null").select("id", "split_name"), "id")
            .groupBy("group_id").agg(F.min("split_name").alias("low"), F.max("split_name").alias("high"))
        )
        groups = groups.join(known, "group_id", "left")
    else:
        groups = groups.withColumns({"low": F.lit(None).cast("string"), "high": F.lit(None).cast("string")})
    return assign_groups(scratch.save(groups), targets, seed, scratch)


def assign_groups(groups: DataFrame, targets: Targets, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """`groups` (`group_id`, `n_rows`, `mean_value`, `low`, `high`: least and greatest split held so far, and more
    columns) with `split_name` and `status`, as `assign` says."""
    extra = [c for c in groups.columns if c not in ("group_id", "n_rows", "mean_value", "low", "high")]
    cuts = groups.where("mean_value is not null").selectExpr(
        "percentile_approx(mean_value, array(0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9), 10000) c"
    ).first()["c"]
    stratum = F.when(F.col("mean_value").isNull(), F.lit(-1)).otherwise(
        sum([F.when(F.col("mean_value") >= c, 1).otherwise(0) for c in cuts or []], F.lit(0))
    )
    marked = groups.select(
        "group_id", "n_rows", *extra, stratum.alias("stratum"), F.col("low").isNotNull().alias("held"), "low", "high",
        F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    total = groups.agg(F.sum("n_rows")).first()[0] or 0
    k, place = len(targets.names), {name: i for i, name in enumerate(targets.names)}
    least = max(1.0, total * LARGE)
    filled: dict[int, np.ndarray] = {}
    for r in marked.where("held and low = high").groupBy("stratum", "low").agg(F.sum("n_rows").alias("n")).collect():
        if r["low"] in place:
            filled.setdefault(r["stratum"], np.zeros(k))[place[r["low"]]] += r["n"]
    shares = np.array(targets.shares)
    large = marked.where(~F.col("held") & (F.col("n_rows") > least)).select("group_id", "n_rows", "stratum").collect()
    histogram = marked.where(~F.col("held") & (F.col("n_rows") <= least)).groupBy("stratum", "bucket").agg(F.sum("n_rows").alias("n")).toPandas()
    weight = {s: float(x) for s, x in histogram.groupby("stratum")["n"].sum().items()}
    for r in large:
        weight[r["stratum"]] = weight.get(r["stratum"], 0) + r["n_rows"]
    for s, x in filled.items():
        weight[s] = weight.get(s, 0) + x.sum()
    placed: list[tuple[int, str]] = []
    overall = sum(filled.values(), np.zeros(k))
    for r in sorted(large, key=lambda r: (-r["n_rows"], r["group_id"])):
        s = r["stratum"]
        own = filled.setdefault(s, np.zeros(k))
        to = int(np.argmax(shares * total - overall))
        own[to] += r["n_rows"]
        overall[to] += r["n_rows"]
        placed.append((r["group_id"], targets.names[to]))
    rule = F.lit(targets.names[0])
    carry = np.zeros(k)
    for s, part in histogram.groupby("stratum"):
        sizes = np.bincount(part["bucket"].to_numpy(), part["n"].to_numpy(), BUCKETS)
        lack = np.maximum(shares * weight[s] - filled.get(s, np.zeros(k)) + carry, 0)
        edges = np.searchsorted(np.cumsum(sizes), np.cumsum(lack / max(lack.sum(), 1e-9))[:-1] * sizes.sum(), side="right")
        bounds = [0, *edges.tolist(), BUCKETS]
        got = np.array([sizes[a:b].sum() for a, b in zip(bounds, bounds[1:], strict=False)])
        carry = carry + shares * weight[s] - filled.get(s, np.zeros(k)) - got
        inner = F.lit(targets.names[-1])
        for name, edge in list(zip(targets.names, edges.tolist(), strict=False))[::-1]:
            inner = F.when(F.col("bucket") < edge, F.lit(name)).otherwise(inner)
        rule = F.when(F.col("stratum") == int(s), inner).otherwise(rule)
    singles = marked.sparkSession.createDataFrame(placed, "group_id long, placed string")
    return (
        marked.join(F.broadcast(singles), "group_id", "left")  # at most 1 / LARGE rows
        .select(
            "group_id", "n_rows", *extra,
            F.when(F.col("low") != F.col("high"), F.lit(QUARANTINE)).otherwise(F.coalesce("low", "placed", rule)).alias("split_name"),
            F.when(F.col("low") != F.col("high"), F.lit("conflict")).when(F.col("held"), F.lit("kept")).otherwise(F.lit("new")).alias("status"),
        )
    )


def code_key(col: Column) -> Column:
    """A code without case, punctuation and spaces; only null gives null."""
    return F.regexp_replace(F.upper(col), "[^A-Z0-9]", "")
