"""Duplicates hidden by formatting (problem 1).

A record is a multiset of (field name, normalised value) pairs. Each pair is hashed; the hashes are added, so neither
the order of fields nor that of the pieces of a field matters and nothing is sorted. Records are grouped by two such
sums, and each member of a group is compared with the group's first record, pair by pair.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.operators.hotkeys import join_group
from lodewright.session import Scratch

_MISSING = "\u0000"
_SEEDS = (17, 7919)


def multiset_hash(pairs: Column, seed: int) -> Column:
    """Order-free sum over the pairs modulo 2 to the 55th, cut after each addition, so that no number of pairs overflows."""
    cut = F.lit((1 << 55) - 1).cast("long")
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: (acc + F.shiftright(F.xxhash64(F.lit(seed), x), 9)).bitwiseAND(cut))


def same_multiset(a: Column, b: Column) -> Column:
    """Equality of two arrays as multisets: as they stand, or by how often each value occurs, without sorting."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return (a == b) | ((F.size(a) == F.size(b)) & F.forall(F.array_distinct(a), lambda x: times(a, x) == times(b, x)))


def as_pairs(fields: Mapping[str, Column]) -> Column:
    """Pairs of field name and value; each value is an array of strings, and null stands for a missing value."""

    def named(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array(F.lit(_MISSING))), lambda x: F.concat(F.lit(name + "\u0001"), x))

    return F.concat(*(named(name, values) for name, values in fields.items()))


def collapse(df: DataFrame, id_col: str, pairs_col: str, hot_rows: int | None = None) -> DataFrame:
    """(`first_id`, `id`) for every record: the smallest id among its copies and its own.

    Rows whose pairs are null take no part. Missing values equal each other. Repeated rows of one id give repeated
    rows. An empty input gives an empty output; other columns are ignored.

    The normalised pairs and their sums are written once. Grouping sends two sums, an id and a count, combined on the
    map side. Records of one copy are done then; of the others, whole records meet their group's first record, and
    groups with a large share of the rows are split over many tasks (`join_group`). Records whose sums collide with
    those of another record form groups of their own in a further round.
    """
    scratch = Scratch(df.sparkSession)
    pairs = scratch.save(df.where(F.col(pairs_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(pairs_col).alias("pairs")))
    rest = scratch.save(pairs.select("id", "pairs", multiset_hash(F.col("pairs"), _SEEDS[0]).alias("h1"), multiset_hash(F.col("pairs"), _SEEDS[1]).alias("h2")))
    scratch.drop(pairs)
    found = None
    while True:
        groups = scratch.save(rest.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")))
        several = groups.where("n > 1")
        members = scratch.save(join_group(rest, several, ["h1", "h2"], "id", hot_rows=hot_rows))
        heads = members.where("id = first_id").groupBy("h1", "h2").agg(F.first("pairs").alias("first_pairs"))
        heads = scratch.save(heads.join(several.select("h1", "h2", "n"), ["h1", "h2"]))
        other = F.when(~same_multiset(F.col("pairs"), F.col("first_pairs")), F.col("pairs")).alias("other")
        compared = scratch.save(join_group(members, heads, ["h1", "h2"], "id", hot_rows=hot_rows).select("h1", "h2", "first_id", "id", other))
        part = groups.where("n = 1").select("first_id", F.col("first_id").alias("id")).unionByName(compared.where("other is null").select("first_id", "id"))
        found = part if found is None else found.unionByName(part)
        rest = compared.where("other is not null").select("id", F.col("other").alias("pairs"), "h1", "h2")
        if rest.isEmpty():
            return found


def collapsed(df: DataFrame, id_col: str, pairs_col: str) -> DataFrame:
    """(`first_id`, `n_copies`): one row for each record, with how many rows hold it."""
    return collapse(df, id_col, pairs_col).groupBy("first_id").agg(F.count("*").alias("n_copies"))
