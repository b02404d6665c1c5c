"""Same or near-same records across splits (problem 4): an edit-distance segment join.

Each distinct evaluation text is cut into k + 1 segments, of which at least one survives k edits; each distinct
training text is looked up by its substrings at the positions where such a segment can stand. The candidates are
verified by banded dynamic programming. Copies are expanded only at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.llm.edits import segment_keys, signature, signature_distance, substring_keys, within
from lodewright.operators.hotkeys import join_group
from lodewright.session import Scratch


#: A class of copies is spread over one more part for each so many rows when pairs are expanded.
PART_ROWS = 50_000


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.where("text is not null and text <> ''").groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def linked_texts(train: DataFrame, evals: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(`train_id`, `eval_id`): links between first records of distinct texts, from (`id`, `text`, `s0`, `s1`).

    Pairs meet under a key only to be compared by their character counts in the join condition; what passes is a true
    pair with few exceptions. A key that very many texts share is split by adaptive execution; it costs comparisons
    of two longs, but no rows.
    """
    probe = train.select(F.col("id").alias("train_id"), F.col("s0").alias("t0"), F.col("s1").alias("t1"), F.explode(F.array_distinct(substring_keys(F.col("text"), k))).alias("key"))
    index = evals.select(F.col("id").alias("eval_id"), F.col("s0").alias("e0"), F.col("s1").alias("e1"), F.explode(F.array_distinct(segment_keys(F.col("text"), k))).alias("key"))
    near = signature_distance([F.col("t0"), F.col("t1")], [F.col("e0"), F.col("e1")]) <= 2 * k
    pairs = probe.join(index, "key").where(near).select("train_id", "eval_id").distinct()
    left = train.select(F.col("id").alias("train_id"), F.col("text").alias("train_text"))
    right = evals.select(F.col("id").alias("eval_id"), F.col("text").alias("eval_text"))
    return scratch.save(
        pairs.join(left, "train_id").join(right, "eval_id")
        .where(within(F.col("train_text"), F.col("eval_text"), k)).select("train_id", "eval_id")
    )


def _classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct texts under their first record's id, with their number of rows and signatures."""
    s0, s1 = signature(F.col("text"))
    return scratch.save(_distinct(rows.select("id", "text")).select("id", "text", "n", s0.alias("s0"), s1.alias("s1")))


def _members(rows: DataFrame, classes: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """(`id`, `n`, `member`): the rows of the linked classes, whatever the size of a class."""
    wanted = scratch.save(classes.join(linked, "id").select("text", "id", F.col("n").alias("size"), "n"))
    own = rows.where("text is not null and text <> ''").withColumnRenamed("id", "member")
    return join_group(own, wanted, ["text"], "member").drop("text").withColumnRenamed("size", "n")


def _spread(links: DataFrame, members: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """Links with the class `name` replaced by its members; large classes meet their links part by part."""
    parts = F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("int")
    many = links.join(sizes.select(F.col("id").alias(f"{name}_id"), "n"), f"{name}_id")
    many = many.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    own = members.select(F.col("id").alias(f"{name}_id"), F.col("member").alias(f"{name}_member"), F.pmod(F.xxhash64("member"), parts).cast("int").alias("part"))
    return many.join(own, [f"{name}_id", "part"]).drop("part", f"{name}_id")


def cross_split_pairs(train: DataFrame, evals: DataFrame, k: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(`train_id`, `eval_id`): every pair of a training and an evaluation record at most k edits apart.

    Both inputs are (`id`, `text`). Null and empty texts take no part. Repeated rows give repeated pairs. An empty
    side gives no pairs. Texts of any length are compared whole.
    """
    scratch = scratch or Scratch(train.sparkSession)
    train, evals = train.select("id", "text"), evals.select("id", "text")
    firsts = [_classes(rows, scratch) for rows in (train, evals)]
    links = linked_texts(*firsts, k, scratch)
    for rows, first, name in zip((train, evals), firsts, ("train", "eval"), strict=True):
        linked = links.select(F.col(f"{name}_id").alias("id")).distinct()
        links = _spread(links, _members(rows, first, linked, scratch), first, name)
    return links.select(F.col("train_member").alias("train_id"), F.col("eval_member").alias("eval_id"))


def overlap_counts(train: DataFrame, evals: DataFrame, k: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """`evals` with `n_pairs`, the number of training records at most k edits away, for records that have any.

    As `cross_split_pairs`, but pairs are counted by the sizes of the classes of copies and never expanded. Other
    columns of `evals` are kept.
    """
    scratch = scratch or Scratch(train.sparkSession)
    firsts = [_classes(rows, scratch) for rows in (train, evals)]
    links = linked_texts(*firsts, k, scratch)
    sizes = firsts[0].select(F.col("id").alias("train_id"), F.col("n").alias("n_train"))
    counted = links.join(sizes, "train_id").groupBy(F.col("eval_id").alias("id")).agg(F.sum("n_train").alias("n_pairs"))
    wanted = scratch.save(firsts[1].join(counted, "id").select("text", "n_pairs", F.col("n").alias("__n")))
    return join_group(evals, wanted, ["text"], "id", n_col="__n")
