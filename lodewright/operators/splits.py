"""Train/test splits, folds and groups. All orders come from md5 of seed and id, so a split can be repeated anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.operators.hotkeys import join_group
from lodewright.operators.neighbours import tanimoto_links
from lodewright.operators.running import quantile_row, running_sums
from lodewright.session import Scratch


def digest(seed: int, *cols: str) -> Column:
    """Text whose order shuffles rows: md5 of the seed and the columns, joined with ":"."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


#: Rows whose ranks are counted in one task, on average.
RANK_ROWS = 100_000


def ranked(df: DataFrame, order: Column, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """The rows with their rank (from 1) by a hexadecimal digest within `keys`.

    Ranks are counted within the first digits of the digest and shifted by the sizes of the parts before; there are as
    many digits as leave about `RANK_ROWS` rows to a part, so no task sorts a whole class.
    """
    digits, n = 1, df.count()
    while n > RANK_ROWS * 16**digits:
        digits += 1
    cut = df.withColumn("__order", order).withColumn("__part", F.substring("__order", 1, digits))
    sizes = cut.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn(
        "__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), "__before")
    match = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__order"))
    return cut.join(before, match).withColumn(name, inner + F.col("__before")).select(*df.columns, name)


def random_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """The rows with `split`: the ceil(test_size n) first ones by digest are `test`."""
    n_test = F.ceil(F.lit(test_size) * F.lit(df.count()) - F.lit(1e-9))
    return ranked(df, digest(seed, id_col)).withColumn("split", F.when(F.col("rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))).drop("rank")


def stratified_split(df: DataFrame, id_col: str, class_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """As `random_split`, with the test rows shared out over the classes by largest remainders."""
    sizes = df.groupBy(class_col).agg(F.count("*").alias("n")).orderBy(class_col).limit(10_001).collect()
    if len(sizes) > 10_000:
        raise ValueError("more than 10,000 classes")
    total = sum(r["n"] for r in sizes)
    n_test = -int(-(test_size * total - 1e-9) // 1)
    shares = [r["n"] * n_test / max(total, 1) for r in sizes]
    quota = [int(s) for s in shares]
    for i in sorted(range(len(sizes)), key=lambda i: (-(shares[i] - quota[i]), i))[: n_test - sum(quota)]:
        quota[i] += 1
    allowed = F.lit(0)
    for r, q in zip(sizes, quota, strict=True):
        allowed = F.when(F.col(class_col).eqNullSafe(F.lit(r[class_col])), F.lit(q)).otherwise(allowed)
    marked = ranked(df, digest(seed, id_col), [class_col])
    return marked.withColumn("split", F.when(F.col("rank") <= allowed, F.lit("test")).otherwise(F.lit("train"))).drop("rank")


def repeated_folds(df: DataFrame, id_col: str, n_splits: int = 5, n_repeats: int = 5, class_col: str | None = None, seed: int = 42) -> DataFrame:
    """(`id`, [class], `repeat`, `fold`): each repeat deals the rows (of each class) to the folds in a new order."""
    keep = [id_col, *([class_col] if class_col else [])]
    rows = df.select(*keep, F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    keys = ["repeat", *([class_col] if class_col else [])]
    return ranked(rows, digest(seed, "repeat", id_col), keys).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(n_splits)).cast("int")).drop("rank")


def _group_key(id_col: str, group_col: str) -> Column:
    """The group as text; a row without one is a group of its own."""
    return F.coalesce(F.col(group_col).cast("string"), F.concat(F.lit("\u0000"), F.col(id_col).cast("string")))


def group_sizes(df: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """(`group`, `size`, `first_id`); rows without a group are groups of their own."""
    group = _group_key(id_col, group_col)
    return df.select(group.alias("group"), F.col(id_col).alias("i")).groupBy("group").agg(F.count("*").alias("size"), F.min("i").alias("first_id"))


def greedy_fill(groups: DataFrame, order: Sequence[Column], cutoff: int, first: str = "train", second: str = "test") -> DataFrame:
    """(`group`, `split`): groups in order go to `first` while they fit below the cutoff, else to `second`; a smaller
    group later on may still fit.

    Pass by pass: of the groups that are still small enough, all up to the first one that no longer fits are taken at
    once, by running sums over ranges of the order; that one is passed over, and only smaller groups after it remain.
    Each pass leaves less room than the group passed over was large, so there are few. Groups without a size, and the
    order of equal ones, follow the group's name.
    """
    scratch = Scratch(groups.sparkSession)
    every = scratch.save(groups.select("group", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("group").alias("g")).alias("key")))
    left, room, taken = every.where(F.col("size") <= max(cutoff, 0)), cutoff, every.limit(0).select("group")
    while room >= 0:
        sums = scratch.save(running_sums(left, [], ["key"], {"upto": "size"}, scratch))
        stop = sums.where(F.col("upto") > room).agg(F.min("key").alias("key"), F.count("*").alias("n")).first()
        if not stop["n"]:
            taken = taken.unionByName(sums.select("group"))
            break
        stopped = sums.where(F.col("upto") > room).orderBy("key").limit(1).select(F.col("key").alias("stop"))
        marked = sums.join(F.broadcast(stopped))  # one row
        inside = scratch.save(marked.where("key < stop").select("group", "size"))
        taken = taken.unionByName(inside.select("group"))
        room -= inside.agg(F.sum("size")).first()[0] or 0
        left = scratch.save(marked.where((F.col("key") > F.col("stop")) & (F.col("size") <= room)).select("group", "size", "key"))
    return every.join(taken.withColumn("hit", F.lit(True)), "group", "left").select("group", F.when(F.col("hit"), F.lit(first)).otherwise(F.lit(second)).alias("split"))


def group_split(df: DataFrame, id_col: str, group_col: str, test_size: float = 0.2, seed: int | None = None) -> DataFrame:
    """The rows with `split`, groups kept together.

    Without a seed, groups by falling size (then falling first id) fill the training part; with one, groups in shuffled
    order fill the test part up to floor(test_size n).
    """
    n = df.count()
    groups = group_sizes(df, id_col, group_col)
    if seed is None:
        placed = greedy_fill(groups, [-F.col("size"), -F.col("first_id")], int((1 - test_size) * n + 1e-9))
    else:
        placed = greedy_fill(groups, [digest(seed, "first_id")], int(test_size * n + 1e-9), "test", "train")
    named = placed.join(groups.select("group", "size"), "group").select(F.col("group").alias("__group"), "split", F.col("size").alias("n"))
    out = join_group(df.withColumn("__group", _group_key(id_col, group_col)), Scratch(df.sparkSession).save(named), ["__group"], id_col)
    return out.drop("__group")


def stratified_group_folds(df: DataFrame, id_col: str, group_col: str, class_col: str | None = None, n_splits: int = 5, activity_col: str | None = None, n_bins: int = 5, seed: int | None = None) -> DataFrame:
    """The rows with `fold`, groups kept together and dealt out so that folds get like shares of every stratum.

    A group's stratum is its most frequent class (the first by name on a tie; a missing class is one more), or, for
    numbers, the bin of its mean activity among `n_bins` quantiles of groups (groups without one are a stratum of their
    own). Within a stratum groups go to the folds forth and back by falling size, then first id, or in an order
    shuffled by `seed`. Rows without a group are groups of their own. Groups are ranked by running sums and rows meet
    their group by `join_group`, so neither many groups nor a large one fills a task.
    """
    scratch = Scratch(df.sparkSession)
    key = _group_key(id_col, group_col)
    if (class_col is None) == (activity_col is None):
        raise ValueError("name either class_col or activity_col")
    base = scratch.save(df.withColumn("__g", key))
    if class_col is not None:
        counts = base.groupBy("__g", F.coalesce(F.col(class_col).cast("string"), F.lit("")).alias("c")).agg(F.count("*").alias("n"), F.min(id_col).alias("f"))
        groups = counts.groupBy("__g").agg(F.sum("n").alias("n"), F.min("f").alias("f"), F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("stratum"))
    else:
        means = scratch.save(base.groupBy("__g").agg(F.count("*").alias("n"), F.min(id_col).alias("f"), F.avg(F.col(activity_col).cast("double")).alias("mean")))
        cuts = quantile_row(means, {"mean": F.col("mean")}, [b / n_bins for b in range(1, n_bins)]).get("mean", [])
        place = sum((F.when(F.col("mean") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
        groups = means.withColumn("stratum", F.when(F.col("mean").isNotNull(), place).otherwise(F.lit(-1)).cast("string"))
    groups = scratch.save(groups.select("__g", "n", "f", "stratum", F.lit(1).alias("one")))
    order = [-F.col("n"), F.col("f")] if seed is None else [digest(seed, "f")]
    ranks = running_sums(groups, ["stratum"], order, {"rank": "one"}, scratch)
    turn = F.pmod(F.col("rank") - 1, F.lit(2 * n_splits))
    fold = F.when(turn < n_splits, turn).otherwise(2 * n_splits - 1 - turn).cast("int")
    return join_group(base, scratch.save(ranks.select("__g", "n", fold.alias("fold"))), ["__g"], id_col).drop("__g")


def group_checks(df: DataFrame, id_col: str, group_col: str, split_col: str) -> DataFrame:
    """One row: `n_rows`, `n_groups`, `n_unplaced` (rows without a split) and `n_parted` (groups in more than one split)."""
    rows = df.select(_group_key(id_col, group_col).alias("g"), F.col(split_col).cast("string").alias("s"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("s").isNull()).alias("gaps"), (F.min("s") != F.max("s")).alias("parted"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_groups"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("n_unplaced"), F.count_if(F.col("parted")).alias("n_parted"))


def sphere_exclusion(rows: DataFrame, cutoff: float = 0.35) -> DataFrame:
    """(`id`, `cluster`): clusters around the row with the most neighbours within the cutoff, again and again.

    `rows` (`id`, `bits`). A row becomes a centre once no row left around it comes first, so all local leaders of a
    round are taken at once; the result is that of taking them one at a time. Neighbour counts are those of the start.
    """
    scratch = Scratch(rows.sparkSession)
    links = tanimoto_links(rows, cutoff)
    both = scratch.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    left = scratch.save(rows.select("id").join(degree, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))
    done = left.limit(0).select("id", F.col("id").alias("cluster"))
    while not left.isEmpty():
        key = F.struct(-F.col("n"), F.col("id"))
        rank = left.select("id", key.alias("key"))
        near = both.join(rank.withColumnRenamed("id", "b").withColumnRenamed("key", "other"), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        second = both.join(near.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("far"))
        centres = scratch.save(
            rank.join(near, "id", "left").join(second, "id", "left")
            .where((F.col("other").isNull() | (F.col("key") < F.col("other"))) & (F.col("far").isNull() | (F.col("key") <= F.col("far")))).select("id")
        )
        members = both.join(centres, both["a"] == centres["id"]).select(F.col("b").alias("id"), F.col("a").alias("cluster")).join(left.select("id"), "id")
        taken = scratch.save(members.groupBy("id").agg(F.min("cluster").alias("cluster")).union(centres.select("id", F.col("id").alias("cluster"))))
        done = done.union(taken)
        left = scratch.save(left.join(taken.select("id"), "id", "left_anti"))
    return done


OPTIONS = ("random", "stratified_random", "scaffold", "random_scaffold", "stratified_scaffold", "butina")


def split(df: DataFrame, option: str, id_col: str, activity_col: str, group_col: str | None = None, test_size: float = 0.2, n_splits: int = 5, cutoff: float = 0.35, seed: int = 42) -> DataFrame:
    """One entry for all ways of splitting: the rows with `split`."""
    if option == "random":
        return random_split(df, id_col, test_size, seed)
    if option == "stratified_random":
        return stratified_split(df, id_col, activity_col, test_size, seed)
    if option == "scaffold":
        return group_split(df, id_col, group_col, test_size)
    if option == "random_scaffold":
        return group_split(df, id_col, group_col, test_size, seed)
    if option == "stratified_scaffold":
        folds = stratified_group_folds(df, id_col, group_col, activity_col, n_splits)
        return folds.withColumn("split", F.when(F.col("fold") == 0, F.lit("test")).otherwise(F.lit("train"))).drop("fold")
    if option == "butina":
        clusters = sphere_exclusion(df.select(F.col(id_col).alias("id"), F.col(group_col).alias("bits")), cutoff)
        named = df.join(clusters.withColumnRenamed("id", id_col), id_col)
        return group_split(named, id_col, "cluster", test_size).drop("cluster")
    raise ValueError(f"option must be one of {', '.join(OPTIONS)}")
