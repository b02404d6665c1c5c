"""The queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.llm import calibrated_sample, cross_split, density_clusters, format_duplicates, leakage, packing, reading_level, related_splits
from lodewright.llm.cleanform import clean_form, clean_pieces, missing_to_null
from lodewright.operators.hotkeys import join_group
from lodewright.session import Scratch, table
from lodewright.sources.rejects import let


def _one(body):
    """The body as a function of one argument, which is what an array function takes for a value alone."""
    return lambda x: body(x)


def _format_rows(spark: SparkSession, d: str) -> DataFrame:
    """Both tables' records as multisets of fields; a structure has one value for each of its pieces."""

    def text(x):
        return F.when(x.isNotNull(), F.array(x.cast("string")))

    tv, tc = table(spark, d, "train_val"), table(spark, d, "testcase")
    parts = []
    for rows, name, structure, others in (
        (tv, "train_val", "drug", {"endpoint": text(F.col("endpoint")), "y": text(missing_to_null(F.col("y")))}),
        (tc, "testcase", "smiles", {"pchembl": text(missing_to_null(F.col("pchembl")))}),
    ):
        fields = {"table": F.array(F.lit(name)), **others}
        as_record = lambda pieces, fields=fields: F.when(F.size(pieces) > 0, format_duplicates.as_pairs(fields | {"structure": pieces}))
        parts.append(rows.select("rec_id", let(clean_pieces(F.col(structure)), _one(as_record)).alias("pairs")))
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = format_duplicates.collapse(_format_rows(spark, d), "rec_id", "pairs")
    return groups.where("id <> first_id").select(F.col("first_id").alias("first_rec_id"), F.col("id").alias("rec_id"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.collapsed(_format_rows(spark, d), "rec_id", "pairs").withColumnRenamed("first_id", "first_rec_id")


def _sampling(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, d, "train_val").select(
        F.col("rec_id").alias("id"), F.col("endpoint").alias("stratum"), missing_to_null(F.col("y")).alias("value")
    )
    bands = table(spark, d, "y_bands").select(
        "band_id", F.col("endpoint").alias("stratum"), F.col("y_from").alias("low"), F.col("y_below").alias("below"), "target_pct", "min_rows"
    )
    strata = table(spark, d, "assay_endpoints").select(F.col("endpoint").alias("stratum"), "sample_pct")
    return rows, bands, strata


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Bands of which the sample lacks rows."""
    return calibrated_sample.sample_report(*_sampling(spark, d)).where("missed > 0").select("band_id")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    rows, bands, strata = _sampling(spark, d)
    return calibrated_sample.draw(rows, bands, calibrated_sample.band_plan(rows, bands, strata)).withColumnRenamed("id", "rec_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    report = calibrated_sample.sample_report(*_sampling(spark, d))
    return report.select("band_id", F.col("stratum").alias("endpoint"), "n_rows", "wanted", "n_drawn", "shortfall")


def p2_crossed(spark: SparkSession, d: str) -> DataFrame:
    """A sample whose bands and splits both have the shares wanted: by endpoint and split, its rows and their share of all."""
    rows, bands, strata = _sampling(spark, d)
    split = table(spark, d, "train_val").select(F.col("rec_id").alias("id"), F.col("endpoint").alias("stratum"), missing_to_null(F.col("y")).alias("value"), F.coalesce("split_name", F.lit("")).alias("category"))
    plan = calibrated_sample.crossed_plan(split, bands, strata)
    expected = plan.groupBy("stratum", "category").agg(F.sum("n_rows").alias("n_rows"), F.sum("expected").alias("expected"))
    drawn = calibrated_sample.draw(split, bands, plan).join(split.select("id", "stratum", "category"), "id").groupBy("stratum", "category").agg(F.count("*").alias("n_drawn"))
    return expected.join(drawn, ["stratum", "category"], "left").select(
        F.col("stratum").alias("endpoint"), F.col("category").alias("split_name"), "n_rows", F.round("expected", 3).alias("expected"), F.coalesce("n_drawn", F.lit(0)).alias("n_drawn")
    )


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tv = table(spark, d, "train_val").select("rec_id", "drug", "split_name", "source")
    train = tv.where("split_name = 'train'").select(F.col("rec_id").alias("id"), clean_form(F.col("drug")).alias("text"), "source")
    parts = [
        (tv.where("split_name = 'valid'"), "drug", "valid"),
        (table(spark, d, "test_set"), "drug", "test_set"),
        (table(spark, d, "testcase"), "smiles", "testcase"),
    ]
    evals = reduce(
        DataFrame.unionByName,
        [t.select(F.col("rec_id").alias("id"), clean_form(F.col(c)).alias("text"), F.lit(n).alias("part"), "source") for t, c, n in parts],
    )
    return train, evals


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    train, evals = (scratch.save(x.select("id", "text")) for x in _sides(spark, d))
    pairs = cross_split.cross_split_pairs(train, evals, scratch=scratch)
    return pairs.select(F.least("train_id", "eval_id").alias("rec_id_a"), F.greatest("train_id", "eval_id").alias("rec_id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: evaluation records with an overlap, and pairs."""
    scratch = Scratch(spark)
    train, evals = (scratch.save(x) for x in _sides(spark, d))
    counted = cross_split.overlap_counts(train, evals, scratch=scratch)
    return counted.groupBy("part", "source").agg(F.count("*").alias("n_records"), F.sum("n_pairs").alias("n_pairs"))


_KEYS = ["compound", "study"]


def _related(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_val").select(
        "rec_id", clean_form(F.col("drug")).alias("compound"), related_splits.code_key(F.col("study_id")).alias("study"), missing_to_null(F.col("y")).alias("value"), "loaded_at"
    )


def _batches(spark: SparkSession, d: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The records loaded first, about nine tenths, and those loaded later."""
    rows = scratch.save(_related(spark, d))
    cut = rows.agg(F.percentile_approx("loaded_at", F.lit(0.9))).first()[0]
    late = F.coalesce(F.col("loaded_at") > F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)
    return rows.where(~late), rows.where(late)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The groups of the component table after two batches, in the order of loading."""
    scratch = Scratch(spark)
    store = related_splits.ComponentTable(spark, f"{scratch.root}/components")
    for batch in _batches(spark, d, scratch):
        store.extend(batch, "rec_id", _KEYS, scratch=scratch)
    groups = scratch.save(store.groups(scratch))
    several = scratch.save(groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"))
    return join_group(groups, several, ["group_id"], "id").select(F.col("group_id").alias("group_rec_id"), F.col("id").alias("rec_id"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """One split for each record: the whole table as the first batch of a component table."""
    scratch = Scratch(spark)
    store = related_splits.ComponentTable(spark, f"{scratch.root}/components")
    given = store.extend(_related(spark, d), "rec_id", _KEYS, related_splits.Targets.of(table(spark, d, "split_targets")), "value", scratch)
    named = scratch.save(given.select(F.col("component").alias("group_id"), "split_name", F.col("n_rows").alias("n")))
    return join_group(store.groups(scratch), named, ["group_id"], "id").select(F.col("id").alias("rec_id"), "split_name")


def p5_increment(spark: SparkSession, d: str) -> DataFrame:
    """What the records loaded later did to the components: kept, new and in conflict, by split."""
    scratch = Scratch(spark)
    store = related_splits.ComponentTable(spark, f"{scratch.root}/components")
    targets = related_splits.Targets.of(table(spark, d, "split_targets"))
    for batch in _batches(spark, d, scratch):
        given = store.extend(batch, "rec_id", _KEYS, targets, "value", scratch)
    return given.groupBy("status", "split_name").agg(F.count("*").alias("n_groups"), F.sum("n_rows").alias("n_rows"))


def _structures(spark: SparkSession, d: str) -> DataFrame:
    return Scratch(spark).save(
        table(spark, d, "train_val").select(F.col("rec_id").alias("id"), clean_form(F.col("drug")).alias("text"))
        .unionByName(table(spark, d, "testcase").select(F.col("rec_id").alias("id"), clean_form(F.col("smiles")).alias("text")))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return density_clusters.linked_clusters(_structures(spark, d)).select(F.col("cluster_id").alias("cluster_rec_id"), F.col("id").alias("rec_id"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """With four samples to a core, so that mutual reachability weighs down thin chains."""
    return density_clusters.density_clusters(_structures(spark, d), density_clusters.Settings(min_samples=4))[0]


def _packed(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", packing.token_count(F.col("text")).cast("long").alias("n_tokens"))
    return packing.pack(scratch.save(docs), table(spark, d, "container_specs"), scratch)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_pieces > 1").select("spec_id", "doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per specification: containers used and the share of their room that is filled."""
    used = _packed(spark, d).where("container > 0").groupBy("spec_id").agg(F.count_distinct("container").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    return used.join(table(spark, d, "container_specs"), "spec_id").select(
        "spec_id", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled")
    )


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents").select("doc_id", "lang", "text"), table(spark, d, "level_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    formula = reading_level.readability(F.col("n_words"), F.col("n_letters"), F.col("n_sentences"))
    return _levels(spark, d).where(F.col("lang").isin("markdown", "text") & (F.col("n_words") >= 50) & (formula >= 18.0)).select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level", "grade")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    band = F.least(F.greatest(F.round("level"), F.lit(1)), F.lit(5)).cast("int")
    return _levels(spark, d).groupBy("lang", band.alias("band")).agg(F.count("*").alias("n_documents"), F.round(F.avg("level"), 4).alias("mean_level"))


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well levels agree with grades that were kept back."""
    out = reading_level.held_out(table(spark, d, "documents").select("doc_id", "lang", "text"), table(spark, d, "level_labels"))
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("error", "error_of_mean", "correlation")))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_collapsed, p2_found, p2_sample, p2_report, p2_crossed, p4_found, p4_report, p5_found, p5_splits, p5_increment, p6_found, p6_clusters,
        p7_found, p7_containers, p7_fill, p8_found, p8_spans, p9_found, p9_levels, p9_profile, p9_quality,
    )
}
