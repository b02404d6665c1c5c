"""Reading level of each document (problem 9).

Documents and words form a bipartite graph, in which documents of similar style (word and sentence lengths) also share
nodes. Graded documents are clamped to their grades; every word takes the mean of
its documents and every other document the weighted mean of its words, again and again, until the levels are harmonic.
Words are numbered by a hash into a fixed number of buckets, so the word side is one vector of fixed size that each
iteration sends out, and no edge of the graph is ever shuffled.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.session import Scratch

RUN = re.compile(r"[A-Za-z]+")
SENTENCE_END = re.compile(r"[.!?]+(?=[ \t\r\n\f\x0b]|\Z)")
_NUMBERS: dict[str, int] = {}


@dataclass(frozen=True)
class Settings:
    """`buckets` of the word hash, at most `rounds` iterations until no word moves by more than `tolerance`, and
    `prior` documents of mean level added to each word. `style` is the weight of the edge to each of a document's three
    nodes of style, next to weights of words between 0.7 (in most documents) and about the logarithm of their number."""

    buckets: int = 1 << 18
    rounds: int = 25
    tolerance: float = 0.002
    prior: float = 2.0
    style: float = 50.0


def _number(word: str, buckets: int) -> int:
    if (n := _NUMBERS.get(word)) is None:
        if len(_NUMBERS) > 300_000:
            _NUMBERS.clear()
        n = _NUMBERS[word] = zlib.crc32(word.lower().encode()) % buckets
    return n


#: Nodes of each kind of style, after those of the words.
STYLES = 64


def style_nodes(n: int, letters: int, ends: int, buckets: int) -> list[int]:
    """Nodes shared by documents of similar style: letters a word, words a sentence (by logarithm), and both in one."""
    if not n:
        return []
    a, b = letters / n, n / ends
    marks = (int(a * 8), int(4 * math.log2(1 + b)), int(4.71 * a + 0.5 * b - 21.43) + 20)
    return [buckets + k * STYLES + min(max(m, 0), STYLES - 1) for k, m in enumerate(marks)]


def text_counts(text: str) -> tuple[int, int, int, list[str]]:
    """Words, letters in them, sentence ends (at least 1) and the words themselves."""
    runs = RUN.findall(text)
    return len(runs), sum(map(len, runs)), max(1, len(SENTENCE_END.findall(text))), runs


FEATURES = "doc_id long, lang string, n_words long, n_letters long, n_sentences long, words array<int>"


def _features(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                n, letters, ends, runs = text_counts(text.as_py() or "")
                rows.append((n, letters, ends, sorted({_number(w, buckets) for w in set(runs)}) + style_nodes(n, letters, ends, buckets)))
            counts = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(counts[3], pa.list_(pa.int32()))],
                names=["doc_id", "lang", "n_words", "n_letters", "n_sentences", "words"],
            )

    return run


def _document_levels(words: pa.ListArray, level: np.ndarray, weight: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of the documents of a batch, with the flat word numbers and their rows."""
    sizes = np.diff(words.offsets.to_numpy())
    flat = words.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    w = weight[flat]
    total = np.bincount(row, w, len(sizes))
    own = np.bincount(row, w * level[flat], len(sizes))
    return np.where(total > 0, own / np.maximum(total, 1e-12), mean), flat, row


def _spread(vectors, buckets: int, mean: float):
    """One half-iteration in a partition: document levels from word levels, summed back by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, weight = vectors.value
        total, n = np.zeros(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            docs, flat, row = _document_levels(batch.column(0), level, weight, mean)
            grade = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            docs = np.where(np.isnan(grade), docs, grade)
            total += np.bincount(flat, docs[row], buckets)
            n += np.bincount(flat, minlength=buckets)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen]), pa.array(n[seen])], names=["word", "total", "n"])

    return run


def _score(vectors, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, weight = vectors.value
        for batch in batches:
            docs = _document_levels(batch.column(batch.schema.get_field_index("words")), level, weight, mean)[0]
            keep = [c for c in batch.schema.names if c != "words"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(docs)], names=[*keep, "raw_level"])

    return run


def readability(n_words: Column, n_letters: Column, n_sentences: Column) -> Column:
    """4.71 letters a word + 0.5 words a sentence - 21.43; null without words."""
    words = F.when(n_words > 0, n_words.cast("double"))
    return F.lit(4.71) * n_letters / words + F.lit(0.5) * words / n_sentences - F.lit(21.43)


def reading_levels(
    documents: DataFrame, grades: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
    text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """(`doc_id`, `lang`, `n_words`, `n_letters`, `n_sentences`, `level`, `grade`) for every row of `documents`.

    `grades` (`doc_id`, `level_no`): several grades of a document are averaged, null grades are left out. `level` is
    the propagated level on the scale of the grades, also for graded documents (their own view is in `grade`). Texts
    without words (null and empty ones too) get the mean grade. Without any grade, `level` is null. Repeated rows stay
    repeated; no documents give no rows; other columns are ignored. Texts are read once, whole.

    Each iteration reads the word numbers once and returns, by word, sums that are added up by Spark; the driver holds
    vectors of `buckets` numbers. The line that maps levels to grades is fitted to sums over all graded documents.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string").alias("lang")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), lang, F.col(text_col).alias("text"))
    own = grades.where("level_no is not null").groupBy(F.col("doc_id").alias("graded_id")).agg(F.avg("level_no").alias("grade"))
    graph = scratch.save(
        texts.mapInArrow(_features(settings.buckets), FEATURES).join(own, F.col("doc_id") == F.col("graded_id"), "left").drop("graded_id")
    )
    mean = graph.where("grade is not null").agg(F.avg("grade")).first()[0]
    if mean is None:
        return graph.drop("words", "grade").withColumns({"level": F.lit(None).cast("double"), "grade": F.lit(None).cast("double")})
    nodes = settings.buckets + 3 * STYLES
    edges = graph.select("words", "grade")
    level, weight = np.full(nodes, mean), np.ones(nodes)
    for turn in range(settings.rounds):
        vectors = spark.sparkContext.broadcast((level, weight))
        sums = (
            edges.mapInArrow(_spread(vectors, nodes, mean), "word long, total double, n long")
            .groupBy("word").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        )
        word, total, n = (sums.column(c).to_numpy() for c in ("word", "total", "n"))
        new = np.full(nodes, mean)
        new[word] = (total + settings.prior * mean) / (n + settings.prior)
        if turn == 0:
            # A word that most documents share says little; a rare one is held near the mean by the prior.
            weight[word] = np.log1p(n[word < settings.buckets].max(initial=1) / n)
            weight[settings.buckets :] = settings.style
        moved = np.abs(new - level).max()
        level = new
        vectors.unpersist()
        if turn and moved <= settings.tolerance:
            break
    else:
        warnings.warn(f"levels still move by {moved:.4f} after {settings.rounds} rounds", stacklevel=2)
    scored = scratch.save(
        graph.mapInArrow(
            _score(spark.sparkContext.broadcast((level, weight)), mean),
            "doc_id long, lang string, n_words long, n_letters long, n_sentences long, grade double, raw_level double",
        )
    )
    scratch.drop(graph)
    slope, offset = scored.agg(
        F.covar_samp("raw_level", "grade") / F.nullif(F.var_samp(F.when(F.col("grade").isNotNull(), F.col("raw_level"))), F.lit(0.0)),
        F.avg(F.when(F.col("grade").isNotNull(), F.col("raw_level"))),
    ).first()
    level_col = F.lit(mean) + F.lit(float(slope or 0.0)) * (F.col("raw_level") - F.lit(float(offset)))
    return scored.select("doc_id", "lang", "n_words", "n_letters", "n_sentences", F.when(F.col("n_words") > 0, level_col).otherwise(F.lit(mean)).alias("level"), "grade")


def held_out(documents: DataFrame, grades: DataFrame, settings: Settings = Settings(), part: int = 5, seed: int = 42) -> DataFrame:
    """One row that measures the levels on graded documents whose grades were kept back: `n`, `error` (mean absolute
    difference from the grade), `error_of_mean` (of the mean grade instead), `correlation`.

    One in `part` graded documents, by a hash of its id, is kept back; all others are clamped.
    """
    back = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(part)) == 0
    own = grades.where("level_no is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("level_no").alias("level_no"))
    levels = reading_levels(documents, own.where(~back), settings).select("doc_id", "level")
    mean = own.where(~back).agg(F.avg("level_no")).first()[0]
    tested = levels.join(own.where(back), "doc_id")
    return tested.agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("level") - F.col("level_no"))).alias("error"),
        F.avg(F.abs(F.lit(mean).cast("double") - F.col("level_no"))).alias("error_of_mean"), F.corr("level", "level_no").alias("correlation"),
    )
