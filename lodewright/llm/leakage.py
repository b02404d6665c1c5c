"""Evaluation texts in training text (problem 8).

The runs of `n` consecutive words of all test items form one Aho-Corasick automaton over word numbers; every document
is read once, and matches come with their place in the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+")
#: Words of test items that one automaton holds at most; beyond that the corpus is scanned once for each block of items.
BLOCK_WORDS = 400_000
_BUILT: dict[str, Automaton] = {}

SCHEMA = "item_id long, doc_id long, start long, stop long, n_words long"


def words(text: str) -> list[str]:
    """Longest runs of a-z and 0-9 in the lower-cased text."""
    return WORD.findall(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """Places of the words in the original text, also where lower-casing changes its length."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    origin = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


class Automaton:
    """All runs of `n` words of the items; `hits` gives what a text contains."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        import ahocorasick

        self.n, self.numbers = n, {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        owners: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for i in range(len(ids) - n + 1):
                own = owners.setdefault(tuple(ids[i : i + n]), [])
                if not own or own[-1] != item:
                    own.append(item)
        for run, own in owners.items():
            self.machine.add_word(run, own)
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, stop, words) of each longest stretch in which an item's runs follow each other."""
        number = self.numbers.get
        found: dict[int, list[int]] = {}
        for end, own in self.machine.iter(tuple([number(w, 0) for w in words(text)])):
            for item in own:
                found.setdefault(item, []).append(end)
        if not found:
            return []
        spans, out = word_spans(text), []
        for item, ends in found.items():
            first = last = ends[0]
            for end in [*ends[1:], None]:
                if end is not None and end <= last + 1:
                    last = end
                    continue
                begin = first - self.n + 1
                out.append((item, spans[begin][0], spans[last][1], last - begin + 1))
                first = last = end
        return out


def _scan(shared, key: str, n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:  # one automaton at a time in each Python worker
            _BUILT.clear()
            _BUILT[key] = Automaton(shared.value, n)
        machine = _BUILT[key]
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not machine.empty:
                    rows += [(item, doc, a, b, k) for item, a, b, k in machine.hits(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "start", "stop", "n_words"])

    return scan


def leaks(
    documents: DataFrame, items: DataFrame, n: int = 12, id_col: str = "doc_id", text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(`item_id`, `doc_id`, `start`, `stop`, `n_words`): each stretch of at least `n` words of an item in a document.

    `items` (`item_id`, `item_text`). `start` and `stop` are places in the original text. Null and empty texts, and
    items of fewer than `n` words, match nothing. An item that repeats a run of words can have overlapping stretches
    joined. Repeated documents give repeated rows. Other columns are ignored.

    The items are a small held-out set by nature. They reach the driver in blocks of at most `block_words` words; each
    block is one automaton, sent once to each executor, so memory is bounded whatever their number.
    """
    spark = documents.sparkSession
    texts = documents.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    out = None
    block: list[tuple[int, str]] = []
    size = 0

    def scanned(block: list[tuple[int, str]]) -> DataFrame:
        return texts.mapInArrow(_scan(spark.sparkContext.broadcast(block), uuid.uuid4().hex, n), SCHEMA)

    for r in items.where(F.length("item_text") > 0).select("item_id", "item_text").orderBy("item_id").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(words(r[1]))
        if size >= block_words:
            part = scanned(block)
            out, block, size = part if out is None else out.unionByName(part), [], 0
    if block or out is None:
        part = scanned(block) if block else spark.createDataFrame([], SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out
