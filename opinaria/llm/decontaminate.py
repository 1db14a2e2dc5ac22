"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: every task turns each block of its documents into postings, the sorted positions of every
term that the benchmark knows. A benchmark window is looked up in a shard by intersecting the postings of its terms, shifted by the
term's offset in the window, from the term that is rarest there; most windows end at an empty list. What is left when all
terms are intersected are exact phrase occurrences. Proximity looks for a short stretch that holds the window's terms in any
order, starting from the occurrences of its rarest term.

The benchmark is the stated query set: it visits all shards in blocks of at most ``block_words`` words, so that a
block's size is known before it is sent, and the documents are read once per block. No document text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.llm.common import as_bytes

# Lower-cases A-Z; every other ASCII sign that is neither a letter nor a digit becomes a blank.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
                   for b in range(256))
SCHEMA = ("doc_id long, n_words long, spans array<struct<first:int,past:int>>, "
          "items array<string>, near_items array<string>")
# Documents whose postings are held together: at most so many words, or one document.
SHARD_WORDS = 4_000_000
KEPT_ROWS = 2048  # rows that are judged together where whole rows are passed on


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """The distinct windows of a block of benchmark items, as rows of term numbers padded with -1."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            numbers = [self.terms.setdefault(w, len(self.terms)) for w in words]
            for at in range(max(1, len(numbers) - width + 1)) if numbers else ():
                found.setdefault(tuple(numbers[at : at + width]), set()).add(item)
        self.items = list(found.values())
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.matrix = np.full((len(found), width), -1, np.int64)
        for k, w in enumerate(found):
            self.matrix[k, : len(w)] = w


def numbered(text: bytes | None, terms: dict[bytes, int]) -> np.ndarray:
    """The text's words as term numbers, -1 for words that the benchmark does not know."""
    words = words_of(text)
    return np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words))


class Shard:
    """Postings of a block of documents: for each term, its sorted positions in the joined word sequence."""

    def __init__(self, documents: list[np.ndarray], terms: int):
        self.starts = np.concatenate([[0], np.cumsum([len(d) for d in documents], dtype=np.int64)])
        ids = np.concatenate(documents) if documents else np.zeros(0, np.int32)
        known = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[known], kind="stable")
        self.positions = known[order]
        self.counts = np.bincount(ids[known], minlength=terms)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term + 1]]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Positions at which the window occurs within one document."""
        order = np.argsort(self.counts[window], kind="stable")
        bases = self.postings(window[order[0]]) - order[0]
        for offset in order[1:]:
            if not len(bases):
                return bases
            postings = self.postings(window[offset])
            at = np.minimum(np.searchsorted(postings, bases + offset), len(postings) - 1)
            bases = bases[postings[at] == bases + offset]
        inside = (bases >= 0) & (self.document(np.maximum(bases, 0)) == self.document(bases + len(window) - 1))
        return bases[inside]

    def near(self, window: np.ndarray, within: int) -> np.ndarray:
        """Documents with a stretch of at most ``within`` words that holds every term of the window.

        Such a stretch holds an occurrence of the rarest term. From there every term has a nearest occurrence to the left and to the
        right; for each possible left extent, the terms beyond it must be found on the right.
        """
        terms = np.unique(window)
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        anchors = self.postings(terms[0])
        docs = self.document(anchors)
        low, high = np.maximum(anchors - within + 1, self.starts[docs]), np.minimum(anchors + within - 1, self.starts[docs + 1] - 1)
        lefts, rights = [np.zeros(len(anchors), np.int64)], [np.zeros(len(anchors), np.int64)]
        for term in terms[1:]:
            if not len(anchors):
                return docs
            postings = self.postings(term)
            at = np.searchsorted(postings, anchors)
            before, after = postings[np.maximum(at - 1, 0)], postings[np.minimum(at, len(postings) - 1)]
            left = np.where((at > 0) & (before >= low), anchors - before, within)
            right = np.where((at < len(postings)) & (after <= high), after - anchors, within)
            kept = np.minimum(left, right) < within
            lefts, rights = [[x[kept] for x in [*side, new]] for side, new in ((lefts, left), (rights, right))]
            anchors, docs, low, high = anchors[kept], docs[kept], low[kept], high[kept]
        fits = np.zeros(len(anchors), bool)
        for extent in lefts:
            needed = np.zeros(len(anchors), np.int64)
            for left, right in zip(lefts, rights):
                np.maximum(needed, np.where(left > extent, right, 0), out=needed)
            fits |= extent + needed < within
        return np.unique(docs[fits])


def _matches(shard: Shard, windows: Windows, within: int | None):
    """Per document of the shard: merged spans, items by phrase, items by proximity."""
    n = len(shard.starts) - 1
    exact, close = [set() for _ in range(n)], [set() for _ in range(n)]
    edges = np.zeros(shard.starts[-1] + 1, np.int32)
    if len(windows.items):
        present = np.where(windows.matrix >= 0, shard.counts[windows.matrix], 1).min(axis=1) > 0
        for k in np.flatnonzero(present):
            window = windows.matrix[k, : windows.lengths[k]]
            bases = shard.phrase(window)
            if len(bases):
                np.add.at(edges, bases, 1)
                np.add.at(edges, bases + len(window), -1)
                for d in np.unique(shard.document(bases)).tolist():
                    exact[d] |= windows.items[k]
            if within is not None:
                for d in shard.near(window, within).tolist():
                    close[d] |= windows.items[k]
    covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0])
    cut = shard.starts[:-1][np.diff(shard.starts) > 0]  # a span ends where its document ends
    starts = np.flatnonzero(covered[1:] & (~covered[:-1] | np.isin(np.arange(len(covered) - 1), cut)))
    spans: list[list[dict]] = [[] for _ in range(n)]
    for at, d in zip(starts.tolist(), shard.document(starts).tolist()):
        limit = int(shard.starts[d + 1])
        gap = np.flatnonzero(~covered[at + 1 : limit + 1])
        spans[d].append({"first": at - int(shard.starts[d]), "past": (at + int(gap[0]) if len(gap) else limit) - int(shard.starts[d])})
    return spans, exact, close


def _search(windows_of_block, within: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of_block.value
        ids, texts, marks, held = [], [], [], 0

        def rows() -> pa.RecordBatch:
            spans, exact, close = _matches(Shard(texts, len(windows.terms)), windows, within)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.string())]
            cells = [ids, [len(t) for t in texts], spans, [sorted(x) for x in exact], [sorted(x) for x in close]]
            names = ["doc_id", "n_words", "spans", "items", "near_items"]
            if marks:
                kinds, cells, names = [*kinds, pa.string()], [*cells, marks], [*names, "mark"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

        for batch in batches:
            every_mark = batch.column(2).to_pylist() if batch.num_columns > 2 else repeat(None)
            for doc, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), every_mark):
                words = numbered(text.as_py(), windows.terms)
                ids.append(doc)
                texts.append(words)
                if batch.num_columns > 2:
                    marks.append(mark)
                held += len(words)
                if held >= SHARD_WORDS:
                    yield rows()
                    ids, texts, marks, held = [], [], [], 0
        if ids:
            yield rows()

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, held = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), as_bytes(text_col)).toLocalIterator():
        words = words_of(bytes(row[1]) if row[1] is not None else None)
        if words:
            block.append((row[0] if row[0] is not None else "", words))
            held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, within: int | None = 20, block_words: int = 1_000_000,
                      id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, spans, items, near_items.

    ``spans`` are the merged word ranges [first, past) covered by exact occurrences of windows of ``width`` item words (shorter
    items are one window), ``items`` the benchmark items with such windows, ``near_items`` those with a window all of whose terms
    lie, in any order, in some stretch of at most ``within`` words of the document (empty when ``within`` is None).

    A null text has no words; repeated rows each give a row; a null item id is reported as an empty string; an empty benchmark
    matches nothing; other columns are ignored. One item larger than ``block_words`` is a block of its own.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    marked = source.select("doc_id", "text", F.sha2("text", 256).alias("mark"))
    parts = []
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        windows = spark.sparkContext.broadcast(Windows(block, width))
        parts.append(windows)
    if len(parts) > 1:
        return _over_blocks([marked.mapInArrow(_search(p, within), SCHEMA + ", mark string") for p in parts])
    windows = parts[0] if parts else spark.sparkContext.broadcast(Windows([], width))
    return source.mapInArrow(_search(windows, within if parts else None), SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 1_000_000,
                         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any exact window of the benchmark; one pass over the shards per block, no shuffle."""
    at, names = docs.columns.index(text_col), docs.columns

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for whole in batches:
                for first in range(0, whole.num_rows, KEPT_ROWS):
                    batch = whole.slice(first, KEPT_ROWS)
                    texts = [numbered(t.as_py().encode() if t.is_valid else None, windows.terms) for t in batch.column(at)]
                    spans, _, _ = _matches(Shard(texts, len(windows.terms)), windows, None)
                    yield pa.RecordBatch.from_arrays(batch.filter(pa.array([not s for s in spans], pa.bool_())).columns, names=names)

        return run

    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        docs = docs.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(Windows(block, width))), docs.schema)
    return docs


def _over_blocks(parts: list[DataFrame]) -> DataFrame:
    """Rows of several benchmark blocks, brought together by id and digest of the text; rows that repeat both are alike and stay as many as they were."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("doc_id", "mark").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("near_items")))).alias("near_items"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("rows"))
    return merged.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "n_words", merge_spans("spans").alias("spans"), "items", "near_items")


def merge_spans(column: str) -> Column:
    """Sorted ranges, overlapping and touching ones joined."""
    kind = "array<struct<first:int,past:int>>"

    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last["first"].alias("first"), F.greatest(last["past"], span["past"]).alias("past"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["past"] >= span["first"]), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.col(column), F.array().cast(kind), step)


def hit_words(column: str = "spans") -> Column:
    return F.aggregate(F.col(column), F.lit(0).cast("long"), lambda n, s: n + (s["past"] - s["first"]))
