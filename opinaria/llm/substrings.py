"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where the hash is the smallest of its neighbourhood, so boundaries depend
on the bytes around them alone and an insertion shifts no later chunk. Chunks are deduplicated by digest: a chunk is a repeat when
a document with a smaller id holds the same one. Repeats that follow each other form a run, the run is extended byte by byte at both
ends as far as the first document agrees, and a run of at least ``min_words`` whole words is a repeated passage.

Digests and positions are shuffled, very common chunks are looked up in a broadcast table of hot digests (see ``join_hot``), and the texts are shuffled twice:
to the places whose surroundings are read and to their own repeats. The plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.llm.common import as_bytes, hot_keys, join_hot, join_shuffled
from opinaria.session import cut_lineage

GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)
REACH = 20  # a boundary is the smallest hash among so many positions on either side
LONGEST = 1023  # longer chunks (repetitive bytes) are cut at multiples of this
EDGE = 256  # bytes by which a run may grow at either end; boundaries differ only within some forty bytes of a passage's ends
NO_ID = (1 << 63) - 1  # rows without an id come last
LATER = f"doc_id > first_doc or doc_id = {NO_ID} and first_doc = {NO_ID} and copy > first_copy"
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the last 16 bytes at every position: two bits of shift per byte, in four doubling steps."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(2 * step)
    return h


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position on (fewer at the end)."""
    out, have = h.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            np.minimum(out[:-step], out[step:], out=out[:-step])
        have += step
    return out


def boundaries(data: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Chunk starts of a text and its end."""
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64)
    cuts = [0]
    if n > 2 * reach:
        h = gear_hash(data)
        lowest = _smallest(h, reach)
        inner = np.arange(reach, n - reach)
        left, right = lowest[inner - reach], lowest[inner + 1]
        found = inner[(h[inner] < left) & (h[inner] <= right)] + 1
        cuts += found.tolist()
    cuts.append(n)
    out = np.array(cuts, np.int64)
    if (np.diff(out) > longest).any():
        out = np.unique(np.concatenate([np.arange(a, b, longest) for a, b in zip(out[:-1], out[1:])] + [out[-1:]]))
    return out


def chunk_text(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, numbers of word starts and digests (signed 64 bits) of a text's chunks.

    Sixty-four bits are enough: a chance equality of one chunk never reaches ``min_words``.
    """
    data = np.frombuffer(text, np.uint8)
    cuts = boundaries(data)
    if len(cuts) < 2:
        return (np.zeros(0, np.int64),) * 4
    blank = BLANKS[data]
    first = ~blank
    first[1:] &= blank[:-1]
    words = np.add.reduceat(first, cuts[:-1], dtype=np.int64)
    ends = cuts[1:].tolist()
    digest = xxhash.xxh3_64_intdigest
    marks = np.array([digest(text[a:b]) for a, b in zip(cuts[:-1].tolist(), ends)], np.uint64)
    return cuts[:-1], np.diff(cuts), words, marks.view(np.int64)


def chunks(source: DataFrame) -> DataFrame:
    """Chunks of (doc_id, copy, text): doc_id, copy, n, start, len, words, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int16(), pa.int16(), pa.int64()]
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in NAMES]
            held = 0
            for doc, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                start, length, words, digest = chunk_text(text.as_py() or b"")
                if not len(start):
                    continue
                for part, value in zip(parts, [np.full(len(start), doc), np.full(len(start), copy), np.arange(len(start)), start, length, words, digest]):
                    part.append(value)
                held += len(start)
                if held >= HELD_CHUNKS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), k) for p, k in zip(parts, kinds)], names=NAMES)
                    parts, held = [[] for _ in NAMES], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), k) for p, k in zip(parts, kinds)], names=NAMES)

    return source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(NAMES, ["long", "long", "int", "long", "short", "short", "long"])))


HELD_CHUNKS = 100_000  # chunks that a task passes on together, or those of one text
NAMES = ["doc_id", "copy", "n", "start", "len", "words", "digest"]


def _common_suffix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        n += 1
    return n


def _common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def passages_of(text: bytes, runs: list[dict], min_words: int) -> list[tuple[int, int, int, int]]:
    """(start, end, words, first_doc) of the runs that hold ``min_words`` whole words after extension."""
    out: list[tuple[int, int, int, int]] = []
    for run in sorted(runs, key=lambda r: r["start"]):
        start, end = run["start"], run["end"]
        start -= _common_suffix(text[max(0, start - EDGE) : start], run["before"] or b"")
        end += _common_prefix(text[end : end + EDGE], run["after"] or b"")
        if out and start < out[-1][1]:
            start = out[-1][1]
        if start > 0 and not BLANKS[text[start - 1]]:  # whole words only
            while start < end and not BLANKS[text[start]]:
                start += 1
        if end < len(text) and not BLANKS[text[end]]:
            while end > start and not BLANKS[text[end - 1]]:
                end -= 1
        while start < end and BLANKS[text[start]]:
            start += 1
        while end > start and BLANKS[text[end - 1]]:
            end -= 1
        words = len(text[start:end].split())
        if words >= min_words:
            out.append((start, end, words, run["first_doc"]))
    return out


def _runs(source: DataFrame, min_words: int) -> DataFrame:
    """Candidate runs per document: (doc_id, copy, runs). A passage's whole chunks hold a quarter of its words at least."""
    pieces = cut_lineage(chunks(source))
    holder = F.struct("doc_id", "copy")
    repeated = cut_lineage(pieces.groupBy("digest").agg(F.count(F.lit(1)).alias("many"), F.min(holder).alias("first"), F.max(holder).alias("last"))
                           .where(f"many > 1 and (first.doc_id <> last.doc_id or first.doc_id = {NO_ID} and first.copy <> last.copy)")
                           .select("digest", "many", F.col("first.doc_id").alias("first_doc"), F.col("first.copy").alias("first_copy")))
    hot = hot_keys(repeated, "digest", "many", pieces.count())
    hits = cut_lineage(join_shuffled(pieces, repeated.drop("many"), "digest", "inner", hot))
    inside = Window.partitionBy("doc_id", "copy")
    # Equal rows (id and text) hold the same chunks, so places are numbered densely: every one of them is in the island of the others.
    island = hits.where(LATER).withColumn("island", F.col("n") - F.dense_rank().over(inside.orderBy("n")))
    first, last = (lambda c: F.min_by(c, "n")), (lambda c: F.max_by(c, "n"))
    runs = island.groupBy("doc_id", "copy", "island").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"), F.sum("words").alias("words"),
        first("digest").alias("head"), last("digest").alias("tail"), first("first_doc").alias("first_doc"))
    runs = cut_lineage(runs.where(F.col("words") >= min_words // 4).drop("island", "words"))
    ends = runs.select(F.col("head").alias("digest")).union(runs.select("tail")).distinct()
    places = (hits.where("doc_id = first_doc and copy = first_copy").join(ends, "digest", "left_semi").groupBy("digest")
              .agg(F.min(F.struct("doc_id", "copy", "start", "len")).alias("at")).select("digest", "at.*"))
    wanted = cut_lineage(places.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("digest", "start", "len")).alias("places")))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p["digest"], text[max(0, p["start"] - EDGE) : p["start"]], text[p["start"] + p["len"] : p["start"] + p["len"] + EDGE])
                    for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in places]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["digest", "before", "after"])

    around = cut_lineage(_with_text(source, wanted).select("text", "places").mapInArrow(contexts, "digest long, before binary, after binary"))
    before = around.select(F.col("digest").alias("head"), "before")
    after = around.select(F.col("digest").alias("tail"), "after")
    extended = join_hot(cut_lineage(join_hot(runs, before, "head")), after, "tail")
    return cut_lineage(extended.groupBy("doc_id", "copy").agg(
        F.collect_list(F.struct("start", "end", "before", "after", "first_doc")).alias("runs")))


def _with_text(source: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    """Join per-document lists to the texts by one shuffle of the texts. The lists grow with the documents, so at no size they are broadcast; a task
    holds the lists of its share of the documents and streams the texts past them."""
    return source.join(dim.hint("shuffle_hash"), ["doc_id", "copy"], how)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*identity(id_col, text_col), as_bytes(text_col).alias("text")).where("text is not null")


def identity(id_col: str, text_col: str) -> list[Column]:
    """A row's (doc_id, copy): its id, the largest number where it has none, and a digest of its text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(as_bytes(text_col)).alias("copy")]


def repeated_passages(docs: DataFrame, min_words: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage that an earlier document holds: doc_id, start, end (bytes), words, first_doc.

    A passage is a run of whole words that repeats chunks of documents with smaller ids. ``first_doc`` is the first holder of the passage's
    first whole chunk. Repeats within one document do not count. Null and empty texts have none; rows without an id come after all
    others, in the order of a digest of their texts, so that a passage which only such rows share is a repeat in all but one of them (their doc_id is null
    again in the result, and so is a ``first_doc`` without an id). Rows that repeat both id and text are one document and each give its passages;
    other columns are ignored; an empty table gives no rows. A stretch whose words repeat with a period below ``REACH`` bytes has no boundary and
    is cut at multiples of ``LONGEST``; there an insertion shifts the chunks up to the next boundary.
    """
    source = _source(docs, id_col, text_col)
    runs = _runs(source, min_words)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc if doc != NO_ID else None, *p[:3], p[3] if p[3] != NO_ID else None) for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)) for p in passages_of(text, found, min_words)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "end", "words", "first_doc"])

    found = _with_text(source, runs).select("doc_id", "text", "runs")
    return found.mapInArrow(find, "doc_id long, start long, end long, words long, first_doc long")


def without_repeats(docs: DataFrame, min_words: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages (see ``repeated_passages``) cut out of the text; documents that have none are unchanged.

    All rows and columns stay; a text that was nothing but repeats becomes empty. A blank is left where a passage was cut from the middle.
    """
    runs = _runs(_source(docs, id_col, text_col), min_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(at_text).to_pylist(), batch.column(at_runs).to_pylist()):
                if found and text:
                    data, kept, at = text.encode(), [], 0
                    for start, end, _, _ in passages_of(data, found, min_words):
                        kept.append(data[at:start])
                        at = end
                    kept.append(data[at:])
                    text = b"".join(kept).decode() if len(kept) > 1 else text
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if k == at_text else batch.column(k) for k in range(at_runs)]
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    at_text, at_runs = docs_columns.index(text_col), len(docs_columns)
    keyed = docs.select(F.struct("*").alias("_all"), *identity(id_col, text_col))
    return _with_text(keyed, runs, "left").select("_all.*", F.col("runs").alias("_runs")).mapInArrow(cut, docs.schema)
