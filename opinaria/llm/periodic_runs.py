"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q whose length is at least ``max(min_length, min_repeats * q)`` and which no neighbouring
word extends. Each of its words occurs at least ``min_repeats`` times in it. So a word that occurs more rarely within a segment lies in no run:
such words split the segment, the parts are counted anew, and so on until nothing changes. Only the surviving segments are scanned,
lag by lag. Splitting works on many texts at once, by sorting (segment, word) pairs; each text is whole in its scan task and nothing is shuffled.

At a lag q a run agrees with itself at ``needed = max(min_length, min_repeats * q) - q`` positions in a row, so every ``step``-th position suffices to
rule a lag out, and the scan of n words costs n log n comparisons. A lag that is a multiple of the period of a run found before
agrees inside that run; such positions are no evidence, because two runs whose periods divide one another overlap in fewer words than the longer period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.llm.common import as_bytes

MIN_LENGTH, MIN_REPEATS = 24, 3
PROBES = 16  # positions that rule a lag out, at least
HELD_WORDS = 1_000_000  # words of the texts that are split together; a longer text is split alone
RUN_SCHEMA = "doc_id long, start long, length long, period long"


def split_rare(words: np.ndarray, segment: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of one segment each in which every word occurs ``min_repeats`` times, after splitting to stability.

    ``words`` are small numbers, ``segment`` is non-decreasing.
    """
    place = np.arange(len(words))
    while len(place):
        key = segment * (words.max() + 1) + words
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order], prepend=-1))
        counts = np.diff(edges, append=len(order))
        often = np.empty(len(order), bool)
        often[order] = np.repeat(counts >= min_repeats, counts)
        kept = np.flatnonzero(often)
        first = np.diff(place[kept], prepend=-2) != 1  # where a new segment begins
        first[1:] |= segment[kept][1:] != segment[kept][:-1]
        number = np.cumsum(first) - 1
        sizes = np.bincount(number) if len(number) else np.zeros(0, np.int64)
        long = sizes[number] >= min_length if len(number) else np.zeros(0, bool)
        stable = len(kept) == len(place)
        place, words, segment = place[kept][long], words[kept][long], number[long]
        if stable:
            break
    if not len(place):
        return []
    starts = np.flatnonzero(np.diff(segment, prepend=-1))
    ends = np.append(starts[1:], len(place))
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(starts, ends)]


def _stretches(equal: np.ndarray, needed: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of true values, ``needed`` long at least."""
    stops = np.flatnonzero(~equal)
    starts = np.concatenate([[0], stops + 1])
    ends = np.append(stops, len(equal))
    keep = ends - starts >= needed
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def lag_scan(words: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment."""
    n = len(words)
    found: list[tuple[int, int, int]] = []
    by_period: dict[int, list[tuple[int, int]]] = {}
    periods = np.zeros(0, np.int64)
    for lag in range(1, n // min_repeats + 1):
        needed = max(min_length, min_repeats * lag) - lag
        if needed + lag > n:
            break
        step = max(1, needed // PROBES)
        row = needed // step  # probes that agree one after another in any run of this period
        probe = words[: n - lag : step] == words[lag::step]
        if np.count_nonzero(probe) < row:
            continue
        inner = [run for p in periods[lag % periods == 0].tolist() for run in by_period[p]] if len(periods) else []
        for start, end in inner:
            probe[-(-start // step) : max(0, end - lag - 1) // step + 1 if end - lag > start else 0] = False
        if np.count_nonzero(probe) < row or not _stretches(probe, row):
            continue
        for start, end in _stretches(words[: n - lag] == words[lag:], needed):
            if not any(s <= start and end + lag <= e for s, e in inner):
                found.append((start, end + lag - start, lag))
                by_period.setdefault(lag, []).append((start, end + lag))
        if lag in by_period:
            periods = np.append(periods, lag)
    return found


def runs_of(texts: list[list], min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start and period."""
    numbers: dict = {}
    sizes = [len(t) for t in texts]
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, sum(sizes))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end in split_rare(flat, np.repeat(np.arange(len(texts)), sizes), min_length, min_repeats):
        text = int(np.searchsorted(offsets, start, "right")) - 1
        shift = start - int(offsets[text])
        out[text] += [(s + shift, length, period) for s, length, period in lag_scan(flat[start:end], min_length, min_repeats)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, held in zip(words, np.cumsum(edge).tolist()) if not held]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or (run[1] * best[2], -run[0], -run[2]) > (best[1] * run[2], -best[0], -best[2]):
            best = run
    return best


def repeat_words(words: list, mark: int | None) -> list:
    """A planted repetition: from word ``a`` on the first ``p`` words again and again, when the mark is a multiple of ten."""
    n = len(words)
    if mark is None or mark % 10 or not n:
        return words
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _batches(batch: pa.RecordBatch, plant: bool) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, word lists) of parts of a batch, bounded by their words."""
    first, held, part = 0, 0, []
    for k, text in enumerate(batch.column(1)):
        words = (text.as_py() or b"").split()
        if plant:
            mark = batch.column(0)[k].as_py()
            words = repeat_words(words, None if mark is None else zlib.crc32(str(mark).encode()))
        if part and held + len(words) > HELD_WORDS:
            yield first, part
            first, held, part = k, 0, []
        part.append(words)
        held += len(words)
    if part:
        yield first, part


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """One row per run: doc_id, start (word number from 0), length, period.

    Words are what white space (0x20, 0x09-0x0D) parts. Null and empty texts have no run; repeated rows give their runs as often; a null id stays null; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, part in _batches(batch, False):
                rows = [(ids[first + k], *r) for k, runs in enumerate(runs_of(part, min_length, min_repeats)) for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "start", "length", "period"])

    return _source(docs, id_col, text_col).mapInArrow(run, RUN_SCHEMA)


def without_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each run cut to its first period: the kept words, joined by one space. A text without a run is left as it is, a null stays null; all rows and columns stay."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at).cast(pa.binary())], names=["id", "text"])
            texts: list[str | None] = []
            for first, part in _batches(pair, False):
                for k, (words, runs) in enumerate(zip(part, runs_of(part))):
                    texts.append(b" ".join(collapsed(words, runs)).decode() if runs else batch.column(at)[first + k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, the strongest run (start, length, period, exponent_milli; null without a run), runs_sha256 and collapsed_sha256.

    ``plant`` first repeats words in documents whose id's crc32 is a multiple of ten (see ``repeat_words``). Null and empty texts have no words and no
    run, a null id plants nothing; repeated rows are judged one by one; other columns are ignored; an empty table gives no rows.
    """
    numbers = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    digests = ["runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for first, part in _batches(batch, plant):
                for k, (words, runs) in enumerate(zip(part, runs_of(part))):
                    best = strongest(runs)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    rows.append((ids[first + k], len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2],
                                 hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.string()) for k, c in enumerate(columns)], names=numbers + digests)

    return _source(docs, id_col, text_col).mapInArrow(run, ", ".join([f"{n} long" for n in numbers] + [f"{n} string" for n in digests]))
