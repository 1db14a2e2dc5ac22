"""SimHash near-duplicates by pivot distance tables.

Fingerprints are 64 bits, cut into words of bits. Reference fingerprints (pivots) are cut likewise, and for every distinct fingerprint the
table holds its Hamming distance to every pivot, word by word. Two fingerprints within ``max_bits`` differ in at most
``max_bits`` words, so on some choice of the other words all their coordinates are equal: those coordinates are the key on which
pairs meet. Within a key, a pair is discarded when the sum over words of its largest coordinate difference exceeds ``max_bits`` (the
triangle inequality, per word), and the survivors are verified on the bits. No link is lost.

Copies share a fingerprint and are one row here. A key shared by more than ``bucket`` fingerprints is cut again by the
coordinates of parts of the other bits, without loss. A bucket emits a spanning forest of its links, not all
pairs; links of different buckets meet in the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.llm.common import as_bytes, components, join_hot
from opinaria.session import MAX_BROADCAST_ROWS, cut_lineage

SEED = 42
BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the lower-cased words' shingles, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(shingle, len(words))
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class PivotTable:
    """Reference fingerprints cut into ``words`` words of nearly equal width; distances of one word to ``pivots`` references are
    packed in a long, ``pivots`` * 4 bits (a word has at most 15 bits)."""

    def __init__(self, words: int = 6, pivots: int = 8, seed: int = 1):
        cuts = [BITS * k // words for k in range(words + 1)]
        if max(b - a for a, b in zip(cuts, cuts[1:])) > 15 or pivots > 15:
            raise ValueError("a word has at most 15 bits and 15 references")
        self.masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
        draw = np.random.default_rng(seed)
        self.references = [int(x) for x in draw.integers(0, 1 << 63, pivots, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, pivots, dtype=np.uint64)]

    def coordinates(self, fp: Column, mask: Column) -> Column:
        """The distances of the bits in ``mask``, at most 15 of them, to all references, packed in a long."""
        packed = F.lit(0).cast("long")
        for k, reference in enumerate(self.references):
            near = F.bit_count(fp.bitwiseXOR(F.lit(signed(reference))).bitwiseAND(mask)).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(near, 4 * k))
        return packed

    def unpacked(self, fps: np.ndarray) -> np.ndarray:
        """Distances as (fingerprint, word, reference)."""
        refs, masks = np.array(self.references, np.uint64), np.array(self.masks, np.uint64)
        return np.bitwise_count((fps.view(np.uint64)[:, None, None] ^ refs[None, None, :]) & masks[None, :, None]).astype(np.int8)


def bucket_links(fps: np.ndarray, table: PivotTable, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket, as pairs of fingerprints.

    The search goes breadth first; only fingerprints that no link has reached yet are compared with the next one.
    """
    fps = np.unique(fps)
    bits, far = fps.view(np.uint64), table.unpacked(fps)
    left, queue, links = np.arange(len(fps)), [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        one = queue.pop()
        bound = np.abs(far[left] - far[one]).max(axis=2).sum(axis=1)  # largest coordinate difference of each word
        kept = np.flatnonzero(bound <= max_bits)
        kept = kept[np.bitwise_count(bits[left[kept]] ^ bits[one]) <= max_bits]
        if len(kept):
            reached = left[kept].tolist()
            queue += reached
            links += [(int(fps[one]), int(fps[k])) for k in reached]
            left = np.delete(left, kept)
    return links


def _small_buckets(table: PivotTable, max_bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            links = [pair for fps in frame["fps"] for pair in bucket_links(np.asarray(fps, np.int64), table, max_bits)]
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def links(distinct: DataFrame, max_bits: int = 3, table: PivotTable | None = None, bucket: int = 2000, depth: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` within ``max_bits`` bits, enough of them to connect all that are linked.

    Keys are the coordinates on every choice of words - max_bits words. Keys with one fingerprint end here. Under a key with more than
    ``bucket`` fingerprints the bits outside the chosen words are cut into max_bits + 1 parts, one of which agrees for any
    link, and the coordinates of each part go into a finer key, up to ``depth`` times.
    """
    table = table or PivotTable()
    word = lambda m: table.coordinates(F.col("fp"), F.lit(signed(m)))
    packed = distinct.select("fp", *[word(m).alias(f"w{k}") for k, m in enumerate(table.masks)])
    n = len(table.masks)
    masks = {c: sum(table.masks[w] for w in c) for c in combinations(range(n), n - max_bits)}
    keys = F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.xxhash64(F.lit(signed(m)), *[F.col(f"w{w}") for w in c]).alias("key"))
                     for c, m in masks.items()])
    rows = cut_lineage(packed.select("fp", F.inline(keys)))
    chosen = list(masks.values())
    found = None
    for level in range(depth + 1):
        sizes = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        small = rows.join(sizes.where(F.col("n") <= bucket).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        part = small.mapInPandas(_small_buckets(table, max_bits), "a long, b long")
        found = part if found is None else found.unionByName(part)
        large = sizes.where(F.col("n") > bucket).select("key")
        if large.isEmpty():
            return found
        hot = rows.join(large, "key")
        if level < depth:
            finer = [(m, part) for m in chosen for part in open_parts(m, max_bits + 1)]
            options = rows.sparkSession.createDataFrame([(signed(m), signed(p)) for m, p in finer], "mask long, part long")
            hot = hot.join(F.broadcast(options), "mask")
            rows = cut_lineage(hot.select("fp", F.col("mask").bitwiseOR(F.col("part")).alias("mask"),
                                          F.xxhash64("key", "part", table.coordinates(F.col("fp"), F.col("part"))).alias("key")))
            chosen = sorted({m | p for m, p in finer})
    return found.unionByName(_same_coordinates(hot, max_bits))


def open_parts(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` groups of nearly equal size."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << b for b in free[len(free) * k // parts : len(free) * (k + 1) // parts]) for k in range(parts)]


def _same_coordinates(rows: DataFrame, max_bits: int) -> DataFrame:
    """What is left under the finest keys: fingerprints that agree on all but some ten bits or that the references cannot tell apart."""
    left, right = rows.select("key", F.col("fp").alias("a")), rows.select("key", F.col("fp").alias("b"))
    return left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def near_duplicates(docs: DataFrame, max_bits: int = 3, shingle: int = 3, words: int = 6, pivots: int = 8, bucket: int = 2000,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id.

    Documents are linked when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest doc_id that links
    reach. A null text and one without words have fingerprint 0 and link like any other. Repeated rows each give a row; a null id keeps
    its row and does not count as the smallest unless the component has no other; extra columns are ignored; an empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    table = PivotTable(words, pivots)
    labels = cut_lineage(components(cut_lineage(links(distinct.select("fp"), max_bits, table, bucket))))
    member = labels.withColumnRenamed("node", "fp").join(distinct, "fp")
    smallest = cut_lineage(member.groupBy("root").agg(F.min("first").alias("smallest")))
    linked = join_hot(labels.withColumnRenamed("node", "fp"), smallest, "root").select("fp", "smallest")
    classes = cut_lineage(distinct.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")))
    return join_hot(rows, classes, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, max_bits: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id, once.

    The texts are not shuffled while the ids that go are few enough to broadcast (counted first). Rows without an id stay only where no
    row of their group has one, once per fingerprint. All columns stay as they are, whatever their names.
    """
    found = cut_lineage(near_duplicates(docs, max_bits, shingle, id_col=id_col, text_col=text_col))
    own, rep, fp = (unused(docs, name) for name in ("own_id", "rep", "fp"))
    losers = cut_lineage(found.where("doc_id <> component_id").select("doc_id").distinct())
    small = losers.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    kept = docs.withColumn(own, F.col(id_col).cast("long"))
    kept = kept.join((F.broadcast(losers) if small else losers).withColumnRenamed("doc_id", own), own, "left_anti")
    repeated = found.join(losers, "doc_id", "left_anti").groupBy("doc_id").count().where("count > 1 or doc_id is null")
    repeated = cut_lineage(repeated.select(F.col("doc_id").alias(rep)))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    alone = kept.join(repeated, F.col(own) == F.col(rep), "left_anti").where(F.col(own).isNotNull())
    again = kept.join(repeated, F.col(own) == F.col(rep), "left_semi").dropDuplicates([own])
    anonymous = kept.where(F.col(own).isNull())
    bare = cut_lineage(fingerprints(anonymous, shingle, id_col, text_col).select("fp").distinct()
                       .join(found.where("component_id is null").select("fp").distinct(), "fp", "left_semi")).select(F.col("fp").alias(fp))
    unnamed = _with_fingerprint(anonymous, shingle, text_col, fp).join(bare, fp, "left_semi").dropDuplicates([fp])
    return alone.select(docs.columns).unionByName(again.select(docs.columns)).unionByName(unnamed.select(docs.columns))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _with_fingerprint(docs: DataFrame, shingle: int, text_col: str, name: str) -> DataFrame:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t.encode() if t is not None else None, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, F.pandas_udf(run, "long")(F.col(text_col)))
