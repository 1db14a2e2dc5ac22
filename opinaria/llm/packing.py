"""Best-fit packing of token sequences by hierarchical residual packing.

Every scan task tokenises its documents, cuts the long ones and packs the pieces best-fit (longest first) into bins of the
capacity. Nearly full bins are final at once. The others climb a tree: each round merges the underfull bins of
``fan_in`` neighbouring groups, as items, best-fit again, until one group is left. Texts and tokens never move;
only (bin, size) rows do.

After a best-fit round at most one bin of a group is at most half full, so a group of the next round holds at most
``fan_in`` bins that can enter another bin. Passing up at most ``fan_in`` bins of each distinct size therefore loses no
merge, and bounds a group by fan_in * fan_in * capacity rows at any input size.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.llm.common import as_bytes
from opinaria.llm.wordpieces import word_ids
from opinaria.session import cut_lineage, lookup

END_ID = b"\0\0\0\0"
LEAF_SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
               "bin long, offset long, bin_size long, open boolean, leaf long")
BIN_SCHEMA = "leaf long, root long, size long, open boolean, members array<struct<bin:long,shift:long>>"


class BestFit:
    """Bins by free room; the fullest bin that still takes an item is found by the lowest set bit."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.rooms, self.sizes = capacity, 0, defaultdict(list), []

    def put(self, size: int) -> tuple[int, int]:
        """The bin for an item of ``size`` and the item's offset there."""
        fitting = self.free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bins = self.rooms[room]
            number = bins.pop()
            if not bins:
                self.free ^= 1 << room
        else:
            number, room = len(self.sizes), self.capacity
            self.sizes.append(0)
        offset = self.sizes[number]
        self.sizes[number] = offset + size
        if left := room - size:
            self.rooms[left].append(number)
            self.free |= 1 << left
        return number, offset


def climbing(sizes: np.ndarray, capacity: int, nearly_full: float, fan_in: int) -> np.ndarray:
    """Which bins go up: underfull ones, at most ``fan_in`` of one size."""
    seen: dict[int, int] = defaultdict(int)
    up = np.zeros(len(sizes), bool)
    for k, size in enumerate(sizes.tolist()):
        if size < capacity * nearly_full:
            seen[size] += 1
            up[k] = seen[size] <= fan_in
    return up


def pack_leaf(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the size of each bin."""
    fit = BestFit(capacity)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        bins[k], offsets[k] = fit.put(int(lengths[k]))
    return bins, offsets, np.array(fit.sizes, np.int64)


def _leaf_rows(path: str, capacity: int, leaf_items: int, nearly_full: float, fan_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(path)
        leaf = TaskContext.get().partitionId()
        first_bin, rows = leaf << 32, []

        def packed() -> pa.RecordBatch:
            nonlocal first_bin
            doc, piece, start, length, crc = map(list, zip(*rows))
            bins, offsets, sizes = pack_leaf(np.array(length, np.int64), capacity)
            up = climbing(sizes, capacity, nearly_full, fan_in)
            out = pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(first_bin + bins), pa.array(offsets), pa.array(sizes[bins]), pa.array(up[bins]),
                 pa.array(np.full(len(rows), leaf, np.int64))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "bin_size", "open", "leaf"])
            first_bin += len(sizes)
            rows.clear()
            return out

        step = 4 * capacity
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = table.encode(text.as_py() or b"") + END_ID
                rows.extend((doc, k, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step]))
                            for k, at in enumerate(range(0, len(ids), step)))
                if len(rows) >= leaf_items:
                    yield packed()
        if rows:
            yield packed()

    return run


def _merge(capacity: int, nearly_full: float, fan_in: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "root"], ascending=[False, True])
        fit, roots, members = BestFit(capacity), [], []
        for root, size, inner in zip(group["root"], group["size"], group["members"]):
            number, offset = fit.put(int(size))
            if number == len(roots):
                roots.append(root)
                members.append([])
            members[number].extend({"bin": int(m["bin"]), "shift": int(m["shift"]) + offset} for m in inner)
        sizes = np.array(fit.sizes, np.int64)
        return pd.DataFrame({"leaf": group["leaf"].iloc[0], "root": roots, "size": sizes,
                             "open": climbing(sizes, capacity, nearly_full, fan_in), "members": members})

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, fan_in: int = 8, nearly_full: float = 0.995,
         leaf_items: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one end id 0 (a null or empty text: the end id alone). Only documents longer than ``capacity`` are cut,
    into pieces of ``capacity`` ids. A sequence is filled from offset 0 without gaps. Repeated rows are packed as often as they
    occur; a null id stays null; other columns are ignored; an empty table gives no rows. ``nearly_full`` is the
    share from which a bin is final; ``leaf_items`` bounds the pieces that one task holds before it packs them.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    leaves = cut_lineage(source.mapInArrow(_leaf_rows(tokenizer_path, capacity, leaf_items, nearly_full, fan_in), LEAF_SCHEMA))
    level = leaves.where("open and offset = 0").select(
        "leaf", F.col("bin").alias("root"), F.col("bin_size").alias("size"), "open",
        F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"))
    last = leaves.agg(F.max("leaf")).first()[0] or 0
    placed = None
    while True:
        group = level.where("open").withColumn("leaf", F.floor(F.col("leaf") / fan_in).cast("long"))
        merged = cut_lineage(group.groupBy("leaf").applyInPandas(_merge(capacity, nearly_full, fan_in), BIN_SCHEMA))
        last //= fan_in
        final = merged if last == 0 else merged.where("not open")
        placed = final if placed is None else placed.unionByName(final)
        if last == 0:
            break
        level = merged
    moves = placed.select("root", F.inline("members")).where("bin <> root or shift <> 0")
    found = lookup(leaves, moves.select("bin", "root", "shift"), "bin", salt=F.struct("doc_id", "piece"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"),
                        (F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))).alias("offset"))
