"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every table hashes a vector with a few Gaussian projections cut into cells of width w. A query visits cells in the order of the
probability that a neighbour at the expected distance falls there, until the probabilities of a table add up to ``success``; the
candidates of all tables are merged and ranked by exact distance. Cell width and expected distance come from a bounded sample; every row
is indexed.

Equal vectors are indexed once, with their smallest ids. Cells are dealt to parts; a query goes to each part once, with its cells there.
Large parts are split: rows by a salt, queries into blocks, so no task holds more than ``max_queries`` queries or a hot cell alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.llm.common import hash_sample
from opinaria.session import cut_lineage

ROW = "part int, kind int, id long, vec binary, cell long, cells binary"
_erf = np.vectorize(math.erf, otypes=[float])


class Tables:
    """The hash functions: ``tables`` * ``functions`` projections, offsets and the cell width."""

    def __init__(self, dim: int, radius: float, tables: int, functions: int, width: float, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.shape, self.radius, self.width = (tables, functions), radius, width * radius
        self.project = draw.standard_normal((dim, tables * functions))
        self.shift = draw.uniform(0, self.width, tables * functions)
        self.mix = draw.integers(1, 1 << 62, functions, dtype=np.int64) * 2 + 1

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Positions on the projections, in cell widths: (vector, table, function)."""
        return ((vectors @ self.project + self.shift) / self.width).reshape(len(vectors), *self.shape)

    def cells(self, corners: np.ndarray) -> np.ndarray:
        """64-bit numbers of cells given by integer corners (..., function)."""
        with np.errstate(over="ignore"):
            mixed = (corners.astype(np.int64) * self.mix).sum(axis=-1)
            return mixed ^ (mixed >> 29)

    def probes(self, place: np.ndarray, success: float, reach: int = 4, most: int = 100_000) -> np.ndarray:
        """Cells of one table in estimated success order until their probabilities add up to ``success``.

        ``reach`` cells to either side hold all but a negligible probability; ``most`` is a guard that ``success`` meets long before.
        """
        base = np.floor(place)
        steps = np.arange(-reach, reach + 1)
        low = (base[:, None] + steps - place[:, None]) * self.width / self.radius
        chance = (_erf((low + self.width / self.radius) / math.sqrt(2)) - _erf(low / math.sqrt(2))) / 2
        order = np.argsort(-chance, axis=1, kind="stable")
        cost = -np.log(np.maximum(np.take_along_axis(chance, order, 1), 1e-300))
        corner = (base[:, None] + steps[order]).astype(np.int64)
        n = len(place)
        heap, total, found = [(float(cost[:, 0].sum()), (0,) * n, 0)], 0.0, []
        while heap and total < success and len(found) < most:
            spent, choice, last = heapq.heappop(heap)
            total += math.exp(-spent)
            found.append(choice)
            for j in range(last, n):  # each choice is reached once: only functions from ``last`` on move
                if choice[j] + 1 < cost.shape[1]:
                    heapq.heappush(heap, (spent + float(cost[j, choice[j] + 1] - cost[j, choice[j]]), choice[:j] + (choice[j] + 1,) + choice[j + 1 :], j))
        picked = np.array(found)
        return self.cells(np.take_along_axis(corner.T, picked, 0) if n == 1 else corner[np.arange(n), picked])


class Best:
    """The k nearest rows of a block of queries, seen batch by batch: exact distances, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors.astype(float), k
        self.near = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.square = (self.vectors**2).sum(axis=1)

    def see(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256]
            square = (vectors**2).sum(axis=1)
            rough = self.square[some, None] + square[None] - 2 * self.vectors[some] @ vectors.T
            slack = 1e-9 * (self.square[some] + square.max())[:, None]
            bound = self.near[some, -1:] ** 2
            if len(ids) > self.k:
                bound = np.minimum(bound, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            q, c = np.nonzero(rough <= bound + slack)
            exact = np.sqrt(((self.vectors[some[q]] - vectors[c]) ** 2).sum(axis=1))
            for n in np.unique(q):
                mine = q == n
                d, i = np.concatenate([self.near[some[n]], exact[mine]]), np.concatenate([self.found[some[n]], ids[c[mine]]])
                order = np.lexsort((i, d))[: self.k]
                self.near[some[n]], self.found[some[n]] = d[order], i[order]

    def rows(self) -> pa.RecordBatch:
        q, c = np.nonzero(np.isfinite(self.near))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, c]), pa.array(self.near[q, c])], names=["query_id", "vid", "score"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors from a list column or from packed bytes."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, dim)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _index_rows(tables: Tables, dim: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), dim)
            cells = tables.cells(np.floor(tables.places(vectors)))
            n, ids, packed = len(vectors), batch.column(0).to_numpy(), [v.tobytes() for v in vectors]
            for t in range(tables.shape[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((cells[:, t] % parts * tables.shape[0] + t).astype(np.int32)), pa.array(np.ones(n, np.int32)), pa.array(ids), pa.array(packed, pa.binary()),
                     pa.array(cells[:, t]), pa.nulls(n, pa.binary())], names=["part", "kind", "id", "vec", "cell", "cells"])

    return run


def _probe_rows(tables: Tables, dim: int, parts: int, success: float | None):
    """``success`` None: every part of the first table, all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), dim)
            places, rows = tables.places(vectors), []
            for k, query in enumerate(batch.column(0).to_pylist()):
                packed = vectors[k].tobytes()
                if success is None:
                    rows += [(p * tables.shape[0], 0, query, packed, None, None) for p in range(parts)]
                    continue
                for t in range(tables.shape[0]):
                    cells = tables.probes(places[k, t], success)
                    part = cells % parts
                    rows += [(int(p) * tables.shape[0] + t, 0, query, packed, None, np.unique(cells[part == p]).tobytes()) for p in np.unique(part)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "kind", "id", "vec", "cell", "cells"])

    return run


def _search(dim: int, k: int):
    """Groups arrive sorted by (part, block, salt, kind): the queries of a group first, then its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, best, visits, everywhere = None, [], None, {}, np.zeros(0, np.int64)
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            edges = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
                if tuple(key[a]) != group:
                    if best is not None:
                        yield best.rows()
                    group, queries, best = tuple(key[a]), [], None
                kinds = batch.column(3).to_numpy()[a:b]
                split = a + int((kinds == 0).sum())
                if split > a:
                    queries += zip(batch.column(4)[a:split].to_pylist(), batch.column(5)[a:split].to_pylist(), batch.column(7)[a:split].to_pylist())
                if split == b or not queries:
                    continue
                if best is None:
                    best = Best(np.array([q[0] for q in queries]), np.frombuffer(b"".join(q[1] for q in queries), float).reshape(-1, dim), k)
                    everywhere = np.array([n for n, q in enumerate(queries) if q[2] is None], np.int64)
                    some = [(n, np.frombuffer(q[2], np.int64)) for n, q in enumerate(queries) if q[2] is not None]
                    cell = np.concatenate([c for _, c in some]) if some else np.zeros(0, np.int64)
                    who = np.repeat(np.array([n for n, _ in some], np.int64), [len(c) for _, c in some])
                    order = np.argsort(cell, kind="stable")
                    names, first = np.unique(cell[order], return_index=True)
                    visits = dict(zip(names.tolist(), np.split(who[order], first[1:])))
                ids, cells = batch.column(4)[split:b].to_numpy(), batch.column(6)[split:b].to_numpy()
                vectors = _matrix(batch.column(5)[split:b], dim)
                order = np.argsort(cells, kind="stable")
                names, first = np.unique(cells[order], return_index=True)
                for name, rows in zip(names.tolist(), np.split(order, first[1:])):
                    asked = np.concatenate([visits.get(name, everywhere[:0]), everywhere])
                    if len(asked):
                        best.see(asked, ids[rows], vectors[rows])
        if best is not None:
            yield best.rows()

    return run


def expected_radius(distinct: DataFrame, n: int, k: int, max_rows: int = 20_000, queries: int = 256) -> float:
    """Distance within which a typical query has its k-th neighbour, from at most ``max_rows`` rows with the smallest hashes."""
    rows = hash_sample(distinct, "vid", max_rows, n).select("vec").toArrow()
    vectors = np.array(rows["vec"].to_pylist(), float)
    if len(vectors) < 2:
        return 1.0
    some = vectors[:queries]
    square = (vectors**2).sum(axis=1)
    away = np.sqrt(np.maximum(square[: len(some), None] + square[None] - 2 * some @ vectors.T, 0))
    rank = min(max(1, math.ceil(k * len(vectors) / n)), len(vectors) - 1)
    radius = float(np.quantile(np.partition(away, rank, axis=1)[:, rank], 0.75))
    return radius if radius > 0 else float(away.max()) or 1.0


def nearest(vectors: DataFrame, queries: str, k: int = 10, tables: int = 2, functions: int = 8, width: float = 2.25, success: float = 0.78,
            parts: int | None = None, max_queries: int = 20_000, max_rows: int = 200_000, sample: int = 20_000,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for every row that the SQL condition ``queries`` selects: query_id, rank, vec_id, score.

    Nearness is the Euclidean distance in double precision, ties go to the smaller id, a query is no candidate of its own. A neighbour is
    found with a probability of about 1 - (1 - success)^tables; queries with fewer than ``k`` rows are searched again in all cells, so that no query gets
    fewer rows than there are candidates. ``sample`` bounds the rows from which the expected distance is estimated.

    Rows without an id, null or zero vectors, vectors with null, nan or infinite components and vectors of another length than most take no part.
    Repeated ids with equal vectors count once. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    value = F.col(vec_col)
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(value, lambda x: x != 0)
    valid = vectors.where(F.col(id_col).isNotNull() & value.isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), value.cast("array<double>").alias("vec"), F.expr(queries).alias("asked"))
    lengths = valid.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["dim"]
    valid = valid.where(F.size("vec") == dim).withColumn("hash", F.xxhash64("vec"))
    # Of equal vectors the k + 1 smallest ids are all that can be among k nearest; the limit is applied before the shuffle as well.
    equal = Window.partitionBy("hash", "vec").orderBy("vec_id")
    ids = valid.groupBy("hash", "vec", "vec_id").agg(F.lit(1)).withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= k + 1)
    copies = cut_lineage(ids.groupBy("hash", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "vec", "ids"))
    distinct = copies.select("vid", "vec")
    n = distinct.count()
    hashes = Tables(dim, expected_radius(distinct, n, k, sample), tables, functions, width)
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = cut_lineage(distinct.mapInArrow(_index_rows(hashes, dim, parts), ROW))
    asked = cut_lineage(valid.where("asked").select("vec_id", "vec").dropDuplicates(["vec_id"]))

    def search(wanted: DataFrame, chance: float | None) -> DataFrame:
        probes = cut_lineage(wanted.mapInArrow(_probe_rows(hashes, dim, parts, chance), ROW))
        sizes = (probes.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / max_queries).cast("int").alias("blocks"))
                 .join(index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / max_rows).cast("int").alias("salts")), "part"))
        dealt = F.broadcast(sizes)  # one row per part, parts * tables in all
        numbered = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        drawn = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        left = probes.join(dealt, "part").withColumn("block", drawn("blocks")).withColumn("salt", numbered("salts"))
        right = index.join(dealt, "part").withColumn("salt", drawn("salts")).withColumn("block", numbered("blocks"))
        cells = ["part", "block", "salt", "kind", "id", "vec", "cell", "cells"]
        groups = left.select(cells).unionByName(right.select(cells)).repartition("part", "block", "salt").sortWithinPartitions("part", "block", "salt", "kind")
        found = groups.mapInArrow(_search(dim, k + 1), "query_id long, vid long, score double")
        return found.groupBy("query_id", "vid").agg(F.min("score").alias("score"))

    def ranked(found: DataFrame) -> DataFrame:
        nearest_first = Window.partitionBy("query_id")
        top = found.withColumn("_n", F.row_number().over(nearest_first.orderBy("score", "vid"))).where(F.col("_n") <= k + 1)
        spread = cut_lineage(top.drop("_n")).join(copies.select("vid", "ids"), "vid").select("query_id", F.explode("ids").alias("vec_id"), "score")
        order = F.row_number().over(nearest_first.orderBy("score", "vec_id")).cast("int")
        return spread.where("query_id <> vec_id").withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = cut_lineage(ranked(search(asked, success)))
    short = cut_lineage(asked.join(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
    if short.isEmpty():
        return first
    again = ranked(search(short, None))
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
