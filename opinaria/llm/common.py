"""Helpers shared by the operators: tables, skew-proof look-ups and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinaria.session import cut_lineage, fits_broadcast

# A key is hot when it holds more than one in so many rows; at most as many keys can be.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null stays null."""
    return F.encode(F.col(column).cast("string"), "UTF-8")


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of a column written as text, modulo ``modulus``; null when the column is null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def hash_sample(df: DataFrame, id_col: str, max_rows: int, n: int) -> DataFrame:
    """The ``max_rows`` of ``n`` rows whose ids have the smallest hashes, fewer only if there are fewer. Rows that have no chance are filtered
    out first, so that not every task sends its own ``max_rows`` to the sort."""
    drawn = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    likely = df if n <= max_rows else df.where(drawn < int((1 << 40) * min(1.0, (1.2 * max_rows + 1000) / n)))
    return likely.orderBy(drawn, id_col).limit(max_rows)


def join_hot(stream: DataFrame, dim: DataFrame, on: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join ``dim`` (unique on ``on``) to a stream some of whose keys may hold a large share of the rows.

    A small ``dim`` is broadcast after a count. Otherwise the keys that hold over 1/1000 of the stream,
    at most a thousand of them by arithmetic, are looked up in a broadcast table and only the rest is
    shuffled. No row is dropped. ``stream`` is read up to four times, so it should be a written table; ``hot``
    passes the hot keys on (one column, a proven bound) when the caller has counted them already.
    """
    if fits_broadcast(dim):
        return stream.join(F.broadcast(dim), on, how)
    if hot is None:
        hot = hot_keys(stream.where(F.col(on).isNotNull()).groupBy(on).count(), on, "count", stream.count())
    return join_shuffled(stream, dim, on, how, hot)


def join_shuffled(stream: DataFrame, dim: DataFrame, on: str, how: str, hot: DataFrame) -> DataFrame:
    """``join_hot`` for a ``dim`` that grows with the stream: one shuffle of all but the rows of hot keys, at every size."""
    hot_dim = F.broadcast(dim.join(F.broadcast(hot), on, "left_semi"))
    flagged = stream.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    head = flagged.where("_hot").drop("_hot").join(hot_dim, on, how)
    tail = flagged.where("_hot is null").drop("_hot").join(dim.hint("shuffle_merge"), on, how)
    return head.unionByName(tail)


def hot_keys(counts: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """The keys with over 1/1000 of ``total`` rows, written down; fewer than a thousand."""
    return cut_lineage(counts.where(F.col(count) * HOT_SHARE > total).select(on))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph of edges (a, b): one row (node, root) per node.

    ``root`` is some node of the component. Every round draws a priority per node (a hash with the round
    as seed), points each node at the best node of its neighbourhood and contracts the edges, which
    leaves a fraction of the nodes; the pointers are resolved backwards at the end. Neighbourhoods are
    reduced by partial aggregation, so a hub with a third of all edges costs one row per task, and the
    look-ups split hot keys. Self-loops and repeats are allowed; rows with a null end are ignored.
    """
    pairs = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select("a", F.col("a").alias("b"))
    both = pairs.where("a <> b")
    current = cut_lineage(both.union(both.select("b", "a")).distinct())
    nodes = cut_lineage(current.select("a").union(loops.select("a")).distinct())
    steps: list[DataFrame] = []
    while not current.isEmpty():
        if len(steps) == max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
        seed = F.lit(len(steps))
        own, other = (F.struct(F.xxhash64(seed, F.col(x)).alias("p"), F.col(x).alias("v")) for x in ("a", "b"))
        step = cut_lineage(current.groupBy("a").agg(F.min(other).alias("m"))
                           .select("a", F.least(F.col("m"), own)["v"].alias("rep")))
        steps.append(step)
        left = cut_lineage(join_hot(current, step, "a").select(F.col("rep").alias("ra"), "b"))
        right = step.select(F.col("a").alias("b"), F.col("rep").alias("rb"))
        current = cut_lineage(join_hot(left, right, "b").where("ra <> rb")
                              .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    labels: DataFrame | None = None
    for step in reversed(steps):
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("rep").alias("root"))
        else:
            upper = labels.select(F.col("node").alias("rep"), "root")
            labels = cut_lineage(join_hot(step, upper, "rep")
                                 .select(F.col("a").alias("node"), F.coalesce("root", "rep").alias("root")))
    if labels is None:
        return nodes.select(F.col("a").alias("node"), F.col("a").alias("root"))
    alone = nodes.select(F.col("a").alias("node")).join(labels, "node", "left_anti")
    return labels.unionByName(alone.select("node", F.col("node").alias("root")))
