"""Exact order statistics and running sums without a single-task sort.

Both cut the value range into buckets at approximate quantiles (a bounded, mergeable sketch),
count the buckets, and sort only inside a bucket. Equal values are merged beforehand, so one
value holding a large share of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinaria.session import cut_lineage, fits_broadcast, shuffled, sized

BUCKETS = 256


def _cuts(value: Column, buckets: int) -> Column:
    probs = [i / buckets for i in range(1, buckets)]
    return F.percentile_approx(value, probs, buckets * 40)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    totals: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Linearly interpolated quantiles per key as ``q0, q1, ...``.

    ``totals`` (keys and ``total``) gives the population size where ``df`` leaves out its zeros; values
    are then taken to be non-negative and the missing rows to be zero.
    """
    keys = list(keys)
    if not keys:
        # One group: give it a key, so that the same joins serve both cases.
        only = F.lit(0).alias("_all")
        totals = None if totals is None else totals.select("total", only)
        return exact_quantiles(df.select(value, only), ["_all"], value, probs, totals, buckets).drop("_all")
    # Both are read several times below; the first holds distinct values, the second one row per key.
    hist = cut_lineage(df.groupBy(*keys, value).agg(F.count("*").alias("_n")))
    per_key = hist.groupBy(*keys).agg(_cuts(F.col(value), buckets).alias("_cuts"), F.sum("_n").alias("_m"))
    per_key = per_key.withColumn("total", F.col("_m")) if totals is None else per_key.join(totals, keys)
    # Ranks on either side of each quantile, counted from the smallest listed value; a rank
    # below zero falls among the left-out zeros.
    ranks = []
    for i, p in enumerate(probs):
        place = (F.col("total") - 1) * p
        zeros = F.col("total") - F.col("_m")
        for slot, at in ((2 * i, F.floor(place)), (2 * i + 1, F.ceil(place))):
            ranks.append(F.struct(F.lit(slot).alias("slot"), (at - zeros).alias("rank"), (place - F.floor(place)).alias("frac")))
    per_key = cut_lineage(per_key.withColumn("_ranks", F.array(*ranks)))
    few = fits_broadcast(per_key)

    def attach(rows: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
        return rows.join(F.broadcast(dim) if few else shuffled(dim), on)

    placed = attach(hist, per_key.select(*keys, "_cuts"), keys).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_b")
    ends = sizes.withColumn("_end", F.sum("_n").over(upto)).withColumn("_start", F.col("_end") - F.col("_n")).drop("_n")
    wanted = per_key.select(*keys, F.inline("_ranks"))
    zero = wanted.filter("rank < 0").select(*keys, "slot", "frac", F.lit(0.0).alias("_v"))
    inside = attach(ends, per_key.select(*keys, "_ranks"), keys).withColumn("_w", F.filter(
        "_ranks", lambda r: (r["rank"] >= F.col("_start")) & (r["rank"] < F.col("_end")))).filter(F.size("_w") > 0)
    # Only buckets that hold a wanted rank are sorted.
    rows = attach(placed, inside.select(*keys, "_b", "_start", "_w"), [*keys, "_b"])
    running = F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy(value))
    rows = rows.withColumn("_hi", F.col("_start") + running).select(*keys, F.col(value).alias("_v"), "_n", "_hi", F.inline("_w"))
    found = rows.filter((F.col("rank") < F.col("_hi")) & (F.col("rank") >= F.col("_hi") - F.col("_n"))) \
        .select(*keys, "slot", "frac", F.col("_v").cast("double").alias("_v"))
    picks = found.unionByName(zero)

    def quantile(i: int) -> Column:
        low = F.max(F.when(F.col("slot") == 2 * i, F.col("_v")))
        high = F.max(F.when(F.col("slot") == 2 * i + 1, F.col("_v")))
        frac = F.max(F.when(F.col("slot") == 2 * i, F.col("frac")))
        return (low + (high - low) * frac).alias(f"q{i}")

    return picks.groupBy(*keys).agg(*[quantile(i) for i in range(len(probs))])


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str],
                 buckets: int = BUCKETS) -> DataFrame:
    """Inclusive running sums ``cum_<name>`` per key in descending ``order``, and the next row's
    values as ``next_<name>``. ``order`` must be unique per key; ``df`` is read three times."""
    keys = list(keys)
    # at most ``buckets`` numbers come to the driver
    cuts = F.lit(df.agg(_cuts(F.col(order).cast("double"), buckets)).first()[0] or []).cast("array<double>")
    placed = df.withColumn("_b", F.size(F.filter(cuts, lambda c: c > F.col(order))))
    totals = placed.groupBy(*keys, "_b").agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums], F.max_by(F.struct(*sums), order).alias("_first"))
    by_bucket = W.partitionBy(*keys).orderBy("_b")
    before = by_bucket.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.lead("_first").over(by_bucket).alias("_next"),
                            *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    join_keys = [*keys, "_b"]
    rows = placed.join(sized(offsets), join_keys)
    inner = W.partitionBy(*join_keys).orderBy(F.desc(order))
    nxt = F.coalesce(F.lead(F.struct(*sums)).over(inner), F.col("_next"))
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_nx", nxt)
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(upto) + F.col(f"_o_{s}")).withColumn(f"next_{s}", F.col(f"_nx.{s}"))
    return out.drop("_b", "_next", "_nx", *[f"_o_{s}" for s in sums])
