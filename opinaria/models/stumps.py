"""Boosted decision stumps: AdaBoost (SAMME, Zhu et al. 2009) where a round is one aggregation.

The weights of a round are summed by (feature, value, class) over the non-zero cells; a feature's zero cell is what is left of the class
totals. A feature has at most ``BINS`` values (more are cut at quantiles once), so the sums are few whatever the number of rows; running sums over a
feature's values give the Gini impurity of every split. The best split's leaves tell the error, the new weights' total and the next class
totals, so no row is scored to learn them. The (feature, value) pairs are numbered once and the rows written as blocks of labels and pair numbers, from
which a round works out the weights and their sums with arrays, block by block.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.session import computed, cut_lineage

BINS = 256  # distinct values of a feature; beyond, its values are rounded up to so many quantiles
BLOCK = 4096  # rows of a block
STEPS = 10  # rounds whose votes one expression holds
DIGITS = 10  # impurities equal to so many digits tie: sums differ in their last bits from run to run


@dataclass(frozen=True)
class Stump:
    """Rows with ``feature`` up to ``threshold`` are ``below``, others ``above``; a negative feature number means all rows are ``below``."""

    feature: int
    threshold: float
    below: int
    above: int
    error: float
    say: float


def cells_of(features: str = "features") -> Column:
    """The non-zero cells of a vector, (i, v)."""
    return F.filter(F.transform(vector_to_array(features), lambda v, i: F.struct(i.cast("int").alias("i"), v.alias("v"))), lambda c: c["v"] != 0)


def predicted(stump: Stump, cells: str = "cells") -> Column:
    if stump.feature < 0:
        return F.lit(stump.below)
    held = F.filter(cells, lambda c: c["i"] == stump.feature)
    value = F.when(F.size(held) > 0, held[0]["v"]).otherwise(0.0)
    return F.when(value <= stump.threshold, stump.below).otherwise(stump.above)


def weight_of(stumps: Sequence[Stump], mass: float, written: str = "w", cells: str = "cells", label: str = "label") -> Column:
    """A row's weight after more rounds, scaled to a total of one by the known ``mass``."""
    moved = sum((F.when(predicted(s, cells) != F.col(label), s.say).otherwise(0.0) for s in stumps), F.lit(0.0))
    return F.col(written) * F.exp(moved) / mass


def binned(rows: DataFrame) -> tuple[DataFrame, set[int]]:
    """``rows`` with the values of every feature that has more than ``BINS`` rounded up to its quantiles, and the numbers of these features."""
    values = rows.select(F.inline("cells"))
    many = cut_lineage(values.groupBy("i").agg(F.approx_count_distinct("v", 0.01).alias("n")).filter(F.col("n") > BINS).select("i"))
    if many.isEmpty():
        return rows, set()
    wide = cut_lineage(values.join(F.broadcast(many), "i", "left_semi").groupBy("i").agg(
        F.max("v").alias("top"), F.percentile_approx("v", [k / BINS for k in range(1, BINS)], BINS * 40).alias("cuts"))
        .select("i", F.array_distinct(F.concat("cuts", F.array("top"))).alias("cuts")))
    features = {r["i"] for r in wide.select("i").collect()}
    keyed = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    cells = keyed.select("_row", F.inline("cells")).join(F.broadcast(wide), "i", "left")
    value = F.when(F.col("cuts").isNull(), F.col("v")).otherwise(F.array_min(F.filter("cuts", lambda c: c >= F.col("v"))))
    rounded = cells.select("_row", F.struct("i", value.alias("v")).alias("c")).groupBy("_row").agg(F.sort_array(F.collect_list("c")).alias("_cells"))
    empty = F.array().cast(rows.schema["cells"].dataType)
    return keyed.join(rounded, "_row", "left").withColumn("cells", F.coalesce("_cells", empty)).drop("_row", "_cells"), features


@dataclass(frozen=True)
class Pairs:
    """The (feature, value) pairs of the non-zero cells in order and the rows of each; ``n`` rows in all."""

    i: np.ndarray
    v: np.ndarray
    c: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: DataFrame, n: int) -> Pairs:
        """At most features times ``BINS`` pairs come to the driver."""
        sums = rows.select(F.inline("cells")).groupBy("i", "v").agg(F.count("*").alias("c")).toArrow()
        i, v, c = (sums[name].to_numpy() for name in ("i", "v", "c"))
        order = np.lexsort((v, i))
        return cls(i[order], v[order], c[order], n)

    def above(self, stump: Stump) -> tuple[int, int, int]:
        """First pair of the stump's feature, first one beyond its threshold, end of the feature."""
        start, end = np.searchsorted(self.i, stump.feature, "left"), np.searchsorted(self.i, stump.feature, "right")
        return int(start), int(start + np.searchsorted(self.v[start:end], stump.threshold, "right")), int(end)

    def best_split(self, w1: np.ndarray, w0: np.ndarray, ones: float, zeros: float, wide: Collection[int] = ()) -> tuple | None:
        """(feature, threshold, below ones, below zeros) of the split with the least weighted Gini impurity; ties go to the first feature, then the least
        threshold. Thresholds lie half way between neighbouring values, for the ``wide`` features at the lower one. None if every feature is
        constant. ``w1`` and ``w0`` are the weights of the classes by pair, ``ones`` and ``zeros`` their totals."""
        if not len(self.i):
            return None
        i, v = self.i, self.v
        first = np.flatnonzero(np.diff(i, prepend=-1))
        rest = self.n - np.add.reduceat(self.c, first) > 0  # features that some row does not have
        i, v = np.append(i, i[first][rest]), np.append(v, np.zeros(rest.sum()))
        w1 = np.append(w1, (ones - np.add.reduceat(w1, first))[rest])
        w0 = np.append(w0, (zeros - np.add.reduceat(w0, first))[rest])
        order = np.lexsort((v, i))
        i, v, w1, w0 = i[order], v[order], w1[order], w0[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        sizes = np.diff(np.append(first, len(i)))
        upto = lambda w: np.cumsum(w) - np.repeat(np.cumsum(w)[first] - w[first], sizes)
        b1, b0 = upto(w1), upto(w0)
        a1, a0 = np.maximum(ones - b1, 0), np.maximum(zeros - b0, 0)
        side = lambda x, y: np.divide(x * y, x + y, out=np.zeros_like(x), where=x + y > 0)
        impurity = np.round(side(b1, b0) + side(a1, a0), DIGITS)
        after = np.append(v[1:], np.inf)
        cut = np.where(np.isin(i, list(wide)), v, (v + after) / 2)
        usable = np.append(i[1:] == i[:-1], False)
        if not usable.any():
            return None
        best = np.lexsort((cut[usable], i[usable], impurity[usable]))[0]
        place = np.flatnonzero(usable)[best]
        return int(i[place]), float(cut[place]), float(b1[place]), float(b0[place])


def in_blocks(rows: DataFrame, pairs: Pairs) -> DataFrame:
    """``rows`` as blocks of up to ``BLOCK``: the labels (-1 for null), and the pair and row numbers of the cells in the order of the pairs."""
    numbers = rows.sparkSession.sparkContext.broadcast((pairs.i, pairs.v))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, v = numbers.value
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                features = [np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in part["f"]]
                f = np.concatenate(features)
                values = np.concatenate([np.asarray(x, float) if x is not None else np.zeros(0) for x in part["x"]])
                row = np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in features])
                order = np.lexsort((values, f))
                f, values, row = f[order], values[order], row[order]
                first = np.flatnonzero(np.diff(f, prepend=-1))
                pair = np.empty(len(f), np.int32)
                for a, b in zip(first, np.append(first[1:], len(f))):
                    low, high = np.searchsorted(i, f[a], "left"), np.searchsorted(i, f[a], "right")
                    pair[a:b] = low + np.searchsorted(v[low:high], values[a:b], "left")
                labels = part["label"].fillna(-1).to_numpy().astype(np.int8)
                yield pd.DataFrame({"labels": [labels.tobytes()], "pair": [pair.tobytes()], "row": [row.tobytes()]})

    flat = rows.select("label", F.col("cells.i").alias("f"), F.col("cells.v").alias("x"))
    return flat.mapInPandas(cut, "labels binary, pair binary, row binary")


def sums_of(blocks: DataFrame, pairs: Pairs, stumps: Sequence[Stump], start: float, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """The weights of each pair's rows by class, after ``stumps``. A task adds up its blocks; the tasks' sums are added by pair."""
    size = len(pairs.i)
    rounds = [(*pairs.above(s), s.below if s.feature < 0 or 0.0 <= s.threshold else s.above, s) for s in stumps]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * size)
        for frame in frames:
            for labels, pair, row in zip(frame["labels"], frame["pair"], frame["row"]):
                labels, pair, row = np.frombuffer(labels, np.int8), np.frombuffer(pair, np.int32), np.frombuffer(row, np.int32)
                moved = np.zeros(len(labels))
                for low, middle, high, otherwise, stump in rounds:
                    vote = np.full(len(labels), otherwise, np.int8)
                    if stump.feature >= 0:
                        a, b, c = np.searchsorted(pair, (low, middle, high))
                        vote[row[a:b]] = stump.below
                        vote[row[b:c]] = stump.above
                    moved += np.where((vote != labels) & (labels >= 0), stump.say, 0.0)
                weight = start * np.exp(moved) / mass
                total += np.bincount(pair + size * (labels[row] == 1), weights=weight[row], minlength=2 * size)
        yield pd.DataFrame({"pair": np.arange(size, dtype=np.int32), "w0": total[:size], "w1": total[size:]})

    parts = blocks.mapInPandas(add, "pair int, w0 double, w1 double").groupBy("pair").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0")).toArrow()
    w1, w0 = np.zeros(size), np.zeros(size)
    place = parts["pair"].to_numpy()
    w1[place], w0[place] = parts["w1"].to_numpy(), parts["w0"].to_numpy()
    return w1, w0


def boost(rows: DataFrame, rounds: int, learning_rate: float = 1.0) -> tuple[list[Stump], DataFrame]:
    """Stumps of up to ``rounds`` rounds for ``rows`` (label 0 or 1, cells), and ``rows`` with the weights ``w`` after them.

    Boosting ends when a stump makes no error (it alone then speaks, with a say of one) or is no better than chance (it is left out unless it is the first).
    """
    rows = cut_lineage(rows)
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if total == 0:
        raise ValueError("boosting needs rows")
    rows, wide = binned(rows)
    if wide:
        rows = cut_lineage(rows)
    pairs = Pairs.of(rows, total)
    blocks = cut_lineage(in_blocks(rows, pairs))
    ones, zeros = positive / total, (total - positive) / total
    stumps: list[Stump] = []
    fresh: list[Stump] = []  # the stumps that moved the weights, and the weights' total
    mass = 1.0
    for _ in range(rounds):
        split = pairs.best_split(*sums_of(blocks, pairs, fresh, 1.0 / total, mass), ones, zeros, wide) if len(pairs.i) else None
        feature, threshold, b1, b0 = split if split else (-1, 0.0, ones, zeros)
        a1, a0 = max(ones - b1, 0.0), max(zeros - b0, 0.0)
        below, above = int(b1 > b0), int(a1 > a0)
        error = (min(b1, b0) + min(a1, a0)) / (ones + zeros)
        if error <= 1e-12:
            stumps.append(Stump(feature, threshold, below, above, 0.0, 1.0))
            break
        if error >= 0.5:
            if not stumps:
                stumps.append(Stump(feature, threshold, below, above, error, 1.0))
            break
        say = learning_rate * log((1 - error) / error)
        stump = Stump(feature, threshold, below, above, error, say)
        stumps.append(stump)
        # The missed weight of each class grows; the totals of the next round follow from the leaves.
        missed1, missed0 = (0 if below else b1) + (0 if above else a1), (b0 if below else 0) + (a0 if above else 0)
        ones, zeros = ones + missed1 * (exp(say) - 1), zeros + missed0 * (exp(say) - 1)
        scale = ones + zeros
        ones, zeros, mass = ones / scale, zeros / scale, mass * scale
        fresh.append(stump)
    weighted = rows.withColumn("w", F.lit(1.0 / total))
    for at in range(0, len(fresh), STEPS):
        weighted = computed(weighted, w=weight_of(fresh[at : at + STEPS], 1.0)).select(*weighted.columns)
    return stumps, weighted.withColumn("w", F.col("w") / mass)


class StumpVote(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The weighted vote of stumps; a tie goes to label 0. All of it is a column expression, and its parameters are its state."""

    stumpFeatures = Param(Params._dummy(), "stumpFeatures", "feature numbers, -1 for none", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "thresholds", TypeConverters.toListFloat)
    below = Param(Params._dummy(), "below", "labels up to the threshold", TypeConverters.toListInt)
    above = Param(Params._dummy(), "above", "labels beyond it", TypeConverters.toListInt)
    says = Param(Params._dummy(), "says", "weights of the votes", TypeConverters.toListFloat)

    def __init__(self, stumps: Sequence[Stump] = ()):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(stumpFeatures=[s.feature for s in stumps], thresholds=[s.threshold for s in stumps], below=[s.below for s in stumps],
                  above=[s.above for s in stumps], says=[s.say for s in stumps])

    def margin(self, values: str) -> Column:
        """The votes for label 1 less those for label 0, from a column with the features as an array."""
        parts = zip(*(self.getOrDefault(p) for p in (self.stumpFeatures, self.thresholds, self.below, self.above, self.says)))
        votes = [F.when(F.col(values)[i] <= t, (2 * b - 1) * s).otherwise((2 * a - 1) * s) if i >= 0 else F.lit((2 * b - 1) * s) for i, t, b, a, s in parts]
        return sum(votes[1:], votes[0]) if votes else F.lit(0.0)

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != self.getPredictionCol()]
        wide = computed(df.select(*kept), _x=vector_to_array(self.getFeaturesCol()))
        return wide.withColumn(self.getPredictionCol(), (self.margin("_x") > 1e-12).cast("double")).drop("_x")


class StumpBoost(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """AdaBoost over decision stumps, see :func:`boost`."""

    rounds = Param(Params._dummy(), "rounds", "number of stumps", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of a stump's say", TypeConverters.toFloat)

    def __init__(self, rounds: int = 50, learning_rate: float = 1.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(rounds=rounds, learningRate=learning_rate)

    def _fit(self, df: DataFrame) -> StumpVote:
        rows = df.select(F.col(self.getLabelCol()).cast("int").alias("label"), cells_of(self.getFeaturesCol()).alias("cells"))
        stumps, _ = boost(rows, self.getOrDefault(self.rounds), self.getOrDefault(self.learningRate))
        return StumpVote(stumps)
