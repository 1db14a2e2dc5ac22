"""Voting, bagging and boosting over Spark ML classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.session import cut_lineage


class _VoteWriter(MLWriter):
    """Metadata with the weights, and every member as a pipeline of its own."""

    def __init__(self, vote: WeightedVote):
        super().__init__()
        self.vote = vote

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.vote, path, self.sparkSession, extraMetadata={"weights": self.vote.weights})
        for i, model in enumerate(self.vote.models):
            wrapped = model if isinstance(model, PipelineModel) else PipelineModel([model])
            wrapped.write().overwrite().save(f"{path}/model{i:04d}")


class _VoteReader(MLReader):
    def load(self, path: str) -> WeightedVote:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        weights = metadata["weights"]
        vote = WeightedVote([PipelineModel.load(f"{path}/model{i:04d}") for i in range(len(weights))], weights)
        vote._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(vote, metadata)
        return vote


class WeightedVote(Model, HasPredictionCol, MLWritable, MLReadable):
    """Binary vote of fitted models; a tie goes to label 0. All votes are columns of one row. It is written and read like any stage, so
    that a pipeline may end in it."""

    def write(self) -> MLWriter:
        return _VoteWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _VoteReader()

    def __init__(self, models: Sequence[Model] = (), weights: Sequence[float] | None = None):
        super().__init__()
        self.models = list(models)
        self.weights = list(weights) if weights is not None else [1.0] * len(self.models)
        self._setDefault(predictionCol="prediction")

    def votes(self, df: DataFrame) -> DataFrame:
        """``df`` plus one column ``_vote<i>`` per model."""
        out, names = df, list(df.columns)
        for i, model in enumerate(self.models):
            scored = model.transform(out)
            names.append(f"_vote{i}")
            out = scored.withColumn(f"_vote{i}", F.col("prediction")).select(*names)
        return out

    def margin(self) -> Column:
        parts = [(F.col(f"_vote{i}") * 2 - 1) * w for i, w in enumerate(self.weights)]
        return sum(parts[1:], parts[0])

    def _transform(self, df: DataFrame) -> DataFrame:
        voted = self.votes(df)
        return voted.withColumn(self.getPredictionCol(), (self.margin() > 1e-12).cast("double")).select(
            *[c for c in df.columns if c != self.getPredictionCol()], self.getPredictionCol())

    def copy(self, extra=None):
        return self


class _OverBase(Estimator, HasLabelCol, HasPredictionCol, HasSeed):
    """Shared by the estimators that refit a weighted base classifier."""

    rounds = Param(Params._dummy(), "rounds", "number of base models", TypeConverters.toInt)

    def __init__(self, base: Estimator, rounds: int, seed: int = 0):
        super().__init__()
        self.base = base
        self._setDefault(labelCol="label", predictionCol="prediction", seed=0)
        self._set(rounds=rounds, seed=seed)

    def copy(self, extra=None):
        twin = super().copy(extra)
        twin.base = self.base.copy(extra)
        return twin

    def _base(self, weight: str) -> Estimator:
        return self.base.copy({self.base.getParam("weightCol"): weight})


class Bagging(_OverBase):
    """Bootstrap aggregation. A row's multiplicity in a sample is a Poisson(1) draw taken from a hash
    of the row, which needs no shuffle and repeats after a lost executor."""

    def _fit(self, df: DataFrame) -> WeightedVote:
        models = []
        # Poisson(1) distribution function at 0, 1, 2, ...
        steps, p, total = [], 0.36787944117144233, 0.0
        for k in range(12):
            total += p
            steps.append(total)
            p /= k + 1
        columns = [c for c in df.columns if c != "features"]
        for i in range(self.getOrDefault(self.rounds)):
            draw = F.pmod(F.xxhash64(F.lit(self.getSeed() * 1_000_003 + i), F.hash("features"), *columns), F.lit(1 << 30)) / float(1 << 30)
            weight = sum([(draw > s).cast("double") for s in steps[1:]], (draw > steps[0]).cast("double"))
            models.append(self._base("_weight").fit(df.withColumn("_weight", weight)))
        return WeightedVote(models)


class AdaBoost(_OverBase):
    """Discrete boosting for two classes (SAMME, Zhu et al. 2009). Each round is one weighted fit and
    one aggregate; the weights are written out every round, so plans stay short."""

    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of a model's say", TypeConverters.toFloat)

    def __init__(self, base: Estimator, rounds: int, learning_rate: float = 1.0, seed: int = 0):
        super().__init__(base, rounds, seed)
        self._set(learningRate=learning_rate)

    def _fit(self, df: DataFrame) -> WeightedVote:
        label = self.getLabelCol()
        total = df.count()
        current = df.withColumn("_weight", F.lit(1.0 / total))
        models, weights = [], []
        for _ in range(self.getOrDefault(self.rounds)):
            model = self._base("_weight").fit(current)
            missed = (F.col("prediction") != F.col(label)).cast("double")
            scored = cut_lineage(model.transform(current).select(*df.columns, "_weight", missed.alias("_missed")))
            error, mass = scored.agg(F.sum(F.col("_weight") * F.col("_missed")), F.sum("_weight")).first()
            error = error / mass
            if error <= 0:
                models, weights = [*models, model], [*weights, 1.0]
                break
            if error >= 0.5:
                if not models:
                    models, weights = [model], [1.0]
                break
            say = self.getOrDefault(self.learningRate) * log((1 - error) / error)
            models, weights = [*models, model], [*weights, say]
            grown = F.col("_weight") * F.exp(F.col("_missed") * say)
            new_mass = scored.agg(F.sum(grown)).first()[0]
            current = scored.withColumn("_weight", grown / new_mass).drop("_missed")
        return WeightedVote(models, weights)
