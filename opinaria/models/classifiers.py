"""The compared classifiers as Spark ML estimators, with the parameter grids of the search.

Penalties are stated per data set there and per row in Spark, hence the divisions by the row
count. Boosted-tree and network libraries are represented by Spark's own trees and perceptron, each with the
rounds, step and depth that its library has by default; "no limit" of depth is Spark's own maximum of 30.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import Binarizer, SQLTransformer
from pyspark.ml.regression import LinearRegression

from opinaria.models.ensembles import AdaBoost, Bagging
from opinaria.models.stumps import StumpBoost

# Spark's trees stop at depth 30. "No limit" means that; a deeper request is an error.
DEEPEST = 30


def _depth(max_depth: int | None) -> int:
    if max_depth is None or max_depth == -1:
        return DEEPEST
    if max_depth > DEEPEST:
        raise ValueError(f"trees can be {DEEPEST} levels deep, not {max_depth}")
    return max_depth


@dataclass(frozen=True)
class Classifier:
    """``build(n_rows, n_features, **params)`` makes the estimator; ``grid`` lists what the search varies."""

    family: str
    name: str
    build: Callable[..., Estimator]
    grid: dict[str, list]

    @property
    def c_name(self) -> str:
        return f"{self.family}.{self.name}"

    def combinations(self) -> list[dict]:
        return [dict(zip(self.grid, values)) for values in product(*self.grid.values())]


def _logistic(n, d, C=1.0, penalty="l2", max_iter=100):
    return LogisticRegression(regParam=1 / (C * n), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                              standardization=False, maxIter=max_iter)


def _svc(n, d, C=1.0, max_iter=100):
    return LinearSVC(regParam=1 / (C * n), standardization=False, maxIter=max_iter)


def _sgd(n, d, loss="hinge", alpha=1e-4, max_iter=100):
    if loss == "log":
        return LogisticRegression(regParam=alpha, standardization=False, maxIter=max_iter)
    return LinearSVC(regParam=alpha, standardization=False, maxIter=max_iter)


def _ridge(n, d, alpha=1.0):
    # Least squares on 0/1 labels cut at one half equals the fit on -1/1 labels cut at zero.
    fit = LinearRegression(regParam=alpha / n, elasticNetParam=0.0, standardization=False, predictionCol="_margin")
    return Pipeline(stages=[fit, SQLTransformer(
        statement="SELECT *, CAST(_margin > 0.5 AS DOUBLE) AS prediction FROM __THIS__")])


def _tree(n, d, criterion="gini", min_leaf=1, max_depth=None):
    return DecisionTreeClassifier(impurity=criterion, minInstancesPerNode=min_leaf,
                                  maxDepth=_depth(max_depth), maxMemoryInMB=1024, seed=0)


def _forest(n, d, n_estimators=100, criterion="gini", min_leaf=1, max_depth=None):
    return RandomForestClassifier(numTrees=n_estimators, impurity=criterion, minInstancesPerNode=min_leaf,
                                  maxDepth=_depth(max_depth), maxMemoryInMB=1024, seed=0)


def _forest_xgb(n, d, n_estimators=100, gamma=0.0, max_depth=5):
    return RandomForestClassifier(numTrees=n_estimators, minInfoGain=gamma, maxDepth=max_depth,
                                  subsamplingRate=0.8, seed=0)


def _boosted(n, d, n_estimators=100, learning_rate=0.1, max_depth=3, gamma=0.0, min_leaf=1):
    return GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, maxDepth=_depth(max_depth), minInfoGain=gamma,
                         minInstancesPerNode=min_leaf, seed=0)


# Without smoothing an unseen term makes every class impossible; a smoothing of 0 means this.
LEAST_SMOOTHING = 1e-10


def _boosted_as(n_estimators, learning_rate, max_depth):
    """Spark's boosted trees with another library's default rounds, step and depth."""
    def build(n, d, n_estimators=n_estimators, learning_rate=learning_rate, max_depth=max_depth, gamma=0.0, min_leaf=1):
        return _boosted(n, d, n_estimators, learning_rate, max_depth, gamma, min_leaf)

    return build


def _multinomial(n, d, alpha=1.0):
    return NaiveBayes(modelType="multinomial", smoothing=max(alpha, LEAST_SMOOTHING))


def _bernoulli(n, d, alpha=1.0, binarize=0.0):
    return Pipeline(stages=[Binarizer(threshold=binarize, inputCol="features", outputCol="_present"),
                            NaiveBayes(modelType="bernoulli", smoothing=max(alpha, LEAST_SMOOTHING), featuresCol="_present")])


def _perceptron(n, d, hidden=100, max_iter=20, solver="l-bfgs", step=0.03):
    return MultilayerPerceptronClassifier(layers=[d, hidden, 2], maxIter=max_iter, solver=solver, stepSize=step, seed=0)


def _base(n, d, kind, max_iter=100):
    return _logistic(n, d, max_iter=max_iter) if kind == "logistic" else _sgd(n, d, max_iter=max_iter)


def _bagging(n, d, n_estimators=10, base="tree", max_iter=100):
    if base == "tree":
        return RandomForestClassifier(numTrees=n_estimators, featureSubsetStrategy="all", subsamplingRate=1.0,
                                      maxDepth=DEEPEST, maxMemoryInMB=1024, seed=0)
    return Bagging(_base(n, d, base, max_iter), n_estimators)


def _adaboost(n, d, n_estimators=50, learning_rate=1.0, base="stump"):
    if base == "stump":
        return StumpBoost(n_estimators, learning_rate)
    return AdaBoost(_base(n, d, base), n_estimators, learning_rate)


# Names and search grids, as far as Spark has the parameter.
CLASSIFIERS = (
    Classifier("aux", "KerasClassifier", lambda n, d, epochs=5: _perceptron(n, d, hidden=32, max_iter=epochs),
               {"epochs": [5, 10, 15]}),
    Classifier("xgboost", "XGBClassifier", _boosted_as(100, 0.3, 6),
               {"n_estimators": [100, 200], "gamma": [1, 0.1, 0.001, 0.0001], "max_depth": [5, 10]}),
    Classifier("xgboost", "XGBRFClassifier", _forest_xgb,
               {"n_estimators": [100, 200], "gamma": [1, 0.1, 0.001, 0.0001], "max_depth": [5, 10]}),
    Classifier("lightgbm", "LGBMClassifier", _boosted_as(100, 0.1, 5),
               {"n_estimators": [100, 200], "learning_rate": [0.1, 0.5, 1.0], "max_depth": [5, 6, 7, -1]}),
    Classifier("aux", "CatBoostClassifier", _boosted_as(100, 0.03, 6),
               {"n_estimators": [100, 200], "learning_rate": [0.03, 0.5, 1.0], "max_depth": [5, 6, 7]}),
    Classifier("linear_model", "LogisticRegression", _logistic, {"C": [0.05, 0.5, 1.0], "penalty": ["l1", "l2"]}),
    Classifier("linear_model", "SGDClassifier", _sgd, {"loss": ["hinge", "log"]}),
    Classifier("linear_model", "RidgeClassifier", _ridge, {"alpha": [0, 0.001, 0.01, 0.25, 0.5, 0.75, 1.0]}),
    Classifier("tree", "DecisionTreeClassifier", _tree,
               {"criterion": ["gini", "entropy"], "min_leaf": [1, 2, 5, 7], "max_depth": [5, 6, 7, None]}),
    Classifier("naive_bayes", "MultinomialNB", _multinomial, {"alpha": [0, 0.001, 0.01, 0.25, 0.5, 0.75, 1.0]}),
    Classifier("naive_bayes", "BernoulliNB", _bernoulli, {"alpha": [0.25, 0.5, 0.75, 1.0], "binarize": [0.0, 0.5, 1.0]}),
    Classifier("ensemble", "RandomForestClassifier", _forest,
               {"n_estimators": [100, 200], "criterion": ["entropy", "gini"], "min_leaf": [1, 2, 5, 7],
                "max_depth": [5, 6, 7, None]}),
    Classifier("ensemble", "GradientBoostingClassifier", _boosted, {"min_leaf": [1, 3, 7], "max_depth": [3, 5, 7]}),
    Classifier("ensemble", "BaggingClassifier", _bagging,
               {"n_estimators": [10, 20], "base": ["tree", "logistic", "linear"]}),
    Classifier("ensemble", "AdaBoostClassifier", _adaboost,
               {"n_estimators": [10, 50, 100], "learning_rate": [0.5, 1.0], "base": ["stump", "logistic", "linear"]}),
    Classifier("svm", "LinearSVC", _svc, {"C": [1, 10, 100, 1000]}),
    Classifier("neural_network", "MLPClassifier", _perceptron, {"solver": ["l-bfgs", "gd"]}),
)
BY_NAME = {c.name: c for c in CLASSIFIERS}
