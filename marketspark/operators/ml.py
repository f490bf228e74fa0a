"""Model training, scoring, search and leakage experiments as Spark ML jobs.

Folds are column predicates; every fit runs over the distributed rows of its fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .splits import expanding

c = F.col
SEED = 42


def _pipeline(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), estimator])


def direction_model(features: Sequence[str], label: str = "target", kind: str = "forest", **params) -> Pipeline:
    """Three-class direction model."""
    if kind == "logistic":
        return _pipeline(features, LogisticRegression(labelCol=label, family="multinomial", **({"maxIter": 50} | params)))
    return _pipeline(features, RandomForestClassifier(labelCol=label, seed=SEED, **({"numTrees": 20, "maxDepth": 5} | params)))


#: Most rounds of a boosted model; the improvement of the validation error below which it stops.
ROUNDS, TOLERANCE = 500, 1e-3


def binary_model(features: Sequence[str], label: str = "target", **params) -> Pipeline:
    return _pipeline(features, GBTClassifier(labelCol=label, seed=SEED, **({"maxIter": ROUNDS, "maxDepth": 4} | params)))


def risk_model(features: Sequence[str], label: str = "risk_score", **params) -> Pipeline:
    return _pipeline(features, GBTRegressor(labelCol=label, seed=SEED, **({"maxIter": ROUNDS, "maxDepth": 4} | params)))


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, make, valid: Column, rounds: int = ROUNDS, tolerance: float = TOLERANCE, **params):
    """Boosting that stops when the error on the ``valid`` rows no longer falls, then a refit on all rows at that number of rounds.

    Returns the refitted model and its rounds.
    """
    marked = df.withColumn("_valid", valid)
    first = make(features, label, maxIter=rounds, validationIndicatorCol="_valid", validationTol=tolerance, **params).fit(marked)
    best = max(1, first.stages[-1].getNumTrees)
    return make(features, label, maxIter=best, **params).fit(df), best


def last_share(share: float = 0.2, keys: Sequence[str] = ("symbol",), pos: str = "pos") -> Column:
    """The latest rows of every series, as validation rows; row positions come from the rows themselves."""
    return c(pos) >= F.max(pos).over(Window.partitionBy(*keys)) * (1 - share)


def score_direction(model, df: DataFrame) -> DataFrame:
    """P_down / P_flat / P_up, class, confidence and expected return."""
    p = vector_to_array("probability")
    out = model.transform(df).withColumns({"P_down": F.coalesce(F.get(p, F.lit(0)), F.lit(0.0)), "P_flat": F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)),
                                           "P_up": F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))})
    out = out.withColumns({"predicted_class": c("prediction").cast("int"), "confidence": F.greatest("P_down", "P_flat", "P_up"), "expected_return": c("P_up") - c("P_down")})
    return out.drop("features", "rawPrediction", "probability", "prediction")


def score_binary(model, df: DataFrame) -> DataFrame:
    out = model.transform(df).withColumn("P_up", F.get(vector_to_array("probability"), F.lit(1)))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def score_risk(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("predicted_risk", F.least(F.greatest(c("prediction"), F.lit(0.0)), F.lit(1.0))).drop("features", "prediction")


def importance(model, features: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def cross_validate(df: DataFrame, features: Sequence[str], label: str, make, task: str, folds: int = 5, split=expanding, boost: Column | None = None) -> DataFrame:
    """One metric row per fold over time-ordered folds; ``boost``: validation rows inside a fold's training rows, for early stopping."""
    rows = split(df, folds)
    out = None
    for i in range(folds):
        part = rows.filter(c("fold") == i)
        train = part.filter("role = 'train'")
        model = fit_boosted(train, features, label, make, boost)[0] if boost is not None else make(features, label).fit(train)
        scored = part.filter("role = 'valid'")
        if task == "direction":
            m = stats.classification_metrics(score_direction(model, scored), label, ["P_down", "P_flat", "P_up"])
        elif task == "binary":
            m = stats.auc(score_binary(model, scored), (), "P_up", c(label) == 1)
        else:
            m = stats.regression_metrics(score_risk(model, scored), label, "predicted_risk")
        m = m.withColumn("fold", F.lit(i))
        out = m if out is None else out.unionByName(m)
    return out


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and deviation of every metric over folds."""
    names = [n for n, t in folds.dtypes if t == "double"]
    return folds.agg(*[f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def search(df: DataFrame, features: Sequence[str], label: str, make, task: str, grid: Mapping[str, Sequence], folds: int = 3, metric: str = "log_loss") -> DataFrame:
    """Mean fold metric per parameter set, best first; time-ordered folds."""
    out = None
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        m = cross_validate(df, features, label, lambda f, y, p=params: make(f, y, **p), task, folds)
        row = m.agg(F.avg(metric).alias("score")).select(*[F.lit(v).alias(k) for k, v in params.items()], "score")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("score")


def fit_twice(df: DataFrame, features: Sequence[str], label: str, make, keys: Sequence[str]) -> DataFrame:
    """Two fits with one seed, compared row by row."""
    a, b = (score_risk(fit_boosted(df, features, label, make, last_share())[0], df) for _ in range(2))
    return stats.compare_tables(a, b, keys, ["predicted_risk"])


def order_reversal(df: DataFrame, features: Sequence[str], label: str, make, share: float = 0.5, pos: str = "pos", total: str = "n") -> DataFrame:
    """Accuracy when training on the past and when training on the future; equal values hint at leakage."""
    first = c(pos) < F.floor(c(total) * share)
    out = None
    for name, train, test in (("past_to_future", first, ~first), ("future_to_past", ~first, first)):
        model = make(features, label).fit(df.filter(train))
        m = stats.classification_metrics(score_direction(model, df.filter(test)), label, ["P_down", "P_flat", "P_up"]).withColumn("scenario", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def cross_symbol(df: DataFrame, features: Sequence[str], label: str, make, train_symbol: str) -> DataFrame:
    """Train on one symbol, evaluate on every other."""
    model = make(features, label).fit(df.filter(c("symbol") == train_symbol))
    return stats.classification_metrics(score_direction(model, df.filter(c("symbol") != train_symbol)), label, ["P_down", "P_flat", "P_up"], ["symbol"])
