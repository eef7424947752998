"""The candidate pool (X4): every classifier by name, with its parameter space and a switch.

``fit_classifier`` fits one of them on clean numeric features; whatever it returns has
``transform(df, out="p")``, which adds P(label = 1) and keeps the other columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import models as M
from .neural import MLP
from .sampling import kfold
from .spaces import CLASSIFIER_SPACES
from .trees import ExtraTrees, HistogramBoosting


class MLModel:
    """A fitted pyspark.ml classifier."""

    def __init__(self, model, features):
        self.model, self.features = model, list(features)

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        scored = M.ml_probability(self.model.transform(M.assemble(df.select(*keep), self.features, "_ml_features")), out)
        return scored.select(*keep, out)


class Margin:
    """A linear margin as an expression, for calibration."""

    def __init__(self, features, coefficients, intercept):
        self.features, self.coefficients, self.intercept = list(features), [float(c) for c in coefficients], float(intercept)

    def decision(self) -> Column:
        return sum((F.lit(w) * F.col(c) for c, w in zip(self.features, self.coefficients)), F.lit(self.intercept))


def _balanced(train: DataFrame, label: str) -> tuple[DataFrame, int]:
    counts = {int(r[label]): r["count"] for r in train.groupBy(label).count().collect()}  # one row per class
    n = sum(counts.values())
    w = {k: n / (len(counts) * c) for k, c in counts.items()}
    return train.withColumn("_weight", F.when(F.col(label) == 1, F.lit(w.get(1, 1.0))).otherwise(F.lit(w.get(0, 1.0)))), n


def _ml(kind: str, balanced: bool):
    def fit(params, train, features, label, key, seed):
        params = {**params, "n_in": len(features), "seed": seed}
        if balanced:
            train, n = _balanced(train, label)
        else:
            n = train.count()
        est = M.ml_estimator(kind, params, label, "_weight" if balanced else None, n)
        est.setFeaturesCol("_ml_features")
        return MLModel(est.fit(M.assemble(train, features, "_ml_features")), features)

    return fit


def _calibrated(fit_margin):
    def fit(params, train, features, label, key, seed):
        # written, as the folds' fits and calibrations read it dozens of times: each would rank all rows again, or hold the plan of the ranking
        folds = stored(kfold(train.select(key, label, *features), key, label, k=3, seed=seed), "folds")
        return M.platt_calibrated(folds, lambda part: fit_margin(params, part, features, label), label=label, k=3)

    return fit


def _svc_margin(params, train, features, label):
    weighted, n = _balanced(train, label)
    est = M.ml_estimator("linear_svc", params, label, "_weight", n).setFeaturesCol("_ml_features")
    model = est.fit(M.assemble(weighted, features, "_ml_features"))
    return Margin(features, model.coefficients, model.intercept)


def _ridge_margin(params, train, features, label):
    return M.Ridge(features, label, alpha=params.get("alpha", 1.0)).fit(train)


def _knn(params, train, features, label, key, seed):
    return M.Neighbours(train, features, key, label, params.get("n_neighbors", 5), params.get("p", 2), params.get("weights", "uniform"), seed)


def _adaboost(params, train, features, label, key, seed):
    return M.AdaBoosted(M.adaboost(train, features, label, params.get("n_estimators", 10), params.get("learning_rate", 1.0)), features)


def _given(params: dict, *names: str) -> dict:
    return {n: params[n] for n in names if n in params}


def _extra_trees(params, train, features, label, key, seed):
    return ExtraTrees(features, label, seed=seed, **_given(params, "n_estimators", "max_depth", "max_features", "min_samples_split",
                                                           "min_samples_leaf", "min_impurity_decrease")).fit(train)


def _boosting(params, train, features, label, key, seed):
    return HistogramBoosting(features, label, seed=seed, **_given(
        params, "max_iter", "learning_rate", "max_depth", "min_samples_leaf", "l2_regularization", "max_bins", "max_leaf_nodes",
        "validation_fraction", "n_iter_no_change", "tol")).fit(train, key)


def _mlp(params, train, features, label, key, seed):
    hidden = [params.get(f"size_{i + 1}", 32) for i in range(params.get("n_layers", 1))]
    return MLP(features, label, hidden, seed=seed, **_given(params, "activation", "alpha", "learning_rate_init", "max_iter")).fit(train, key)


@dataclass(frozen=True)
class PoolEntry:
    fit: Callable
    space: dict
    enabled: bool = True


POOL: dict[str, PoolEntry] = {name: PoolEntry(fit, CLASSIFIER_SPACES[name]) for name, fit in {
    "logistic": _ml("logistic", True),
    "qda": lambda p, t, f, y, key, seed: M.QDA(f, y, reg=p.get("reg_param", 1e-4)).fit(t),
    "adaboost": _adaboost,
    "lasso": _ml("lasso", True),
    "random_forest": _ml("random_forest", True),
    "linear_svc": _calibrated(_svc_margin),
    "sgd_classifier": lambda p, t, f, y, key, seed: M.ProximalLinear(
        f, y, p.get("loss", "log_loss"), p.get("penalty", "l2"), p.get("alpha", 1e-4), max_iter=p.get("max_iter", 300)).fit(t),
    "extra_trees": _extra_trees,
    "naive_bayes": lambda p, t, f, y, key, seed: M.GaussianNB(f, y).fit(t),
    "lda": lambda p, t, f, y, key, seed: M.LDA(f, y).fit(t),
    "ridge": _calibrated(_ridge_margin),
    "gradient_boosting": _boosting,
    "mlp": _mlp,
    "knn": _knn,
}.items()}


def enabled(names: list[str] | None = None) -> list[str]:
    return [n for n, e in POOL.items() if e.enabled and (names is None or n in names)]


def fit_classifier(name: str, params: dict, train: DataFrame, features: list[str], label: str = "label", key: str = "row_id",
                   seed: int = 42):
    entry = POOL.get(name)
    if entry is None or not entry.enabled:
        raise KeyError(f"classifier {name!r} isn't in the pool; enabled: {', '.join(enabled())}")
    return entry.fit(params, train, list(features), label, key, seed)
