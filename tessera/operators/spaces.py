"""Hyper-parameter spaces (SM11, X3): declarative draws of hash-uniforms.

A space maps a parameter to a constant or a draw. Every draw has the same three forms: a
Python value (driver decisions), a Spark column (candidate tables) and SQL text (oracles),
all from one uniform of (seed, ``<owner>.<parameter>``, key). A draw may depend on parameters
drawn before it (``when``) and on the number of features (``upto_features``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, py_uniform, sql_uniform


@dataclass(frozen=True)
class Draw:
    """``kind``: choice of ``values``; uniform, int (upper end left out), log10 or logint (the
    whole part of 10^x) between ``lo`` and ``hi``."""

    kind: str
    lo: float = 0.0
    hi: float = 1.0
    values: tuple = ()
    when: tuple | None = None  # (parameter, values it must have)
    upto_features: bool = False  # the upper end is the number of features, held to hi if hi > 0

    def top(self, n_features: int | None) -> float:
        if not self.upto_features:
            return self.hi
        n = n_features or 2
        return max(2, min(n, int(self.hi)) if self.hi > 0 else n)

    def value(self, u: float, n_features: int | None = None):
        if self.kind == "choice":
            return self.values[int(u * len(self.values))]
        x = self.lo + (self.top(n_features) - self.lo) * u
        return {"uniform": lambda: x, "int": lambda: int(x), "log10": lambda: 10.0**x, "logint": lambda: int(10.0**x)}[self.kind]()

    def column(self, u: Column) -> Column:
        if self.kind == "choice":
            return F.element_at(F.array(*[F.lit(v) for v in self.values]), (F.floor(u * len(self.values)) + 1).cast("int"))
        x = F.lit(float(self.lo)) + F.lit(float(self.hi - self.lo)) * u
        return {"uniform": x, "int": F.floor(x), "log10": F.pow(F.lit(10.0), x), "logint": F.floor(F.pow(F.lit(10.0), x))}[self.kind]

    def sql(self, u: str) -> str:
        if self.kind == "choice":
            items = ", ".join(f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in self.values)
            return f"list_extract([{items}], CAST(floor({u} * {len(self.values)}) AS INTEGER) + 1)"
        x = f"({float(self.lo)}::DOUBLE + {float(self.hi - self.lo)}::DOUBLE * {u})"
        return {"uniform": x, "int": f"floor({x})", "log10": f"pow(10.0::DOUBLE, {x})", "logint": f"floor(pow(10.0::DOUBLE, {x}))"}[self.kind]


def choice(*values, when=None):
    return Draw("choice", values=values, when=when)


def uniform(lo, hi):
    return Draw("uniform", lo, hi)


def integer(lo, hi, when=None):
    return Draw("int", lo, hi, when=when)


def log10(lo, hi, when=None):
    return Draw("log10", lo, hi, when=when)


def log_integer(lo, hi, when=None):
    return Draw("logint", lo, hi, when=when)


def features(most=0):
    return Draw("int", 1, most, upto_features=True)


# The candidate models, in the order of the draw, with their ranges.
CLASSIFIER_SPACES: dict[str, dict] = {
    "logistic": {"solver": choice("lbfgs", "newton-cg", "sag"), "max_iter": 1000, "tol": 1e-3},
    "qda": {"reg_param": log10(-4, 0)},
    "adaboost": {"n_estimators": integer(2, 50), "learning_rate": log10(-1.0, 0.5)},
    "lasso": {"C": log10(-1, 1), "solver": choice("liblinear", "saga"), "max_iter": choice(100, 200, 300), "tol": 1e-3},
    "random_forest": {"n_estimators": log_integer(1.0, 2.0), "max_depth": integer(2, 20), "min_samples_split": log_integer(0.3, 1.3),
                      "min_samples_leaf": log_integer(0, 1), "max_features": choice("sqrt", "log2", "all")},
    "linear_svc": {"C": log10(-1, 1), "max_iter": 50000, "tol": 1e-3},
    "sgd_classifier": {"loss": choice("log_loss", "modified_huber"), "penalty": choice("l2", "l1", "elasticnet"), "alpha": log10(-5, -1),
                       "learning_rate": choice("optimal", "adaptive", "constant"), "eta0": log10(-4, -1), "max_iter": choice(300, 500, 800)},
    "extra_trees": {"n_estimators": integer(2, 20), "max_depth": integer(2, 10), "min_samples_split": log_integer(0.7, 1.5),
                    "min_samples_leaf": log_integer(0.5, 1.3), "max_features": choice("sqrt", "log2"), "min_impurity_decrease": 1e-7},
    "naive_bayes": {},
    "lda": {},
    "ridge": {"alpha": log10(-2, 2), "solver": choice("auto", "cholesky", "lsqr"), "tol": 1e-3},
    "gradient_boosting": {"max_iter": integer(2, 10), "learning_rate": log10(-2.0, 0), "max_depth": integer(2, 10),
                          "l2_regularization": log10(-4, 1), "min_samples_leaf": log_integer(1, 2), "max_bins": choice(32, 64, 128, 255)},
    "mlp": {"n_layers": integer(1, 4), "size_1": log_integer(1.3, 2.3), "size_2": log_integer(1.3, 2.3, when=("n_layers", (2, 3))),
            "size_3": log_integer(1.3, 2.3, when=("n_layers", (3,))), "alpha": log10(-5, -1), "learning_rate_init": log10(-4, -2),
            "activation": choice("relu", "tanh", "logistic"), "max_iter": choice(100, 150, 200)},
    "knn": {"n_neighbors": integer(3, 10), "weights": choice("uniform", "distance"), "p": choice(1, 2), "leaf_size": log_integer(1, 2)},
}

# The feature operators of a pipeline and their ranges.
TRANSFORMER_SPACES: dict[str, dict] = {
    "ratio": {"n_features": integer(5, 31)}, "product": {"n_features": integer(5, 31)},
    "difference": {"n_features": integer(5, 31)}, "sum": {"n_features": integer(5, 31)},
    "reciprocal": {}, "square": {}, "sqrt": {}, "log": {},
    "binning": {"n_bins": integer(3, 8), "strategy": choice("quantile", "uniform")},
    "kde": {"bandwidth": choice("scott", "silverman")},
    "kmeans": {"n_clusters": integer(3, 11), "add_distances": choice(True, False)},
    "nystroem": {"kernel": choice("rbf", "poly", "sigmoid", "cosine"), "n_components": features(),
                 "gamma": log10(-3, 0, when=("kernel", ("rbf", "poly", "sigmoid"))), "degree": integer(2, 5, when=("kernel", ("poly",)))},
    "rbf_sampler": {"n_components": features(), "gamma": log10(-3, 0)},
    "power_transform": {"standardize": choice(True, False)},
    "quantile_transform": {"n_quantiles": choice(100, 500, 1000), "output": choice("uniform", "normal")},
    "noise_injector": {"feature_fraction": uniform(0.0, 1.0), "scale_lo": uniform(0.001, 0.05), "scale_hi": uniform(0.05, 0.3)},
}

# The reductions of a pipeline and their ranges.
REDUCTION_SPACES: dict[str, dict] = {
    "pca": {"n_components": choice(0.80, 0.85, 0.90, 0.95, 0.99)},
    "truncated_svd": {"n_components": features(15)},
    "fast_ica": {"n_components": features(15), "max_iter": integer(200, 501)},
    "factor_analysis": {"n_components": features(15), "max_iter": 1000, "tol": 0.01},
}


def draw(space: dict, seed, owner: str, key, n_features: int | None = None) -> dict:
    """One parameter set; a parameter whose condition doesn't hold is left out."""
    out: dict = {}
    for name, d in space.items():
        if not isinstance(d, Draw):
            out[name] = d
        elif d.when is None or out.get(d.when[0]) in d.when[1]:
            out[name] = d.value(py_uniform(seed, f"{owner}.{name}", key), n_features)
    return out


def draw_rows(space: dict, seed, owner: str, key: str) -> list[tuple[str, Column, Column, Column]]:
    """(parameter, holds, number or null, text or null) of every drawn parameter as columns."""
    out, columns = [], {}
    for name, d in space.items():
        if not isinstance(d, Draw):
            continue
        c = columns[name] = d.column(hash_uniform(seed, f"{owner}.{name}", key))
        holds = F.lit(True) if d.when is None else columns[d.when[0]].isin(*d.when[1])
        text = d.kind == "choice" and isinstance(d.values[0], str)
        out.append((name, holds, F.lit(None).cast("double") if text else c.cast("double"), c if text else F.lit(None).cast("string")))
    return out


def draw_rows_sql(space: dict, seed, owner: str, key: str) -> list[tuple[str, str, str, str]]:
    """SQL twins of ``draw_rows``."""
    out, exprs = [], {}
    for name, d in space.items():
        if not isinstance(d, Draw):
            continue
        e = exprs[name] = d.sql(sql_uniform(seed, f"{owner}.{name}", key))
        holds = "TRUE" if d.when is None else f"({exprs[d.when[0]]}) IN ({', '.join(map(repr, d.when[1]))})"
        text = d.kind == "choice" and isinstance(d.values[0], str)
        out.append((name, holds, "NULL" if text else f"CAST({e} AS DOUBLE)", e if text else "NULL"))
    return out
