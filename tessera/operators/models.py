"""Classifiers.

Sufficient-statistic models (Gaussian naive Bayes, LDA, QDA, ridge) fit with ONE grouped
aggregation over the training frame and score with column expressions. The others are
``pyspark.ml`` estimators configured from a drawn parameter row (SM11); all produce a
``p`` column = P(label = 1).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bits
from ..functions.scalar import sigmoid
from .matrix import FEW, covariances


# ---------------------------------------------------------------- M8 Gaussian naive Bayes
class GaussianNB:
    """Per class prior, means and population variances; variances get + 1e-9 x the largest
    feature variance (over all rows). p = sigmoid(jll_1 - jll_0)."""

    def __init__(self, features: list[str], label: str = "label", var_smoothing: float = 1e-9):
        self.features, self.label, self.vs, self.state = list(features), label, var_smoothing, {}

    def fit(self, df: DataFrame) -> "GaussianNB":
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(self.features):
            aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
        rows = {r[self.label]: r for r in df.groupBy(self.label).agg(*aggs).collect()}  # one row per class
        n = sum(r["n"] for r in rows.values())
        overall = []  # variance of all rows from the classes' moments
        for i in range(len(self.features)):
            use = [r for r in rows.values() if r[f"m{i}"] is not None]
            mean = sum(r["n"] * r[f"m{i}"] for r in use) / n if use else 0.0
            overall.append(sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in use) / n if use else 0.0)
        eps = self.vs * max(overall, default=0.0)
        self.state = {
            int(k): {"prior": r["n"] / n, "mean": [r[f"m{i}"] for i in range(len(self.features))],
                     "var": [r[f"v{i}"] + eps for i in range(len(self.features))]}
            for k, r in rows.items()
        }
        return self

    def jll(self, k: int) -> Column:
        s = self.state[k]
        e = F.lit(math.log(s["prior"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in s["var"]))
        for c, m, v in zip(self.features, s["mean"], s["var"]):
            e = e - F.lit(0.5 / v) * (F.col(c) - F.lit(m)) * (F.col(c) - F.lit(m))
        return e

    def decision(self) -> Column:
        return self.jll(1) - self.jll(0)

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        if set(self.state) != {0, 1}:
            raise ValueError("binary Gaussian NB needs both classes in training data")
        return df.withColumn(out, sigmoid(self.decision()))


# ---------------------------------------------------------------- M9/M10/M11 (normal equations)
def class_moments(df: DataFrame, features: list[str], label: str) -> dict:
    """Per class: n, means and population covariance matrix in one grouped aggregation of
    (co)variance aggregates, whose merges stay stable where raw sums of products cancel; for many
    features the products about the means are a pass of their own."""
    p = len(features)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]
    if p <= FEW:
        aggs += [F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = df.groupBy(label).agg(*aggs).collect()
    wide = covariances(df, features, {int(r[label]): [r[f"m{i}"] for i in range(p)] for r in rows}, by=label) if p > FEW else {}
    out = {}
    for r in rows:
        cov = wide.get(int(r[label]), np.zeros((p, p)))
        for i in range(p if p <= FEW else 0):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[int(r[label])] = (r["n"], np.array([r[f"m{i}"] for i in range(p)], dtype=float), cov)
    return out


class LDA:
    """Linear discriminant: class means, pooled covariance; p = sigmoid(w.x + b) (M9)."""

    def __init__(self, features, label="label"):
        self.features, self.label, self.state = list(features), label, {}

    def fit(self, df):
        mom = class_moments(df, self.features, self.label)
        n = sum(v[0] for v in mom.values())
        mu = {k: m for k, (_, m, _) in mom.items()}
        pooled = sum(c * cov for c, _, cov in mom.values()) / (n - len(mom))
        inv = np.linalg.pinv(pooled)
        w = inv @ (mu[1] - mu[0])
        pri = {k: c / n for k, (c, _, _) in mom.items()}
        b = -0.5 * (mu[1] @ inv @ mu[1] - mu[0] @ inv @ mu[0]) + math.log(pri[1] / pri[0])
        self.state = {"w": w.tolist(), "b": float(b)}
        return self

    def decision(self):
        z = F.lit(self.state["b"])
        for c, w in zip(self.features, self.state["w"]):
            z = z + F.lit(w) * F.col(c)
        return z

    def transform(self, df, out="p"):
        return df.withColumn(out, sigmoid(self.decision()))


class QDA:
    """Quadratic discriminant with covariance (1-r) S_k + r I."""

    def __init__(self, features, label="label", reg=1e-4):
        self.features, self.label, self.reg, self.state = list(features), label, reg, {}

    def fit(self, df):
        mom = class_moments(df, self.features, self.label)
        n = sum(v[0] for v in mom.values())
        st = {}
        for k, (c, mu, cov) in mom.items():
            cov = cov * c / max(c - 1, 1)
            cov = (1 - self.reg) * cov + self.reg * np.eye(len(mu))
            sign, logdet = np.linalg.slogdet(cov)
            st[k] = {"mu": mu.tolist(), "inv": np.linalg.inv(cov).tolist(), "c": math.log(c / n) - 0.5 * logdet}
        self.state = st
        return self

    def _score(self, k):
        s = self.state[k]
        d = [F.col(c) - F.lit(m) for c, m in zip(self.features, s["mu"])]
        q = F.lit(0.0)
        for i in range(len(d)):
            for j in range(len(d)):
                q = q + F.lit(s["inv"][i][j]) * d[i] * d[j]
        return F.lit(s["c"]) - F.lit(0.5) * q

    def decision(self):
        return self._score(1) - self._score(0)

    def transform(self, df, out="p"):
        return df.withColumn(out, sigmoid(self.decision()))


class Ridge:
    """Ridge regression on a +/-1 target with balanced weights from one Gram aggregation;
    decision value passed through a sigmoid (M11, uncalibrated; M15 calibrates)."""

    def __init__(self, features, label="label", alpha=1.0):
        self.features, self.label, self.alpha, self.state = list(features), label, alpha, {}

    def fit(self, df):
        mom = class_moments(df, self.features, self.label)
        n, k = sum(c for c, _, _ in mom.values()), len(mom)
        share = n / k  # a class's balanced weight times its rows
        target = {y: 1.0 if y == 1 else -1.0 for y in mom}
        mean = sum(m for _, m, _ in mom.values()) / k
        middle = sum(target.values()) / k
        a = share * sum(cov + np.outer(m - mean, m - mean) for _, m, cov in mom.values())
        rhs = share * sum((target[y] - middle) * (m - mean) for y, (_, m, _) in mom.items())
        beta = np.linalg.solve(a + self.alpha * np.eye(len(self.features)), rhs)
        self.state = {"beta": [float(middle - mean @ beta), *beta.tolist()]}
        return self

    def decision(self):
        b = self.state["beta"]
        z = F.lit(b[0])
        for c, w in zip(self.features, b[1:]):
            z = z + F.lit(w) * F.col(c)
        return z

    def transform(self, df, out="p"):
        return df.withColumn(out, sigmoid(self.decision()))


# ---------------------------------------------------------------- pyspark.ml wrappers
def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


MOST_TREE_DEPTH = 30  # Spark's trees can't be deeper


def _depth(params: dict, default: int) -> int:
    depth = params.get("max_depth", default)
    if depth > MOST_TREE_DEPTH:
        raise ValueError(f"max_depth {depth} is above {MOST_TREE_DEPTH}")
    return depth


def _subset(params: dict) -> str:
    return {"sqrt": "sqrt", "log2": "log2", "all": "all", None: "auto"}[params.get("max_features")]


def ml_estimator(kind: str, params: dict, label: str = "label", weight: str | None = None, n_rows: int | None = None):
    """M1-M4, M12, M13 as pyspark.ml estimators from a drawn parameter dict; every parameter that
    Spark has is passed through. M12 stops early where ``validation`` names an indicator column.
    (Spark's boosting has no leaf regularisation, its perceptron logistic units and no L2.)"""
    common = dict(featuresCol="features", labelCol=label)
    if kind in ("logistic", "lasso"):
        reg = 1.0 / (params.get("C", 1.0) * max(n_rows or 1, 1))
        est = LogisticRegression(regParam=reg, elasticNetParam=1.0 if kind == "lasso" else 0.0, tol=params.get("tol", 1e-3),
                                 maxIter=params.get("max_iter", 1000), **common)
    elif kind == "random_forest":
        est = RandomForestClassifier(numTrees=params.get("n_estimators", 20), maxDepth=_depth(params, 5),
                                     minInstancesPerNode=max(1, params.get("min_samples_leaf", 1)),
                                     featureSubsetStrategy=_subset(params), seed=params.get("seed", 42), **common)
    elif kind == "linear_svc":
        est = LinearSVC(regParam=1.0 / (params.get("C", 1.0) * max(n_rows or 1, 1)), tol=params.get("tol", 1e-3),
                        maxIter=params.get("max_iter", 50000), **common)
    elif kind == "gradient_boosting":
        extra = {"validationIndicatorCol": params["validation"]} if params.get("validation") else {}
        est = GBTClassifier(maxIter=params.get("max_iter", 10), maxDepth=_depth(params, 3), stepSize=params.get("learning_rate", 0.1),
                            minInstancesPerNode=max(1, params.get("min_samples_leaf", 1)), maxBins=params.get("max_bins", 32),
                            seed=params.get("seed", 42), **extra, **common)
    elif kind == "mlp":
        sizes = [params.get(f"size_{i + 1}", 32) for i in range(params.get("n_layers", 1))]
        est = MultilayerPerceptronClassifier(layers=[params["n_in"], *sizes, 2], maxIter=params.get("max_iter", 100),
                                             stepSize=params.get("learning_rate_init", 0.03), seed=params.get("seed", 42), **common)
    else:
        raise ValueError(f"no pyspark.ml form for {kind}")
    if weight and kind != "mlp":
        est.setWeightCol(weight)
    return est


class ProximalLinear:
    """M5: linear model by proximal Newton steps on the log or the modified Huber loss with an L2,
    L1 or elastic-net penalty ``alpha`` (on the mean loss). Each step is one aggregation of the
    gradient and Hessian sums; the penalised quadratic model is solved by coordinate descent on
    the driver (p x p numbers). Class weights are balanced."""

    def __init__(self, features, label="label", loss="log_loss", penalty="l2", alpha=1e-4, l1_ratio=0.15, max_iter=300,
                 tol=1e-5):
        if loss not in ("log_loss", "modified_huber") or penalty not in ("l2", "l1", "elasticnet"):
            raise ValueError(f"unknown loss {loss} or penalty {penalty}")
        self.features, self.label, self.loss, self.max_iter, self.tol = list(features), label, loss, max_iter, tol
        mix = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty]
        self.l1, self.l2, self.state = alpha * mix, alpha * (1 - mix), {}

    def _sums(self, df, beta, weights):
        cols = [F.lit(1.0)] + [F.col(c).cast("double") for c in self.features]
        y = F.when(F.col(self.label) == 1, 1.0).otherwise(-1.0)
        w = F.when(F.col(self.label) == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0))
        z = y * sum((F.lit(float(b)) * c for b, c in zip(beta, cols)), F.lit(0.0))
        if self.loss == "log_loss":
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(z))
            loss, g, h = F.when(z > 0, F.log1p(F.exp(-z))).otherwise(-z + F.log1p(F.exp(z))), -y * p, p * (F.lit(1.0) - p)
        else:
            gap = F.greatest(F.lit(0.0), F.lit(1.0) - z)
            loss = F.when(z >= -1, gap * gap).otherwise(F.lit(-4.0) * z)
            g = y * F.when(z >= -1, F.lit(-2.0) * gap).otherwise(F.lit(-4.0))
            h = F.when((z >= -1) & (z < 1), F.lit(2.0)).otherwise(F.lit(0.0))
        d = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], (w * loss).alias("l"), (w * g).alias("g"), (w * h).alias("h"), w.alias("w"))
        p = len(cols)
        aggs = [F.sum("w").alias("w"), F.sum("l").alias("l")] + [F.sum(F.col("g") * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)]
        aggs += [F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        r = d.agg(*aggs).first()
        grad = np.array([r[f"g{i}"] for i in range(p)]) / r["w"]
        hess = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                hess[i, j] = hess[j, i] = r[f"h{i}_{j}"] / r["w"]
        return r["l"] / r["w"], grad, hess

    def _penalty(self, beta):
        return self.l1 * np.abs(beta[1:]).sum() + 0.5 * self.l2 * (beta[1:] ** 2).sum()

    def fit(self, df):
        counts = {int(r[self.label]): r["count"] for r in df.groupBy(self.label).count().collect()}
        n = sum(counts.values())
        weights = {k: n / (len(counts) * c) for k, c in counts.items()}
        beta = np.zeros(len(self.features) + 1)
        loss, grad, hess = self._sums(df, beta, weights)
        for _ in range(self.max_iter):
            total = loss + self._penalty(beta)
            goal = self._solve(beta, grad, hess + 1e-8 * np.eye(len(beta)))
            step, size = goal - beta, 1.0
            while True:  # a Newton step may overshoot: halve it until the objective falls
                after = self._sums(df, beta + size * step, weights)
                if after[0] + self._penalty(beta + size * step) <= total + 1e-12 or size < 1e-4:
                    break
                size /= 2
            beta, (loss, grad, hess) = beta + size * step, after
            if total - (loss + self._penalty(beta)) < self.tol * max(1.0, abs(total)):
                break
        self.state = {"beta": beta.tolist(), "objective": float(loss + self._penalty(beta)), "loss": self.loss}
        return self

    def _solve(self, beta, grad, hess):
        """Minimiser of the quadratic model around ``beta`` with the penalty."""
        x = beta.copy()
        for _ in range(500):
            moved = 0.0
            for i in range(len(x)):
                g = grad[i] + hess[i] @ (x - beta)
                a = hess[i, i] + (self.l2 if i else 0.0)
                raw = x[i] * hess[i, i] - g
                new = np.sign(raw) * max(abs(raw) - (self.l1 if i else 0.0), 0.0) / a
                moved = max(moved, abs(new - x[i]))
                x[i] = new
            if moved < 1e-10:
                break
        return x

    def decision(self):
        b = self.state["beta"]
        return sum((F.lit(w) * F.col(c) for c, w in zip(self.features, b[1:])), F.lit(b[0]))

    def transform(self, df, out="p"):
        z = self.decision()
        if self.state["loss"] == "modified_huber":
            return df.withColumn(out, (F.least(F.lit(1.0), F.greatest(F.lit(-1.0), z)) + F.lit(1.0)) / F.lit(2.0))
        return df.withColumn(out, sigmoid(z))


def ml_probability(df: DataFrame, out: str = "p") -> DataFrame:
    """P(class 1) from the ML ``probability`` vector (or a sigmoid of the raw margin)."""
    if "probability" in df.columns:
        return df.withColumn(out, vector_to_array("probability")[1])
    return df.withColumn(out, sigmoid(vector_to_array("rawPrediction")[1]))


# ---------------------------------------------------------------- M14 exact kNN
#: Cells of the distance matrix that a task holds at a time (8 MB of doubles).
TILE_CELLS = 1 << 20


def knn_top(q: np.ndarray, x: np.ndarray, keys: np.ndarray, k: int, p_norm: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, train rows) of the k nearest of each query, ties to the smaller key, computed
    in tiles of at most TILE_CELLS cells."""
    k = min(k, len(x))
    dist, near = np.empty((len(q), k)), np.empty((len(q), k), np.int64)
    rows = max(1, TILE_CELLS // max(len(x), 1))
    for at in range(0, len(q), rows):
        part = q[at:at + rows]
        d = np.zeros((len(part), len(x)))
        for f in range(x.shape[1]):
            gap = part[:, f, None] - x[None, :, f]
            d += np.abs(gap) if p_norm == 1 else gap * gap
        if p_norm != 1:
            np.sqrt(d, out=d)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        for i in range(len(part)):
            close = np.flatnonzero(d[i] <= kth[i])
            best = close[np.lexsort((keys[close], d[i, close]))[:k]]
            dist[at + i], near[at + i] = d[i, best], best
    return dist, near


def knn_predict(spark, train: DataFrame, query: DataFrame, features: list[str], key: str = "row_id",
                label: str = "label", k: int = 5, p_norm: int = 2, weights: str = "uniform",
                max_train_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """Exact k-nearest-neighbour probability for every query row against the train rows, or
    against the ``max_train_rows`` of them with the smallest hash: that documented bound of the
    fitted sample is the bound of what is broadcast. One pass over the queries; every task works
    in tiles of fixed size, and the result equals brute force (ties to the smaller train key)."""
    rows = train.select(key, label, *features).withColumn("_h", hash_bits(seed, "knn", key)).orderBy("_h", key).limit(max_train_rows)
    fitted = rows.toPandas()
    model = spark.sparkContext.broadcast((fitted[features].to_numpy(dtype=float), fitted[key].to_numpy(),
                                          fitted[label].to_numpy(dtype=float)))

    def run(batches):
        import pandas as pd

        x, keys, y = model.value
        for pdf in batches:
            if len(pdf) == 0 or len(x) == 0:
                continue
            dist, near = knn_top(pdf[features].to_numpy(dtype=float), x, keys, k, p_norm)
            w = 1.0 / np.maximum(dist, 1e-12) if weights == "distance" else np.ones_like(dist)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "p": (w * y[near]).sum(1) / w.sum(1)})

    return query.select(key, *features).mapInPandas(run, f"{key} long, p double")


# ---------------------------------------------------------------- M7 AdaBoost (SAMME, stumps)
def adaboost(train: DataFrame, features: list[str], label: str = "label", rounds: int = 5, learning_rate: float = 1.0,
             checkpoint_every: int = 10):
    """SAMME on depth-1 trees: each round fits a weighted stump (pyspark.ml), takes its weighted
    error in one aggregation and updates the weight column, which is kept while the next round
    reads it; the sum of weights follows from the error. Lineage is cut with ``checkpoint()``
    every ``checkpoint_every`` rounds. Stops at a perfect or useless stump, as SAMME does.
    Returns [(alpha, stump_model)]."""
    from pyspark import StorageLevel
    from pyspark.ml.classification import DecisionTreeClassifier

    d = assemble(train, features)
    n = d.count()
    d = d.withColumn("_w", F.lit(1.0 / n)).persist(StorageLevel.MEMORY_AND_DISK)
    models = []
    for r in range(rounds):
        stump = DecisionTreeClassifier(maxDepth=1, labelCol=label, featuresCol="features", weightCol="_w",
                                       predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw").fit(d)
        scored = stump.transform(d)
        miss = (F.col("_pred") != F.col(label).cast("double")).cast("double")
        err = scored.agg((F.sum(F.col("_w") * miss) / F.sum("_w")).alias("e")).first()["e"]
        if err >= 0.5 and models:
            break
        held = min(max(err, 1e-10), 1 - 1e-10)
        alpha = learning_rate * math.log((1 - held) / held)  # SAMME with 2 classes
        models.append((alpha, stump))
        if err <= 0 or err >= 0.5 or r == rounds - 1:
            break
        total = (1 - err) + err * math.exp(alpha)
        after = (scored.withColumn("_w", F.col("_w") * F.exp(F.lit(alpha) * miss) / F.lit(total)).drop("_pred", "_prob", "_raw"))
        after = after.checkpoint() if (r + 1) % checkpoint_every == 0 else after.persist(StorageLevel.MEMORY_AND_DISK)
        after.count()
        d.unpersist()
        d = after
    d.unpersist()
    return models


def adaboost_predict(df: DataFrame, models, features: list[str], out: str = "p") -> DataFrame:
    """Probability of class 1: the logistic of twice the stumps' vote, weighted and divided by the
    sum of weights (a vote between -1 and 1)."""
    d = assemble(df, features)
    score = F.lit(0.0)
    for i, (alpha, m) in enumerate(models):
        d = m.setPredictionCol(f"_p{i}").setProbabilityCol(f"_pb{i}").setRawPredictionCol(f"_r{i}").transform(d)
        score = score + F.lit(alpha) * (F.lit(2.0) * F.col(f"_p{i}") - F.lit(1.0))
    weights = sum(alpha for alpha, _ in models)
    return d.withColumn(out, sigmoid(score * F.lit(2.0 / weights if weights else 0.0)))


# ---------------------------------------------------------------- M15 Platt calibration
def platt_calibrated(train: DataFrame, score_fn, fold_col: str = "fold", label: str = "label", k: int = 3):
    """Sigmoid calibration over k folds: for each fold fit the base model on the other
    folds (``score_fn(train_part) -> fitted model with .decision()``), fit a 1-D logistic
    on its margin over the held-out fold; the calibrated probability is the average of
    the k calibrated models."""
    parts = []
    for f in range(k):
        fitted = score_fn(train.filter(F.col(fold_col) != f))
        hold = train.filter(F.col(fold_col) == f).withColumn("_m", fitted.decision())
        lr = LogisticRegression(featuresCol="_mv", labelCol=label, regParam=0.0, maxIter=100)
        cal = lr.fit(VectorAssembler(inputCols=["_m"], outputCol="_mv").transform(hold))
        parts.append((fitted, float(cal.coefficients[0]), float(cal.intercept)))

    return Calibrated(parts)


class Calibrated:
    """The mean of calibrated margins: parts of (fitted model with ``decision``, slope, offset)."""

    def __init__(self, parts):
        self.parts = [tuple(p) for p in parts]

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        total = sum((sigmoid(F.lit(a) * fitted.decision() + F.lit(b)) for fitted, a, b in self.parts), F.lit(0.0))
        return df.withColumn(out, total / F.lit(float(len(self.parts))))


class AdaBoosted:
    """Fitted stumps with their weights."""

    def __init__(self, models, features):
        self.models, self.features = [tuple(m) for m in models], list(features)

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        return adaboost_predict(df.select(*keep), self.models, self.features, out).select(*keep, out)


class Neighbours:
    """M14 as a model: holds the train rows that ``knn_predict`` may read, at most its bound."""

    def __init__(self, rows: DataFrame, features, key: str, label: str, k: int, p_norm: int, weights: str, seed: int, max_train_rows: int = 20_000):
        self.rows = rows.select(key, label, *features).withColumn("_h", hash_bits(seed, "knn", key)).orderBy("_h", key).limit(max_train_rows).drop("_h")
        self.features, self.key, self.label, self.k, self.p_norm, self.weights, self.seed = list(features), key, label, k, p_norm, weights, seed

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        p = knn_predict(df.sparkSession, self.rows, df, self.features, self.key, self.label, self.k, self.p_norm, self.weights, seed=self.seed)
        return df.select(*keep).join(p.withColumnRenamed("p", out), self.key)
