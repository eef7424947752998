"""Matrix and kernel feature operators (FE19-FE21, FE30-FE37).

Every fit reduces the data to O(p^2) sufficient statistics in one distributed
aggregation (covariances, second moments, likelihood sums over a lambda grid, quantile
knots, value counts) and solves the small problem on the driver; every transform is a
set of column expressions with the fitted numbers as literals. No fit ships rows to the
driver or to one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bits, py_uniform
from ..session import ship_package, stored
from .stats import exact_quantiles


#: Columns up to which pairs are aggregates of their own; their number grows with the square of the columns'.
FEW = 8


def products(df: DataFrame, cols: list[str], shifts: dict, by: str | None = None) -> dict:
    """{group: (rows, sums, products)} of all pairs of columns, from one pass: tasks multiply their rows' values
    less the group's ``shifts`` and add up. Pair (i, j) has the rows where both have a value: their number, the
    sum of i over them, the sum of i times j. ``by`` names the column of the groups, the keys of ``shifts``."""
    ship_package(df.sparkSession)
    p, groups = len(cols), list(shifts)
    centre = [np.array(shifts[g], dtype=float) for g in groups]

    def run(batches):
        total = np.zeros((len(groups), 3, p, p))
        for batch in batches:
            x_all = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
            there = np.column_stack([batch.column(i).is_valid().to_numpy(zero_copy_only=False) for i in range(p)])
            own = batch.column(p).to_numpy(zero_copy_only=False)
            for g in range(len(groups)):
                rows = own == g
                m = there[rows].astype(float)
                x = np.where(there[rows], x_all[rows] - centre[g], 0.0)
                total[g, 0] += m.T @ m
                total[g, 1] += x.T @ m
                total[g, 2] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    place = F.lit(0)
    if by:
        place = F.coalesce(*[F.when(F.col(by) == F.lit(g), F.lit(i)) for i, g in enumerate(groups)], F.lit(-1))
    got = np.zeros((len(groups), 3, p, p))
    sums = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], place.alias("g")).mapInArrow(run, "i long, x double")
    for r in sums.groupBy("i").agg(F.sum("x").alias("x")).collect():  # groups x columns x columns
        got.flat[r["i"]] = r["x"]
    return {g: tuple(got[k]) for k, g in enumerate(groups)}


def covariances(df: DataFrame, cols: list[str], means: dict, by: str | None = None, sample: bool = False) -> dict:
    """{group: covariance matrix} about the groups' ``means``, which one aggregation gave before."""
    shifts = {g: [v if v is not None and math.isfinite(v) else 0.0 for v in m] for g, m in means.items()}
    out = {}
    for g, (n, s, x) in products(df, cols, shifts, by).items():
        with np.errstate(divide="ignore", invalid="ignore"):
            out[g] = (x - s * s.T / n) / (n - 1 if sample else n)
    return out


def covariance(df: DataFrame, cols: list[str], sample: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector and covariance matrix: one aggregation of (co)variance aggregates (numerically
    stable merges, no raw sums of squares), or means and then products about them for many columns."""
    p = len(cols)
    cov = F.covar_samp if sample else F.covar_pop
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    if p <= FEW:
        aggs += [cov(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    r = df.agg(*aggs).first()
    m = np.array([r[f"m{i}"] for i in range(p)])
    if p > FEW:
        return m, covariances(df, cols, {0: m.tolist()}, sample=sample)[0], r["n"]
    c = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
    return m, c, r["n"]


def second_moment(df: DataFrame, cols: list[str]) -> np.ndarray:
    p = len(cols)
    if p > FEW:
        n, _, x = products(df, cols, {0: [0.0] * p})[0]
        return np.where(n > 0, x, np.nan)
    r = df.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = r[f"s{i}_{j}"]
    return g


def _sign_fix(vecs: np.ndarray) -> np.ndarray:
    """Deterministic signs: the largest-|.| loading of every component is positive."""
    out = vecs.copy()
    for k in range(out.shape[1]):
        j = int(np.argmax(np.abs(out[:, k])))
        if out[j, k] < 0:
            out[:, k] = -out[:, k]
    return out


def _project(cols, center, vecs, scale=None, prefix="pc") -> dict[str, Column]:
    exprs = {}
    for k in range(vecs.shape[1]):
        e = F.lit(0.0)
        for j, c in enumerate(cols):
            e = e + F.lit(float(vecs[j, k])) * (F.col(c) - F.lit(float(center[j])))
        if scale is not None:
            e = e / F.lit(float(scale[k]))
        exprs[f"{prefix}{k}"] = e
    return exprs


class PCA:
    """FE30: centred PCA on the sample covariance; ``n_components`` int, or a float in
    (0, 1) = smallest k whose cumulative explained-variance ratio reaches it; optional
    whitening."""

    def __init__(self, inputs, n_components=2, whiten=False):
        self.inputs, self.k, self.whiten, self.state = list(inputs), n_components, whiten, {}

    def fit(self, df):
        m, c, _ = covariance(df, self.inputs)
        vals, vecs = np.linalg.eigh(c)
        order = np.argsort(vals)[::-1]
        vals, vecs = np.clip(vals[order], 0, None), _sign_fix(vecs[:, order])
        ratio = vals / vals.sum() if vals.sum() > 0 else vals
        k = self.k if isinstance(self.k, int) else int(np.searchsorted(np.cumsum(ratio), self.k - 1e-12) + 1)
        k = max(1, min(k, len(vals)))
        self.state = {"mean": m.tolist(), "vecs": vecs[:, :k].tolist(), "var": vals[:k].tolist(),
                      "ratio": ratio[:k].tolist()}
        return self

    def outputs(self):
        return [f"pc{k}" for k in range(len(self.state["var"]))]

    def transform(self, df):
        scale = np.sqrt(self.state["var"]) if self.whiten else None
        return df.withColumns(_project(self.inputs, np.array(self.state["mean"]), np.array(self.state["vecs"]), scale))


class TruncatedSVD:
    """FE31: no centring; right singular vectors from the eigenvectors of X^T X."""

    def __init__(self, inputs, n_components=2):
        self.inputs, self.k, self.state = list(inputs), n_components, {}

    def fit(self, df):
        g = second_moment(df, self.inputs)
        vals, vecs = np.linalg.eigh(g)
        order = np.argsort(vals)[::-1][: self.k]
        self.state = {"singular": np.sqrt(np.clip(vals[order], 0, None)).tolist(),
                      "vecs": _sign_fix(vecs[:, order]).tolist()}
        return self

    def outputs(self):
        return [f"svd{k}" for k in range(len(self.state["singular"]))]

    def transform(self, df):
        return df.withColumns(_project(self.inputs, np.zeros(len(self.inputs)), np.array(self.state["vecs"]), prefix="svd"))


# ---------------------------------------------------------------- FE35 random Fourier features
def _normal(seed, salt, *k):
    u1 = max(py_uniform(seed, salt, *k, "a"), 1e-300)
    u2 = py_uniform(seed, salt, *k, "b")
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2 * math.pi * u2)


class RBFSampler:
    """FE35: z_k = sqrt(2/m) cos(w_k . x + b_k), w ~ N(0, 2 gamma), b ~ U(0, 2 pi), drawn on
    the driver from the seed."""

    def __init__(self, inputs, n_components=8, gamma=0.5, seed=42):
        self.inputs, self.m, self.gamma, self.seed = list(inputs), n_components, gamma, seed
        sd = math.sqrt(2.0 * gamma)
        self.state = {"w": [[sd * _normal(seed, "rbf_w", k, j) for j in range(len(self.inputs))] for k in range(self.m)],
                      "b": [2 * math.pi * py_uniform(seed, "rbf_b", k) for k in range(self.m)]}

    def fit(self, df):
        return self

    def outputs(self):
        return [f"rff{k}" for k in range(self.m)]

    def transform(self, df):
        exprs = {}
        for k in range(self.m):
            z = F.lit(self.state["b"][k])
            for j, c in enumerate(self.inputs):
                z = z + F.lit(self.state["w"][k][j]) * F.col(c)
            exprs[f"rff{k}"] = F.lit(math.sqrt(2.0 / self.m)) * F.cos(z)
        return df.withColumns(exprs)


# ---------------------------------------------------------------- FE34 Nystroem
def kernel_expr(kind: str, cols: list[str], landmark: list[float], gamma: float = 0.5, degree: int = 3,
                coef0: float = 1.0) -> Column:
    dot = sum((F.col(c) * F.lit(float(v)) for c, v in zip(cols, landmark)), F.lit(0.0))
    if kind == "rbf":
        d2 = sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(cols, landmark)), F.lit(0.0))
        return F.exp(F.lit(-gamma) * d2)
    if kind == "poly":
        return F.pow(F.lit(gamma) * dot + F.lit(coef0), F.lit(float(degree)))
    if kind == "sigmoid":
        return F.tanh(F.lit(gamma) * dot + F.lit(coef0))
    if kind == "cosine":
        nx = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
        nl = math.sqrt(sum(v * v for v in landmark))
        return F.try_divide(dot, nx * F.lit(nl))
    raise ValueError(kind)


def _kernel_np(kind, a, b, gamma=0.5, degree=3, coef0=1.0):
    if kind == "rbf":
        return np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    dot = a @ b.T
    if kind == "poly":
        return (gamma * dot + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    return dot / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))


class Nystroem:
    """FE34: m landmarks = the rows with the smallest hash (exact, partition-independent);
    features = K(x, landmarks) @ K_mm^(-1/2) (pseudo-inverse square root)."""

    def __init__(self, inputs, key, n_components=5, kernel="rbf", gamma=0.5, seed=42, degree=3):
        self.inputs, self.key, self.m, self.kernel, self.gamma, self.seed = list(inputs), key, n_components, kernel, gamma, seed
        self.degree = degree
        self.state = {}

    def fit(self, df):
        lm = (df.select(self.key, *self.inputs).withColumn("_h", hash_bits(self.seed, "landmark", self.key))
              .orderBy("_h", self.key).limit(self.m).collect())  # m rows (top-k, not a global sort)
        L = np.array([[r[c] for c in self.inputs] for r in lm], dtype=float)
        K = _kernel_np(self.kernel, L, L, self.gamma, self.degree)
        vals, vecs = np.linalg.eigh(K)
        inv_sqrt = vecs @ np.diag([1 / math.sqrt(v) if v > 1e-12 else 0.0 for v in vals]) @ vecs.T
        self.state = {"landmarks": L.tolist(), "keys": [r[self.key] for r in lm], "norm": inv_sqrt.tolist()}
        return self

    def kernel_columns(self, df):
        return df.withColumns({f"k{j}": kernel_expr(self.kernel, self.inputs, lm, self.gamma, self.degree)
                               for j, lm in enumerate(self.state["landmarks"])})

    def outputs(self):
        return [f"ny{i}" for i in range(len(self.state["landmarks"]))]

    def transform(self, df):
        d = self.kernel_columns(df)
        norm = np.array(self.state["norm"])
        m = len(self.state["landmarks"])
        exprs = {f"ny{i}": sum((F.col(f"k{j}") * F.lit(float(norm[j, i])) for j in range(m)), F.lit(0.0)) for i in range(m)}
        return d.withColumns(exprs).drop(*[f"k{j}" for j in range(m)])


# ---------------------------------------------------------------- FE36 Yeo-Johnson
def yeo_johnson(x: Column, lam: float) -> Column:
    pos = x >= 0
    if abs(lam) < 1e-12:
        a = F.log1p(x)
    else:
        a = (F.pow(x + F.lit(1.0), F.lit(lam)) - F.lit(1.0)) / F.lit(lam)
    if abs(lam - 2.0) < 1e-12:
        b = -F.log1p(-x)
    else:
        b = -(F.pow(F.lit(1.0) - x, F.lit(2.0 - lam)) - F.lit(1.0)) / F.lit(2.0 - lam)
    return F.when(pos, a).otherwise(b)


def yj_grid(start: float, stop: float, step: float) -> list[float]:
    n = int(round((stop - start) / step))
    return [round(start + i * step, 10) for i in range(n + 1)]


class PowerTransformer:
    """FE36: per column, the Yeo-Johnson lambda on the 0.01 grid that maximises the profile
    log-likelihood -n/2 ln(var_pop(y)) + (lambda-1) sum(sign(x) ln(|x|+1)); optional
    standardisation of the output. The likelihood is unimodal in lambda: a bracket of a few
    lambdas per column and pass (plain aggregates over the rows, nothing exploded) widens while
    its best lies on an edge, then narrows from step to step."""

    STEPS = (1.0, 0.2, 0.05, 0.01)

    def __init__(self, inputs, standardize=True, start=(-2.0, 2.0), most_widenings=12):
        self.inputs, self.standardize, self.start, self.most_widenings, self.state = list(inputs), standardize, start, most_widenings, {}

    def _likelihoods(self, df, grids: dict) -> dict:
        """{column: {lambda: log-likelihood}} of new lambdas in one aggregation."""
        aggs = []
        for i, c in enumerate(self.inputs):
            aggs += [F.count(c).alias(f"n{i}"), F.sum(F.signum(c) * F.log1p(F.abs(c))).alias(f"j{i}")]
            aggs += [F.var_pop(yeo_johnson(F.col(c), lam)).alias(f"v{i}_{g}") for g, lam in enumerate(grids[c])]
        r = df.agg(*aggs).first()
        out = {}
        for i, c in enumerate(self.inputs):
            out[c] = {lam: -r[f"n{i}"] / 2.0 * math.log(v) + (lam - 1) * r[f"j{i}"]
                      for g, lam in enumerate(grids[c]) if (v := r[f"v{i}_{g}"]) and 0 < v < float("inf")}
        return out

    def fit(self, df):
        known: dict = {c: {} for c in self.inputs}
        tried: dict = {c: set() for c in self.inputs}

        def look(grids):
            new = {c: [x for x in dict.fromkeys(round(v, 10) for v in grids[c]) if x not in tried[c]] for c in self.inputs}
            if any(new.values()):
                for c, got in self._likelihoods(df, new).items():
                    known[c].update(got)
                    tried[c].update(new[c])

        best = lambda c: max(known[c], key=lambda x: (known[c][x], -x)) if known[c] else 1.0
        lo, hi = self.start
        look({c: yj_grid(lo, hi, self.STEPS[0]) for c in self.inputs})
        for _ in range(self.most_widenings):
            edge = [c for c in self.inputs if best(c) in (min(tried[c]), max(tried[c]))]
            if not edge:
                break
            look({c: ([best(c) + s * k for k in (1, 2, 4) for s in (-1, 1)] if c in edge else []) for c in self.inputs})
        for wide, step in zip(self.STEPS, self.STEPS[1:]):
            look({c: yj_grid(best(c) - wide, best(c) + wide, step) for c in self.inputs})
        lam = {c: best(c) for c in self.inputs}
        stats = {}
        if self.standardize:
            r = df.agg(*[F.avg(yeo_johnson(F.col(c), lam[c])).alias(f"m{i}") for i, c in enumerate(self.inputs)],
                       *[F.stddev_pop(yeo_johnson(F.col(c), lam[c])).alias(f"s{i}") for i, c in enumerate(self.inputs)]).first()
            stats = {c: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, c in enumerate(self.inputs)}
        self.state = {"lambda": lam, "stats": stats}
        return self

    def outputs(self):
        return list(self.inputs)

    def transform(self, df):
        exprs = {}
        for c in self.inputs:
            y = yeo_johnson(F.col(c), self.state["lambda"][c])
            if self.standardize:
                m, s = self.state["stats"][c]
                y = (y - F.lit(m)) / F.lit(s)
            exprs[c] = y
        return df.withColumns(exprs)


# ---------------------------------------------------------------- FE37 quantile transform
#: Coefficients of the inverse normal CDF's rational approximation.
PPF = (
    [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
    [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01],
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00],
)


def norm_ppf(p: Column) -> Column:
    """Inverse standard-normal CDF as a rational-approximation expression (relative error
    about 1e-9), for the 'normal' output of the quantile transform."""
    a, b, c, d = PPF

    def poly(coef, x):
        e = F.lit(coef[0])
        for k in coef[1:]:
            e = e * x + F.lit(k)
        return e

    lo = 0.02425
    q_tail = F.sqrt(F.lit(-2.0) * F.log(p))
    q_up = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    q = p - F.lit(0.5)
    r = q * q
    central = poly(a, r) * q / (poly(b, r) * r + F.lit(1.0))
    lower = poly(c, q_tail) / (poly(d, q_tail) * q_tail + F.lit(1.0))
    upper = -poly(c, q_up) / (poly(d, q_up) * q_up + F.lit(1.0))
    return F.when(p < lo, lower).when(p > 1 - lo, upper).otherwise(central)


def norm_ppf_values(p: np.ndarray, coefficients=PPF) -> np.ndarray:
    """``norm_ppf`` of an array."""
    a, b, c, d = coefficients

    def poly(coef, x):
        e = np.full_like(x, coef[0])
        for k in coef[1:]:
            e = e * x + k
        return e

    lo = 0.02425
    q_tail, q_up, q = np.sqrt(-2.0 * np.log(p)), np.sqrt(-2.0 * np.log(1.0 - p)), p - 0.5
    r = q * q
    central = poly(a, r) * q / (poly(b, r) * r + 1.0)
    lower = poly(c, q_tail) / (poly(d, q_tail) * q_tail + 1.0)
    upper = -poly(c, q_up) / (poly(d, q_up) * q_up + 1.0)
    return np.where(p < lo, lower, np.where(p > 1 - lo, upper, central))


class QuantileTransformer:
    """FE37: knots = exact linear percentiles at n_quantiles evenly spaced levels; output =
    average of forward and backward piecewise-linear interpolation (ties map to the middle
    of their reference range), clamped to [0, 1] outside the knots; ``output='normal'``
    maps the clipped uniform value through the inverse normal CDF."""

    CLIP = 1e-7

    def __init__(self, inputs, n_quantiles=100, output="uniform"):
        self.inputs, self.nq, self.output, self.state = list(inputs), n_quantiles, output, {}

    def fit(self, df):
        probs = [i / (self.nq - 1) for i in range(self.nq)]
        q = exact_quantiles(df, self.inputs, probs, clean=False)
        self.state = {"knots": {c: q[c] for c in self.inputs}, "refs": probs}
        return self

    def outputs(self):
        return list(self.inputs)

    def _level(self, c: str) -> Column:
        """The level of each value, placed between the knots by binary search in batches."""
        knots, refs = np.array([float(v) for v in self.state["knots"][c]]), np.array(self.state["refs"])
        clip = self.CLIP if self.output == "normal" else None
        ppf = norm_ppf_values

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(level(x.to_numpy(dtype=float, na_value=np.nan)))

        def level(v):
            last = np.searchsorted(knots, v, side="right") - 1  # the last knot <= v
            first = np.searchsorted(knots, v, side="left")  # the first knot >= v
            inside = (v > knots[0]) & (v < knots[-1])
            j, i, x = last[inside], first[inside], v[inside]
            fwd = refs[j] + (x - knots[j]) * (refs[j + 1] - refs[j]) / (knots[j + 1] - knots[j])
            bwd = refs[i] - (knots[i] - x) * (refs[i] - refs[i - 1]) / (knots[i] - knots[i - 1])
            out = np.where(v <= knots[0], 0.0, 1.0)  # not-a-number is above all knots
            out[inside] = 0.5 * (fwd + bwd)
            return out if clip is None else ppf(np.clip(out, clip, 1 - clip))

        found = F.when(F.col(c).isNotNull(), F.pandas_udf(run, "double")(F.col(c).cast("double")))
        return found if clip is None else found.otherwise(F.lit(float(ppf(np.array([clip]))[0])))  # no value: the clipped lower end

    def transform(self, df):
        ship_package(df.sparkSession)
        return df.withColumns({c: self._level(c) for c in self.inputs})


# ---------------------------------------------------------------- FE19 KDE density
class KDEDensity:
    """FE19: Gaussian KDE density of each value (not a smoothed x). Bandwidth factor scott
    n^(-1/5) or silverman (3n/4)^(-1/5); kernel variance = sample variance x factor^2. A column
    without variance keeps its values.

    One algorithm at every size: values are gathered in bins of ``resolution`` bandwidths, each
    with its count and mean, so a bin with one distinct value is exact and the relative error of
    any other is below resolution^2 / 2. Bins stand in cells of ``REACH`` bandwidths; a value
    meets the bins of its own and the two neighbouring cells by a join on the cell, as kernels
    beyond are below exp(-REACH^2 / 2). Values come to the join in lists, those that a task has of
    a cell at once, so the bins are read once for a list; lists of a cell are dealt over ``SALTS``
    copies of its bins. No support comes to the driver."""

    REACH, SALTS, LIST = 8.0, 16, 1 << 18

    def __init__(self, column, bandwidth="scott", resolution=1.0 / 64):
        self.column, self.bw, self.resolution, self.state = column, bandwidth, resolution, {}

    def fit(self, df):
        c = self.column
        st = df.agg(F.count(c).alias("n"), F.var_samp(c).alias("v"), F.min(c).alias("lo")).first()
        n = st["n"] or 1
        factor = n ** (-0.2) if self.bw == "scott" else (n * 3.0 / 4.0) ** (-0.2)
        self.state = {"n": n, "var": (st["v"] or 0.0) * factor * factor, "lo": st["lo"]}
        self._support = None
        if self.state["var"] > 0:
            width = math.sqrt(self.state["var"])
            bins = df.where(F.col(c).isNotNull()).groupBy(F.floor((F.col(c) - F.lit(self.state["lo"])) / F.lit(width * self.resolution)).alias("_b")) \
                .agg(F.count(F.lit(1)).cast("double").alias("w"), F.avg(c).alias("v"))
            cell = F.floor((F.col("v") - F.lit(self.state["lo"])) / F.lit(width * self.REACH))
            # with those of both neighbours: at most 3 * REACH / resolution bins in a cell, in the order of their values
            near = bins.select(F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"), F.struct("v", "w").alias("bin"))
            # written, as every later use would gather the fitted rows' bins again
            self._support = stored(near.groupBy("_cell").agg(F.sort_array(F.collect_list("bin")).alias("_bins")), "kde-support")
        return self

    def density_table(self, df) -> DataFrame:
        c = self.column
        var, n = self.state["var"], self.state["n"]
        values = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias(c)).distinct()
        if var <= 0:
            return values.withColumn("density", F.col(c))
        own = F.floor((F.col(c) - F.lit(self.state["lo"])) / F.lit(math.sqrt(var) * self.REACH))
        salts, most = self.SALTS, self.LIST

        def lists(batches):  # the values of a cell that come together
            held, n, made = [], 0, 0

            def give():
                nonlocal held, n, made
                x, cell = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
                order = np.argsort(cell, kind="stable")
                cells, starts = np.unique(cell[order], return_index=True)
                xs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)).astype(np.int32)), pa.array(x[order]))
                salt = (made + np.arange(len(cells))) % salts
                made, held, n = made + len(cells) + 1, [], 0
                return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(salt.astype(np.int32)), xs], names=["_cell", "_salt", "x"])

            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= most:
                    yield give()
            if n:
                yield give()

        def kernels(x: pd.Series, v: pd.Series, w: pd.Series) -> pd.Series:  # a row: a list of values and their cell's bins
            return pd.Series([summed(xs, vs, ws) for xs, vs, ws in zip(x, v, w)])

        def summed(xs, vs, ws):
            out, step = np.empty(len(xs)), max(1, (1 << 17) // len(vs))
            for i in range(0, len(xs), step):
                t = xs[i:i + step, None] - vs[None, :]
                t *= t
                t *= -0.5 / var
                np.exp(t, out=t)
                t *= ws
                out[i:i + step] = t.sum(axis=1)
            return out

        ship_package(df.sparkSession)
        near = values.select(F.col(c).alias("x"), own.alias("_cell")).mapInArrow(lists, "_cell long, _salt int, x array<double>")
        support = self._support.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        part = near.join(support, ["_cell", "_salt"]).select("x", F.pandas_udf(kernels, "array<double>")("x", F.col("_bins.v"), F.col("_bins.w")).alias("s"))
        part = part.select(F.explode(F.arrays_zip("x", "s")).alias("p"))
        return part.select(F.col("p.x").alias(c), (F.col("p.s") / F.lit(n * math.sqrt(2 * math.pi * var))).alias("density"))

    def transform(self, df):
        return df.join(self.density_table(df).withColumnRenamed("density", f"kde_{self.column}"), self.column, "left")


class KDEColumns:
    """FE19 over several columns as one chain step: each becomes its density."""

    def __init__(self, inputs, bandwidth="scott"):
        self.inputs, self.parts = list(inputs), [KDEDensity(c, bandwidth) for c in inputs]

    def fit(self, df):
        for part in self.parts:
            part.fit(df)
        return self

    def outputs(self):
        return [f"kde_{c}" for c in self.inputs]

    def transform(self, df):
        out = df
        for part in self.parts:  # a density needs its own column alone, not the joins before it
            out = out.join(part.density_table(df).withColumnRenamed("density", f"kde_{part.column}"), part.column, "left")
        return out.drop(*self.inputs)


# ---------------------------------------------------------------- FE20/FE21 k-means
class KMeansFeatures:
    """FE20/FE21: k-means with ``n_init`` starts, fitted on the inputs, which must be clean; cluster
    label and distance to every centre as expressions on the literal centres of the start with
    the least cost.

    Each start picks its centres (k-means++) from the ``seed_rows`` rows with the smallest hashes
    of their values, the only part of the fit that doesn't read all rows. A Lloyd step then is one
    aggregation for all starts together: tasks add up their rows per start and centre, so
    ``n_init`` starts take no more passes than the longest of them. A start ends when the squared
    moves of its centres fall to ``tol`` times the inputs' mean variance."""

    def __init__(self, inputs, k=4, seed=315, max_iter=100, add_distances=True, prefix="km", n_init=10, tol=1e-4, seed_rows=4096):
        self.inputs, self.k, self.seed, self.max_iter, self.add_distances, self.prefix = list(inputs), k, seed, max_iter, add_distances, prefix
        self.n_init, self.tol, self.seed_rows = n_init, tol, seed_rows
        self.state = {}

    def _seeds(self, sample: np.ndarray) -> np.ndarray:
        """(n_init, k, columns): k-means++ on the sampled rows."""
        out = []
        for r in range(self.n_init):
            rng = np.random.default_rng(self.seed + r)
            centres = [sample[rng.integers(len(sample))]]
            near = ((sample - centres[0]) ** 2).sum(1)
            while len(centres) < self.k:
                weights = near / near.sum() if near.sum() > 0 else np.full(len(sample), 1 / len(sample))
                centres.append(sample[rng.choice(len(sample), p=weights)])
                near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(1))
            out.append(centres)
        return np.array(out)

    def _step(self, v, centres: np.ndarray) -> np.ndarray:
        """Per start and centre: rows, sums of the columns and of squared distances."""
        starts, k, p = centres.shape

        def sums(batches):
            import pyarrow as pa

            total = np.zeros((starts, k, p + 2))
            for b in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                for s in range(starts):
                    far = np.stack([((x - c) ** 2).sum(1) for c in centres[s]], axis=1)
                    at = far.argmin(1)
                    for j, w in enumerate((np.ones(len(x)), *x.T, far[np.arange(len(x)), at])):
                        total[s, :, j] += np.bincount(at, w, minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

        got = np.zeros(centres.shape[0] * k * (p + 2))
        for r in v.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # starts x centres x columns
            got[r["i"]] = r["x"]
        return got.reshape(starts, k, p + 2)

    def fit(self, df):
        from pyspark import StorageLevel

        # a null or NaN fails the fit: cleaning is a step before this one
        value = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.raise_error(F.lit(f"null or NaN in {c}")).cast("double")).otherwise(
            F.col(c).cast("double"))
        v = df.select(*[value(c).alias(f"x{i}") for i, c in enumerate(self.inputs)]).persist(StorageLevel.MEMORY_AND_DISK)
        names = v.columns
        r = v.agg(*[F.var_pop(c).alias(c) for c in names]).first()
        least = self.tol * float(np.mean([r[c] or 0.0 for c in names]))
        hashed = v.withColumn("h", F.xxhash64(F.lit(self.seed), *names)).orderBy("h", *names).limit(self.seed_rows).collect()
        if not hashed:
            raise ValueError("k-means needs rows")
        centres = self._seeds(np.array([[row[c] for c in names] for row in hashed]))
        moving = np.ones(self.n_init, dtype=bool)
        for _ in range(self.max_iter):
            if not moving.any():
                break
            t = self._step(v, centres[moving])
            n = t[:, :, :1]
            new = np.where(n > 0, t[:, :, 1:-1] / np.maximum(n, 1), centres[moving])  # a centre without rows stays
            far = ((new - centres[moving]) ** 2).sum((1, 2))
            centres[moving] = new
            moving[moving] = far > least
        cost = self._step(v, centres)[:, :, -1].sum(1)
        v.unpersist()
        best = int(cost.argmin())
        self.state = {"centers": centres[best].tolist(), "cost": float(cost[best]), "costs": cost.tolist()}
        return self

    def outputs(self):
        return [f"{self.prefix}_label"] + ([f"{self.prefix}_d{j}" for j in range(len(self.state["centers"]))] if self.add_distances else [])

    def transform(self, df):
        ds = [F.sqrt(sum(((F.col(c) - F.lit(v)) ** 2 for c, v in zip(self.inputs, cen)), F.lit(0.0)))
              for cen in self.state["centers"]]
        d = df.withColumns({f"{self.prefix}_d{j}": e for j, e in enumerate(ds)})
        arr = F.array(*[F.struct(F.col(f"{self.prefix}_d{j}").alias("d"), F.lit(j).alias("j")) for j in range(len(ds))])
        d = d.withColumn(f"{self.prefix}_label", F.array_min(arr)["j"])
        if not self.add_distances:
            d = d.drop(*[f"{self.prefix}_d{j}" for j in range(len(ds))])
        return d


# ---------------------------------------------------------------- FE32 FastICA / FE33 factor analysis
class FastICA:
    """FE32: whitening by the covariance (one aggregation), then symmetric fixed-point
    iterations; each iteration is ONE aggregation of E[z g(Wz)] and E[g'(Wz)] for all
    components (g = tanh, 'logcosh'), followed by symmetric decorrelation on the driver."""

    def __init__(self, inputs, n_components=2, max_iter=200, tol=1e-4, seed=42):
        self.inputs, self.k, self.max_iter, self.tol, self.seed, self.state = list(inputs), n_components, max_iter, tol, seed, {}

    def fit(self, df):
        m, c, _ = covariance(df, self.inputs)
        vals, vecs = np.linalg.eigh(c)
        order = [i for i in np.argsort(vals)[::-1][: self.k] if vals[i] > 1e-12 * max(vals.max(), 1e-300)]
        self.k = len(order)
        K = (vecs[:, order] / np.sqrt(vals[order])).T  # k x p whitening
        z_exprs = [sum((F.lit(float(K[a, j])) * (F.col(cn) - F.lit(float(m[j]))) for j, cn in enumerate(self.inputs)),
                       F.lit(0.0)) for a in range(self.k)]
        zdf = df.select(*[e.alias(f"z{a}") for a, e in enumerate(z_exprs)]).persist()
        rng = np.array([[_normal(self.seed, "ica", a, b) for b in range(self.k)] for a in range(self.k)])
        W = _sym_decorrelate(rng)
        for _ in range(self.max_iter):
            aggs = []
            for a in range(self.k):
                wz = sum((F.lit(float(W[a, b])) * F.col(f"z{b}") for b in range(self.k)), F.lit(0.0))
                g = F.tanh(wz)
                aggs += [F.avg(F.col(f"z{b}") * g).alias(f"e{a}_{b}") for b in range(self.k)]
                aggs.append(F.avg(F.lit(1.0) - g * g).alias(f"d{a}"))
            r = zdf.agg(*aggs).first()
            W1 = np.array([[r[f"e{a}_{b}"] - r[f"d{a}"] * W[a, b] for b in range(self.k)] for a in range(self.k)])
            W1 = _sym_decorrelate(W1)
            lim = max(abs(abs(np.diag(W1 @ W.T)) - 1))
            W = W1
            if lim < self.tol:
                break
        zdf.unpersist()
        self.state = {"unmixing": (W @ K).tolist(), "mean": m.tolist()}
        return self

    def outputs(self):
        return [f"ic{k}" for k in range(len(self.state["unmixing"]))]

    def transform(self, df):
        U = np.array(self.state["unmixing"])
        return df.withColumns(_project(self.inputs, np.array(self.state["mean"]), U.T, prefix="ic"))


def _sym_decorrelate(W):
    s, u = np.linalg.eigh(W @ W.T)
    return u @ np.diag(1.0 / np.sqrt(np.clip(s, 1e-12, None))) @ u.T @ W


def _settled(S: np.ndarray, digits: int = 12) -> np.ndarray:
    """A covariance without its last bits, which depend on the order in which the tasks' sums arrive: between
    nearly equal variances they would turn the first factors, and a fit taken again would end elsewhere."""
    scale = np.sqrt(np.abs(np.diag(S)))
    unit = 10.0 ** (np.floor(np.log10(np.outer(scale, scale), where=np.outer(scale, scale) > 0, out=np.zeros_like(S))) - digits)
    return np.where(np.isfinite(S), np.round(S / unit) * unit, S)


class FactorAnalysis:
    """FE33: maximum-likelihood factor analysis by EM on the sample covariance (the
    sufficient statistic; no data passes after the one aggregation); transform = posterior
    mean of the factors as projection expressions."""

    def __init__(self, inputs, n_components=2, tol=1e-2, max_iter=1000):
        self.inputs, self.k, self.tol, self.max_iter, self.state = list(inputs), n_components, tol, max_iter, {}

    def fit(self, df):
        m, S, n = covariance(df, self.inputs, sample=False)
        S = _settled(S)
        p = len(self.inputs)
        vals, vecs = np.linalg.eigh(S)
        order = np.argsort(vals)[::-1][: self.k]
        L = vecs[:, order] * np.sqrt(np.clip(vals[order], 1e-12, None))
        psi = np.clip(np.diag(S) - (L * L).sum(1), 1e-6, None)
        old = -np.inf
        for _ in range(self.max_iter):
            inv = np.linalg.inv(L @ L.T + np.diag(psi))
            beta = L.T @ inv
            ezz = np.eye(self.k) - beta @ L + beta @ S @ beta.T
            L = S @ beta.T @ np.linalg.inv(ezz)
            psi = np.clip(np.diag(S - L @ beta @ S), 1e-6, None)
            sign, logdet = np.linalg.slogdet(L @ L.T + np.diag(psi))
            ll = -0.5 * n * (p * math.log(2 * math.pi) + logdet + np.trace(np.linalg.inv(L @ L.T + np.diag(psi)) @ S))
            if ll - old < self.tol:
                break
            old = ll
        inv = np.linalg.inv(L @ L.T + np.diag(psi))
        self.state = {"loadings": L.tolist(), "psi": psi.tolist(), "mean": m.tolist(), "proj": (L.T @ inv).tolist(),
                      "loglik": float(old)}
        return self

    def outputs(self):
        return [f"fa{k}" for k in range(len(self.state["proj"]))]

    def transform(self, df):
        P = np.array(self.state["proj"])
        return df.withColumns(_project(self.inputs, np.array(self.state["mean"]), P.T, prefix="fa"))
