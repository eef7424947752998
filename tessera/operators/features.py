"""Fitted feature operators (FE1-FE29, FE39-FE41).

Protocol (X2): ``op.fit(df)`` runs ONE aggregation over all input columns and keeps only
O(columns) numbers on the driver; ``op.transform(df)`` adds or replaces columns with
built-in expressions (whole-stage codegen, no Python per row). Fitted state is a plain
dict (``op.state``) so it can be stored in a bundle as JSON.
"""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, py_uniform
from ..functions.scalar import EPS, finite_or_null, signed_log, signed_sqrt
from .stats import distinct_levels, exact_quantiles, moments


def safe_name(s) -> str:
    """SQL-safe output names (FE40)."""
    return re.sub(r"[^0-9A-Za-z_]", "_", str(s))


class Op:
    inputs: list[str]
    state: dict

    def fit(self, df: DataFrame) -> "Op":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def outputs(self) -> list[str]:
        return list(self.inputs)


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.withColumns(exprs)


# ---------------------------------------------------------------- P11
class DropConstant(Op):
    """Of ``inputs``, the columns with fewer than two distinct values in the fitted rows (null
    is none) are dropped, in these rows and in any others; one aggregation of least and greatest."""

    def __init__(self, inputs):
        self.inputs, self.state = list(inputs), {}

    def fit(self, df):
        r = df.agg(*[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(f"v{i}") for i, c in enumerate(self.inputs)]).first()
        self.state = {"dropped": [c for i, c in enumerate(self.inputs) if not r[f"v{i}"]]}
        return self

    def outputs(self):
        return [c for c in self.inputs if c not in self.state["dropped"]]

    def transform(self, df):
        return df.drop(*self.state["dropped"])


# ---------------------------------------------------------------- FE1 / FE1b
class CleanNumeric(Op):
    """NaN/+inf/-inf/null -> fitted statistic (median, mean or most_frequent).
    An all-bad column becomes 0 (FE1) or is dropped (``drop_empty=True``, FE1b)."""

    def __init__(self, inputs, strategy="median", drop_empty=False):
        self.inputs, self.strategy, self.drop_empty, self.state = list(inputs), strategy, drop_empty, {}

    def fit(self, df):
        if self.strategy == "median":
            q = exact_quantiles(df, self.inputs, [0.5], clean=True)
            fill = {c: q[c][0] for c in self.inputs}
        elif self.strategy == "mean":
            m = moments(df, self.inputs, clean=True)
            fill = {c: m[c]["mean"] for c in self.inputs}
        elif self.strategy == "most_frequent":
            r = df.agg(*[F.mode(finite_or_null(c), True).alias(f"m{i}") for i, c in enumerate(self.inputs)]).first()
            fill = {c: r[f"m{i}"] for i, c in enumerate(self.inputs)}
        else:
            raise ValueError(f"unknown strategy {self.strategy}")
        self.state = {"fill": fill}
        return self

    def outputs(self):
        fill = self.state["fill"]
        return [c for c in self.inputs if not (self.drop_empty and fill[c] is None)]

    def transform(self, df):
        fill = self.state["fill"]
        keep = self.outputs()
        out = _replace(df, {c: F.coalesce(finite_or_null(c), F.lit(float(fill[c] if fill[c] is not None else 0.0)))
                            for c in keep})
        dropped = [c for c in self.inputs if c not in keep]
        return out.drop(*dropped)


# ---------------------------------------------------------------- FE2 / FE3a / FE3b
class StandardScale(Op):
    """(x - mean) / population std; zero std -> divide by 1 (FE2)."""

    def __init__(self, inputs):
        self.inputs, self.state = list(inputs), {}

    def fit(self, df):
        m = moments(df, self.inputs)
        self.state = {c: (m[c]["mean"], m[c]["std"] if m[c]["std"] else 1.0) for c in self.inputs}
        return self

    def transform(self, df):
        return _replace(df, {c: (F.col(c) - F.lit(mu)) / F.lit(sd) for c, (mu, sd) in self.state.items()})


class MinMaxScale(Op):
    """(x - min) / (max - min); zero range -> divide by 1 (FE3a)."""

    def __init__(self, inputs):
        self.inputs, self.state = list(inputs), {}

    def fit(self, df):
        m = moments(df, self.inputs)
        self.state = {c: (m[c]["min"], (m[c]["max"] - m[c]["min"]) or 1.0) for c in self.inputs}
        return self

    def transform(self, df):
        return _replace(df, {c: (F.col(c) - F.lit(lo)) / F.lit(rg) for c, (lo, rg) in self.state.items()})


class RobustScale(Op):
    """(x - median) / IQR; zero IQR -> 1 (FE3b)."""

    def __init__(self, inputs):
        self.inputs, self.state = list(inputs), {}

    def fit(self, df):
        q = exact_quantiles(df, self.inputs, [0.25, 0.5, 0.75], clean=False)
        self.state = {c: (q[c][1], (q[c][2] - q[c][0]) or 1.0) for c in self.inputs}
        return self

    def transform(self, df):
        return _replace(df, {c: (F.col(c) - F.lit(md)) / F.lit(iqr) for c, (md, iqr) in self.state.items()})


# ---------------------------------------------------------------- FE4 / FE5
class OrdinalEncode(Op):
    """Code = position in the given level order (0-based); unknown or null -> -1 (FE4).
    Without an order the sorted distinct values are used."""

    def __init__(self, levels: dict | list, max_levels: int | None = None):
        self.max_levels = max_levels
        if isinstance(levels, dict):
            self.inputs, self.state = list(levels), {c: list(v) if v else None for c, v in levels.items()}
        else:
            self.inputs, self.state = list(levels), {c: None for c in levels}

    def fit(self, df):
        missing = [c for c, v in self.state.items() if v is None]
        if missing:
            self.state.update(distinct_levels(df, missing, self.max_levels))
        return self

    def transform(self, df):
        exprs = {}
        for c, lv in self.state.items():
            pos = F.array_position(F.array(*[F.lit(x) for x in lv]), F.col(c))
            exprs[c] = F.when(pos > 0, (pos - 1).cast("double")).otherwise(F.lit(-1.0))
        return _replace(df, exprs)


class OneHot(Op):
    """0/1 column per sorted level, FIRST level dropped; unknown -> all zeros (FE5)."""

    def __init__(self, inputs, drop_first=True, max_levels: int | None = None):
        self.inputs, self.drop_first, self.max_levels, self.state = list(inputs), drop_first, max_levels, {}

    def fit(self, df):
        self.state = distinct_levels(df, self.inputs, self.max_levels)
        return self

    def _names(self):
        return {c: [(lv, f"{c}_{safe_name(lv)}") for lv in (lvs[1:] if self.drop_first else lvs)]
                for c, lvs in self.state.items()}

    def outputs(self):
        return [n for v in self._names().values() for _, n in v]

    def transform(self, df):
        exprs = {}
        for c, pairs in self._names().items():
            for lv, name in pairs:
                exprs[name] = F.when(F.col(c) == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0))
        return df.withColumns(exprs).drop(*self.inputs)


# ---------------------------------------------------------------- FE6 / FE7 / FE8
class IQRClip(Op):
    """Clip to [Q1 - m*IQR, Q3 + m*IQR] with linear percentiles (FE6)."""

    def __init__(self, inputs, multiplier=2.0):
        self.inputs, self.m, self.state = list(inputs), multiplier, {}

    def fit(self, df):
        q = exact_quantiles(df, self.inputs, [0.25, 0.75], clean=False)
        self.state = {c: (q[c][0] - self.m * (q[c][1] - q[c][0]), q[c][1] + self.m * (q[c][1] - q[c][0]))
                      for c in self.inputs}
        return self

    def transform(self, df):
        return _replace(df, {c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
                             for c, (lo, hi) in self.state.items()})


class VarianceFilter(Op):
    """Keep columns with population variance > threshold (FE8); with ``keep_first_if_empty``
    it is the constant-feature remover with threshold 1e-10 (FE7)."""

    def __init__(self, inputs, threshold=1e-10, keep_first_if_empty=True, strict_less=True):
        self.inputs, self.t, self.keep_first, self.strict_less = list(inputs), threshold, keep_first_if_empty, strict_less
        self.state = {}

    def fit(self, df):
        m = moments(df, self.inputs)
        if self.strict_less:  # FE7: drop var < t
            keep = [c for c in self.inputs if (m[c]["var"] or 0.0) >= self.t]
        else:  # FE8: keep var > t
            keep = [c for c in self.inputs if (m[c]["var"] or 0.0) > self.t]
        if not keep and self.keep_first and self.inputs:
            keep = [self.inputs[0]]
        self.state = {"keep": keep, "var": {c: m[c]["var"] for c in self.inputs}}
        return self

    def outputs(self):
        return self.state["keep"]

    def transform(self, df):
        return df.drop(*[c for c in self.inputs if c not in self.state["keep"]])


def anova_f(df: DataFrame, cols: list[str], label: str) -> dict:
    """One-way ANOVA F per column from per-class count, mean and population variance (one
    grouped pass; the merged moments are numerically stable, unlike raw sums of squares)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    rows = df.groupBy(label).agg(*aggs).collect()  # one row per class
    k = len(rows)
    n = sum(r["n"] for r in rows)
    out = {}
    for i, c in enumerate(cols):
        grand = sum(r["n"] * r[f"m{i}"] for r in rows) / n
        ss_between = sum(r["n"] * (r[f"m{i}"] - grand) ** 2 for r in rows)
        ss_within = sum(r["n"] * r[f"v{i}"] for r in rows)
        dfb, dfw = k - 1, n - k
        out[c] = (ss_between / dfb) / (ss_within / dfw) if ss_within > 0 and dfb > 0 else float("inf")
    return out


class SelectPercentileF(Op):
    """Keep the top ``percentile`` % of columns by ANOVA F; ties broken by column order (FE9)."""

    def __init__(self, inputs, label, percentile=50):
        self.inputs, self.label, self.pct, self.state = list(inputs), label, percentile, {}

    def fit(self, df):
        f = anova_f(df, self.inputs, self.label)
        k = max(1, int(len(self.inputs) * self.pct / 100))
        ranked = sorted(range(len(self.inputs)), key=lambda i: (-f[self.inputs[i]], i))[:k]
        self.state = {"f": f, "keep": [self.inputs[i] for i in sorted(ranked)]}
        return self

    def outputs(self):
        return self.state["keep"]

    def transform(self, df):
        return df.drop(*[c for c in self.inputs if c not in self.state["keep"]])


# ---------------------------------------------------------------- FE10-FE17 (replace inputs)
PAIR_EXPR = {
    "ratio": lambda a, b: a / (b + F.lit(EPS)),
    "product": lambda a, b: a * b,
    "difference": lambda a, b: a - b,
    "sum": lambda a, b: a + b,
}
PAIR_NAME = {"ratio": "ratio", "product": "product", "difference": "diff", "sum": "sum"}


def draw_pairs(n_inputs: int, n_features: int, seed: int, salt: str) -> list[tuple[int, int]]:
    """Random (i, j) pairs, i != j when at least 2 inputs, else (0, 0) (FE10 rule)."""
    if n_inputs < 2:
        return [(0, 0)] * n_features
    out = []
    for t in range(n_features):
        i = int(py_uniform(seed, salt, t, "i") * n_inputs)
        j = int(py_uniform(seed, salt, t, "j") * (n_inputs - 1))
        out.append((i, j if j < i else j + 1))
    return out


class RandomPairs(Op):
    """``n_features`` random-pair features of one kind; output replaces the inputs (FE10-FE13)."""

    def __init__(self, inputs, kind="ratio", n_features=5, seed=42):
        self.inputs, self.kind, self.k, self.seed = list(inputs), kind, n_features, seed
        self.state = {"pairs": draw_pairs(len(self.inputs), n_features, seed, kind)}

    def outputs(self):
        """One name per pair; a pair that is drawn again gets a running suffix."""
        seen: dict = {}
        names = []
        for pair in self.state["pairs"]:
            seen[pair] = seen.get(pair, 0) + 1
            names.append(f"{PAIR_NAME[self.kind]}_{pair[0]}_{pair[1]}" + (f"_{seen[pair]}" if seen[pair] > 1 else ""))
        return names

    def expressions(self) -> dict[str, Column]:
        f = PAIR_EXPR[self.kind]
        return {name: f(F.col(self.inputs[i]), F.col(self.inputs[j]))
                for name, (i, j) in zip(self.outputs(), self.state["pairs"])}

    def transform(self, df):
        exprs = self.expressions()
        return df.withColumns(exprs).drop(*[c for c in self.inputs if c not in exprs])


UNARY = {
    "reciprocal": (lambda x: F.lit(1.0) / (x + F.lit(EPS)), "inv_{}"),
    "square": (lambda x: x * x, "{}_sq"),
    "sqrt": (lambda x: signed_sqrt(x), "sqrt_{}"),
    "log": (lambda x: signed_log(x), "log_{}"),
}


class Unary(Op):
    """Reciprocal 1/(x+1e-8), square, signed sqrt, signed log (FE14-FE17), replacing inputs."""

    def __init__(self, inputs, kind):
        self.inputs, self.kind, self.state = list(inputs), kind, {}

    def outputs(self):
        return [UNARY[self.kind][1].format(c) for c in self.inputs]

    def expressions(self) -> dict[str, Column]:
        fn = UNARY[self.kind][0]
        return {n: fn(F.col(c)) for c, n in zip(self.inputs, self.outputs())}

    def transform(self, df):
        exprs = self.expressions()
        return df.withColumns(exprs).drop(*[c for c in self.inputs if c not in exprs])


# ---------------------------------------------------------------- FE18 binning
class Binning(Op):
    """Quantile (linear percentiles, equal edges merged) or uniform edges; the ordinal code
    is the number of inner edges <= x (right-closed search), clamped to [0, bins-1];
    ``encode='onehot'`` emits one 0/1 column per bin (FE18)."""

    def __init__(self, inputs, n_bins=5, strategy="quantile", encode="ordinal"):
        self.inputs, self.n_bins, self.strategy, self.encode, self.state = list(inputs), n_bins, strategy, encode, {}

    def fit(self, df):
        if self.strategy == "quantile":
            probs = [i / self.n_bins for i in range(self.n_bins + 1)]
            q = exact_quantiles(df, self.inputs, probs, clean=False)
            edges = {c: sorted(set(q[c])) for c in self.inputs}
        else:
            m = moments(df, self.inputs)
            edges = {}
            for c in self.inputs:
                lo, hi = m[c]["min"], m[c]["max"]
                edges[c] = [lo + (hi - lo) * i / self.n_bins for i in range(self.n_bins + 1)] if hi > lo else [lo, hi]
        self.state = {"edges": edges}
        return self

    def _code(self, c):
        inner = self.state["edges"][c][1:-1]
        if not inner:
            return F.lit(0.0)
        return sum((F.col(c) >= F.lit(e)).cast("double") for e in inner)

    def outputs(self):
        if self.encode == "ordinal":
            return [f"binned_{c}" for c in self.inputs]
        return [f"binned_{c}_{b}" for c in self.inputs for b in range(max(1, len(self.state["edges"][c]) - 1))]

    def transform(self, df):
        exprs = {}
        for c in self.inputs:
            code = self._code(c)
            if self.encode == "ordinal":
                exprs[f"binned_{c}"] = code
            else:
                for b in range(max(1, len(self.state["edges"][c]) - 1)):
                    exprs[f"binned_{c}_{b}"] = (code == F.lit(float(b))).cast("double")
        return df.withColumns(exprs).drop(*self.inputs)


# ---------------------------------------------------------------- FE22 noise
class NoiseInjector(Op):
    """Adds centred noise to the hash-chosen int(n * fraction) columns (none for fraction 0; a
    ``fraction`` of None is drawn in [0, 1]). Distribution and scale are drawn per column from
    ``dists`` and ``scale_range``; sd = scale x column sd over finite values (bad or zero
    sd -> 1). Noise is the inverse CDF of a hash-uniform of (seed, column, row key):
    deterministic and partition-independent. Not applied at inference (``training=False``)."""

    DISTS = ("normal", "uniform", "laplace", "exponential")

    def __init__(self, inputs, key, fraction=0.5, dists=DISTS, scale_range=(0.01, 0.2), seed=42):
        self.inputs, self.key, self.seed = list(inputs), key, seed
        self.frac = py_uniform(seed, "noisefrac") if fraction is None else fraction
        self.dists, self.scale_range, self.state = tuple(dists), scale_range, {}
        if set(self.dists) - set(self.DISTS):
            raise ValueError(f"unknown distributions in {self.dists}")

    def fit(self, df):
        k = int(len(self.inputs) * self.frac)
        chosen = sorted(self.inputs, key=lambda c: (py_uniform(self.seed, "noisecol", c), c))[:k]
        m = moments(df, chosen, clean=True) if chosen else {}
        lo, hi = self.scale_range
        self.state = {c: {"dist": self.dists[int(py_uniform(self.seed, "noisedist", c) * len(self.dists))],
                          "scale": lo + (hi - lo) * py_uniform(self.seed, "noisescale", c),
                          "sd": m[c]["std"] if m[c]["std"] and math.isfinite(m[c]["std"]) else 1.0}
                      for c in self.inputs if c in chosen}
        return self

    def noise(self, c):
        own = self.state[c]
        u = hash_uniform(self.seed, f"noise|{c}", self.key)
        s = F.lit(own["scale"] * own["sd"])
        if own["dist"] == "uniform":  # centred uniform with the given sd
            return (u - F.lit(0.5)) * F.lit(math.sqrt(12.0)) * s
        if own["dist"] == "laplace":  # sd = sqrt(2) b
            b = s / F.lit(math.sqrt(2.0))
            return -b * F.signum(u - F.lit(0.5)) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u - F.lit(0.5)))
        if own["dist"] == "exponential":  # mean removed
            return s * (-F.log(F.lit(1.0) - u) - F.lit(1.0))
        u2 = hash_uniform(self.seed, f"noise2|{c}", self.key)  # normal: Box-Muller on two uniforms
        return s * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * u2)

    def transform(self, df, training=True):
        if not training or not self.state:
            return df
        return df.withColumns({c: F.col(c) + self.noise(c) for c in self.state})


# ---------------------------------------------------------------- FE23-FE28
class AllPairs(Op):
    """All pairs: difference/sum over combinations, ratio over ordered pairs with offset
    x_i / (x_j + min_j + 1), min fitted on train (FE23-FE25). Inputs are kept (union)."""

    def __init__(self, inputs, kind="difference"):
        self.inputs, self.kind, self.state = list(inputs), kind, {}

    def fit(self, df):
        if self.kind == "ratio":
            m = moments(df, self.inputs)
            self.state = {"min": {c: m[c]["min"] for c in self.inputs}}
        return self

    def _pairs(self):
        if self.kind == "ratio":
            return list(itertools.permutations(range(len(self.inputs)), 2))
        return list(itertools.combinations(range(len(self.inputs)), 2))

    def outputs(self):
        tag = {"difference": "diff", "sum": "sum", "ratio": "ratio"}[self.kind]
        return [f"{tag}_{self.inputs[i]}_{self.inputs[j]}" for i, j in self._pairs()]

    def transform(self, df):
        exprs = {}
        for (i, j), name in zip(self._pairs(), self.outputs()):
            a, b = F.col(self.inputs[i]), F.col(self.inputs[j])
            if self.kind == "difference":
                exprs[name] = a - b
            elif self.kind == "sum":
                exprs[name] = a + b
            else:
                exprs[name] = F.try_divide(a, b + F.lit(self.state["min"][self.inputs[j]] + 1.0))
        return df.withColumns(exprs)


class OffsetUnary(Op):
    """Offset ops with min fitted on train: 1/(x+min+1), ln(x+min+1), sqrt(x+min+1); the
    reference formula is kept (plus, not minus); undefined results are null (FE26-FE28)."""

    def __init__(self, inputs, kind="log"):
        self.inputs, self.kind, self.state = list(inputs), kind, {}

    def fit(self, df):
        m = moments(df, self.inputs)
        self.state = {"min": {c: m[c]["min"] for c in self.inputs}}
        return self

    def outputs(self):
        return [f"{self.kind}_off_{c}" for c in self.inputs]

    def transform(self, df):
        exprs = {}
        for c, name in zip(self.inputs, self.outputs()):
            z = F.col(c) + F.lit(self.state["min"][c] + 1.0)
            if self.kind == "reciprocal":
                exprs[name] = F.try_divide(F.lit(1.0), z)
            elif self.kind == "log":
                exprs[name] = F.when(z > 0, F.log(z))
            elif self.kind == "sqrt":
                exprs[name] = F.when(z >= 0, F.sqrt(z))
            else:
                raise ValueError(self.kind)
        return df.withColumns(exprs)


# ---------------------------------------------------------------- FE29 polynomial
def poly_terms(n: int, degree: int, interaction_only: bool, bias: bool) -> list[tuple[int, ...]]:
    """Terms in the order: 1, x_i, then degree-2 x_i*x_j (i<=j), ... (FE29)."""
    terms = [()] if bias else []
    for d in range(1, degree + 1):
        gen = itertools.combinations(range(n), d) if interaction_only else itertools.combinations_with_replacement(range(n), d)
        terms.extend(gen)
    return terms


class Polynomial(Op):
    def __init__(self, inputs, degree=2, interaction_only=False, bias=True):
        self.inputs, self.degree, self.io, self.bias, self.state = list(inputs), degree, interaction_only, bias, {}
        self.state = {"terms": poly_terms(len(self.inputs), degree, interaction_only, bias)}

    def outputs(self):
        return ["poly_1" if not t else "poly_" + "_".join(self.inputs[i] for i in t) for t in self.state["terms"]]

    def expressions(self) -> dict[str, Column]:
        exprs = {}
        for t, name in zip(self.state["terms"], self.outputs()):
            e = F.lit(1.0)
            for i in t:
                e = e * F.col(self.inputs[i])
            exprs[name] = e
        return exprs

    def transform(self, df):
        exprs = self.expressions()
        return df.withColumns(exprs).drop(*[c for c in self.inputs if c not in exprs])


def fit_chain(ops: list[Op], train: DataFrame) -> list[Op]:
    """Fit a chain: each op is fitted on the train frame transformed by the ops before it
    (FE38 order). The train frame is small-plan lazily re-derived; call ``persist`` upstream
    for long chains."""
    cur = train
    for op in ops:
        op.fit(cur)
        cur = op.transform(cur)
    return ops


def apply_chain(ops: list[Op], df: DataFrame) -> DataFrame:
    for op in ops:
        df = op.transform(df)
    return df


# ---------------------------------------------------------------- P1 / P3 role projection
def project_roles(df: DataFrame, roles: dict, id_column: str | None = "id", keep: list[str] | None = None) -> DataFrame:
    """Route columns by role, unlisted columns dropped, output order numeric, ordinal,
    nominal (``keep`` columns such as the row key and label stay in front). P3: an ``id``
    column is dropped when present (no-op otherwise)."""
    if id_column and id_column in df.columns:
        df = df.drop(id_column)
    cols = list(roles.get("numeric", [])) + list(roles.get("ordinal", {})) + list(roles.get("nominal", []))
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"role columns not in frame: {missing}")
    return df.select(*(keep or []), *cols)
