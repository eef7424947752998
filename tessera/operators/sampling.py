"""Exact, reproducible sampling and splitting (SM1-SM12, FE41, P9/P10).

Randomness is the hash-uniform of (seed, salt, key). Exact stratum quotas come from the
skew-safe ``exact_rank`` (rank by hash inside each stratum, computed in bounded hash
buckets), so a split picks exactly the rows that
``row_number() OVER (PARTITION BY label ORDER BY h, key) <= quota`` would pick, without a
window over a whole stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bits, hash_uniform, py_uniform
from .scan import exact_rank
from .spaces import CLASSIFIER_SPACES, draw_rows

PPM = 1_000_000


def _ppm(f: float) -> int:
    return int(round(f * PPM))


def ranked_strata(df: DataFrame, key: str, strata: list[str], seed: int, salt: str) -> DataFrame:
    """Adds ``_h`` (52-bit hash), ``_rank`` (1-based inside stratum) and ``_n`` (stratum
    size) in one ranking pass (no separate counting job)."""
    d = df.withColumn("_h", hash_bits(seed, salt, key))
    return exact_rank(d, strata, "_h", key).withColumnRenamed("_rank_total", "_n")


def quota_expr(frac_ppm_cum: int) -> str:
    return f"(_n * {frac_ppm_cum}) div {PPM}"


def stratified_split(df: DataFrame, key: str, label: str, fractions=(0.6, 0.35, 0.05),
                     names=("train", "val1", "val2"), seed: int = 42, salt: str = "split") -> DataFrame:
    """SM1: exact stratified split; part i gets ranks in (floor(n*F_{i-1}), floor(n*F_i)]."""
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError(f"split fractions must sum to 1, got {sum(fractions)}")
    if len(fractions) != len(names):
        raise ValueError("one name per fraction")
    d = ranked_strata(df, key, [label], seed, salt)
    cum, acc = [], 0
    for f in fractions[:-1]:
        acc += _ppm(f)
        cum.append(acc)
    expr = None
    for c, nm in zip(cum, names[:-1]):
        cond = F.col("_rank") <= F.expr(quota_expr(c))
        expr = F.when(cond, F.lit(nm)) if expr is None else expr.when(cond, F.lit(nm))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return d.withColumn("split", expr).drop("_h", "_rank", "_n")


def stratified_sample(df: DataFrame, key: str, label: str | None, fraction: float, seed: int = 42,
                      salt: str = "rows") -> DataFrame:
    """SM2/SM10: exactly floor(n_s * fraction) rows of every stratum (all rows if no label)."""
    d = ranked_strata(df, key, [label] if label else [], seed, salt)
    return d.filter(F.col("_rank") <= F.expr(quota_expr(_ppm(fraction)))).drop("_h", "_rank", "_n")


def drawn_fraction(lo: float, hi: float, seed: int, salt: str = "frac", iteration: int = 0) -> float:
    """Fraction drawn uniformly in [lo, hi] on the driver, reproducible; rounded to ppm."""
    return round(lo + (hi - lo) * py_uniform(seed, salt, iteration), 6)


def sample_columns(cols: list[str], fraction: float | None, seed: int, keep_order: bool = True,
                   lo: float = 0.5, hi: float = 1.0) -> list[str]:
    """P9 (fixed fraction, order kept) / P10 (drawn fraction, order by hash): the
    ``max(1, int(n*f))`` columns with the smallest hash of (seed, name)."""
    f = fraction if fraction is not None else drawn_fraction(lo, hi, seed, "colfrac")
    k = max(1, int(len(cols) * f))
    picked = sorted(cols, key=lambda c: (py_uniform(seed, "col", c), c))[:k]
    return [c for c in cols if c in picked] if keep_order else picked


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42, salt: str = "simple") -> DataFrame:
    """SM6: the n rows with the smallest hash (exact size, no replacement)."""
    d = ranked_strata(df, key, [], seed, salt)
    return d.filter(F.col("_rank") <= n).drop("_h", "_rank", "_n")


def disjoint_second_sample(df: DataFrame, first: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SM7: n rows drawn from the rows not in ``first`` (anti join, J3)."""
    rest = df.join(first.select(key), on=key, how="left_anti")
    return simple_sample(rest, key, n, seed, salt="second")


def random_split(df: DataFrame, key: str, train_fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """SM8: unstratified exact split, floor(n*f) rows 'train', the rest 'test'."""
    d = ranked_strata(df, key, [], seed, "rsplit")
    return d.withColumn("split", F.when(F.col("_rank") <= F.expr(quota_expr(_ppm(train_fraction))), "train")
                        .otherwise("test")).drop("_h", "_rank", "_n")


def kfold(df: DataFrame, key: str, label: str, k: int = 3, seed: int = 42) -> DataFrame:
    """SM9: stratified fold id = (rank-1) mod k; fold sizes differ by at most one per class."""
    d = ranked_strata(df, key, [label], seed, "kfold")
    return d.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank", "_n")


def stratum_quotas(counts: dict, size: int) -> dict:
    """Rows per stratum of a proportional sample of ``size`` rows: whole parts first, the rest
    by largest remainder, ties by stratum."""
    n = sum(counts.values())
    exact = {k: divmod(c * size, n) for k, c in counts.items()} if n else {}
    out = {k: q for k, (q, _) in exact.items()}
    for k in sorted(exact, key=lambda k: (-exact[k][1], k))[:size - sum(out.values())]:
        out[k] += 1
    return out


def presample_sizes(n: int, candidates: list[tuple[int, float, int]], least: int = 100) -> dict[int, int]:
    return {cid: min(n, max(least, int(n * f))) for cid, f, _ in candidates}


def candidate_presample(df: DataFrame, key: str, label: str, candidates: list[tuple[int, float, int]],
                        least: int = 100) -> DataFrame:
    """SM5: stratified samples of exactly max(``least``, int(n * fraction)) rows for every
    candidate of a batch, [(candidate_id, fraction, seed)], in one pass over the pool; returns
    (candidate_id, key).

    A stratum's sample is its rows with the smallest hashes. Rows are first cut at a hash level
    that keeps a few more than the quota (missing it has a probability below 1e-14), so only the
    rows near a sample are expanded per candidate; the exact rank among them is the exact rank
    among all."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    n = sum(counts.values())
    sizes = presample_sizes(n, candidates, least)
    quotas = {cid: stratum_quotas(counts, sizes[cid]) for cid, _, _ in candidates}
    level = lambda q, c: min(1.0, (q + 8 * math.sqrt(q) + 64) / c)
    arr = F.array(*[F.struct(F.lit(cid).alias("cid"), F.lit(str(s)).alias("s"), F.lit(k).alias("k"), F.lit(quotas[cid][k]).alias("q"),
                             F.lit(level(quotas[cid][k], counts[k])).alias("t"))
                    for cid, _, s in candidates for k in counts if quotas[cid].get(k)])
    own = F.concat(F.lit("|pre|"), F.col(key).cast("string"))

    def bits(c):
        return F.conv(F.substring(F.md5(F.concat(c["s"], own)), 1, 13), 16, 10).cast("bigint")

    near = F.filter(arr, lambda c: (c["k"] == F.col(label)) & (bits(c) / F.lit(float(1 << 52)) < c["t"]))
    d = df.select(F.col(key), F.explode(near).alias("_c"))
    d = d.select(F.col("_c.cid").alias("candidate_id"), F.col("_c.k").alias("_k"), F.col("_c.q").alias("_q"), key, bits(F.col("_c")).alias("_h"))
    ranked = exact_rank(d, ["candidate_id", "_k"], "_h", key)
    return ranked.filter(F.col("_rank") <= F.col("_q")).select("candidate_id", key)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """FE41: balanced weight n / (n_classes * n_class), joined from the class-count table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))  # one row
    w = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(w, on=label, how="left")


# ---------------------------------------------------------------- SM11/SM12 hyper-parameter draws
CLASSIFIERS = list(CLASSIFIER_SPACES)


def draw_params(df: DataFrame, key: str, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """SM12: classifier type, row and column fraction per row of a candidate table."""
    u = lambda salt: hash_uniform(seed, salt, key)
    k = len(CLASSIFIERS)
    cls = F.element_at(F.array(*[F.lit(c) for c in CLASSIFIERS]), (F.floor(u("clf") * k) + 1).cast("int"))
    return df.select(key, *(carry or []), cls.alias("classifier_type"), (F.lit(0.1) + F.lit(0.8) * u("rowfrac")).alias("row_fraction"),
                     (F.lit(0.5) + F.lit(0.5) * u("colfrac")).alias("column_fraction"))


def draw_hyperparameters(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """SM11: the drawn parameters of each candidate's classifier, a row each: (key,
    classifier_type, param, number, text). A parameter may depend on one drawn before it."""
    cand = draw_params(df, key, seed)
    cells = []
    for name, space in CLASSIFIER_SPACES.items():
        for param, holds, number, text in draw_rows(space, seed, name, key):
            ok = (F.col("classifier_type") == name) & holds
            cells.append(F.when(ok, F.struct(F.lit(param).alias("param"), number.alias("number"), text.alias("text"))))
    drawn = F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull()))
    return cand.select(key, "classifier_type", drawn.alias("c")).select(key, "classifier_type", "c.*")
