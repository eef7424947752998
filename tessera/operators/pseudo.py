"""Pseudo-labelling (PL1-PL6): confident unlabelled rows, class balancing by exact
hash-ranked quotas, confidence caps and pool augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import ranked_strata


def confident(df: DataFrame, threshold: float = 0.8, p: str = "p") -> DataFrame:
    """PL1/P8: keep rows with p >= t or p <= 1 - t; pseudo label = p >= 0.5."""
    c = df.filter((F.col(p) >= F.lit(threshold)) | (F.col(p) <= F.lit(1.0) - F.lit(threshold)))
    return c.withColumn("pseudo_label", (F.col(p) >= F.lit(0.5)).cast("int"))


def class_counts(df: DataFrame, label: str = "pseudo_label") -> dict:
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows at most
    return {int(r[label]): int(r["n"]) for r in rows}


def quotas_balance(counts: dict) -> dict:
    """PL2: both classes cut to the smaller count (only when both are present)."""
    if len(counts) < 2:
        return dict(counts)
    m = min(counts.values())
    return {k: m for k in counts}


def quotas_ratio(counts: dict, ratio: float) -> dict:
    """PL3: target positive share r; when a class is short, the other is shrunk by
    int(k*(1-r)/r) or int(k*r/(1-r))."""
    if len(counts) < 2:
        return dict(counts)
    npos, nneg = counts.get(1, 0), counts.get(0, 0)
    n = npos + nneg
    want_pos = int(n * ratio)
    want_neg = n - want_pos
    if npos < want_pos:
        return {1: npos, 0: min(nneg, int(npos * (1 - ratio) / ratio))}
    if nneg < want_neg:
        return {0: nneg, 1: min(npos, int(nneg * ratio / (1 - ratio)))}
    return {1: want_pos, 0: want_neg}


def pick_quotas(df: DataFrame, key: str, label: str, quotas: dict, seed: int = 42, salt: str = "pl") -> DataFrame:
    """Exactly ``quotas[class]`` rows per class: the smallest hashes (D3 exact ranks)."""
    r = ranked_strata(df, key, [label], seed, salt)
    q = F.lit(0)
    for k, v in quotas.items():
        q = F.when(F.col(label) == k, F.lit(v)).otherwise(q)
    return r.filter(F.col("_rank") <= q).drop("_h", "_rank", "_n")


def cap_by_confidence(df: DataFrame, n: int, key: str, p: str = "p") -> DataFrame:
    """PL4/O2: the n most confident rows |p - 0.5|, key tie-break."""
    return df.orderBy(F.desc(F.abs(F.col(p) - 0.5)), key).limit(n)


def generate(df: DataFrame, key: str, p: str = "p", threshold: float = 0.95, max_samples: int | None = None,
             balance: bool = True, ratio: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """PL1 in one call: the confident rows; classes drawn to ``ratio`` or, without one and with
    ``balance``, to equal counts (either only where both classes are there); then the
    ``max_samples`` most confident. Returns the rows with ``pseudo_label`` and one row of counts:
    n_total, n_positive, n_negative, mean_confidence (null without rows), min_confidence,
    test_set_size, coverage in percent."""
    picked = confident(df, threshold, p)
    counts = class_counts(picked)
    if len(counts) == 2 and (ratio is not None or balance):
        quotas = quotas_balance(counts) if ratio is None else quotas_ratio(counts, ratio)
        picked = pick_quotas(picked, key, "pseudo_label", quotas, seed)
    if max_samples is not None:
        picked = cap_by_confidence(picked, max_samples, key, p)
    stats = picked.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("pseudo_label") == 1).alias("n_positive"),
        F.count_if(F.col("pseudo_label") == 0).alias("n_negative"),
        F.avg(F.greatest(F.col(p), F.lit(1.0) - F.col(p))).alias("mean_confidence"), F.lit(threshold).alias("min_confidence"))
    size = df.agg(F.count(F.lit(1)).alias("test_set_size"))
    stats = stats.crossJoin(size)  # one row each
    share = F.coalesce(F.try_divide(F.col("n_total") * F.lit(100.0), F.col("test_set_size")), F.lit(0.0))
    return picked, stats.withColumn("coverage", share)


def augment(labelled: DataFrame, pseudo: DataFrame, key: str, max_fraction: float, seed: int = 42) -> DataFrame:
    """PL5: union the pool with pseudo rows capped at int(n * f / (1 - f)) by random pick."""
    n = labelled.count()
    cap = int(n * max_fraction / (1 - max_fraction))
    ranked = ranked_strata(pseudo, key, [], seed, "augment")
    picked = ranked.filter(F.col("_rank") <= cap).drop("_h", "_rank", "_n")
    return (labelled.withColumn("is_pseudo", F.lit(False))
            .unionByName(picked.withColumn("is_pseudo", F.lit(True)), allowMissingColumns=True))
