"""Ensemble algebra on the long prediction table (row_id, model_id, p[, score], label).

EN1/EN2 aggregate per row; EN5-EN9 reduce a model x model Pearson matrix of pairwise sums
that each task adds up for its rows, so no (row, model_a, model_b) pairs are ever emitted.
Only the p x p matrix (p = number of models) reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform


def aggregate_rows(preds: DataFrame, how: str | list[str] = "mean", p: str = "p", strict: bool = False) -> DataFrame:
    """EN1: per-row mean and / or median of model probabilities, clipped to [0, 1], in one
    aggregation (columns ``p_<how>``, or ``p_ens`` for a single one); null (failed) predictions
    are skipped. A row with none left gets null, or with ``strict`` fails the job."""
    kinds = [how] if isinstance(how, str) else list(how)
    fn = {"mean": F.avg, "median": F.median}
    cut = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    names = ["p_ens"] if isinstance(how, str) else [f"p_{h}" for h in kinds]
    out = preds.groupBy("row_id").agg(*[cut(fn[h](p)).alias(c) for h, c in zip(kinds, names)], F.count(p).alias("n_models"))
    if strict:
        ok = F.assert_true(F.col("n_models") > 0, F.lit("no model predicted a row"))
        out = out.withColumn("n_models", F.coalesce(ok.cast("long"), F.col("n_models")))
    return out


def with_failed_as_zeros(preds: DataFrame, models: list[int], p: str = "p") -> DataFrame:
    """EN18: a row of zeros for every (row, model) without a prediction, so a failed model
    counts as zeros; one aggregation per row and one explode over the model list."""
    got = F.map_from_entries(F.collect_list(F.struct("model_id", F.coalesce(F.col(p), F.lit(0.0)).alias("p"))))
    per_row = preds.filter(F.col("model_id").isin(*models)).groupBy("row_id").agg(got.alias("m"), F.max("label").alias("label"))
    ids = F.array(*[F.lit(m) for m in models])
    return (per_row.select("row_id", "label", "m", F.explode(ids).alias("model_id"))
            .select("row_id", "model_id", F.coalesce(F.element_at("m", F.col("model_id")), F.lit(0.0)).alias("p"), "label"))


def hard_label(col: str = "p_ens", threshold: float = 0.5):
    """EN2: label at p >= threshold (inclusive)."""
    return (F.col(col) >= F.lit(threshold)).cast("int")


def hybrid_score(preds: DataFrame, ensemble: list[int], meta_models: list[int], meta: DataFrame | None = None,
                 p: str = "p", carry: list[str] | None = None) -> DataFrame:
    """EN4: no meta-model -> mean of all members; every member in the meta-model -> meta
    prediction; otherwise (meta * n_old + mean(new) * n_new) / n. ``meta`` holds the
    meta-model's probability of each row (row_id, p_meta), trained on ``meta_models``;
    ``carry`` names row-level columns of ``preds`` to keep."""
    inside = set(meta_models) & set(ensemble)
    n_old, n_new = len(inside), len(set(ensemble) - inside)
    old = F.col("model_id").isin(*inside) if inside else F.lit(False)
    g = preds.filter(F.col("model_id").isin(*ensemble)).groupBy("row_id").agg(
        F.avg(F.when(~old, F.col(p))).alias("_new"), *[F.max(c).alias(c) for c in carry or []])
    if n_old == 0:
        return g.select("row_id", *(carry or []), F.col("_new").alias("p_ens"))
    if meta is None:
        raise ValueError("members of a meta-model need its predictions")
    g = g.join(meta.select("row_id", "p_meta"), "row_id")
    share = F.col("p_meta") if n_new == 0 else \
        (F.col("p_meta") * F.lit(float(n_old)) + F.col("_new") * F.lit(float(n_new))) / F.lit(float(n_old + n_new))
    return g.select("row_id", *(carry or []), share.alias("p_ens"))


def evaluate_candidate(scoring: DataFrame, diverse: DataFrame, ensemble: list[int], meta_models: list[int],
                       meta: DataFrame | None = None, p: str = "p") -> dict:
    """EN4 of a candidate ensemble: the tie-exact AUC of its hybrid score on the rows of ``scoring``
    (row_id, model_id, p, label), its mean pairwise correlation on the rows of ``diverse`` and the
    name of the rule that scored it."""
    from .metrics import auc

    inside = len(set(meta_models) & set(ensemble))
    outside = len(set(ensemble)) - inside
    rule = "simple mean" if not inside else "meta-model" if not outside else f"hybrid (meta-model of {inside}, mean of {outside})"
    scored = hybrid_score(scoring, ensemble, meta_models, meta, p, carry=["label"])
    score = auc(scored, "p_ens", "label").first()["auc"]
    spread = diversity(correlation_matrix(diverse, ensemble, p)) if len(ensemble) > 1 else None
    return {"score": score, "diversity": spread, "aggregation": rule}


def wide_matrix(preds: DataFrame, models: list[int], p: str = "p") -> DataFrame:
    """Rows x models (explicit pivot values: no distinct-values job)."""
    return preds.groupBy("row_id").pivot("model_id", models).agg(F.first(p))


def correlation_matrix(preds: DataFrame, models: list[int], p: str = "p", center: float = 0.5) -> np.ndarray:
    """Pearson matrix of the models' predictions, each pair over the rows that both models
    predicted; NaN where a pair has no common rows or no variance (a failed model spoils its
    own pairs only). Rows become vectors, each task adds up its block's pairwise sums around
    ``center`` in one matrix product, and the sums per pair are aggregated: p x p numbers per
    batch, never (row, model, model) pairs."""
    k = len(models)
    at = F.array(*[F.max(F.when(F.col("model_id") == m, F.col(p).cast("double"))) for m in models])
    wide = preds.filter(F.col("model_id").isin(*models)).groupBy("row_id").agg(at.alias("v")).select("v")

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((4, k, k))
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
            there = np.isfinite(flat)
            x, w = np.where(there, flat - center, 0.0), there.astype(float)
            total += np.stack([w.T @ w, x.T @ w, (x * x).T @ w, x.T @ x])
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(t.ravel()) for t in total]],
                                         names=["i", "j", "n", "x", "xx", "xy"])

    parts = wide.mapInArrow(sums, "i long, j long, n double, x double, xx double, xy double")
    got = np.zeros((4, k, k))
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")]).collect():  # k * k rows
        got[:, r["i"], r["j"]] = r["n"], r["x"], r["xx"], r["xy"]
    n, x, xx, xy = got
    with np.errstate(divide="ignore", invalid="ignore"):
        var = xx - x * x / n
        out = (xy - x * x.T / n) / np.sqrt(var * var.T)
        tiny = (var <= 1e-15 * np.maximum(xx, 1e-300)) | (var.T <= 1e-15 * np.maximum(xx.T, 1e-300))
    out[(n < 2) | tiny | ~np.isfinite(out)] = np.nan
    return np.clip(out, -1.0, 1.0)


def pair_values(mat: np.ndarray) -> list[float]:
    k = mat.shape[0]
    return [float(mat[i, j]) for i in range(k) for j in range(i + 1, k)]


def diversity(mat: np.ndarray) -> float:
    """EN5: mean signed pairwise correlation, NaN kept; needs >= 2 models."""
    if mat.shape[0] < 2:
        raise ValueError("diversity needs at least two models")
    return float(np.mean(pair_values(mat)))


def diversity_abs(mat: np.ndarray) -> float:
    """EN6: mean absolute correlation, NaN pairs skipped, < 2 models -> 0."""
    if mat.shape[0] < 2:
        return 0.0
    v = [abs(x) for x in pair_values(mat) if not math.isnan(x)]
    return float(np.mean(v)) if v else 0.0


def detailed_diversity(mat: np.ndarray) -> dict:
    """EN7: mean, min, max, population std, pair count, model count."""
    v = np.array(pair_values(mat))
    return {"mean_corr": float(v.mean()), "min_corr": float(v.min()), "max_corr": float(v.max()),
            "std_corr": float(v.std()), "n_pairs": int(v.size), "n_models": int(mat.shape[0])}


def matrix_frame(spark: SparkSession, mat: np.ndarray, models: list[int]) -> DataFrame:
    """EN8: long form (model_a, model_b, r) of a p x p matrix (O(p^2) values)."""
    rows = [(int(models[i]), int(models[j]), float(mat[i, j])) for i in range(len(models)) for j in range(len(models))]
    return spark.createDataFrame(rows, "model_a int, model_b int, r double")


def acceptance(delta, temperature, u):
    """EN10 row-wise: accept on delta > 0 or delta == 0, else with probability exp(delta/T); a
    delta that is null or not a number is rejected (Spark orders NaN above all numbers, so it
    is tested first). Returns (accepted, probability, reason) columns."""
    bad = delta.isNull() | F.isnan(delta) | temperature.isNull() | F.isnan(temperature)
    prob = F.when(bad, F.lit(0.0)).when(delta >= 0, F.lit(1.0)).otherwise(F.exp(delta / temperature))
    acc = F.when(bad, F.lit(False)).otherwise((delta >= 0) | (u < prob))
    reason = (F.when(bad, "rejected: no score").when(delta > 0, "improvement").when(delta == 0, "equal score")
              .when(u < prob, "annealing accept").otherwise("rejected: worse score"))
    return acc, prob, reason


class Temperature:
    """EN10 controls: a temperature in (0, 1) with multiplicative decay (factor in (0, 1]) and
    increase (factor >= 1, held at 0.999)."""

    MOST = 0.999

    def __init__(self, value: float):
        self.set(value)

    def set(self, value: float) -> None:
        if not 0 < value < 1:
            raise ValueError(f"temperature must be in (0, 1), got {value}")
        self.value = float(value)

    def decay(self, factor: float) -> float:
        if not 0 < factor <= 1:
            raise ValueError(f"decay factor must be in (0, 1], got {factor}")
        self.value *= factor
        return self.value

    def increase(self, factor: float) -> float:
        if factor < 1:
            raise ValueError(f"increase factor must be >= 1, got {factor}")
        raised = self.value * factor
        self.value = self.MOST if raised >= 1 else raised
        return self.value


def acceptance_columns(df: DataFrame, score: str, current: str, temperature: str, key: str, seed: int = 42) -> DataFrame:
    if df.schema[temperature].dataType.simpleString() not in ("double", "float"):
        raise ValueError("temperature must be numeric")
    delta = F.col(score) - F.col(current)
    acc, prob, reason = acceptance(delta, F.col(temperature), hash_uniform(seed, "accept", key))
    return df.withColumn("accepted", acc).withColumn("accept_prob", prob).withColumn("reason", reason)


def retrain_schedule(accepted_log: DataFrame, every: int = 5) -> DataFrame:
    """EN17: retrain the meta-learner every k accepted models; optimise its
    hyper-parameters at batches 1 and 2, then every 3rd; trials 10 / 8 / 5."""
    b = F.floor(F.col("num_models") / every)
    return (accepted_log.filter(F.pmod("num_models", F.lit(every)) == 0)
            .withColumn("retrain_batch", b.cast("int"))
            .withColumn("optimise", (b == 1) | (b == 2) | (F.pmod(b, F.lit(3)) == 0))
            .withColumn("trials", F.when(b == 1, 10).when(b == 2, 8).otherwise(5)))
