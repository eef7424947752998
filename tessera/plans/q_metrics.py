"""Metric queries (MT1-MT4, MT8-MT10) on the long prediction table (B4) and the resource
table (B9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators.metrics import auc, confusion, invert_memory, invert_runtime, normalized_confusion, scaling_model
from ..sources import views as V
from .registry import register
from .sqlv import with_views


def auc_sql(src: str, score: str, by: str) -> str:
    return f"""g AS (SELECT {by}, {score} AS s, sum(label) AS pos, count(*) - sum(label) AS neg FROM {src} GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM g),
a AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c GROUP BY {by})"""


@register("mt1_auc_per_model", ids=("MT1", "D4"), sql=lambda: with_views("preds", extra=auc_sql("preds", "score", "model_id")) + """
SELECT model_id, round(auc, 6) AS auc, n_pos, n_neg FROM a""")
def mt1_auc_per_model(spark, d):
    """MT1: exact tie-corrected AUC for all 64 models in one pass (prefix sums over distinct
    scores, chunked per model)."""
    a = auc(V.preds(spark, d), "score", "label", by=["model_id"])
    return a.select("model_id", r6("auc").alias("auc"), "n_pos", "n_neg")


@register("mt2_mt3_confusion", ids=("MT2", "MT3"), sql=lambda: with_views("preds") + """
SELECT model_id, CAST(count_if(p < 0.5 AND label = 0) AS BIGINT) AS tn, CAST(count_if(p >= 0.5 AND label = 0) AS BIGINT) AS fp,
  CAST(count_if(p < 0.5 AND label = 1) AS BIGINT) AS fn, CAST(count_if(p >= 0.5 AND label = 1) AS BIGINT) AS tp,
  round(avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM preds GROUP BY model_id""")
def mt2_mt3_confusion(spark, d):
    c = confusion(V.preds(spark, d), "p", "label", 0.5, by=["model_id"])
    return c.withColumn("accuracy", r6("accuracy"))


@register("mt4_normalized_confusion", ids=("MT4",), sql=lambda: with_views("preds") + """
, x AS (SELECT model_id, label, CAST(p >= 0.5 AS INTEGER) AS pred FROM preds),
c AS (SELECT model_id, label, pred, count(*) AS count FROM x GROUP BY 1, 2, 3)
SELECT model_id, label, pred, count, round(count / sum(count) OVER (PARTITION BY model_id, label), 6) AS rate FROM c""")
def mt4_normalized_confusion(spark, d):
    p = V.preds(spark, d).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return normalized_confusion(p, "pred", "label", by=["model_id"]).withColumn("rate", r6("rate"))


@register("mt8_auc_on_hard_labels", ids=("MT8",), sql=lambda: with_views(
    "preds", extra="h AS (SELECT model_id, CAST(p >= 0.5 AS DOUBLE) AS hard, label FROM preds), " + auc_sql("h", "hard", "model_id")) + """
SELECT model_id, round(auc, 6) AS auc_hard FROM a""")
def mt8_auc_on_hard_labels(spark, d):
    """MT8: the reference's quirk of scoring AUC on hard 0/1 predictions."""
    h = V.preds(spark, d).withColumn("hard", (F.col("p") >= 0.5).cast("double"))
    return auc(h, "hard", "label", by=["model_id"]).select("model_id", r6("auc").alias("auc_hard"))


@register("mt9_mt10_scaling_model", ids=("MT9", "MT10"), sql=lambda: with_views("sizes") + """
, z AS (SELECT *, (sample_size / 1000.0) * (sample_size / 1000.0) * n_iter AS zr,
               (sample_size / 1000.0) * (sample_size / 1000.0) AS zm FROM sizes),
f AS (SELECT regr_slope(runtime_seconds, zr) AS slope, regr_intercept(runtime_seconds, zr) AS intercept,
             regr_r2(runtime_seconds, zr) AS r2, regr_slope(peak_memory_mb, zm) AS m_slope,
             regr_intercept(peak_memory_mb, zm) AS m_intercept, regr_r2(peak_memory_mb, zm) AS m_r2 FROM z),
e AS (SELECT sqrt(avg((runtime_seconds - (intercept + slope * zr)) * (runtime_seconds - (intercept + slope * zr)))) AS rmse FROM z, f)
SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(rmse, 6) AS rmse,
  round(m_slope, 6) AS m_slope, round(m_intercept, 6) AS m_intercept, round(m_r2, 6) AS m_r2,
  greatest(1, CAST(floor((3600.0 - intercept) / slope / ((5000 / 1000.0) * (5000 / 1000.0))) AS BIGINT)) AS n_iter_for_hour,
  CASE WHEN (2048.0 - m_intercept) / m_slope > 0 THEN greatest(1, CAST(floor(1000.0 * sqrt((2048.0 - m_intercept) / m_slope)) AS BIGINT)) ELSE 1 END AS size_for_2gb
FROM f, e""")
def mt9_mt10_scaling_model(spark, d):
    """MT9 runtime/memory scaling regressions with residual RMSE and MT10 inversions, as
    expressions over the fitted one-row frames (no driver round trip)."""
    s = V.sizes(spark, d)
    f = scaling_model(s, "sample_size", "n_iter", "runtime_seconds")
    m = scaling_model(s, "sample_size", "n_iter", "peak_memory_mb", by_memory=True)
    m = m.select(*[F.col(c).alias(f"m_{c}") for c in ("slope", "intercept", "r2")])
    out = f.crossJoin(F.broadcast(m))  # one row each
    return out.select(*[r6(c).alias(c) for c in ("slope", "intercept", "r2", "rmse", "m_slope", "m_intercept", "m_r2")],
                      invert_runtime(F.col("slope"), F.col("intercept"), 3600.0, 5000.0).alias("n_iter_for_hour"),
                      invert_memory(F.col("m_slope"), F.col("m_intercept"), 2048.0).alias("size_for_2gb"))
