"""Metrics (MT1-MT4, MT8-MT10, MT13).

MT1 is the exact, tie-corrected ROC-AUC for many models in one pass:
  1. aggregate the long table (group, model, score, label) to distinct scores with
     positive / negative counts (map-side partial aggregation, volume = distinct scores);
  2. running count of negatives below each score per (group, model): the distinct scores are
     range-partitioned, summed within each range and shifted by the totals of the lower
     ranges (``prefix_sums``), never one task per model;
  3. AUC = sum(pos * (neg_below + 0.5 * neg_equal)) / (P * N).
One class only -> null (the reference raises).
"""

from __future__ import annotations

from ..session import track

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import prefix_sums

def auc(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None,
        out: str = "auc") -> DataFrame:
    by = list(by or [])
    part = by or ["_all"]
    g = (df.groupBy(*by, score)
         .agg(F.sum(F.col(label).cast("bigint")).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
         .withColumn("_neg", F.col("_cnt") - F.col("_pos")))
    if not by:
        g = g.withColumn("_all", F.lit(0))
    # Distinct scores dealt by range: the partition number is a chunk id that is monotone in the
    # score within a group. Kept, as chunk totals and local sums both read it (and a partition
    # number must not be derived twice).
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = track(g.repartitionByRange(n, *part, score).withColumn("_range", F.spark_partition_id().cast("bigint")))
    c = prefix_sums(ranged, part, [score], F.col("_range"), {"_neg_le": F.col("_neg")})
    c = c.withColumn("_below", F.col("_neg_le") - F.col("_neg"))
    res = c.groupBy(*part).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.lit(0.5) * F.col("_neg"))).alias("_num"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    res = res.withColumn(out, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                     F.col("_num") / (F.col("_P").cast("double") * F.col("_N"))))
    return res.select(*by, out, F.col("_P").alias("n_pos"), F.col("_N").alias("n_neg"))


def confusion(df: DataFrame, p: str = "p", label: str = "label", threshold: float = 0.5,
              by: list[str] | None = None) -> DataFrame:
    """MT3: tn, fp, fn, tp at ``p >= threshold``; MT2 accuracy alongside."""
    by = list(by or [])
    pred = F.col(p) >= F.lit(threshold)
    y = F.col(label) == 1
    aggs = [F.count_if(~pred & ~y).alias("tn"), F.count_if(pred & ~y).alias("fp"),
            F.count_if(~pred & y).alias("fn"), F.count_if(pred & y).alias("tp"),
            F.avg(((pred & y) | (~pred & ~y)).cast("double")).alias("accuracy")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def normalized_confusion(df: DataFrame, pred: str, label: str, by: list[str] | None = None) -> DataFrame:
    """MT4: row-normalised confusion matrix (by, label, pred, count, rate)."""
    keys = [*(by or []), label]
    cnt = df.groupBy(*keys, pred).agg(F.count(F.lit(1)).alias("count"))
    tot = cnt.groupBy(*keys).agg(F.sum("count").alias("_tot"))
    return cnt.join(tot, keys).withColumn("rate", F.col("count") / F.col("_tot")).drop("_tot")


def scaling_model(df: DataFrame, x_size: str, x_iter: str, y: str, by_memory: bool = False) -> DataFrame:
    """MT9: runtime = a + c * (S/1000)^2 * N (memory: a + c * (S/1000)^2) by least squares: one
    row with slope, intercept, r2, n and rmse, all from one aggregation (``regr_*``)."""
    z = (F.col(x_size) / 1000.0) * (F.col(x_size) / 1000.0)
    if not by_memory:
        z = z * F.col(x_iter)
    return df.withColumn("_z", z).agg(
        F.regr_slope(y, "_z").alias("slope"), F.regr_intercept(y, "_z").alias("intercept"), F.regr_r2(y, "_z").alias("r2"),
        F.count(F.lit(1)).alias("n"),
        F.sqrt((F.regr_syy(y, "_z") - F.regr_sxy(y, "_z") * F.regr_sxy(y, "_z") / F.regr_sxx(y, "_z")) / F.regr_count(y, "_z")).alias("rmse"))


def invert_runtime(slope: Column, intercept: Column, budget_sec: float, size: float) -> Column:
    """MT10: iterations affordable within a time budget: max(1, floor((t-b)/m/(S/1000)^2))."""
    per = F.lit((size / 1000.0) * (size / 1000.0))
    return F.greatest(F.lit(1), F.floor((F.lit(budget_sec) - intercept) / slope / per)).cast("bigint")


def invert_memory(slope: Column, intercept: Column, budget_mb: float) -> Column:
    """MT10: largest sample within a memory budget: max(1, floor(1000*sqrt((M-b)/c)))."""
    v = (F.lit(budget_mb) - intercept) / slope
    return F.when(v > 0, F.greatest(F.lit(1), F.floor(F.lit(1000.0) * F.sqrt(v)))).otherwise(F.lit(1)).cast("bigint")
