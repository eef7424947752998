"""The reference's own acceptance tolerances, on fixtures shaped like its test data."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import ensemble as E
from tessera.operators.sampling import stratified_sample, stratified_split


def _labelled(spark, n=1000, pos=0.3, seed=42):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < pos).astype(int)
    return spark.createDataFrame([(i, int(v), float(rng.normal())) for i, v in enumerate(y)], "row_id long, label int, x double")


def test_split_shares_and_class_rates(spark):
    df = _labelled(spark)
    s = stratified_split(df, "row_id", "label")
    n = df.count()
    rate = df.agg(F.avg("label")).first()[0]
    for name, share, tol in [("train", 0.60, 0.05), ("val1", 0.35, 0.05), ("val2", 0.05, 0.10)]:
        part = s.filter(F.col("split") == name)
        assert abs(part.count() / n - share) <= 0.02
        assert abs(part.agg(F.avg("label")).first()[0] - rate) <= tol
    assert s.select("row_id").distinct().count() == n


def test_row_sample_class_rate(spark):
    df = _labelled(spark)
    s = stratified_sample(df, "row_id", "label", 0.4)
    assert s.count() < df.count()
    assert abs(s.agg(F.avg("label")).first()[0] - df.agg(F.avg("label")).first()[0]) <= 0.05


def _long(spark, mats):
    rows = [(r, m, float(mats[m][r])) for m in range(len(mats)) for r in range(len(mats[0]))]
    return spark.createDataFrame(rows, "row_id long, model_id int, p double")


def test_diversity_random_vs_near_copies(spark):
    rng = np.random.default_rng(42)
    rand = [rng.random(100) for _ in range(3)]
    assert E.diversity(E.correlation_matrix(_long(spark, rand), [0, 1, 2])) < 0.3
    base = rng.random(100)
    near = [base + rng.normal(0, 0.01, 100) for _ in range(3)]
    mat = E.correlation_matrix(_long(spark, near), [0, 1, 2])
    assert E.diversity(mat) > 0.8
    assert np.allclose(np.diag(mat), 1.0)
