"""Exact quantiles equal numpy's at any accuracy of the sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera.operators.stats as ST


@pytest.mark.parametrize("edges, accuracy", [(2, 10), (64, 100), (64, 10_000)])
def test_quantiles_equal_numpy(spark, monkeypatch, edges, accuracy):
    """Values between edges, values that fill whole buckets, several columns at once, bad values."""
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(2500, 0.25), rng.exponential(size=1500)])
    rows = [(float(v), float(i % 3), None, float("nan") if i % 2 else float(i)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0, *np.linspace(0, 1, 101).tolist()]
    monkeypatch.setattr(ST, "EDGES", edges)
    got = ST.exact_quantiles(df, ["x", "y", "z", "w"], probs, accuracy=accuracy)
    assert np.allclose(got["x"], np.quantile(vals, probs), rtol=0, atol=1e-12)
    assert np.allclose(got["y"], np.quantile(np.arange(len(vals)) % 3, probs), rtol=0, atol=1e-12)
    assert got["z"] == [None] * len(probs)
    assert np.allclose(got["w"], np.quantile(np.arange(0, len(vals), 2), probs), rtol=0, atol=1e-9)


def test_skewed_column_never_gathers_rows(spark):
    """No plan of a quantile sorts or windows rows, and a skewed column of 200,000 rows is exact."""
    rng = np.random.default_rng(3)
    vals = np.concatenate([np.exp(rng.normal(0, 6, 100_000)), np.full(60_000, 3.0), -np.exp(rng.normal(0, 3, 40_000))])
    df = spark.createDataFrame(__import__("pandas").DataFrame({"x": vals}))
    probs = [0.001, 0.25, 0.5, 0.75, 0.999]
    assert ST.exact_quantiles(df, ["x"], probs)["x"] == pytest.approx(np.quantile(vals, probs).tolist(), rel=1e-12)
    plan = ST._cells(df, [F.col("x")], {0: [1.0, 2.0]}).groupBy("c", "b").agg(F.count(F.lit(1)))._jdf.queryExecution().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_norm_ppf_and_quantile_normal_output(spark):
    from statistics import NormalDist

    from tessera.operators.matrix import QuantileTransformer, norm_ppf

    ps = [1e-6, 0.01, 0.02425, 0.1, 0.3, 0.5, 0.77, 0.975, 0.99, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(norm_ppf(F.col("p"))).collect()]
    assert max(abs(g - NormalDist().inv_cdf(p)) for g, p in zip(got, ps)) < 1e-8
    x = spark.createDataFrame([(float(i),) for i in range(1000)], "x double")
    qt = QuantileTransformer(["x"], 50, output="normal").fit(x)
    out = qt.transform(x).agg(F.avg("x").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    assert abs(out["m"]) < 1e-6 and out["lo"] < -5 and out["hi"] > 5


@pytest.mark.parametrize("ranges", [2, 16])
def test_grouped_quantiles(spark, ranges):
    """A group of three quarters of the rows, a null group, groups without values and two columns equal
    numpy's quantiles; the hot group's values lie in several ranges."""
    rng = np.random.default_rng(11)
    rows = [("hot", float(v), float(i % 5)) for i, v in enumerate(rng.normal(size=6000))]
    rows += [(None, float(v), None) for v in rng.exponential(size=500)] + [("one", 2.5, 1.0), ("none", None, None)]
    rows += [("same", 7.0, float(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    probs = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {(r["g"], r["column"]): r for r in ST.grouped_quantiles(df, ["g"], ["x", "y"], probs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 10
    for (g, column), r in got.items():
        vals = [row[1 if column == "x" else 2] for row in rows if row[0] == g]
        vals = [v for v in vals if v is not None]
        assert r["n"] == len(vals)
        if vals:
            assert r["q"] == pytest.approx(np.quantile(vals, probs).tolist(), rel=0, abs=1e-12)
            assert (r["least"], r["greatest"]) == (min(vals), max(vals)) and r["mean"] == pytest.approx(np.mean(vals))
        else:
            assert r["q"] == [None] * len(probs) and r["least"] is None
    assert ST.grouped_quantiles(df.limit(0), ["g"], ["x"], probs).count() == 0


def test_quantile_levels_are_placed_in_batches(spark):
    """A value's level is a binary search of a batch, not an expression over the knots for every row."""
    from tessera.operators.matrix import QuantileTransformer

    df = spark.range(3000).select(F.when(F.col("id") % 10 != 0, F.sin("id") * 50).alias("x"))
    qt = QuantileTransformer(["x"], 1000).fit(df)
    out = qt.transform(df.withColumn("raw", F.col("x")))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    raw = np.array([r["raw"] for r in rows if r["raw"] is not None])
    knots, refs = np.quantile(raw, np.linspace(0, 1, 1000)), np.linspace(0, 1, 1000)
    want = 0.5 * (np.interp(raw, knots, refs) - np.interp(-raw, -knots[::-1], -refs[::-1]))
    assert np.abs(np.array([r["x"] for r in rows if r["raw"] is not None]) - want).max() < 1e-9
    assert all(r["x"] is None for r in rows if r["raw"] is None)
    normal = QuantileTransformer(["x"], 100, output="normal").fit(df)
    assert normal.transform(df).where("x is null").count() == 0  # a null is at the clipped lower end


def test_covariance_of_many_columns_with_nulls(spark):
    """Beyond a few columns the pairs aren't aggregates of their own; the numbers are the same."""
    from tessera.operators import matrix as MX
    from tessera.operators import models as M

    cols = [f"c{j}" for j in range(12)]
    df = spark.range(500).select(F.col("id"), (F.col("id") % 2).alias("label"), *[
        F.when(F.col("id") % (7 + j) != 0, F.sin(F.col("id") * (j + 1)) + 1e6).alias(c) for j, c in enumerate(cols)])
    want = df.agg(*[F.covar_samp(a, b).alias(f"{a}_{b}") for a in cols for b in cols]).first()
    _, got, n = MX.covariance(df, cols)
    assert n == 500 and "covar" not in str(MX.covariances.__code__.co_names)
    assert max(abs(got[i, j] - want[f"{a}_{b}"]) for i, a in enumerate(cols) for j, b in enumerate(cols)) < 1e-9
    for k, (rows, _, cov) in M.class_moments(df, cols, "label").items():
        one = df.where(F.col("label") == k).agg(F.covar_pop("c0", "c5").alias("a"), F.count(F.lit(1)).alias("n")).first()
        assert rows == one["n"] and abs(cov[0, 5] - one["a"]) < 1e-9
