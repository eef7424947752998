"""Chunked scans equal plain windows, including the multi-chunk paths."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_bits
from tessera.operators.scan import exact_rank, id_chunk, prefix_sums, rolling_rows


def _frame(spark, n=400, groups=3, seed=1):
    rnd = random.Random(seed)
    ids = rnd.sample(range(10 * n), n)
    # one hot group holds about half of the rows
    rows = [(i, 0 if rnd.random() < 0.5 else rnd.randrange(1, groups), rnd.random()) for i in ids]
    return spark.createDataFrame(rows, "id long, g long, v double")


def test_prefix_sums_multichunk(spark):
    df = _frame(spark)
    got = prefix_sums(df, ["g"], ["id"], id_chunk("id", 37), {"s": F.col("v")}, maxes={"m": F.col("v")})
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s2", F.sum("v").over(w)).withColumn("m2", F.max("v").over(w))
    j = got.join(want, ["id", "g", "v"])
    assert j.count() == df.count()
    assert j.filter(F.abs(F.col("s") - F.col("s2")) > 1e-9).count() == 0
    assert j.filter(F.col("m") != F.col("m2")).count() == 0


def test_prefix_sums_exclusive(spark):
    df = _frame(spark, seed=2)
    got = prefix_sums(df, ["g"], ["id"], id_chunk("id", 11), {"c": F.lit(1)}, maxes={"m": F.col("v")}, exclusive=True)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("c2", F.coalesce(F.count(F.lit(1)).over(w), F.lit(0))).withColumn("m2", F.max("v").over(w))
    j = got.join(want, ["id", "g", "v"])
    assert j.filter(F.col("c") != F.col("c2")).count() == 0
    assert j.filter(~F.col("m").eqNullSafe(F.col("m2"))).count() == 0


def test_exact_rank_matches_row_number(spark, monkeypatch):
    import tessera.operators.scan as S

    df = _frame(spark, n=500, seed=3).withColumn("h", hash_bits(7, "t", "id"))
    monkeypatch.setattr(S, "choose_bits", lambda n, target=1 << 16: 5)  # force 32 buckets
    got = exact_rank(df, ["g"], "h", "id", 500)
    w = Window.partitionBy("g").orderBy("h", "id")
    want = df.withColumn("r2", F.row_number().over(w))
    j = got.join(want, ["id", "g", "v", "h"])
    assert j.filter(F.col("_rank") != F.col("r2")).count() == 0


def test_rolling_rows_across_chunks(spark):
    df = _frame(spark, seed=4)
    got = rolling_rows(df, ["g"], "id", 10, {"m": lambda w: F.avg("v").over(w),
                                             "s": lambda w: F.stddev_samp("v").over(w)}, chunk_rows=13)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(-9, 0)
    want = df.withColumn("m2", F.avg("v").over(w)).withColumn("s2", F.stddev_samp("v").over(w))
    j = got.join(want, ["id", "g", "v"])
    assert j.count() == df.count()
    assert j.filter(F.abs(F.col("m") - F.col("m2")) > 1e-9).count() == 0
    assert j.filter(~(F.col("s").isNull() & F.col("s2").isNull()) & (F.abs(F.col("s") - F.col("s2")) > 1e-9)).count() == 0


def test_searchsorted_matches_numpy(spark):
    import numpy as np

    from tessera.operators.scan import searchsorted

    rnd = np.random.default_rng(0)
    edges = sorted(rnd.integers(0, 50, 37).astype(float).tolist())  # with duplicates
    xs = [float(v) for v in rnd.integers(-5, 60, 200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn(
        "e", F.array(*[F.lit(v) for v in edges]))
    got = [r["c"] for r in searchsorted(df, "e", "x", len(edges), "c").collect()]
    want = [int(np.searchsorted(edges, x, side="right")) for x in xs]
    assert got == want
