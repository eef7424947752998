"""Hand-made edge frames C1-C13 (FIXTURES part C)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ensemble as E
from tessera.operators import features as FE
from tessera.operators import pseudo as PL
from tessera.operators.logs import batch_summary, run_summary, worker_summary
from tessera.operators.metrics import auc
from tessera.operators.sampling import stratified_split

NAN, INF = float("nan"), float("inf")


def test_c1_median_fill(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0, NAN, INF, -INF, None])], "id long, x double")
    op = FE.CleanNumeric(["x"], "median").fit(df)
    assert op.state["fill"]["x"] == 2.5
    out = [r["x"] for r in op.transform(df).orderBy("id").collect()]
    assert out == [1.0, 2.0, 3.0, 10.0, 2.5, 2.5, 2.5, 2.5]


def test_c2_all_nan_column(spark):
    df = spark.createDataFrame([(1, NAN, 1.0), (2, NAN, 2.0)], "id long, x double, y double")
    a = FE.CleanNumeric(["x", "y"], "median").fit(df)
    assert [r["x"] for r in a.transform(df).collect()] == [0.0, 0.0]
    b = FE.CleanNumeric(["x", "y"], "median", drop_empty=True).fit(df)
    assert "x" not in b.transform(df).columns and b.outputs() == ["y"]


def test_c3_all_constant_keeps_first(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0)], "a double, b double")
    op = FE.VarianceFilter(["a", "b"]).fit(df)
    assert op.outputs() == ["a"]


def test_c4_unseen_category(spark):
    fit = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    new = spark.createDataFrame([("w",)], "c string")
    o = FE.OrdinalEncode(["c"]).fit(fit)
    assert o.transform(new).first()["c"] == -1.0
    h = FE.OneHot(["c"]).fit(fit)
    r = h.transform(new).first()
    assert h.outputs() == ["c_y", "c_z"] and r["c_y"] == 0.0 and r["c_z"] == 0.0


def test_c5_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.3, 1), (0.3, 0), (0.3, 1), (0.3, 0)], "s double, label int")
    assert auc(df, "s", "label").first()["auc"] == 0.5
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, label int")
    assert auc(one, "s", "label").first()["auc"] is None


def test_c6_diversity_cases():
    with pytest.raises(ValueError):
        E.diversity(np.array([[1.0]]))
    assert E.diversity(np.array([[1.0, 1.0], [1.0, 1.0]])) == 1.0
    m = np.array([[1.0, NAN, 0.5], [NAN, 1.0, NAN], [0.5, NAN, 1.0]])
    assert math.isnan(E.diversity(m))
    assert E.diversity_abs(m) == 0.5
    assert E.diversity_abs(np.array([[1.0]])) == 0.0


def test_c7_acceptance(spark):
    df = spark.createDataFrame([(0.8, 0.7, 0.01), (0.7, 0.7, 0.01), (0.69, 0.7, 0.01)], "c double, cur double, t double")
    d = F.col("c") - F.col("cur")
    acc, prob, reason = E.acceptance(d, F.col("t"), F.lit(0.3))
    rows = df.select(acc.alias("a"), prob.alias("p"), reason.alias("r")).collect()
    assert rows[0]["a"] and rows[1]["a"]
    # exp(-0.01 / 0.01) = 0.3679 > 0.3 -> accepted
    assert rows[2]["a"] and abs(rows[2]["p"] - math.exp(-1.0)) < 1e-6
    acc2, _, _ = E.acceptance(d, F.col("t"), F.lit(0.5))
    assert not df.select(acc2.alias("a")).collect()[2]["a"]


def test_c8_ratio_quota():
    assert PL.quotas_ratio({1: 2, 0: 100}, 0.3) == {1: 2, 0: 4}


def test_c9_pseudo_empty_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.55)], "row_id long, p double")
    assert PL.confident(df, 0.8).count() == 0
    one = spark.createDataFrame([(1, 0.95), (2, 0.99)], "row_id long, p double")
    c = PL.confident(one, 0.8)
    q = PL.quotas_balance(PL.class_counts(c))
    assert q == {1: 2}


def test_c10_duplicate_bin_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 10 + list(range(1, 11))], "x double")
    b = FE.Binning(["x"], 4, "quantile").fit(df)
    edges = b.state["edges"]["x"]
    assert len(edges) == len(set(edges)) < 5


def test_c11_pair_with_one_input(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    for kind, want in [("ratio", 2.0 / (2.0 + 1e-8)), ("product", 4.0), ("difference", 0.0), ("sum", 4.0)]:
        op = FE.RandomPairs(["x"], kind, 1)
        assert op.state["pairs"] == [(0, 0)]
        assert abs(op.transform(df).first()[op.outputs()[0]] - want) < 1e-12


def test_c12_empty_log(spark):
    empty = spark.createDataFrame([], "worker_id long, status string, runtime_sec double, batch_num int")
    r = worker_summary(empty).first()
    assert r["total"] == 0 and r["avg_runtime"] == 0.0 and r["max_batch"] == 0
    log = spark.createDataFrame([], "run_id long, iteration_num long, accepted int, timeout int, num_models long, "
                                    "stage1_val_auc double, temperature double, timestamp timestamp")
    assert run_summary(log).count() == 0
    whole = run_summary(log, by=[]).first()
    assert (whole["total"], whole["accepted"], whole["ensemble_size"], whole["best_auc"], whole["last_temperature"]) == (0, 0, 0, 0.0, 0.0)
    assert whole["aggregation"] == "N/A" and whole["models_per_hour"] == 0.0 and whole["last_time"] is None
    jobs = spark.createDataFrame([], "classifier_type string, batch_num int")
    assert tuple(batch_summary(jobs, F.lit(1)).first()) == (0, 0, 0.0, "")
    assert batch_summary(jobs, F.lit(1), by=["batch_num"]).count() == 0


def test_one_call_of_pseudo_labels(spark):
    rows = [(i, 0.9 + i / 1000) for i in range(60)] + [(100 + i, 0.04) for i in range(20)] + [(200, 0.5)]
    df = spark.createDataFrame(rows, "row_id long, p double")

    def run(**options):
        picked, stats = PL.generate(df, "row_id", threshold=0.9, **options)
        return {r["pseudo_label"]: r["count"] for r in picked.groupBy("pseudo_label").count().collect()}, stats.first()

    classes, stats = run()
    assert classes == {0: 20, 1: 20} and (stats["n_total"], stats["n_positive"], stats["test_set_size"]) == (40, 20, 81)
    assert run(balance=False)[0] == {0: 20, 1: 60}
    assert run(ratio=0.25)[0] == {0: 20, 1: 6}  # negatives short: int(20 * 0.25 / 0.75) positives
    capped, stats = run(ratio=0.25, max_samples=5)
    assert sum(capped.values()) == stats["n_total"] == 5 and stats["coverage"] == pytest.approx(500 / 81)
    none, stats = PL.generate(df, "row_id", threshold=0.9999)
    assert none.count() == 0 and stats.first()["n_total"] == 0 and stats.first()["mean_confidence"] is None


def test_epoch_records_need_every_column(spark, tmp_path):
    from datetime import datetime

    from tessera.sources import sinks

    row = (datetime(2024, 1, 1), "e", 1, 0.5, 0.6, 0.7, 0.8)
    df = spark.createDataFrame([row], sinks.EPOCH_SCHEMA).withColumn("extra", F.lit(1))
    for _ in range(2):
        sinks.append_epochs(df, str(tmp_path / "e"))
    assert [tuple(r) for r in sinks.read_epochs(spark, str(tmp_path / "e")).collect()] == [row, row]
    with pytest.raises(ValueError):
        sinks.append_epochs(df.drop("val_auc"), str(tmp_path / "f"))
    with pytest.raises(Exception, match="epoch records need epoch"):
        sinks.append_epochs(df.withColumn("epoch", F.lit(None).cast("long")), str(tmp_path / "f"))


def test_constant_columns_stay_as_fitted(spark):
    train = spark.createDataFrame([(1, 1.0, 5.0, None), (2, 2.0, 5.0, None)], "k long, a double, b double, c double")
    other = spark.createDataFrame([(3, 1.0, 6.0, 7.0)], "k long, a double, b double, c double")
    op = FE.DropConstant(["a", "b", "c"]).fit(train)
    assert op.transform(other).columns == ["k", "a"] and op.outputs() == ["a"]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_c13_partition_invariance(spark, parts):
    rows = [(i, i % 3 == 0 and 1 or 0, (i * 7919 % 1000) / 1000.0) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, label int, s double").repartition(parts)
    sp = {r["row_id"]: r["split"] for r in stratified_split(df, "row_id", "label").collect()}
    a = auc(df, "s", "label").first()["auc"]
    ref = spark.createDataFrame(rows, "row_id long, label int, s double").coalesce(1)
    sp1 = {r["row_id"]: r["split"] for r in stratified_split(ref, "row_id", "label").collect()}
    assert sp == sp1 and abs(a - auc(ref, "s", "label").first()["auc"]) < 1e-12


def test_release_tracked_keeps_results(spark):
    """Library caches can be dropped at any time: results recompute identically."""
    from tessera.plans.q_flagship import flagship
    from tessera.session import release_tracked

    from .conftest import SF001

    df = flagship(spark, SF001)
    a = sorted(tuple(r) for r in df.collect())
    assert release_tracked() >= 1
    b = sorted(tuple(r) for r in df.collect())
    assert a == b
