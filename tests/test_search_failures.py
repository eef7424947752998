"""A candidate that fails or times out, in fitting or in scoring, is a rejected row (EN19)."""

import time

import pytest
from pyspark.sql import functions as F

import tessera.operators.search as S
from tessera.sources import sinks


class Raising:
    def transform(self, df):
        return df.withColumn("p", F.raise_error(F.lit("scoring fails")).cast("double"))


class Constant:
    def transform(self, df):
        return df.withColumn("p", F.col("x") / 100.0)


def test_bad_candidates_become_rejected_rows(spark, tmp_path, monkeypatch):
    pool = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 97).cast("double").alias("x"),
                                   F.when(F.col("id") % 2 == 0, "train").otherwise("val1").alias("split"))

    def fit(spec, train, key="row_id", label="label", check=lambda: None):
        if spec.iteration == 1:
            return [], ["x"], Raising()
        if spec.iteration == 2:
            raise ValueError("fitting fails")
        if spec.iteration == 3:
            for _ in range(100):
                time.sleep(0.1)
                check()
        return [], ["x"], Constant()

    monkeypatch.setattr(S, "fit_pipeline", fit)
    cfg = S.SearchConfig(n_batches=1, batch_size=4, timeout_sec=5.0, models=["naive_bayes"])
    res = S.run_search(spark, pool, ["x"], cfg, str(tmp_path / "s"))
    log = {r["iteration_num"]: r for r in sinks.read_log(spark, res["log"]).collect()}
    assert [log[i]["accepted"] for i in (1, 2, 3)] == [False] * 3
    assert [log[i]["timeout"] for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert log[1]["rejection_reason"].startswith("error") and log[2]["rejection_reason"] == "error: ValueError" and log[3]["rejection_reason"] == "timeout"
    assert log[4]["stage1_val_auc"] > 0 and [it for _, it in res["final"]["accepted"]] == ([4] if log[4]["accepted"] else [])


def test_resume_query_runs_the_whole_search():
    """The resumed search has the batches and the pool of models of the search query: founder and six candidates."""
    from tessera.plans.registry import load_all

    assert load_all()["s13_resume_search"].oracle().startswith("SELECT 7 AS n_logged")


@pytest.mark.parametrize("rows, parts", [(1 << 14, 1), (100, 3)])
def test_meta_learner_fits_in_partitions_its_rows_fill(spark, monkeypatch, rows, parts):
    """Before, each pass of a fit had a task for every partition of the frame."""
    from pyspark.ml.classification import LogisticRegression

    seen, fit = [], LogisticRegression.fit

    def counted(self, df, params=None):
        seen.append((df.rdd.getNumPartitions(), df.count()))
        return fit(self, df, params)

    monkeypatch.setattr(LogisticRegression, "fit", counted)
    monkeypatch.setattr(S, "META_ROWS", rows)
    p = (F.col("row_id") % 10) / 10
    frame = spark.range(300, numPartitions=12).select(
        F.col("id").alias("row_id"), ((F.col("id") % 10 + F.col("id") % 7) > 7).cast("int").alias("label")).withColumn("v", F.array(p, 1 - p * p))
    frame = frame.withColumn("part", F.when(F.col("row_id") < 250, "meta_train").otherwise("meta_holdout"))
    got = S.meta_learner(frame, 2, "logistic", n_draws=2)
    assert {n for n, _ in seen} == {parts} and len(seen) == 3
    assert seen[0][1] == seen[1][1] < seen[2][1] == 250  # the last fit has every row
    assert (got["n_train"], got["n_holdout"]) == (250, 50) and got["meta_auc"] > 0.7


def test_searches_and_replays_read_written_rows(spark, tmp_path, monkeypatch):
    """Before, each plan of a search held the plan of the pool, and the driver ran out of memory by them."""
    import tessera.plans.q_search as Q

    pool = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 97).cast("double").alias("x"),
                                   F.when(F.col("id") % 2 == 0, "train").otherwise("val1").alias("split"))
    plans = []

    def fit(spec, train, key="row_id", label="label", check=lambda: None):
        plans.append(train._jdf.queryExecution().toString())
        assert train.count() in (15, 100, 150)  # the founder's tenth, the least sample, all
        return [], ["x"], Constant()

    def scored(df, *a, **b):
        plans.append(df._jdf.queryExecution().toString())
        return auc(df, *a, **b)

    auc = Q.auc
    monkeypatch.setattr(S, "fit_pipeline", fit)
    monkeypatch.setattr(Q, "auc", scored)
    res = S.run_search(spark, pool, ["x"], S.SearchConfig(n_batches=1, batch_size=2, models=["naive_bayes"]), str(tmp_path / "s"))
    assert all(a and b for a, b in Q.replay(spark, res, pool).values())
    assert len(plans) == 5 and not any("Range (" in p for p in plans)


def test_calibration_reads_written_folds(spark, monkeypatch):
    from tessera.operators import pool as P

    seen = []
    monkeypatch.setattr(P.M, "platt_calibrated", lambda folds, fit, label, k: seen.append(folds))
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    P.fit_classifier("ridge", {}, df, ["x"])
    assert "Window" not in seen[0]._jdf.queryExecution().toString()
    assert {r["fold"]: r["count"] for r in seen[0].groupBy("fold").count().collect()} == {0: 20, 1: 20, 2: 20}


def test_pipeline_keeps_few_frames(spark, monkeypatch):
    """Row-local stages are not kept one by one: each would hold the rows once more and the plans before it."""
    import tessera.operators.pipeline as P

    seen = []
    monkeypatch.setattr(P, "fit_classifier", lambda name, params, d, cur, label, key, seed: seen.append((d._jdf.queryExecution().toString(), d.count())))
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), *[(F.col("id") % k).cast("double").alias(f"x{k}") for k in (5, 7)])
    spec = P.PipelineSpec(1, ["x5", "x7"], 0.5, 1.0, "robust", [("square", {}), ("log", {})], ("truncated_svd", {"n_components": 1}), "naive_bayes", {}, 42)
    P.fit_pipeline(spec, df)
    analysed, kept = seen[0][0].partition("== Physical Plan ==")[2], seen[0][1]
    assert analysed.count("InMemoryRelation") == 2 and kept == 60


def test_factors_do_not_depend_on_the_order_of_sums(spark):
    """Between nearly equal variances the last bits of the sums turned the factors."""
    from tessera.operators.matrix import FactorAnalysis

    df = spark.range(10007).select(F.col("id"), ((F.col("id") * 7919) % 10007 / 10007).alias("a"), ((F.col("id") * 4729) % 10007 / 10007).alias("b"))
    states = [FactorAnalysis(["a", "b"], 1).fit(df.repartition(n, "id")).state for n in (1, 3, 7, 16)]
    assert all(s["proj"] == states[0]["proj"] and s["loadings"] == states[0]["loadings"] for s in states)


def test_replayed_means_keep_ties(spark, tmp_path):
    """Before, a row's predictions were added up in the order in which they came: rows with the same ones got other means."""
    from tessera.plans.q_search import replay

    pool = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit("val1").alias("split"))
    p = {1: 0.1, 2: 0.2, 3: 0.3}
    rows = [(i, m, p[m]) for i in range(40) for m in ((1, 2, 3) if i % 2 else (3, 2, 1))]
    spark.createDataFrame(rows, "row_id long, model_id int, p double").coalesce(1).write.parquet(str(tmp_path / "preds"))
    log = [{"iteration_num": i, "stage1_val_auc": 0.5, "accepted": i > 0, "temperature": 0.01, "rejection_reason": ""} for i in range(4)]
    S._write_log(spark, str(tmp_path / "log"), S.SearchConfig(), 1, log)
    got = replay(spark, {"log": str(tmp_path / "log"), "preds": str(tmp_path / "preds"), "run_id": "run-0"}, pool)
    assert got == {i: (True, True) for i in range(4)}
