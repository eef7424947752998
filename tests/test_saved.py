"""Every classifier of the pool and whole drawn pipelines: saved, loaded, the same probabilities."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.pipeline import apply_pipeline, draw_spec, fit_pipeline
from tessera.operators.pool import POOL, fit_classifier
from tessera.sources.saved import load_fitted, save_fitted

X = ["a", "b", "c", "d"]
QUICK = {"random_forest": {"n_estimators": 3}, "extra_trees": {"n_estimators": 3}, "adaboost": {"n_estimators": 2}, "mlp": {"max_iter": 2},
         "gradient_boosting": {"max_iter": 2, "max_bins": 16}, "linear_svc": {"max_iter": 5}, "logistic": {"max_iter": 5}, "lasso": {"max_iter": 5}}


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 0.5, 400) > 0).astype(int)
    return spark.createDataFrame(pd.DataFrame({"row_id": range(400), **dict(zip(X, x.T)), "label": y})).repartition(3).cache()


def _far(a, b):
    r = a.select("row_id", "p").join(b.select("row_id", F.col("p").alias("q")), "row_id").agg(
        F.count(F.lit(1)), F.max(F.abs(F.col("p") - F.col("q")))).first()
    return tuple(r)


@pytest.mark.parametrize("name", sorted(POOL))
def test_classifiers(spark, frame, tmp_path, name):
    model = fit_classifier(name, QUICK.get(name, {}), frame, X)
    save_fitted(spark, str(tmp_path / "m"), model)
    assert _far(model.transform(frame), load_fitted(spark, str(tmp_path / "m")).transform(frame)) == (400, 0.0)


def test_pipelines(spark, frame, tmp_path):
    for it in (1, 2, 3, 4):
        spec = draw_spec(X, 9, it, ["naive_bayes"])
        ops, columns, model = fit_pipeline(spec, frame)
        save_fitted(spark, str(tmp_path / str(it)), {"ops": ops, "columns": columns, "model": model, "spec": spec})
        back = load_fitted(spark, str(tmp_path / str(it)))
        assert back["columns"] == columns and back["spec"] == spec
        assert _far(apply_pipeline(ops, model, frame), apply_pipeline(back["ops"], back["model"], frame)) == (400, 0.0)


def test_what_cannot_be_saved_or_loaded(spark, tmp_path):
    with pytest.raises(TypeError):
        save_fitted(spark, str(tmp_path / "f"), {"f": len})
    for bad in ('{"object": "os:system", "attributes": {}}', '{"ml": "subprocess:Popen", "at": "x"}',
                '{"object": "tessera.operators.models:knn_top", "attributes": {}}'):
        spark.createDataFrame([(bad,)], "fitted string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "g" / "fitted"))
        with pytest.raises(ValueError):
            load_fitted(spark, str(tmp_path / "g"))


def test_densities_do_not_depend_on_how_values_are_listed(spark, monkeypatch):
    """Values meet their cell's bins in lists: before, each value had a copy of the bins of three cells."""
    from tessera.operators.matrix import KDEDensity

    x = np.concatenate([np.random.default_rng(3).normal(size=3000), [40.0, 40.0, 90.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
    kde = KDEDensity("x").fit(df)
    got = []
    for size, salts in ((1 << 18, 16), (50, 16), (1 << 18, 1)):
        monkeypatch.setattr(KDEDensity, "LIST", size)
        monkeypatch.setattr(KDEDensity, "SALTS", salts)
        got.append({r["x"]: r["density"] for r in kde.density_table(df).collect()})
    assert got[0] == got[1] == got[2] and set(got[0]) == set(x)
    var = x.var(ddof=1) * len(x) ** -0.4
    for v in (x[0], x[1], 40.0, 90.0):
        want = np.exp(-0.5 * (v - x) ** 2 / var).mean() / np.sqrt(2 * np.pi * var)
        assert abs(got[0][v] - want) < 2e-4 * want


def test_random_pipelines_draw_from_the_whole_pool():
    """Before, the classifiers of the drawn pipelines came from six of the pool's families."""
    from tessera.plans.q_search import _CHAINS, XW

    assert [(s.iteration, s.model, s.params) for s in _CHAINS] == [(s.iteration, s.model, s.params) for s in (draw_spec(XW, 7, it) for it in range(1, 5))]
    assert "knn" in {s.model for s in _CHAINS}
