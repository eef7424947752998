"""Cases past limits that results must not depend on."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ensemble as E
from tessera.operators import features as FE
from tessera.operators import matrix as MX
from tessera.operators import models as M
from tessera.operators.anneal import anneal_fold
from tessera.operators.sampling import stratum_quotas
from tessera.operators.spaces import CLASSIFIER_SPACES, draw
from tessera.session import ensure_checkpoint_dir

NAN = float("nan")


def test_boosting_rounds_pass_through(spark):
    assert M.ml_estimator("gradient_boosting", {"max_iter": 100}).getMaxIter() == 100
    with pytest.raises(ValueError):
        M.ml_estimator("random_forest", {"max_depth": 31})


def test_failed_model_spoils_its_own_pairs_only(spark):
    rng = np.random.default_rng(0)
    x = rng.random((60, 4))
    rows = [(i, m, None if m == 3 or (m == 2 and i < 5) else float(x[i, m])) for i in range(60) for m in range(4)]
    mat = E.correlation_matrix(spark.createDataFrame(rows, "row_id long, model_id int, p double"), [0, 1, 2, 3])
    assert mat[0, 1] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])
    assert mat[0, 2] == pytest.approx(np.corrcoef(x[5:, 0], x[5:, 2])[0, 1])
    assert np.isnan(mat[:, 3]).all() and math.isnan(E.diversity(mat)) and not math.isnan(E.diversity_abs(mat))


def test_kde_of_many_values_equals_the_exact_sum(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=4000), rng.normal(20, 0.1, 2000)])
    kde = MX.KDEDensity("x").fit(spark.createDataFrame([(float(v),) for v in x], "x double"))
    got = {r["x"]: r["density"] for r in kde.density_table(spark.createDataFrame([(float(v),) for v in x[::40]], "x double")).collect()}
    var = x.var(ddof=1) * len(x) ** -0.4
    exact = {v: np.exp(-0.5 / var * (v - x) ** 2).sum() / (len(x) * math.sqrt(2 * math.pi * var)) for v in got}
    peak = max(exact.values())
    assert max(abs(got[v] - exact[v]) for v in got) < 2e-4 * peak
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert {r["kde_x"] for r in MX.KDEDensity("x").fit(const).transform(const).collect()} == {3.0}


def test_yeo_johnson_lambda_beyond_the_first_bracket(spark):
    x = np.random.default_rng(2).normal(10, 0.5, 400) ** 0.2
    pt = MX.PowerTransformer(["x"]).fit(spark.createDataFrame([(float(v),) for v in x], "x double"))

    def likelihood(lam):
        y = ((x + 1) ** lam - 1) / lam
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.log1p(x).sum()

    lam = pt.state["lambda"]["x"]
    assert lam > 2 and all(likelihood(lam) >= likelihood(lam + d) - 1e-6 for d in (-0.5, -0.01, 0.01, 0.5))


def test_kmeans_refuses_dirty_rows(spark):
    with pytest.raises(Exception, match="null|NaN"):
        MX.KMeansFeatures(["x"], k=2).fit(spark.createDataFrame([(1.0,), (None,), (2.0,), (9.0,)], "x double"))


def test_repeated_pairs_keep_their_number(spark):
    op = FE.RandomPairs(["a", "b"], "sum", 9, seed=1)
    out = op.transform(spark.createDataFrame([(1.0, 2.0)], "a double, b double"))
    assert len(out.columns) == len(set(op.outputs())) == 9


def test_levels_beyond_any_default_and_a_limit(spark):
    df = spark.range(25_000).select(F.col("id").cast("string").alias("c"))
    from tessera.operators.stats import distinct_levels

    assert len(distinct_levels(df, ["c"])["c"]) == 25_000
    with pytest.raises(ValueError):
        distinct_levels(df, ["c"], 10)


@pytest.mark.parametrize("p_norm", [1, 2])
def test_knn_in_tiles_equals_brute_force(monkeypatch, p_norm):
    rng = np.random.default_rng(3)
    x, q, keys = rng.integers(0, 4, (50, 3)).astype(float), rng.integers(0, 4, (31, 3)).astype(float), rng.permutation(50)
    monkeypatch.setattr(M, "TILE_CELLS", 120)
    dist, near = M.knn_top(q, x, keys, 4, p_norm)
    for i in range(len(q)):
        d = np.abs(q[i] - x).sum(1) if p_norm == 1 else np.sqrt(((q[i] - x) ** 2).sum(1))
        best = np.lexsort((keys, d))[:4]
        assert near[i].tolist() == best.tolist() and np.allclose(dist[i], d[best])


def test_a_step_without_score_is_rejected(spark):
    rows = [(1, 0, 0.5, 0.1), (1, 1, NAN, 0.1), (1, 2, 0.6, 0.1), (1, 3, None, 0.1), (1, 4, 0.7, 0.1)]
    df = spark.createDataFrame(rows, "run_id long, iteration_num long, stage1_val_auc double, temperature double")
    for chunk in (2, 1 << 20):
        got = {r["iteration_num"]: (r["accepted"], r["current_score"]) for r in anneal_fold(df, chunk=chunk).collect()}
        assert got[1] == (False, 0.5) and got[2] == (True, 0.6) and got[3] == (False, 0.6) and got[4] == (True, 0.7)


def test_rows_without_score_are_rejected(spark):
    df = spark.createDataFrame([(1, NAN, 0.5, 0.1), (2, None, 0.5, 0.1), (3, 0.6, 0.5, 0.1)], "k long, s double, c double, t double")
    assert [r["accepted"] for r in E.acceptance_columns(df, "s", "c", "t", "k").orderBy("k").collect()] == [False, False, True]


def test_temperature_controls():
    t = E.Temperature(0.5)
    assert t.decay(0.5) == 0.25 and t.increase(1.2) == pytest.approx(0.3) and t.increase(9) == 0.999
    for bad in (lambda: E.Temperature(1.0), lambda: t.decay(0.0), lambda: t.increase(0.9)):
        with pytest.raises(ValueError):
            bad()


def test_quotas_and_draws():
    assert stratum_quotas({0: 70, 1: 30}, 33) == {0: 23, 1: 10} and sum(stratum_quotas({0: 1, 1: 1, 2: 1}, 2).values()) == 2
    for name, space in CLASSIFIER_SPACES.items():
        for key in range(20):
            got = draw(space, 42, name, key)
            assert ("size_3" in got) == (name == "mlp" and got["n_layers"] == 3)


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    monkeypatch.setattr("tessera.session.ship_package", lambda s: None)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_kmeans_starts_in_one_pass_take_the_least_cost(spark):
    """Ten starts reach the cost of the true centres, no worse than any one start; the centres are the
    means of their rows; fewer rows than centres and equal rows are no failure."""
    rng = np.random.default_rng(8)
    true = np.array([[0, 0], [6, 0], [0, 6], [6, 6], [3, 12]], dtype=float)
    x = np.concatenate([c + rng.normal(0, 0.4, (120, 2)) for c in true])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").repartition(5)
    km = MX.KMeansFeatures(["a", "b"], k=5, seed_rows=200).fit(df)
    got = np.array(km.state["centers"])
    label = ((x[:, None] - got) ** 2).sum(-1).argmin(1)
    assert len(km.state["costs"]) == 10 and km.state["cost"] == min(km.state["costs"])
    assert km.state["cost"] == pytest.approx(((x - got[label]) ** 2).sum())
    assert np.abs(got[np.abs(got[:, None] - true).sum(-1).argmin(0)] - true).max() < 0.3
    assert np.allclose(got, [x[label == j].mean(0) for j in range(5)], atol=1e-6)
    same = spark.createDataFrame([(1.0, 2.0)] * 3, "a double, b double")
    assert MX.KMeansFeatures(["a", "b"], k=4).fit(same).state["cost"] == 0.0
