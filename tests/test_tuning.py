"""Random search over families: draws, folds, the best, and draws that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.models import LDA, GaussianNB
from tessera.operators.sampling import kfold
from tessera.operators.spaces import log10
from tessera.operators.tuning import draw_trials, random_search


def rank_auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def frame(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, 2)) + np.outer(y, [1.0, 0.3])
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(600)], "row_id long, label int, a double, b double")


def test_draws_cover_families_and_parameters():
    trials = draw_trials(40, {"one": {"p": log10(-3, 0)}, "two": {}})
    assert {t.family for t in trials} == {"one", "two"} and [t.draw for t in trials] == list(range(40))
    values = [t.params["p"] for t in trials if t.family == "one"]
    assert len(set(values)) == len(values) and 1e-3 <= min(values) and max(values) <= 1.0
    assert draw_trials(40, {"one": {"p": log10(-3, 0)}, "two": {}}) == trials


def test_scores_equal_plain_folds_and_failures_lose(spark):
    df = frame(spark)

    def fails(params, train, features, label, key, seed):
        raise ValueError("no fit")

    fits = {"nb": lambda p, t, f, y, key, seed: GaussianNB(f, y, var_smoothing=p["v"]).fit(t), "lda": lambda p, t, f, y, key, seed: LDA(f, y).fit(t),
            "bad": fails}
    spaces = {"nb": {"v": log10(-3, 1)}, "lda": {}, "bad": {}}
    got = random_search(df, ["a", "b"], 7, spaces, fits)
    assert {t.family for t, _, _ in got["trials"]} == set(spaces)
    folds = kfold(df, "row_id", "label", k=3)
    rows = folds.toPandas()
    for t, mean, own in got["trials"]:
        if t.family == "bad":
            assert mean is None and own == [None] * 3
            continue
        for f in range(3):
            model = fits[t.family](t.params, folds.where(F.col("fold") != f), ["a", "b"], "label", "row_id", 42)
            held = folds.where(F.col("fold") == f).select("label", model.decision().alias("s")).toPandas()
            assert own[f] == pytest.approx(rank_auc(held["label"].to_numpy(), held["s"].to_numpy()), abs=1e-12)
        assert mean == pytest.approx(np.mean(own))
    means = [(m, -t.draw, t) for t, m, _ in got["trials"] if m is not None]
    assert got["best"] == max(means, key=lambda z: z[:2])[2] and len(rows) == 600
    assert got["model"].transform(df).where("p > 0 and p < 1").count() == 600
    with pytest.raises(RuntimeError):
        random_search(df, ["a", "b"], 2, {"bad": {}}, fits)


def test_families_of_the_pool(spark):
    got = random_search(frame(spark), ["a", "b"], 2, {"logistic": {"C": 1.0}, "lda": {}})
    assert all(mean > 0.6 for _, mean, _ in got["trials"])
