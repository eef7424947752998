"""Level-wise trees, histogram boosting and the perceptron: parameters take effect, closed forms, gradients."""

import json

import numpy as np
import pandas as pd
import pytest

from tessera.operators.metrics import auc
from tessera.operators.neural import MLP, Net
from tessera.operators.trees import ExtraTrees, HistogramBoosting, route


@pytest.fixture(scope="module")
def board(spark):
    """Two columns whose signs together make the label, and one of noise."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)) & (rng.random(3000) < 0.95)
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(3000), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y.astype(int)}))
    return df.repartition(5).cache()


X = ["a", "b", "c"]


def _auc(model, df):
    scored = model.transform(df)
    assert scored.columns == [*df.columns, "p"] and scored.where("p < 0 or p > 1 or p is null").count() == 0
    return auc(scored, "p", "label").first()["auc"]


def test_extra_trees(board):
    model = ExtraTrees(X, n_estimators=12, max_depth=8, max_features="all", min_samples_leaf=3).fit(board)
    assert _auc(model, board) > 0.9
    again = ExtraTrees(X)
    again.state = json.loads(json.dumps(model.state))
    assert [r["p"] for r in again.transform(board).orderBy("row_id").collect()] == [r["p"] for r in model.transform(board).orderBy("row_id").collect()]
    other = ExtraTrees(X, n_estimators=12, max_depth=8, max_features="all", min_samples_leaf=3).fit(board.repartition(2, "c"))
    assert other.state["feature"] == model.state["feature"] and other.state["cut"] == model.state["cut"]


def test_extra_trees_parameters_take_effect(board):
    def nodes(**options):
        s = ExtraTrees(X, n_estimators=4, max_depth=6, **options).fit(board).state
        return sum(f >= 0 for t in s["feature"] for f in t), s

    plain = nodes(max_features="all")[0]
    assert nodes(max_features="all", min_samples_split=500)[0] < plain > nodes(max_features="all", min_samples_leaf=300)[0]
    assert nodes(max_features="all", min_impurity_decrease=0.6)[0] == 0
    assert nodes(max_features="sqrt")[1]["feature"] != nodes(max_features="all")[1]["feature"]
    _, s = nodes(max_features="all", min_samples_leaf=300)
    rows = board.toPandas()
    for f, c in zip(s["feature"], s["cut"]):
        at = route(rows[X].to_numpy(), np.array(f), np.array(c))
        assert min(np.unique(at, return_counts=True)[1]) >= 300
    with pytest.raises(ValueError):
        ExtraTrees(X, max_depth=17)


def test_boosting(board):
    model = HistogramBoosting(X, max_iter=10, learning_rate=0.5, max_depth=5, max_bins=32).fit(board)
    assert _auc(model, board) > 0.9 and model.state["losses"][-1] < model.state["losses"][0]
    heavy = HistogramBoosting(X, max_iter=1, learning_rate=0.5, max_depth=5, max_bins=32, l2_regularization=1e4).fit(board)
    assert max(abs(v) for v in heavy.state["trees"][0][2]) < max(abs(v) for v in model.state["trees"][0][2]) / 5
    small = HistogramBoosting(X, max_iter=1, max_depth=8, max_leaf_nodes=5, min_samples_leaf=1).fit(board).state["trees"][0]
    assert sum(f >= 0 for f in small[0]) == 4


def test_boosting_stops_on_the_held_rows(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(2000), "a": rng.normal(size=2000), "label": rng.integers(0, 2, 2000)}))
    model = HistogramBoosting(["a"], max_iter=30, learning_rate=1.0, max_depth=6, min_samples_leaf=1, n_iter_no_change=2).fit(df)
    losses = model.state["losses"]
    assert 2 < len(losses) < 30 and min(losses[-2:]) >= min(losses[:-2]) - 1e-7


@pytest.mark.parametrize("activation", ["relu", "tanh", "logistic"])
def test_gradient_of_the_perceptron(activation):
    rng = np.random.default_rng(3)
    net = Net([3, 5, 4, 1], activation)
    flat, x, y = net.start(1), rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    got = net.gradient(flat, x, y, 0.3)
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        assert got[i] == pytest.approx((net.loss(flat + step, x, y, 0.3) - net.loss(flat - step, x, y, 0.3)) / 2e-6, abs=1e-6)


def test_perceptron_learns_and_l2_shrinks(board):
    model = MLP(X, hidden=(12,), activation="tanh", learning_rate_init=0.03, max_iter=25, batch_rows=50).fit(board)
    assert _auc(model, board) > 0.9
    heavy = MLP(X, hidden=(12,), activation="tanh", learning_rate_init=0.03, max_iter=25, batch_rows=50, alpha=100.0).fit(board)
    assert np.abs(heavy.state["weights"]).sum() < np.abs(model.state["weights"]).sum() / 2
    with pytest.raises(ValueError):
        MLP(X, activation="sine")
