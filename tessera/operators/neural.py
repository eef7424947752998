"""A perceptron with relu, tanh or logistic layers and L2, trained by epochs in the tasks.

An epoch is one pass: every task starts from the same weights and Adam moments, takes Adam steps
over its own rows in batches of ``batch_rows`` and gives its weights and moments back, weighted by
its rows; one aggregation averages them. A task holds a batch of rows and the weights, and the
driver the weights. The result depends on how the rows are dealt to tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..session import ship_package
from .trees import _values, with_score

ACTIVATIONS = {"relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
               "tanh": (np.tanh, lambda a: 1 - a * a),
               "logistic": (lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1 - a))}


class Net:
    """Layers of ``sizes`` (inputs, hidden ..., 1) over one flat vector of weights."""

    def __init__(self, sizes: list[int], activation: str):
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {activation}")
        self.shapes, self.activation = list(zip(sizes[:-1], sizes[1:])), activation
        self.size = sum((a + 1) * b for a, b in self.shapes)

    def layers(self, flat: np.ndarray):
        out, at = [], 0
        for a, b in self.shapes:
            out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def start(self, seed: int) -> np.ndarray:
        rng, factor = np.random.default_rng(seed), 2.0 if self.activation == "logistic" else 6.0
        parts = []
        for a, b in self.shapes:
            most = np.sqrt(factor / (a + b))
            parts += [rng.uniform(-most, most, a * b), rng.uniform(-most, most, b)]
        return np.concatenate(parts)

    def _forward(self, flat, x):
        outs, layers, act = [x], self.layers(flat), ACTIVATIONS[self.activation][0]
        for i, (w, b) in enumerate(layers):
            z = outs[-1] @ w + b
            outs.append(z if i == len(layers) - 1 else act(z))
        return outs

    def margin(self, flat, x):
        return self._forward(flat, x)[-1][:, 0]

    def loss(self, flat, x, y, alpha):
        """Mean log loss and alpha / 2n of the squared weights (not the offsets)."""
        return np.logaddexp(0, self.margin(flat, x) * (1 - 2 * y)).mean() + alpha / (2 * len(x)) * sum((w * w).sum() for w, _ in self.layers(flat))

    def gradient(self, flat, x, y, alpha):
        outs, layers, slope = self._forward(flat, x), self.layers(flat), ACTIVATIONS[self.activation][1]
        delta = (1 / (1 + np.exp(-outs[-1])) - y[:, None]) / len(x)
        parts = []
        for i in reversed(range(len(layers))):
            w = layers[i][0]
            parts += [delta.sum(0), (outs[i].T @ delta + alpha / len(x) * w).ravel()]
            if i:
                delta = (delta @ w.T) * slope(outs[i])
        return np.concatenate(parts[::-1])


class MLP:
    def __init__(self, features, label="label", hidden=(32,), activation="relu", alpha=1e-4, learning_rate_init=1e-3, max_iter=100,
                 batch_rows=200, validation_fraction=0.1, n_iter_no_change=10, tol=1e-4, seed=42):
        self.features, self.label, self.alpha, self.rate, self.max_iter = list(features), label, alpha, learning_rate_init, max_iter
        self.batch, self.held, self.patience, self.tol, self.seed = batch_rows, validation_fraction, n_iter_no_change, tol, seed
        self.sizes, self.activation, self.state = [len(self.features), *hidden, 1], activation, {}
        Net(self.sizes, activation)

    def _epoch(self, rows, names, net, state, steps):
        alpha, rate, size = self.alpha, self.rate, self.batch

        def run(batches):
            import pyarrow as pa

            w, m, v = (a.copy() for a in state)
            n, t = 0, steps
            for b in batches:
                x, y = _values(b, names), b.column("y").to_numpy(zero_copy_only=False)
                for i in range(0, len(x), size):
                    xs, ys = x[i:i + size], y[i:i + size]
                    g = net.gradient(w, xs, ys, alpha)
                    t += 1
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                    n += len(xs)
            if n:
                k = len(w)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *[pa.array(a * n) for a in (w, m, v)], pa.array(np.full(k, float(n))),
                                                  pa.array(np.full(k, float(t)))], names=["i", "w", "m", "v", "n", "t"])

        got = rows.mapInArrow(run, "i long, w double, m double, v double, n double, t double")
        out, last = np.zeros((3, net.size)), steps
        for r in got.groupBy("i").agg(*[F.sum(c).alias(c) for c in "wmvn"], F.max("t").alias("t")).collect():  # a row per weight
            out[:, r["i"]] = r["w"] / r["n"], r["m"] / r["n"], r["v"] / r["n"]
            last = int(r["t"])
        return out, last

    def _held_loss(self, rows, names, net, flat) -> float | None:
        def run(batches):
            import pyarrow as pa

            total = np.zeros(2)
            for b in batches:
                z = net.margin(flat, _values(b, names)) * (1 - 2 * b.column("y").to_numpy(zero_copy_only=False))
                total += np.logaddexp(0, z).sum(), len(z)
            yield pa.RecordBatch.from_arrays([pa.array(total[:1]), pa.array(total[1:])], names=["loss", "n"])

        r = rows.mapInArrow(run, "loss double, n double").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
        return r["loss"] / r["n"] if r["n"] else None

    def fit(self, df: DataFrame, key: str = "row_id") -> "MLP":
        """Ends when the loss of the held rows (by hash of ``key``) hasn't fallen by ``tol`` in
        ``n_iter_no_change`` epochs and keeps the weights with the least."""
        ship_package(df.sparkSession)
        names, net = [f"x{i}" for i in range(len(self.features))], Net(self.sizes, self.activation)
        held = hash_uniform(self.seed, "mlp-held", key) < self.held if self.held > 0 else F.lit(False)
        rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(self.features, names)], F.col(self.label).cast("double").alias("y"),
                         held.alias("held")).persist(StorageLevel.MEMORY_AND_DISK)
        state, steps, losses = np.stack([net.start(self.seed), np.zeros(net.size), np.zeros(net.size)]), 0, []
        if rows.where(~F.col("held")).isEmpty():
            raise ValueError("a perceptron needs rows")
        best = (np.inf, state[0])
        for _ in range(self.max_iter):
            state, steps = self._epoch(rows.where(~F.col("held")), names, net, state, steps)
            loss = self._held_loss(rows.where("held"), names, net, state[0]) if self.held > 0 else None
            if loss is None:
                best = (np.inf, state[0])
                continue
            losses.append(loss)
            if loss < best[0]:
                best = (loss, state[0])
            known = losses[:-self.patience]
            if known and min(losses[-self.patience:]) > min(known) - self.tol:
                break
        rows.unpersist()
        self.state = {"sizes": self.sizes, "activation": self.activation, "weights": best[1].tolist(), "losses": losses}
        return self

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        net, flat = Net(self.state["sizes"], self.state["activation"]), np.array(self.state["weights"])
        return with_score(df, self.features, lambda x: 1 / (1 + np.exp(-net.margin(flat, x))), out)
