"""Tree classifiers grown level by level.

Rows stay where they are: a pass sends the trees grown so far to the tasks, which route their rows
to the open nodes and add up what the next splits need, and one aggregation by node brings these
sums to the driver. Their number depends on nodes, features and bins, never on rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, py_uniform
from ..session import ship_package
from .stats import exact_quantiles

#: Nodes are numbered as in a heap (root 1, children 2i and 2i + 1), so depth is bounded.
MOST_DEPTH = 16


def _checked_depth(depth: int) -> int:
    if depth > MOST_DEPTH:
        raise ValueError(f"max_depth {depth} is above {MOST_DEPTH}")
    return depth


def _values(batch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def route(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node that each row ends at: left where its value is at most the cut; -1 marks a leaf."""
    at, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        right = x[rows, np.where(inner, f, 0)] > cut[at]
        at = np.where(inner, 2 * at + right, at)


def _gini(w0: float, w1: float) -> float:
    total = w0 + w1
    return 1 - (w0 * w0 + w1 * w1) / (total * total) if total > 0 else 0.0


class ExtraTrees:
    """M6: extremely randomised trees with balanced class weights. Each node draws ``max_features``
    of its columns that vary and one cut for each, uniform between the node's least and greatest
    value, all by hash; the cut with the greatest fall in Gini impurity splits it. All trees grow
    together: two passes a level, one for the nodes' ranges and one for the cuts' sides."""

    def __init__(self, features, label="label", n_estimators=10, max_depth=5, max_features="sqrt", min_samples_split=2,
                 min_samples_leaf=1, min_impurity_decrease=0.0, seed=42):
        self.features, self.label, self.n, self.seed = list(features), label, n_estimators, seed
        self.depth, self.split_rows, self.leaf_rows = _checked_depth(max_depth), max(2, min_samples_split), max(1, min_samples_leaf)
        p = len(self.features)
        self.tries = {"sqrt": max(1, int(math.sqrt(p))), "log2": max(1, int(math.log2(p))) if p else 1}.get(max_features, p)
        self.least_fall, self.state = min_impurity_decrease, {}

    def fit(self, df: DataFrame) -> "ExtraTrees":
        ship_package(df.sparkSession)
        names = [f"x{i}" for i in range(len(self.features))]
        rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(self.features, names)], F.col(self.label).cast("double").alias("y"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        counts = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}  # one row per class
        total = sum(counts.values())
        self.weights = [total / (len(counts) * counts[k]) if k in counts else 0.0 for k in (0, 1)]
        size = 2 << self.depth
        feature, cut = np.full((self.n, size), -1, dtype=np.int32), np.zeros((self.n, size))
        value = np.full((self.n, size), counts.get(1, 0) / total if total else 0.5)
        open_ = [(t, 1) for t in range(self.n)]
        for level in range(self.depth + 1):
            found = self._ranges(rows, names, feature, cut, open_)
            tries = {}
            for (t, node), (n, ones, lo, hi) in found.items():
                w0, w1 = self._weigh(n, ones)
                value[t, node] = w1 / (w0 + w1)
                if level < self.depth and n >= self.split_rows and w0 > 0 and w1 > 0:
                    drawn = sorted((f for f in range(len(names)) if hi[f] > lo[f]), key=lambda f: py_uniform(self.seed, "et-column", t, node, f))
                    cuts = [(f, lo[f] + (hi[f] - lo[f]) * py_uniform(self.seed, "et-cut", t, node, f)) for f in drawn[:self.tries]]
                    if cuts:
                        tries[t, node] = cuts
            open_ = []
            for (t, node), sides in (self._sides(rows, names, feature, cut, tries) if tries else {}).items():
                n, ones = found[t, node][:2]
                w0, w1 = self._weigh(n, ones)
                best = None
                for (f, c), (left_rows, left_ones) in zip(tries[t, node], sides):
                    if min(left_rows, n - left_rows) < self.leaf_rows:
                        continue
                    l0, l1 = self._weigh(left_rows, left_ones)
                    left, right = l0 + l1, w0 + w1 - l0 - l1
                    fall = ((w0 + w1) * _gini(w0, w1) - left * _gini(l0, l1) - right * _gini(w0 - l0, w1 - l1)) / total
                    if best is None or fall > best[0]:
                        best = (fall, f, c)
                if best and best[0] >= self.least_fall:
                    feature[t, node], cut[t, node] = best[1], best[2]
                    open_ += [(t, 2 * node), (t, 2 * node + 1)]
            if not open_:
                break
        rows.unpersist()
        self.state = {"feature": feature.tolist(), "cut": cut.tolist(), "value": value.tolist()}
        return self

    def _weigh(self, n, ones) -> tuple[float, float]:
        """Balanced weights of both classes; sums of rows are whole, so the trees don't depend on partitions."""
        return (n - ones) * self.weights[0], ones * self.weights[1]

    def _passes(self, rows, names, feature, cut, nodes, new, add, schema):
        """A task's sums ``new()``, to which ``add(sums, x, y, at)`` adds each batch and tree, ``at`` the place of a row's node in ``nodes`` (-1: none)."""
        places = np.full(feature.shape, -1, dtype=np.int64)
        for i, (t, node) in enumerate(nodes):
            places[t, node] = i
        trees = sorted({t for t, _ in nodes})

        def run(batches):
            import pyarrow as pa

            sums = new()
            for b in batches:
                x, y = _values(b, names), b.column("y").to_numpy(zero_copy_only=False)
                for t in trees:
                    at = places[t][route(x, feature[t], cut[t])]
                    here = at >= 0
                    if here.any():
                        add(sums, x[here], y[here], at[here])
            some = np.flatnonzero(sums[0][:, 0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(list(s[some]), type=pa.list_(pa.float64())) for s in sums]],
                                             names=["node", *[f"v{i}" for i in range(len(sums))]])

        return rows.mapInArrow(run, schema)

    def _ranges(self, rows, names, feature, cut, nodes) -> dict:
        """Rows, rows of class 1, least and greatest values of the nodes that have rows."""
        p, k = len(names), len(nodes)

        def new():
            return np.zeros((k, 2)), np.full((k, p), np.inf), np.full((k, p), -np.inf)

        def add(sums, x, y, at):
            sums[0][:, 0] += np.bincount(at, minlength=k)
            sums[0][:, 1] += np.bincount(at, y, minlength=k)
            order = np.argsort(at, kind="stable")
            there, first = np.unique(at[order], return_index=True)
            sums[1][there] = np.minimum(sums[1][there], np.minimum.reduceat(x[order], first, axis=0))
            sums[2][there] = np.maximum(sums[2][there], np.maximum.reduceat(x[order], first, axis=0))

        got = self._passes(rows, names, feature, cut, nodes, new, add, "node long, v0 array<double>, v1 array<double>, v2 array<double>")
        aggs = [F.sum(F.get("v0", F.lit(j))).alias(n) for j, n in enumerate(("n", "ones"))]
        aggs += [F.min(F.get("v1", F.lit(j))).alias(f"lo{j}") for j in range(p)] + [F.max(F.get("v2", F.lit(j))).alias(f"hi{j}") for j in range(p)]
        return {nodes[r["node"]]: (r["n"], r["ones"], [r[f"lo{j}"] for j in range(p)], [r[f"hi{j}"] for j in range(p)])
                for r in got.groupBy("node").agg(*aggs).collect()}

    def _sides(self, rows, names, feature, cut, tries: dict) -> dict:
        """Rows and rows of class 1 left of every drawn cut."""
        nodes, m = list(tries), self.tries
        k = len(nodes)
        columns, cuts = np.zeros((k, m), dtype=np.int64), np.full((k, m), -np.inf)
        for i, key in enumerate(nodes):
            for j, (f, c) in enumerate(tries[key]):
                columns[i, j], cuts[i, j] = f, c

        def new():
            return (np.zeros((k, 1 + 2 * m)),)

        def add(sums, x, y, at):
            total = sums[0]
            total[:, 0] += np.bincount(at, minlength=k)
            every = np.arange(len(x))
            for j in range(m):
                left = x[every, columns[at, j]] <= cuts[at, j]
                total[:, 1 + 2 * j] += np.bincount(at[left], minlength=k)
                total[:, 2 + 2 * j] += np.bincount(at[left], y[left], minlength=k)

        got = self._passes(rows, names, feature, cut, nodes, new, add, "node long, v0 array<double>")
        out = {}
        for r in got.groupBy("node").agg(*[F.sum(F.get("v0", F.lit(i))).alias(f"s{i}") for i in range(1, 1 + 2 * m)]).collect():
            out[nodes[r["node"]]] = [(r[f"s{1 + 2 * j}"], r[f"s{2 + 2 * j}"]) for j in range(len(tries[nodes[r["node"]]]))]
        return out

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        feature, cut, value = (np.array(self.state[k]) for k in ("feature", "cut", "value"))

        def score(x):
            return np.mean([v[route(x, f, c)] for f, c, v in zip(feature, cut, value)], axis=0)

        return with_score(df, self.features, score, out)


def with_score(df: DataFrame, features: list[str], score, out: str) -> DataFrame:
    """``df`` and ``out``, the values that ``score`` gives for batches of the features' rows."""
    ship_package(df.sparkSession)

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(score(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return df.withColumn(out, F.pandas_udf(run, "double")(*[F.col(c).cast("double") for c in features]))


class HistogramBoosting:
    """Gradient boosting of the log loss on binned columns. A level of a tree is one aggregation of
    gradients, Hessians and rows per (node, column, bin); a split has the greatest second-order
    gain, a leaf the value -G / (H + l2). Of a level's splits the best are taken while the tree
    has fewer than ``max_leaf_nodes`` leaves. With ``validation_fraction`` above 0 the rows whose key
    hashes below it are held out, and growing ends when their loss hasn't fallen by ``tol`` in
    ``n_iter_no_change`` rounds. Bin edges are exact quantiles."""

    def __init__(self, features, label="label", max_iter=10, learning_rate=0.1, max_depth=10, min_samples_leaf=20, l2_regularization=0.0,
                 max_bins=255, max_leaf_nodes=31, validation_fraction=0.1, n_iter_no_change=10, tol=1e-7, seed=42):
        self.features, self.label, self.max_iter, self.rate, self.depth = list(features), label, max_iter, learning_rate, _checked_depth(max_depth)
        self.leaf_rows, self.l2, self.bins, self.leaves, self.held = max(1, min_samples_leaf), l2_regularization, max_bins, max_leaf_nodes, validation_fraction
        self.patience, self.tol, self.seed, self.state = n_iter_no_change, tol, seed, {}

    def _raw(self, x, trees, base):
        raw = np.full(len(x), base)
        for feature, cut, value in trees:
            raw += value[route(x, feature, cut)]
        return raw

    def fit(self, df: DataFrame, key: str = "row_id") -> "HistogramBoosting":
        ship_package(df.sparkSession)
        names = [f"x{i}" for i in range(len(self.features))]
        held = hash_uniform(self.seed, "boost-held", key) < self.held if self.held > 0 else F.lit(False)
        rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(self.features, names)], F.col(self.label).cast("double").alias("y"),
                         held.alias("held")).persist(StorageLevel.MEMORY_AND_DISK)
        train = rows.where(~F.col("held"))
        quantiles = exact_quantiles(train, names, [i / self.bins for i in range(1, self.bins)], clean=False)
        edges = [np.unique([v for v in quantiles[n] if v is not None]) for n in names]
        rate = train.agg(F.avg("y").alias("y")).first()["y"]
        if not rate or rate >= 1:
            raise ValueError("boosting needs both classes in training data")
        base, trees, losses = math.log(rate / (1 - rate)), [], []
        for _ in range(self.max_iter):
            trees.append(self._grow(train, names, edges, trees, base))
            if self.held > 0:
                losses.append(self._loss(rows.where("held"), names, trees, base))
                known = losses[:-self.patience]
                if known and min(losses[-self.patience:]) > min(known) - self.tol:
                    break
        rows.unpersist()
        self.state = {"base": base, "losses": losses, "trees": [[a.tolist() for a in t] for t in trees]}
        return self

    def _loss(self, rows, names, trees, base) -> float:
        def run(batches):
            import pyarrow as pa

            total = np.zeros(2)
            for b in batches:
                z = self._raw(_values(b, names), trees, base) * (1 - 2 * b.column("y").to_numpy(zero_copy_only=False))
                total += np.logaddexp(0, z).sum(), len(z)
            yield pa.RecordBatch.from_arrays([pa.array(total[:1]), pa.array(total[1:])], names=["loss", "n"])

        r = rows.mapInArrow(run, "loss double, n double").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
        return r["loss"] / r["n"] if r["n"] else 0.0

    def _histograms(self, rows, names, edges, trees, base, tree, nodes) -> dict:
        """(node, column) -> (bins, 3): gradients, Hessians and rows."""
        width = max((len(e) for e in edges), default=0) + 1
        p, k = len(names), len(nodes)
        places = np.full(2 << self.depth, -1, dtype=np.int64)
        places[nodes] = np.arange(k)

        def run(batches):
            import pyarrow as pa

            sums = np.zeros((3, k * p * width))
            for b in batches:
                x, y = _values(b, names), b.column("y").to_numpy(zero_copy_only=False)
                at = places[route(x, tree[0], tree[1])]
                here = at >= 0
                x, y, at = x[here], y[here], at[here]
                prob = 1 / (1 + np.exp(-self._raw(x, trees, base)))
                for f in range(p):
                    cell = (at * p + f) * width + np.searchsorted(edges[f], x[:, f], side="left")
                    for j, w in enumerate((prob - y, prob * (1 - prob), np.ones(len(y)))):
                        sums[j] += np.bincount(cell, w, minlength=k * p * width)
            some = np.flatnonzero(sums[2] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(s[some]) for s in sums]], names=["cell", "g", "h", "n"])

        got = rows.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
        out = np.zeros((k * p * width, 3))
        for r in got.collect():  # nodes x columns x bins
            out[r["cell"]] = r["g"], r["h"], r["n"]
        return out.reshape(k, p, width, 3)

    def _grow(self, rows, names, edges, trees, base):
        size = 2 << self.depth
        tree = np.full(size, -1, dtype=np.int32), np.zeros(size), np.zeros(size)
        open_, leaves = [1], 1
        for _ in range(self.depth):
            hist = self._histograms(rows, names, edges, trees, base, tree, open_)
            splits = []
            for i, node in enumerate(open_):
                total = hist[i, 0].sum(0) if names else np.zeros(3)
                if node == 1:
                    tree[2][1] = -total[0] / (total[1] + self.l2) * self.rate if total[2] else 0.0
                best = None
                for f in range(len(names)):
                    left = hist[i, f].cumsum(0)[:len(edges[f])]
                    right = total - left
                    fits = (left[:, 2] >= self.leaf_rows) & (right[:, 2] >= self.leaf_rows)
                    if not fits.any():
                        continue
                    gain = np.where(fits, self._weight(left) + self._weight(right) - self._weight(total[None]), -np.inf)
                    b = int(gain.argmax())
                    if gain[b] > 0 and (best is None or gain[b] > best[0]):
                        best = (float(gain[b]), node, f, float(edges[f][b]), left[b], right[b])
                if best:
                    splits.append(best)
            open_ = []
            for gain, node, f, at, left, right in sorted(splits, key=lambda s: (-s[0], s[1])):
                if leaves >= self.leaves:
                    break
                tree[0][node], tree[1][node] = f, at
                for child, s in ((2 * node, left), (2 * node + 1, right)):
                    tree[2][child] = -s[0] / (s[1] + self.l2) * self.rate
                    open_.append(child)
                leaves += 1
            if not open_:
                break
        return tree

    def _weight(self, s):
        return s[:, 0] ** 2 / np.maximum(s[:, 1] + self.l2, 1e-12)

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        trees, base = [tuple(np.array(a) for a in t) for t in self.state["trees"]], self.state["base"]
        return with_score(df, self.features, lambda x: 1 / (1 + np.exp(-self._raw(x, trees, base))), out)
