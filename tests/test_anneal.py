"""Annealing fold: chunked composition equals the sequential replay."""

import math
import random

import numpy as np

import pytest

from tessera.functions.hashing import py_uniform
from tessera.operators import anneal
from tessera.operators.anneal import anneal_fold, apply_pair, compose_chunk, compose_pairs, replay


def test_compose_equals_replay():
    """A chunk's pair gives the replay's last state from any state, equal scores, steps without a score and
    temperatures of 0 among them; so do the pairs of its parts, composed."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        c, t, u = np.round(rng.random(n), 2), rng.random(n) * 0.05 + 1e-3, rng.random(n)
        c[rng.random(n) < 0.1] = np.nan
        t[rng.random(n) < 0.1] = 0.0
        whole, cut = compose_chunk(c, t, u), n // 2
        parts = compose_pairs(*zip(compose_chunk(c[:cut], t[:cut], u[:cut]), compose_chunk(c[cut:], t[cut:], u[cut:])))
        assert parts == whole
        for s0 in (-math.inf, 0.2, 0.5, 0.99):
            assert abs(apply_pair(*whole, s0) - replay(c, t, u, s0)[1][-1]) < 1e-12 or apply_pair(*whole, s0) == s0 == -math.inf


def test_fold_small_chunks_equals_sequential(spark):
    rnd = random.Random(3)
    rows = [(r, i, round(rnd.random(), 3), 0.02) for r in range(3) for i in range(r * 1000, r * 1000 + 60)]
    df = spark.createDataFrame(rows, "run_id long, iteration_num long, stage1_val_auc double, temperature double")
    small = {(r["run_id"], r["iteration_num"]): (r["accepted"], r["current_score"])
             for r in anneal_fold(df, chunk=7).collect()}
    big = {(r["run_id"], r["iteration_num"]): (r["accepted"], r["current_score"])
           for r in anneal_fold(df, chunk=1 << 20).collect()}
    assert small == big and len(small) == 180


def _sequential(rows, s0=-math.inf):
    c, t, u = (np.array(v, dtype=float) for v in zip(*[(r[2], r[3], py_uniform(42, "anneal", r[1])) for r in rows]))
    acc, cur = replay(c, t, u, s0)
    return {(r[0], r[1]): (bool(a), float(s)) for r, a, s in zip(rows, acc, cur)}


@pytest.mark.parametrize("kind", ["falling", "rising", "mixed"])
def test_many_chunks_a_run_up_and_down_the_tree(spark, monkeypatch, kind):
    """Runs of 1,100 chunks, 3 chunks and one step, with gaps between steps, equal the plain replay; no
    group of the tree holds more than eight pairs."""
    rng = np.random.default_rng(4)
    sizes, seen, rows = {1: 4400, 2: 12, 3: 1}, [], []
    for r, n in sizes.items():
        trend = {"falling": np.linspace(0.9, 0.1, n), "rising": np.linspace(0.1, 0.9, n), "mixed": rng.random(n)}[kind]
        steps = [i if r != 2 else 1000 + 40 * i for i in range(n)]
        heat = 0.05 if kind == "mixed" else 1e-4
        rows += [(r, s, float(c), heat) for s, c in zip(steps, trend + rng.normal(0, 1e-4, n))]
    plain = {}
    for r in sizes:
        plain.update(_sequential([x for x in rows if x[0] == r], 0.5 if r == 1 else -math.inf))
    kept = anneal.stored

    def look(df, name):
        out = kept(df, name)
        if name == "anneal-level":
            seen.append((out.groupBy("run", "over").count().agg({"count": "max"}).first()[0], out.where("run = 1").count()))
        return out

    monkeypatch.setattr(anneal, "stored", look)
    df = spark.createDataFrame(rows, "run_id long, iteration_num long, stage1_val_auc double, temperature double")
    start = spark.createDataFrame([(1, 0.5)], "run_id long, s0 double")
    out = anneal_fold(df, chunk=4, start=start, fan=8).collect()
    assert {(r["run_id"], r["iteration_num"]): (r["accepted"], r["current_score"]) for r in out} == plain
    assert seen == [(8, 1100), (8, 138), (8, 18), (3, 3)]


def test_groups_share_partitions_and_batches(spark):
    """Many runs in a partition and runs over the end of a batch: each step is decided as one after the other,
    and no group is handed to Python by itself."""
    from pyspark.sql import functions as F

    prev = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch",)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(600).select((F.col("id") % 40).alias("run_id"), F.col("id").alias("iteration_num"),
                                     (F.sin("id") / 10 + 0.7).alias("stage1_val_auc"), F.lit(0.05).alias("temperature"))
        whole, cut = anneal_fold(df), anneal_fold(df, chunk=64, fan=4)
        assert "FlatMapGroups" not in whole._jdf.queryExecution().optimizedPlan().toString()
        a, b = (sorted(tuple(r) for r in x.collect()) for x in (whole, cut))
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
    assert len(a) == 600 and a == b
