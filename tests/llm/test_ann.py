import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann as A
from tessera.llm.common import table
from tessera.llm.queries import op7_nearest_neighbours
from tests.conftest import SF01

from .helpers import good_vector


def brute(rows, k=5, step=50):
    use = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows if r["vec_id"] is not None and good_vector(r["embedding"])]
    out = {}
    for q, x in use:
        if q % step:
            continue
        best = {}
        for v, y in use:
            if v != q and len(y) == len(x):
                s = float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))
                best[v] = max(best.get(v, -2), s)
        near = sorted(best.items(), key=lambda z: (-z[1], z[0]))[:k]
        if q not in out or near:
            out[q] = near
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def check(got, want):
    assert {q for q, n in want.items() if n} == set(got)
    for q, near in got.items():
        assert [v for v, _ in near] == [v for v, _ in want[q]], q
        assert np.allclose([s for _, s in near], [s for _, s in want[q]], atol=1e-12)


def test_table_equals_brute_force(spark):
    check(by_query(op7_nearest_neighbours(spark, SF01)), brute(table(spark, SF01, "embeddings").collect()))


def test_clustered_vectors_and_blocks(spark, monkeypatch):
    """Small blocks, clusters that rule blocks out, equal vectors with ties."""
    monkeypatch.setattr(A, "BLOCK_ROWS", 40)
    monkeypatch.setattr(A, "QUERY_ROWS", 4)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 1500)] + 0.1 * rng.normal(size=(1500, 24))
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    check(by_query(A.nearest(spark, df, F.col("vec_id") % 50 == 0)), brute(df.collect()))
    near = by_query(A.nearest(spark, df, F.col("vec_id") % 50 == 0, exact=False))
    want = brute(df.collect())
    hits = sum(len({v for v, _ in near.get(q, [])} & {v for v, _ in n}) for q, n in want.items())
    assert hits / sum(map(len, want.values())) > 0.3  # the curves alone find many where there is structure


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (50, v), (1, v), (2, [3.0, 2.0, 1.0]), (2, [1.0, 2.0, 3.1]), (3, None), (100, None), (4, [0.0] * 3),
            (150, [0.0] * 3), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0, 2.0]), (200, [1.0, 5.0]),
            (None, v), (250, [9.0]), (8, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = by_query(A.nearest(spark, df, F.col("vec_id") % 50 == 0))
    assert set(got) == {0, 50, 200}
    assert [x for x, _ in got[0]] == [1, 50, 2] and [x for x, _ in got[50]] == [0, 1, 2] and [x for x, _ in got[200]] == [7]
    assert A.nearest(spark, df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = A.hilbert_keys(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
