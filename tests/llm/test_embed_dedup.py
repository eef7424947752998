import numpy as np
from pyspark.sql import functions as F

from tessera.llm import embed_dedup as E
from tessera.llm.common import table
from tests.conftest import SF01

from .helpers import components, good_vector


def brute(rows, threshold=0.98):
    """id -> (n_links, component) with every vector a node of its own id."""
    use = [(r["vec_id"], str(r["label"]), np.array(r["embedding"], float)) for r in rows
           if r["vec_id"] is not None and r["label"] is not None and good_vector(r["embedding"])]
    links, counts = [], {}
    for i, (a, la, x) in enumerate(use):
        for b, lb, y in use[:i]:
            if la == lb and len(x) == len(y) and (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= threshold:
                links.append((a, b))
                counts[a] = counts.get(a, 0) + 1
                counts[b] = counts.get(b, 0) + 1
    group = components({r["vec_id"] for r in rows if r["vec_id"] is not None}, links)
    return {i: (counts.get(i, 0), g) for i, g in group.items()}


def check(spark, df):
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(spark, df).collect() if r["vec_id"] is not None}
    assert got == brute(df.collect())


def test_table_equals_brute_force(spark):
    check(spark, table(spark, SF01, "embeddings"))


def test_large_group_in_tiles(spark, tmp_path, monkeypatch):
    """A group of near copies beyond one block, with a few equal vectors in it."""
    monkeypatch.setattr(E, "BLOCK", 50)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.12).tolist(), 1) for i in range(260)]
    rows += [(300 + i, base.tolist(), 1) for i in range(5)] + [(400 + i, (-base).tolist(), 1) for i in range(3)]
    rows += [(500 + i, rng.normal(size=16).tolist(), 1) for i in range(60)]
    check(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1),
            (8, [1.0, float("nan"), 3.0], 1), (9, [1.0, float("inf"), 3.0], 1), (10, [2.0, 4.0, 6.0], 1), (11, [], 1),
            (12, [1.0, 2.0], 1), (13, [1e-200, 2e-200, 3e-200], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("x"))
    got = {r["vec_id"]: r for r in E.near_duplicates(spark, df).collect()}
    assert {i: got[i]["n_links"] for i in (1, 2, 10)} == {1: 3, 2: 3, 10: 3}  # 13 is a tiny copy
    assert got[13]["component_id"] == 1 and not got[13]["kept"]
    for i in (3, 4, 5, 6, 7, 8, 9, 11, 12):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    one = E.near_duplicates(spark, df.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("long"))).first()
    assert one["component_id"] is None and one["kept"]
    assert E.near_duplicates(spark, df.where("false")).count() == 0


def test_tables_keep_to_the_miss_rate():
    for n in (10, 10**4, 10**9):
        bits, tables = E.tables_for(n, 0.98)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= E.MISS
