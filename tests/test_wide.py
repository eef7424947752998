"""Generated features as arrays equal the narrow operators; their ANOVA equals plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera.operators.wide as W
from tessera.operators.features import AllPairs, Polynomial, SelectPercentileF


def frame(spark, n=400, columns=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, columns))
    y = rng.integers(0, 3, n)
    x[:, 1] += y
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(n)]
    names = [f"c{i}" for i in range(columns)]
    return spark.createDataFrame(rows, "row_id long, label int, " + ", ".join(f"{c} double" for c in names)).repartition(7), names


def test_equals_the_narrow_operators(spark, monkeypatch):
    monkeypatch.setattr(W, "CELLS", 300)  # a few rows a piece
    df, names = frame(spark)
    op = W.WideFeatures(names, degree=3).fit(df)
    got = {r["row_id"]: r["features"] for r in op.transform(df).collect()}
    want = df
    narrow = [AllPairs(names, "difference"), AllPairs(names, "sum"), AllPairs(names, "ratio").fit(df)]
    for o in narrow:
        want = o.transform(want)
    poly = Polynomial(names, 3, False, True)
    want = want.withColumns(poly.expressions())
    outs = [c for o in narrow for c in o.outputs()] + poly.outputs()
    assert op.names() == outs
    for r in want.collect():
        assert got[r["row_id"]] == pytest.approx([r[c] for c in outs], rel=1e-12)


def test_selection_equals_the_narrow_selector(spark, monkeypatch):
    monkeypatch.setattr(W, "CELLS", 1000)
    df, names = frame(spark)
    sel = W.WideSelect(W.WideFeatures(names), "label", 20).fit(df)
    wide = df
    narrow = [AllPairs(names, "difference"), AllPairs(names, "sum"), AllPairs(names, "ratio").fit(df)]
    for o in narrow:
        wide = o.transform(wide)
    cols = [c for o in narrow for c in o.outputs()]
    ref = SelectPercentileF(cols, "label", 20).fit(wide)
    assert sel.kept().names() == ref.outputs()
    assert sel.state["f"] == pytest.approx([ref.state["f"][c] for c in cols], rel=1e-9)
    own = {r["row_id"]: r["features"] for r in sel.transform(df).collect()}
    for r in wide.select("row_id", *ref.outputs()).collect():
        assert own[r["row_id"]] == pytest.approx([r[c] for c in ref.outputs()], rel=1e-12)


def test_scores_far_from_zero_and_uneven_tasks(spark):
    """Means of 1e8 with a spread of 1, sorted by class so that tasks see one class each."""
    rng = np.random.default_rng(1)
    y = np.sort(rng.integers(0, 4, 3000))
    x = 1e8 + rng.normal(size=(3000, 3)) + np.outer(y, [0.0, 0.1, 0.5])
    df = spark.createDataFrame([(int(y[i]), *map(float, x[i])) for i in range(3000)], "label int, a double, b double, c double").coalesce(3)
    op = W.WideFeatures(["a", "b", "c"], kinds=("sum",), degree=1, bias=False).fit(df)
    got = {r["place"]: r["f_stat"] for r in W.wide_anova(op, df, "label").collect()}
    v = np.column_stack([x[:, 0] + x[:, 1], x[:, 0] + x[:, 2], x[:, 1] + x[:, 2], x])
    for i in range(v.shape[1]):
        z = v[:, i] - np.round(v[:, i].mean())
        means = np.array([z[y == k].mean() for k in range(4)])
        n = np.bincount(y)
        between = (n * (means - z.mean()) ** 2).sum() / 3
        within = sum(((z[y == k] - means[k]) ** 2).sum() for k in range(4)) / (3000 - 4)
        assert got[i] == pytest.approx(between / within, rel=1e-5)  # a double near 2e8 resolves 3e-8


def test_bad_values_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1.0, 2.0, "x"), (0, None, 1.0, "x"), (1, nan, 3.0, None), (1, 4.0, inf, "y"), (None, 7.0, 8.0, "z"), (1, 2.0, -1.0, "z"), (0, 0.5, 2.0, "z")]
    df = spark.createDataFrame(rows, "label int, a double, b double, features string")
    op = W.WideFeatures(["a", "b"], kinds=("difference", "ratio"), degree=1).fit(df)
    out = op.transform(df)
    assert out.columns == ["label", "a", "b", "features"]
    by = [r["features"] for r in out.collect()]
    assert by[0][0] == -1.0 and by[1][0] is None and by[2][0] is None and by[3][0] is None and by[4][0] == -1.0
    assert all(r[3] == 1.0 for r in by)  # the polynomial's bias
    f = {r["place"]: r["f_stat"] for r in W.wide_anova(op, df, "label").collect()}
    assert len(f) == 6 and f[3] is None and f[0] is not None
    sel = W.WideSelect(op, "label", 50).fit(df)
    assert 3 not in sel.state["keep"] and len(sel.state["keep"]) == 3
    empty = df.where("false")
    assert W.WideFeatures(["a", "b"]).fit(empty).transform(empty).count() == 0
    assert {r["f_stat"] for r in W.wide_anova(W.WideFeatures(["a", "b"]).fit(empty), empty, "label").collect()} == {None}


def test_no_task_holds_wide_rows_of_many(spark):
    """5,041 features of 45 columns come in pieces of at most CELLS numbers."""
    assert len(W.wide_terms(45, degree=2)) == 990 + 990 + 1980 + 1081
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000.0))], names=["a"])
    pieces = list(W._pieces(iter([b]), 5041))
    assert max(p.num_rows for p in pieces) * 5041 <= W.CELLS and sum(p.num_rows for p in pieces) == 10_000
    names = [f"c{i}" for i in range(45)]
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(__import__("pandas").DataFrame(rng.normal(size=(300, 45)), columns=names)).withColumn("label", F.col("c0") > 0)
    sel = W.WideSelect(W.WideFeatures(names, degree=2), "label", 1).fit(df)
    got = sel.transform(df)
    assert got.where(F.size("features") != len(sel.state["keep"])).count() == 0 and len(sel.state["keep"]) == 50
