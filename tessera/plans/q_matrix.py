"""Matrix / kernel feature queries (FE19-FE21, FE30-FE37) on the base view."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import sql_bits
from ..functions.scalar import r6
from ..operators import matrix as MX
from ..sources import views as V
from .registry import register
from .sqlv import with_views

XY = ["x", "y"]
_XY_SQL = "SELECT row_id, c_acctbal / 1000.0 AS x, days / 1000.0 AS y, month FROM base"


def _xy(spark, d):
    return V.base(spark, d).select("row_id", (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("days") / 1000.0).alias("y"),
                                   "month")


def _xy_views(extra=""):
    return with_views("base", extra=f"xy AS ({_XY_SQL})" + (", " + extra if extra else ""))


@register("fe30_pca", ids=("FE30",), sql=lambda: _xy_views("""c AS (SELECT var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS h FROM xy),
e AS (SELECT (a + b) / 2 + sqrt(((a - b) / 2) * ((a - b) / 2) + h * h) AS l1,
             (a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + h * h) AS l2, a + b AS tr FROM c)""") + """
SELECT 0 AS component, round(l1, 6) AS explained_variance, round(l1 / tr, 6) AS ratio FROM e
UNION ALL SELECT 1, round(l2, 6), round(l2 / tr, 6) FROM e""")
def fe30_pca(spark, d):
    """FE30: centred PCA from one covariance aggregation; explained variance and ratio."""
    p = MX.PCA(XY, 2).fit(_xy(spark, d))
    rows = [(k, round(p.state["var"][k], 6), round(p.state["ratio"][k], 6)) for k in range(2)]
    return spark.createDataFrame(rows, "component int, explained_variance double, ratio double")


@register("fe30_pca_projection", ids=("FE30", "FE39"), sql="SELECT true AS reaches_share, true AS fewest, true AS variances_are_eigenvalues, true AS uncorrelated")
def fe30_pca_projection(spark, d):
    """FE30 on the projected data: the fewest components that reach 95 % of the variance, their
    variances equal the eigenvalues, and they are uncorrelated."""
    df = _xy(spark, d)
    p = MX.PCA(XY + ["month"], 0.95).fit(df)
    out = p.transform(df)
    k = len(p.outputs())
    aggs = [F.var_samp(f"pc{i}").alias(f"v{i}") for i in range(k)]
    aggs += [F.covar_samp(f"pc{i}", f"pc{j}").alias(f"c{i}{j}") for i in range(k) for j in range(i + 1, k)]
    r = out.agg(*aggs).first()
    ratio = p.state["ratio"]
    row = (sum(ratio) >= 0.95 - 1e-9, sum(ratio[:-1]) < 0.95, max(abs(r[f"v{i}"] - p.state["var"][i]) for i in range(k)) < 1e-6,
           max([abs(r[f"c{i}{j}"]) for i in range(k) for j in range(i + 1, k)] or [0.0]) < 1e-6)
    return spark.createDataFrame([row], "reaches_share boolean, fewest boolean, variances_are_eigenvalues boolean, uncorrelated boolean")


@register("fe31_truncated_svd", ids=("FE31",), sql=lambda: _xy_views("""c AS (SELECT sum(x * x) AS a, sum(y * y) AS b, sum(x * y) AS h FROM xy),
e AS (SELECT (a + b) / 2 + sqrt(((a - b) / 2) * ((a - b) / 2) + h * h) AS l1,
             (a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + h * h) AS l2 FROM c)""") + """
SELECT 0 AS component, round(sqrt(l1), 6) AS singular_value FROM e UNION ALL SELECT 1, round(sqrt(l2), 6) FROM e""")
def fe31_truncated_svd(spark, d):
    s = MX.TruncatedSVD(XY, 2).fit(_xy(spark, d))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(s.state["singular"])],
                                 "component int, singular_value double")


@register("fe34_nystroem_kernel", ids=("FE34", "J7"), sql=lambda: _xy_views(f"""lm AS (SELECT x AS lx, y AS ly,
  row_number() OVER (ORDER BY {sql_bits(42, 'landmark', 'row_id')}, row_id) - 1 AS j FROM xy
  ORDER BY {sql_bits(42, 'landmark', 'row_id')}, row_id LIMIT 5)""") + """
SELECT xy.row_id, lm.j AS landmark, round(exp(-0.5 * ((xy.x - lm.lx) * (xy.x - lm.lx) + (xy.y - lm.ly) * (xy.y - lm.ly))), 6) AS k
FROM xy, lm""")
def fe34_nystroem_kernel(spark, d):
    """FE34: landmarks by smallest hash; kernel values K(x, landmark_j) (the part before
    the K_mm^(-1/2) map, which is a 5 x 5 driver solve)."""
    df = _xy(spark, d)
    ny = MX.Nystroem(XY, "row_id", 5, "rbf", 0.5).fit(df)
    k = ny.kernel_columns(df).select("row_id", *[f"k{j}" for j in range(5)])
    return k.unpivot("row_id", [f"k{j}" for j in range(5)], "landmark", "k").select(
        "row_id", F.substring("landmark", 2, 3).cast("long").alias("landmark"), r6("k").alias("k"))


_RBF = MX.RBFSampler(XY, 6, 0.5, seed=42)


def _two_landmarks(kernel):
    """SQL of the kernel of two points, columns {a}x, {a}y and {b}x, {b}y."""
    dot = "({a}x * {b}x + {a}y * {b}y)"
    return {"rbf": "exp(-0.5 * (({a}x - {b}x) * ({a}x - {b}x) + ({a}y - {b}y) * ({a}y - {b}y)))", "poly": f"pow(0.5 * {dot} + 1.0, 2)",
            "cosine": dot + " / (sqrt({a}x * {a}x + {a}y * {a}y) * sqrt({b}x * {b}x + {b}y * {b}y))",
            "sigmoid": f"tanh(0.5 * {dot} + 1.0)"}[kernel]


_KERNELS = ("rbf", "poly", "cosine")


@register("fe34_nystroem_map", ids=("FE34",), sql=lambda: _xy_views(f"""lm AS (SELECT x, y, row_number() OVER (ORDER BY {sql_bits(42, 'landmark', 'row_id')}, row_id) AS j
  FROM xy ORDER BY {sql_bits(42, 'landmark', 'row_id')}, row_id LIMIT 2),
ab AS (SELECT max(CASE WHEN j = 1 THEN x END) AS ux, max(CASE WHEN j = 1 THEN y END) AS uy,
       max(CASE WHEN j = 2 THEN x END) AS wx, max(CASE WHEN j = 2 THEN y END) AS wy FROM lm)""") + " UNION ALL ".join(f"""SELECT * FROM (
WITH m AS (SELECT *, {_two_landmarks(n).format(a='u', b='u')} AS p, {_two_landmarks(n).format(a='u', b='w')} AS q, {_two_landmarks(n).format(a='w', b='w')} AS r FROM ab),
i AS (SELECT *, sqrt(p * r - q * q) AS s FROM m),
h AS (SELECT *, sqrt(p + r + 2 * s) / ((p + s) * (r + s) - q * q) AS f FROM i),
k AS (SELECT row_id, f, p, q, r, s, {_two_landmarks(n).format(a='xy.', b='u')} AS k1, {_two_landmarks(n).format(a='xy.', b='w')} AS k2 FROM xy, h)
SELECT '{n}' AS kernel, row_id, round(f * ((r + s) * k1 - q * k2), 6) + 0.0 AS ny0, round(f * ((p + s) * k2 - q * k1), 6) + 0.0 AS ny1 FROM k)""" for n in _KERNELS))
def fe34_nystroem_map(spark, d):
    """FE34: the whole map of three kernels with two landmarks, K(x, landmarks) K_mm^(-1/2); the inverse
    square root of a 2 x 2 matrix has a closed form, which the SQL states."""
    df, rows = _xy(spark, d), None
    for name in _KERNELS:
        out = MX.Nystroem(XY, "row_id", 2, name, 0.5, degree=2).fit(df).transform(df)
        part = out.select(F.lit(name).alias("kernel"), "row_id", *[(r6(c) + F.lit(0.0)).alias(c) for c in ("ny0", "ny1")])  # no -0.0
        rows = part if rows is None else rows.unionByName(part)
    return rows


@register("fe34_sigmoid_kernel", ids=("FE34",), sql=lambda: _xy_views(f"""lm AS (SELECT x AS lx, y AS ly, row_number() OVER
  (ORDER BY {sql_bits(42, 'landmark', 'row_id')}, row_id) - 1 AS j FROM xy ORDER BY {sql_bits(42, 'landmark', 'row_id')}, row_id LIMIT 3)""")
  + f"SELECT row_id, j AS landmark, round({_two_landmarks('sigmoid').format(a='xy.', b='lm.l')}, 6) AS k FROM xy, lm")
def fe34_sigmoid_kernel(spark, d):
    df = _xy(spark, d)
    k = MX.Nystroem(XY, "row_id", 3, "sigmoid", 0.5).fit(df).kernel_columns(df)
    return k.unpivot("row_id", ["k0", "k1", "k2"], "landmark", "k").select(
        "row_id", F.substring("landmark", 2, 3).cast("long").alias("landmark"), r6("k").alias("k"))


@register("fe35_random_fourier", ids=("FE35",), sql=lambda: _xy_views() + "SELECT row_id, " + ", ".join(
    f"round(sqrt(2.0 / 6) * cos({_RBF.state['b'][k]!r} + {_RBF.state['w'][k][0]!r} * x + {_RBF.state['w'][k][1]!r} * y), 6) AS rff{k}"
    for k in range(6)) + " FROM xy")
def fe35_random_fourier(spark, d):
    """FE35: random Fourier features with seed-drawn weights (the oracle uses the same
    seed-derived weights; nothing is fitted from data)."""
    out = _RBF.transform(_xy(spark, d))
    return out.select("row_id", *[r6(f"rff{k}").alias(f"rff{k}") for k in range(6)])


def _yj_sql(v, lam):
    return (f"CASE WHEN {v} >= 0 THEN (CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {v}) ELSE (pow({v} + 1, {lam}) - 1) / {lam} END) "
            f"ELSE (CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {v}) ELSE -(pow(1 - {v}, 2 - {lam}) - 1) / (2 - {lam}) END) END")


def _yj_col_sql(col):
    return f"""g1_{col} AS (SELECT i, CAST(round(-2.0 + i * 0.1, 10) AS DOUBLE) AS lam FROM range(0, 41) t(i)),
l1_{col} AS (SELECT g.i, g.lam, count(*) AS n, var_pop({_yj_sql(col, 'g.lam')}) AS v, sum(sign({col}) * ln(1 + abs({col}))) AS j
   FROM xy, g1_{col} g GROUP BY g.i, g.lam),
b1_{col} AS (SELECT lam FROM l1_{col} ORDER BY -n / 2.0 * ln(v) + (lam - 1) * j DESC, i LIMIT 1),
g2_{col} AS (SELECT i, CAST(round((SELECT lam FROM b1_{col}) - 0.1 + i * 0.01, 10) AS DOUBLE) AS lam FROM range(0, 21) t(i)),
l2_{col} AS (SELECT g.i, g.lam, count(*) AS n, var_pop({_yj_sql(col, 'g.lam')}) AS v, sum(sign({col}) * ln(1 + abs({col}))) AS j
   FROM xy, g2_{col} g GROUP BY g.i, g.lam),
b2_{col} AS (SELECT lam FROM l2_{col} ORDER BY -n / 2.0 * ln(v) + (lam - 1) * j DESC, i LIMIT 1),
t_{col} AS (SELECT row_id, {_yj_sql(col, '(SELECT lam FROM b2_' + col + ')')} AS t FROM xy),
s_{col} AS (SELECT avg(t) AS m, stddev_pop(t) AS s FROM t_{col})"""


@register("fe36_yeo_johnson", ids=("FE36",), sql=lambda: _xy_views(_yj_col_sql("x") + ", " + _yj_col_sql("y")) + """
SELECT t_x.row_id, round((t_x.t - s_x.m) / s_x.s, 6) AS x, round((t_y.t - s_y.m) / s_y.s, 6) AS y,
  (SELECT lam FROM b2_x) AS lambda_x, (SELECT lam FROM b2_y) AS lambda_y
FROM t_x JOIN t_y USING (row_id), s_x, s_y""")
def fe36_yeo_johnson(spark, d):
    """FE36: max-likelihood lambda on the 0.01 grid by a bracket search (all columns together, one
    aggregation a pass); standardised output."""
    df = _xy(spark, d)
    pt = MX.PowerTransformer(XY).fit(df)
    out = pt.transform(df)
    return out.select("row_id", r6("x").alias("x"), r6("y").alias("y"),
                      F.lit(pt.state["lambda"]["x"]).alias("lambda_x"), F.lit(pt.state["lambda"]["y"]).alias("lambda_y"))


def _qt_sql(c, nq=10):
    probs = ", ".join(repr(i / (nq - 1)) for i in range(nq))
    return f"""q_{c} AS (SELECT quantile_cont({c}, [{probs}]) AS q, [{probs}] AS r FROM xy)"""


def _qt_expr(c, nq=10):
    j = f"len(list_filter(q_{c}.q, lambda k: k <= xy.{c}))"
    i = f"(len(list_filter(q_{c}.q, lambda k: k < xy.{c})) + 1)"
    fwd = (f"CASE WHEN q_{c}.q[{j} + 1] > q_{c}.q[{j}] THEN q_{c}.r[{j}] + (xy.{c} - q_{c}.q[{j}]) * (q_{c}.r[{j} + 1] - q_{c}.r[{j}]) "
           f"/ (q_{c}.q[{j} + 1] - q_{c}.q[{j}]) ELSE q_{c}.r[{j}] END")
    bwd = (f"CASE WHEN q_{c}.q[{i}] > q_{c}.q[{i} - 1] THEN q_{c}.r[{i}] - (q_{c}.q[{i}] - xy.{c}) * (q_{c}.r[{i}] - q_{c}.r[{i} - 1]) "
           f"/ (q_{c}.q[{i}] - q_{c}.q[{i} - 1]) ELSE q_{c}.r[{i}] END")
    return (f"round(CASE WHEN xy.{c} <= q_{c}.q[1] THEN 0.0 WHEN xy.{c} >= q_{c}.q[{nq}] THEN 1.0 "
            f"ELSE 0.5 * (({fwd}) + ({bwd})) END, 6) AS {c}")


@register("fe37_quantile_uniform", ids=("FE37",), sql=lambda: _xy_views(_qt_sql("x") + ", " + _qt_sql("month")) + f"""
SELECT xy.row_id, {_qt_expr('x')}, {_qt_expr('month')} FROM xy, q_x, q_month""")
def fe37_quantile_uniform(spark, d):
    """FE37: uniform output via exact knots (10 quantiles; 'month' has tied knots)."""
    df = _xy(spark, d)
    qt = MX.QuantileTransformer(["x", "month"], 10).fit(df)
    return qt.transform(df).select("row_id", r6("x").alias("x"), r6("month").alias("month"))


@register("fe19_kde_density", ids=("FE19",), sql=lambda: with_views("base") + """
, s AS (SELECT count(*) AS n, var_samp(month) * pow(count(*), -0.4) AS v FROM base),
sup AS (SELECT month AS sv, count(*) AS w FROM base GROUP BY month),
dv AS (SELECT DISTINCT month FROM base)
SELECT dv.month, round(ln(sum(sup.w * exp(-0.5 / s.v * (dv.month - sup.sv) * (dv.month - sup.sv))) / (s.n * sqrt(2 * pi() * s.v))), 6) AS log_density
FROM dv, sup, s GROUP BY dv.month, s.n, s.v""")
def fe19_kde_density(spark, d):
    """FE19: Gaussian KDE density (Scott bandwidth) of every distinct value."""
    df = V.base(spark, d).select("month")
    kde = MX.KDEDensity("month", "scott").fit(df)
    return kde.density_table(df).select("month", r6(F.log("density")).alias("log_density"))


@register("fe20_fe21_kmeans", ids=("FE20", "FE21", "J7"), sql=lambda: with_views("base") + """
SELECT g.grp, g.k, (SELECT count(*) FROM base) AS n_rows, true AS label_is_nearest, true AS centres_are_means
FROM (VALUES ('x_y', 4), ('month', 3)) g(grp, k)""")
def fe20_fe21_kmeans(spark, d):
    """FE20 k-means label + distances on (x, y); FE21 one k-means per feature group. Checks per
    group: every label is the nearest centre, and centres are the means of their rows."""
    df = _xy(spark, d)
    rows = []
    for name, cols, k, prefix in (("x_y", XY, 4, "g1"), ("month", ["month"], 3, "g2")):
        km = MX.KMeansFeatures(cols, k=k, prefix=prefix).fit(df)
        out = km.transform(df)
        dist = F.array(*[F.col(f"{prefix}_d{j}") for j in range(k)])
        off = F.count_if(F.get(dist, F.col(f"{prefix}_label")) > F.array_min(dist))
        got = out.groupBy(f"{prefix}_label").agg(F.count(F.lit(1)).alias("n"), off.alias("off"), *[F.avg(c).alias(c) for c in cols]).collect()  # k rows
        means = all(abs(r[c] - km.state["centers"][r[f"{prefix}_label"]][i]) < 0.02 * (1 + abs(r[c])) for r in got for i, c in enumerate(cols))
        rows.append((name, k, sum(r["n"] for r in got), all(r["off"] == 0 for r in got), means))
    return spark.createDataFrame(rows, "grp string, k int, n_rows long, label_is_nearest boolean, centres_are_means boolean")


@register("fe32_fe33_ica_factor", ids=("FE32", "FE33"), sql="""
SELECT true AS unit_variance, true AS uncorrelated, true AS covariance_kept, true AS factor_varies""")
def fe32_fe33_ica_factor(spark, d):
    """FE32 FastICA: components of unit variance without correlation. FE33 factor analysis: loadings
    and noise give back the diagonal of the covariance, and the factor varies."""
    df = _xy(spark, d)
    cols = XY + ["month"]
    ica = MX.FastICA(XY, 2).fit(df)
    fa = MX.FactorAnalysis(cols, 1).fit(df)
    out = fa.transform(ica.transform(df))
    r = out.agg(F.var_samp("ic0").alias("v0"), F.var_samp("ic1").alias("v1"), F.corr("ic0", "ic1").alias("c"), F.stddev_pop("fa0").alias("s"),
                *[F.var_pop(c).alias(c) for c in cols]).first()
    own = [sum(v * v for v in fa.state["loadings"][i]) + fa.state["psi"][i] for i in range(len(cols))]
    row = (abs(r["v0"] - 1) < 1e-6 and abs(r["v1"] - 1) < 1e-6, abs(r["c"]) < 1e-6,
           all(abs(o - r[c]) < 0.02 * r[c] for o, c in zip(own, cols)), r["s"] > 0)
    return spark.createDataFrame([row], "unit_variance boolean, uncorrelated boolean, covariance_kept boolean, factor_varies boolean")


@register("fe37_quantile_thousand", ids=("FE37",), sql=lambda: _xy_views(_qt_sql("x", 1000)) + f"""
SELECT xy.row_id, {_qt_expr('x', 1000)} FROM xy, q_x""")
def fe37_quantile_thousand(spark, d):
    """FE37 with the reference's 1,000 knots."""
    df = _xy(spark, d)
    return MX.QuantileTransformer(["x"], 1000).fit(df).transform(df).select("row_id", r6("x").alias("x"))


@register("fe37_quantile_normal", ids=("FE37",), sql=lambda: _xy_views() + "SELECT count(*) AS n, true AS centred, true AS unit_scale, true AS keeps_order FROM xy")
def fe37_quantile_normal(spark, d):
    """FE37 with normal output: mean 0 and standard deviation 1 nearly, and the order of the values kept."""
    df = _xy(spark, d)
    out = MX.QuantileTransformer(["x"], 100, output="normal").fit(df).transform(df.withColumn("raw", F.col("x")))
    r = out.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    w = out.groupBy("x").agg(F.max("raw").alias("hi"), F.min("raw").alias("lo"))
    rising = w.agg(F.corr("x", "lo").alias("c"), F.max_by("hi", "x").alias("top"), F.max("hi").alias("most")).first()
    return spark.createDataFrame([(r["n"], abs(r["m"]) < 0.05, abs(r["s"] - 1) < 0.15, rising["c"] > 0.9 and rising["top"] == rising["most"])],
                                 "n long, centred boolean, unit_scale boolean, keeps_order boolean")
