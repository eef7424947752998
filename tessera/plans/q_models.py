"""Classifier queries on the planted-signal view (B11): exact SQL oracles for the
sufficient-statistic models (LDA, QDA, ridge), exact kNN, CV and random search; rows of
checks for the iterative models (M1-M15, MT5-MT7)."""

from __future__ import annotations

from ..session import track

from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, py_uniform, sql_bits
from ..functions.scalar import r6
from ..operators import models as M
from ..operators.features import StandardScale
from ..operators.metrics import auc
from ..operators.pool import fit_classifier
from ..operators.sampling import class_weights, kfold, stratified_split
from ..operators.spaces import log10
from ..operators.trees import ExtraTrees, HistogramBoosting
from ..operators.tuning import draw_trials, random_search
from ..sources import views as V
from .q_metrics import auc_sql
from .registry import register

X = ["x1", "x2"]


def planted_frame(spark, d):
    """Planted view split 60/35/5 by its label y, features standardised on train."""
    pl = V.planted(spark, d).select("row_id", F.col("o_totalprice").alias("x1"), F.col("c_acctbal").alias("x2"),
                                    F.col("y").alias("label"))
    s = track(stratified_split(pl, "row_id", "label"))
    sc = StandardScale(X).fit(s.filter(F.col("split") == "train"))
    return sc.transform(s)


def _z_sql():
    return f"""WITH pb AS ({V.planted_sql()}),
r AS (SELECT row_id, o_totalprice, c_acctbal, y, row_number() OVER (PARTITION BY y ORDER BY {sql_bits(42, 'split', 'row_id')}, row_id) AS rk,
      count(*) OVER (PARTITION BY y) AS n FROM pb),
s AS (SELECT row_id, o_totalprice, c_acctbal, y AS label, CASE WHEN rk <= (n * 600000) // 1000000 THEN 'train'
      WHEN rk <= (n * 950000) // 1000000 THEN 'val1' ELSE 'val2' END AS split FROM r),
st AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(c_acctbal) AS m2, stddev_pop(c_acctbal) AS s2
       FROM s WHERE split = 'train'),
z AS (SELECT row_id, label, split, (o_totalprice - m1) / s1 AS x1, (c_acctbal - m2) / s2 AS x2 FROM s, st)"""


def _val_auc(scored, score="score"):
    v = scored.filter(F.col("split") != "train")
    return auc(v, score, "label").select(r6("auc").alias("auc"))


# ================================================================ M9 LDA
@register("m9_lda", ids=("M9",), sql=lambda: _z_sql() + """,
cm AS (SELECT label, count(*) AS n, avg(x1) AS a1, avg(x2) AS a2, var_pop(x1) AS v1, var_pop(x2) AS v2,
       covar_pop(x1, x2) AS c12 FROM z WHERE split = 'train' GROUP BY label),
pool AS (SELECT sum(n * v1) / (sum(n) - 2) AS p11, sum(n * v2) / (sum(n) - 2) AS p22, sum(n * c12) / (sum(n) - 2) AS p12,
         max(CASE WHEN label = 1 THEN a1 END) - max(CASE WHEN label = 0 THEN a1 END) AS d1,
         max(CASE WHEN label = 1 THEN a2 END) - max(CASE WHEN label = 0 THEN a2 END) AS d2 FROM cm),
w AS (SELECT (p22 * d1 - p12 * d2) / (p11 * p22 - p12 * p12) AS w1, (p11 * d2 - p12 * d1) / (p11 * p22 - p12 * p12) AS w2 FROM pool),
v AS (SELECT label, w1 * x1 + w2 * x2 AS score FROM z, w WHERE split <> 'train'),
""" + auc_sql("v", "score", "1") + """
SELECT round((SELECT auc FROM a), 6) AS auc, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM w""")
def m9_lda(spark, d):
    """M9: class means + pooled covariance from one grouped aggregation; AUC on val."""
    z = planted_frame(spark, d)
    m = M.LDA(X).fit(z.filter(F.col("split") == "train"))
    a = _val_auc(z.withColumn("score", m.decision()))
    return a.select("auc", F.lit(round(m.state["w"][0], 6)).alias("w1"), F.lit(round(m.state["w"][1], 6)).alias("w2"))


# ================================================================ M10 QDA
QDA_REG = 0.1


@register("m10_qda", ids=("M10",), sql=lambda: _z_sql() + f""",
cm AS (SELECT label, count(*) AS n, avg(x1) AS a1, avg(x2) AS a2, (1 - {QDA_REG}) * var_samp(x1) + {QDA_REG} AS s11,
       (1 - {QDA_REG}) * var_samp(x2) + {QDA_REG} AS s22, (1 - {QDA_REG}) * covar_samp(x1, x2) AS s12
       FROM z WHERE split = 'train' GROUP BY label),
k AS (SELECT *, s11 * s22 - s12 * s12 AS det, ln(n / (SELECT sum(n) FROM cm)) - 0.5 * ln(s11 * s22 - s12 * s12) AS c FROM cm),
sc AS (SELECT z.row_id, z.label, z.split, k.label AS cls,
       k.c - 0.5 * ((k.s22 / k.det) * (z.x1 - k.a1) * (z.x1 - k.a1) + 2 * (-k.s12 / k.det) * (z.x1 - k.a1) * (z.x2 - k.a2)
                     + (k.s11 / k.det) * (z.x2 - k.a2) * (z.x2 - k.a2)) AS q FROM z, k),
v AS (SELECT label, max(CASE WHEN cls = 1 THEN q END) - max(CASE WHEN cls = 0 THEN q END) AS score
      FROM sc WHERE split <> 'train' GROUP BY row_id, label),
""" + auc_sql("v", "score", "1") + """
SELECT round(auc, 6) AS auc FROM a""")
def m10_qda(spark, d):
    """Per-class covariance (1-r) S_k + r I; AUC of the log-odds on val."""
    z = planted_frame(spark, d)
    m = M.QDA(X, reg=QDA_REG).fit(z.filter(F.col("split") == "train"))
    return _val_auc(z.withColumn("score", m.decision()))


# ================================================================ M11 ridge
ALPHA = 10.0


@register("m11_ridge", ids=("M11", "FE41"), sql=lambda: _z_sql() + f""",
tr0 AS (SELECT * FROM z WHERE split = 'train'),
tr AS (SELECT x1, x2, CASE WHEN label = 1 THEN 1.0 ELSE -1.0 END AS t,
       (SELECT count(*) FROM tr0) / (2.0 * count(*) OVER (PARTITION BY label)) AS w FROM tr0),
mu AS (SELECT sum(w * x1) / sum(w) AS mx1, sum(w * x2) / sum(w) AS mx2, sum(w * t) / sum(w) AS mt FROM tr),
cv AS (SELECT sum(w * (x1 - mx1) * (x1 - mx1)) + {ALPHA} AS c11, sum(w * (x2 - mx2) * (x2 - mx2)) + {ALPHA} AS c22,
       sum(w * (x1 - mx1) * (x2 - mx2)) AS c12, sum(w * (x1 - mx1) * (t - mt)) AS r1, sum(w * (x2 - mx2) * (t - mt)) AS r2
       FROM tr, mu),
b AS (SELECT (c22 * r1 - c12 * r2) / (c11 * c22 - c12 * c12) AS b1, (c11 * r2 - c12 * r1) / (c11 * c22 - c12 * c12) AS b2 FROM cv),
bb AS (SELECT b1, b2, mt - mx1 * b1 - mx2 * b2 AS b0 FROM b, mu),
v AS (SELECT label, b0 + b1 * x1 + b2 * x2 AS score FROM z, bb WHERE split <> 'train'),
""" + auc_sql("v", "score", "1") + """
SELECT round((SELECT auc FROM a), 6) AS auc, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM bb""")
def m11_ridge(spark, d):
    """Ridge on a +/-1 target with balanced weights (normal equations from one Gram
    aggregation, intercept unpenalised)."""
    z = planted_frame(spark, d)
    m = M.Ridge(X, alpha=ALPHA).fit(z.filter(F.col("split") == "train"))
    b = m.state["beta"]
    a = _val_auc(z.withColumn("score", m.decision()))
    return a.select("auc", *[F.lit(round(b[i], 6)).alias(f"b{i}") for i in range(3)])


# ================================================================ M14 exact kNN
@register("m14_knn_exact", ids=("M14", "J7"), sql=lambda: _z_sql() + f""",
tr AS (SELECT row_id AS tk, x1, x2, label FROM z WHERE split = 'train' ORDER BY {sql_bits(42, 'knn', 'row_id')}, row_id LIMIT 1000),
q AS (SELECT row_id, x1, x2 FROM z WHERE split = 'val1'),
dd AS (SELECT q.row_id, tr.tk, tr.label, sqrt((q.x1 - tr.x1) * (q.x1 - tr.x1) + (q.x2 - tr.x2) * (q.x2 - tr.x2)) AS dist FROM q, tr),
kr AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, tk) AS rn FROM dd)
SELECT row_id, round(avg(label), 6) AS p FROM kr WHERE rn <= 5 GROUP BY row_id""")
def m14_knn_exact(spark, d):
    """5-NN (uniform, Euclidean) of every val1 row against the 1,000 train rows with the
    smallest hash (the operator's bound, here a small one); tiles in the tasks, no pair table."""
    z = planted_frame(spark, d)
    tr = z.filter(F.col("split") == "train")
    q = z.filter(F.col("split") == "val1")
    p = M.knn_predict(spark, tr, q, X, k=5, max_train_rows=1000)
    return p.select("row_id", r6("p").alias("p"))


# ================================================================ the model pool
# Four standardised features; the planted signal lies in two of them (best AUC about 0.82).
XW = X + ["x3", "x4"]
ABOVE = 0.7


def wide_frame(spark, d):
    pl = V.planted(spark, d).select("row_id", F.col("o_totalprice").alias("x1"), F.col("c_acctbal").alias("x2"),
                                    F.col("days").alias("x3"), F.col("month").alias("x4"), F.col("y").alias("label"))
    s = track(stratified_split(pl, "row_id", "label"))
    return StandardScale(XW).fit(s.filter(F.col("split") == "train")).transform(s)


def _pool_sql(name):
    return lambda: _z_sql() + f"""
SELECT '{name}' AS model, count(*) AS n_scored, true AS all_probabilities, true AS separates
FROM z WHERE split <> 'train'"""


def _pool_row(scored, name):
    """One row of checks: every row outside the train split has a probability, and the AUC is
    above the bound on the planted signal."""
    v = scored.filter(F.col("split") != "train")
    a = auc(v, "p", "label").select("auc")
    n = v.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if((F.col("p") >= 0) & (F.col("p") <= 1)).alias("good"))
    return n.crossJoin(F.broadcast(a)).select(  # one row each
        F.lit(name).alias("model"), "n_scored", (F.col("good") == F.col("n_scored")).alias("all_probabilities"),
        (F.col("auc") > ABOVE).alias("separates"))


def _pool_query(spark, d, name, params):
    z = wide_frame(spark, d)
    model = fit_classifier(name, params, z.filter(F.col("split") == "train"), XW)
    return _pool_row(model.transform(z), name)


@register("m2_lasso", ids=("M2", "X4"), sql=_pool_sql("lasso"))
def m2_lasso(spark, d):
    return _pool_query(spark, d, "lasso", {"C": 0.5})


@register("m3_random_forest", ids=("M3", "X4"), sql=_pool_sql("random_forest"))
def m3_random_forest(spark, d):
    return _pool_query(spark, d, "random_forest", {"n_estimators": 20, "max_depth": 5, "max_features": "sqrt"})


@register("m4_m15_linear_svc_calibrated", ids=("M4", "M15", "X4"), sql=_pool_sql("linear_svc"))
def m4_m15_linear_svc_calibrated(spark, d):
    """Linear SVC, its margin calibrated by sigmoid fits over 3 folds, averaged."""
    return _pool_query(spark, d, "linear_svc", {"C": 1.0, "max_iter": 30})


@register("m11_m15_ridge_calibrated", ids=("M11", "M15", "X4"), sql=_pool_sql("ridge"))
def m11_m15_ridge_calibrated(spark, d):
    return _pool_query(spark, d, "ridge", {"alpha": 1.0})


@register("m5_sgd_log_loss", ids=("M5", "X4"), sql=_pool_sql("sgd_classifier"))
def m5_sgd_log_loss(spark, d):
    return _pool_query(spark, d, "sgd_classifier", {"loss": "log_loss", "penalty": "elasticnet", "alpha": 1e-3})


@register("m5_sgd_modified_huber", ids=("M5",), sql=_pool_sql("sgd_classifier"))
def m5_sgd_modified_huber(spark, d):
    return _pool_query(spark, d, "sgd_classifier", {"loss": "modified_huber", "penalty": "l1", "alpha": 1e-4})


@register("m6_extra_trees", ids=("M6", "X4"), sql=_pool_sql("extra_trees"))
def m6_extra_trees(spark, d):
    return _pool_query(spark, d, "extra_trees", {"n_estimators": 8, "max_depth": 6, "max_features": "sqrt", "min_samples_split": 6,
                                                 "min_samples_leaf": 4, "min_impurity_decrease": 1e-7})


_CUTS = [py_uniform(42, "et-cut", 0, 1, f) for f in range(2)]


@register("m6_first_split", ids=("M6",), sql=lambda: _z_sql() + f""",
t AS (SELECT * FROM z WHERE split = 'train'),
w AS (SELECT label, (SELECT count(*) FROM t) / (2.0 * count(*)) AS w FROM t GROUP BY label),
c AS (SELECT 0 AS f, min(x1) + (max(x1) - min(x1)) * {_CUTS[0]!r}::DOUBLE AS cut FROM t
      UNION ALL SELECT 1, min(x2) + (max(x2) - min(x2)) * {_CUTS[1]!r}::DOUBLE FROM t),
sd AS (SELECT f, cut, CASE WHEN f = 0 THEN x1 ELSE x2 END <= cut AS l, t.label, w.w FROM t JOIN w USING (label), c),
g AS (SELECT f, cut, sum(w) FILTER (l AND label = 0) AS l0, sum(w) FILTER (l AND label = 1) AS l1,
      sum(w) FILTER (NOT l AND label = 0) AS r0, sum(w) FILTER (NOT l AND label = 1) AS r1 FROM sd GROUP BY 1, 2)
SELECT f AS column_index, round(cut, 6) AS cut, round(l1 / (l0 + l1), 6) AS left_value, round(r1 / (r0 + r1), 6) AS right_value FROM g
ORDER BY (l0 + l1) * (1 - (l0 * l0 + l1 * l1) / ((l0 + l1) * (l0 + l1))) + (r0 + r1) * (1 - (r0 * r0 + r1 * r1) / ((r0 + r1) * (r0 + r1))) LIMIT 1""")
def m6_first_split(spark, d):
    """M6: the root's split of a tree with one drawn cut a column, and the values of its leaves."""
    z = planted_frame(spark, d)
    s = ExtraTrees(X, n_estimators=1, max_depth=1, max_features="all").fit(z.filter(F.col("split") == "train")).state
    return spark.createDataFrame([(int(s["feature"][0][1]), round(s["cut"][0][1], 6), *[round(s["value"][0][i], 6) for i in (2, 3)])],
                                 "column_index int, cut double, left_value double, right_value double")


@register("m7_adaboost", ids=("M7", "X4"), sql=_pool_sql("adaboost"))
def m7_adaboost(spark, d):
    return _pool_query(spark, d, "adaboost", {"n_estimators": 6, "learning_rate": 1.0})


@register("m8_m9_m10_closed_forms_in_pool", ids=("M8", "M9", "M10", "X4"), sql=lambda: " UNION ALL ".join(
    f"SELECT * FROM ({_pool_sql(n)()}) t_{n}" for n in ("naive_bayes", "lda", "qda")))
def m8_m9_m10_closed_forms_in_pool(spark, d):
    z = wide_frame(spark, d)
    train = z.filter(F.col("split") == "train")
    rows = [_pool_row(fit_classifier(n, {"reg_param": 0.01}, train, XW).transform(z), n) for n in ("naive_bayes", "lda", "qda")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("m12_gradient_boosting", ids=("M12", "X4"), sql=_pool_sql("gradient_boosting"))
def m12_gradient_boosting(spark, d):
    """M12 with leaf L2 and early stopping on a hash-held tenth of the train rows."""
    return _pool_query(spark, d, "gradient_boosting", {"max_iter": 6, "max_depth": 3, "learning_rate": 0.3, "max_bins": 64,
                                                       "l2_regularization": 0.5, "n_iter_no_change": 3})


@register("m12_first_round", ids=("M12",), sql=lambda: _z_sql() + """,
t AS (SELECT label, x1, x2, avg(label) OVER () AS p FROM z WHERE split = 'train'),
e AS (SELECT 0 AS f, unnest(quantile_cont(x1, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS cut FROM t
      UNION SELECT 1, unnest(quantile_cont(x2, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) FROM t),
sd AS (SELECT f, cut, CASE WHEN f = 0 THEN x1 ELSE x2 END <= cut AS l, p - label AS g, p * (1 - p) AS h, p FROM t, e),
a AS (SELECT f, cut, max(p) AS p, sum(g) FILTER (l) AS gl, sum(h) FILTER (l) AS hl, sum(g) FILTER (NOT l) AS gr, sum(h) FILTER (NOT l) AS hr
      FROM sd GROUP BY 1, 2 HAVING count(*) FILTER (l) >= 20 AND count(*) FILTER (NOT l) >= 20)
SELECT f AS column_index, round(cut, 6) AS cut, round(-gl / (hl + 2.0), 6) AS left_value, round(-gr / (hr + 2.0), 6) AS right_value,
  round(ln(p / (1 - p)), 6) AS base FROM a ORDER BY gl * gl / (hl + 2.0) + gr * gr / (hr + 2.0) DESC LIMIT 1""")
def m12_first_round(spark, d):
    """The first split of the first round and its second-order leaf values with l2 = 2."""
    z = planted_frame(spark, d)
    m = HistogramBoosting(X, max_iter=1, max_depth=1, learning_rate=1.0, l2_regularization=2.0, max_bins=8, validation_fraction=0.0)
    s = m.fit(z.filter(F.col("split") == "train")).state
    feature, cut, value = s["trees"][0]
    return spark.createDataFrame([(int(feature[1]), round(cut[1], 6), round(value[2], 6), round(value[3], 6), round(s["base"], 6))],
                                 "column_index int, cut double, left_value double, right_value double, base double")


@register("m13_mlp", ids=("M13", "X4"), sql=_pool_sql("mlp"))
def m13_mlp(spark, d):
    return _pool_query(spark, d, "mlp", {"n_layers": 2, "size_1": 8, "size_2": 4, "max_iter": 20, "activation": "tanh", "alpha": 1e-3,
                                         "learning_rate_init": 0.01})


@register("m1_logistic_balanced", ids=("M1", "FE41"), sql=lambda: _z_sql() + """
SELECT 'logistic' AS model, (SELECT count(*) FROM z WHERE split = 'train') AS n_train, true AS at_optimum, true AS separates""")
def m1_logistic_balanced(spark, d):
    """M1: balanced logistic regression; at its optimum the gradient of the penalised mean loss
    vanishes (computed from the fitted coefficients in one aggregation)."""
    z = wide_frame(spark, d)
    train = z.filter(F.col("split") == "train")
    model = fit_classifier("logistic", {"C": 1.0, "tol": 1e-7}, train, XW)
    w = [float(c) for c in model.model.coefficients]
    n = train.count()
    p = model.transform(class_weights(train, "label"))
    gap = F.col("weight") * (F.col("p") - F.col("label"))
    # the penalty acts on standardised coefficients (Spark's default), and x is standardised
    g = p.agg(*[F.avg(gap * F.col(c)).alias(c) for c in XW], F.avg(gap).alias("b")).first()
    slope = max([abs(g[c] + w[i] / n) for i, c in enumerate(XW)] + [abs(g["b"])])
    scored = _pool_row(model.transform(z), "logistic")
    return scored.select("model", F.lit(n).cast("bigint").alias("n_train"), F.lit(slope < 1e-4).alias("at_optimum"), "separates")


# ================================================================ CV and random search
@register("mt5_mt6_cv_oof", ids=("MT5", "MT6", "SM9", "U1"), sql=lambda: _z_sql() + f""",
zf AS (SELECT row_id, label, x1, x2, CAST((row_number() OVER (PARTITION BY label ORDER BY {sql_bits(42, 'kfold', 'row_id')}, row_id) - 1) % 3
       AS INTEGER) AS fold FROM z WHERE split = 'train'),
fo AS (SELECT DISTINCT fold AS f FROM zf),
al AS (SELECT f, count(*) AS n, greatest(var_pop(x1), var_pop(x2)) * 1e-9 AS e FROM fo JOIN zf ON zf.fold <> fo.f GROUP BY f),
fst AS (SELECT f, label AS k, count(*) AS nk, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2
       FROM fo JOIN zf ON zf.fold <> fo.f GROUP BY f, label),
sc AS (SELECT zf.row_id, zf.fold, zf.label, fst.k, ln(nk / al.n) - 0.5 * (ln(2 * pi() * (v1 + e)) + ln(2 * pi() * (v2 + e)))
       - 0.5 * (x1 - m1) * (x1 - m1) / (v1 + e) - 0.5 * (x2 - m2) * (x2 - m2) / (v2 + e) AS j
       FROM zf JOIN fst ON fst.f = zf.fold JOIN al ON al.f = zf.fold),
oof AS (SELECT row_id, fold, label, max(CASE WHEN k = 1 THEN j END) - max(CASE WHEN k = 0 THEN j END) AS s FROM sc GROUP BY 1, 2, 3),
both_ AS (SELECT fold, label, s FROM oof UNION ALL SELECT -1, label, s FROM oof),
""" + auc_sql("both_", "s", "fold") + """
SELECT fold, round(auc, 6) AS auc FROM a""")
def mt5_mt6_cv_oof(spark, d):
    """MT5 per-fold AUC and MT6 out-of-fold predictions (union of the k held-out folds)
    with Gaussian NB fitted per fold (log-odds scores: the sigmoid would tie at 1)."""
    z = track(kfold(planted_frame(spark, d).filter(F.col("split") == "train"), "row_id", "label", k=3))
    oof = None
    for f in range(3):
        nb = M.GaussianNB(X).fit(z.filter(F.col("fold") != f))
        part = z.filter(F.col("fold") == f).withColumn("s", nb.decision())
        oof = part if oof is None else oof.unionByName(part)
    both = oof.select("fold", "label", "s").unionByName(oof.select(F.lit(-1).alias("fold"), "label", "s"))
    return auc(both, "s", "label", by=["fold"]).select("fold", r6("auc").alias("auc"))


DRAWS = [(i, round(10 ** (-4 + 4 * py_uniform(42, "qda_reg", i)), 6)) for i in range(4)]


@register("mt7_random_search_cv", ids=("MT7", "SM11", "O4"), sql=lambda: _z_sql() + f""",
zf AS (SELECT row_id, label, x1, x2, (row_number() OVER (PARTITION BY label ORDER BY {sql_bits(42, 'kfold', 'row_id')}, row_id) - 1) % 3
       AS fold FROM z WHERE split = 'train'),
dr AS (SELECT * FROM (VALUES {', '.join(f'({i}, {r!r}::DOUBLE)' for i, r in DRAWS)}) t(draw, reg)),
fo AS (SELECT DISTINCT fold AS f FROM zf),
fst AS (SELECT f, label AS k, count(*) AS nk, sum(count(*)) OVER (PARTITION BY f) AS n, avg(x1) AS a1, avg(x2) AS a2, var_samp(x1) AS v1,
       var_samp(x2) AS v2, covar_samp(x1, x2) AS c12 FROM fo JOIN zf ON zf.fold <> fo.f GROUP BY f, label),
pr AS (SELECT *, (1 - reg) * v1 + reg AS s11, (1 - reg) * v2 + reg AS s22, (1 - reg) * c12 AS s12 FROM fst, dr),
pd AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM pr),
sc AS (SELECT zf.row_id, zf.fold, zf.label, draw, k, ln(nk / n) - 0.5 * ln(det) - 0.5 * ((s22 / det) * (x1 - a1) * (x1 - a1)
         - 2 * (s12 / det) * (x1 - a1) * (x2 - a2) + (s11 / det) * (x2 - a2) * (x2 - a2)) AS q FROM zf JOIN pd ON pd.f = zf.fold),
od AS (SELECT draw * 3 + fold AS g, label, max(CASE WHEN k = 1 THEN q END) - max(CASE WHEN k = 0 THEN q END) AS s
       FROM sc GROUP BY row_id, 1, 2),
""" + auc_sql("od", "s", "g") + """,
m AS (SELECT CAST(g // 3 AS INTEGER) AS draw, avg(auc) AS mean_auc FROM a GROUP BY 1)
SELECT m.draw, dr.reg, round(mean_auc, 6) AS mean_auc, round(mean_auc, 6) = (SELECT max(round(mean_auc, 6)) FROM m)
  AND m.draw = (SELECT min(draw) FROM m m2 WHERE round(m2.mean_auc, 6) = (SELECT max(round(mean_auc, 6)) FROM m)) AS best,
  (SELECT count(*) FROM z WHERE split <> 'train') AS n_refit_scored
FROM m JOIN dr USING (draw)""")
def mt7_random_search_cv(spark, d):
    """MT7: hash-drawn QDA regularisation values, 3-fold CV mean AUC each, best by mean AUC
    (ties by draw), refitted on all train rows and scored outside them."""
    z = planted_frame(spark, d)
    zf = track(kfold(z.filter(F.col("split") == "train"), "row_id", "label", k=3))
    scored = None
    for f in range(3):
        part = zf.filter(F.col("fold") == f)
        fits = [(i, M.QDA(X, reg=reg).fit(zf.filter(F.col("fold") != f))) for i, reg in DRAWS]
        cells = F.explode(F.array(*[F.struct(F.lit(i * 3 + f).alias("g"), m.decision().alias("s")) for i, m in fits]))
        rows = part.select("label", cells.alias("c")).select("label", "c.*")
        scored = rows if scored is None else scored.unionByName(rows)
    got = {r["g"]: r["auc"] for r in auc(scored, "s", "label", by=["g"]).collect()}  # draws x folds values
    rows = [(i, reg, round(sum(got[i * 3 + f] for f in range(3)) / 3, 6)) for i, reg in DRAWS]
    best = max(rows, key=lambda r: (r[2], -r[0]))
    refit = M.QDA(X, reg=best[1]).fit(z.filter(F.col("split") == "train"))
    n = refit.transform(z.filter(F.col("split") != "train")).filter("p is not null").count()
    return spark.createDataFrame([(i, reg, m, i == best[0], n) for i, reg, m in rows],
                                 "draw int, reg double, mean_auc double, best boolean, n_refit_scored long")


_TUNED = {"qda": {"reg_param": log10(-4, 0)}, "naive_bayes": {"var_smoothing": log10(-9, 0)}}
_TUNE_FITS = {"naive_bayes": lambda p, t, f, y, key, seed: M.GaussianNB(f, y, var_smoothing=p["var_smoothing"]).fit(t)}
_TRIALS = draw_trials(8, _TUNED)


@register("mt7_random_search_families", ids=("MT7", "SM11", "MT5", "M8", "M10"), sql=lambda: _z_sql() + f""",
zf AS (SELECT row_id, label, x1, x2, (row_number() OVER (PARTITION BY label ORDER BY {sql_bits(42, 'kfold', 'row_id')}, row_id) - 1) % 3
       AS fold FROM z WHERE split = 'train'),
dr AS (SELECT * FROM (VALUES {', '.join(f"({t.draw}, '{t.family}', {float(next(iter(t.params.values())))!r}::DOUBLE)" for t in _TRIALS)}) t(draw, family, par)),
fo AS (SELECT DISTINCT fold AS f FROM zf),
al AS (SELECT f, greatest(var_pop(x1), var_pop(x2)) AS top FROM fo JOIN zf ON zf.fold <> fo.f GROUP BY f),
fst AS (SELECT f, label AS k, count(*) AS nk, sum(count(*)) OVER (PARTITION BY f) AS n, avg(x1) AS a1, avg(x2) AS a2, var_samp(x1) AS v1,
       var_samp(x2) AS v2, covar_samp(x1, x2) AS c12, var_pop(x1) AS p1, var_pop(x2) AS p2 FROM fo JOIN zf ON zf.fold <> fo.f GROUP BY f, label),
pr AS (SELECT fst.f, k, nk, n, a1, a2, draw, CASE family WHEN 'qda' THEN (1 - par) * v1 + par ELSE p1 + par * top END AS s11,
       CASE family WHEN 'qda' THEN (1 - par) * v2 + par ELSE p2 + par * top END AS s22,
       CASE family WHEN 'qda' THEN (1 - par) * c12 ELSE 0.0 END AS s12 FROM fst JOIN al USING (f), dr),
pd AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM pr),
sc AS (SELECT zf.row_id, zf.fold, zf.label, draw, k, ln(nk / n) - 0.5 * ln(det) - 0.5 * ((s22 / det) * (x1 - a1) * (x1 - a1)
         - 2 * (s12 / det) * (x1 - a1) * (x2 - a2) + (s11 / det) * (x2 - a2) * (x2 - a2)) AS q FROM zf JOIN pd ON pd.f = zf.fold),
od AS (SELECT draw * 3 + fold AS g, label, max(CASE WHEN k = 1 THEN q END) - max(CASE WHEN k = 0 THEN q END) AS s
       FROM sc GROUP BY row_id, 1, 2),
""" + auc_sql("od", "s", "g") + """,
m AS (SELECT CAST(g // 3 AS INTEGER) AS draw, avg(auc) AS mean_auc FROM a GROUP BY 1)
SELECT m.draw, dr.family, dr.par AS parameter, round(mean_auc, 6) AS mean_auc,
  m.draw = (SELECT draw FROM m ORDER BY mean_auc DESC, draw LIMIT 1) AS best, (SELECT count(*) FROM z WHERE split <> 'train') AS n_refit_scored
FROM m JOIN dr USING (draw)""")
def mt7_random_search_families(spark, d):
    """MT7: eight draws over two families, each with a parameter of its own; the best refitted."""
    z = planted_frame(spark, d)
    got = random_search(z.filter(F.col("split") == "train"), X, 8, _TUNED, _TUNE_FITS)
    n = got["model"].transform(z.filter(F.col("split") != "train")).filter("p is not null").count()
    rows = [(t.draw, t.family, float(next(iter(t.params.values()))), round(mean, 6), t == got["best"], n) for t, mean, _ in got["trials"]]
    return spark.createDataFrame(rows, "draw int, family string, parameter double, mean_auc double, best boolean, n_refit_scored long")
