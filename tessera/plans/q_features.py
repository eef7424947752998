"""Fitted feature-operator queries (FE1-FE29, FE38/39) on the base views.

Where an operator's output COLUMNS depend on fitted state (dropped columns, one-hot
levels, random pairs) the query returns the long form (row_id, feature, value), so the
oracle SQL derives the same state itself instead of hard-coding it.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import sql_uniform
from ..functions.scalar import r6
from ..operators import features as FE
from ..operators.wide import WideFeatures, WideSelect
from ..sources import views as V
from ..sources.tables import read_table
from .registry import register
from .sqlv import with_views

NUM = ["o_totalprice", "c_acctbal", "days", "month"]
DIRTY = ["o_totalprice", "c_acctbal", "days", "month", "null_col"]


def long_form(df, key, cols, name="feature"):
    return df.select(key, *cols).unpivot(key, cols, name, "value").select(key, name, r6("value").alias("value"))


def _unpivot_sql(src, cols, key="row_id", alias="x"):
    vals = ", ".join(f"('{c}', {alias}.{c})" for c in cols)
    return f"SELECT {alias}.{key}, u.name, u.value FROM {src} {alias}, LATERAL (SELECT * FROM (VALUES {vals}) v(name, value)) u"


def _finite(c):
    return f"CASE WHEN isfinite({c}) THEN {c} END"


# ================================================================ FE1 / FE1b
@register("fe1_clean_median", ids=("FE1", "C1", "C2"), sql=lambda: with_views("dirty") + f"""
, m AS (SELECT {', '.join(f'quantile_cont({_finite(c)}, 0.5) AS m_{c}' for c in DIRTY)} FROM dirty)
SELECT row_id, {', '.join(f'round(coalesce({_finite(c)}, m_{c}, 0.0), 6) AS {c}' for c in DIRTY)} FROM dirty, m""")
def fe1_clean_median(spark, d):
    """FE1: NaN/+inf/-inf/null -> column median of finite values; all-bad column -> 0."""
    df = V.dirty(spark, d).select("row_id", *DIRTY)
    out = FE.CleanNumeric(DIRTY, "median").fit_transform(df)
    return out.select("row_id", *[r6(c).alias(c) for c in DIRTY])


@register("fe1b_clean_mean_drop_empty", ids=("FE1b", "C2"), sql=lambda: with_views("dirty") + f"""
, l AS ({_unpivot_sql('dirty', DIRTY)}),
m AS (SELECT name, avg({_finite('value')}) AS fill FROM l GROUP BY name)
SELECT l.row_id, l.name AS feature, round(coalesce({_finite('l.value')}, m.fill), 6) AS value
FROM l JOIN m USING (name) WHERE m.fill IS NOT NULL""")
def fe1b_clean_mean_drop_empty(spark, d):
    """FE1b: mean strategy; a column without finite values is dropped (long form)."""
    df = V.dirty(spark, d).select("row_id", *DIRTY)
    op = FE.CleanNumeric(DIRTY, "mean", drop_empty=True).fit(df)
    return long_form(op.transform(df), "row_id", op.outputs())


# ================================================================ FE2 / FE3
@register("fe2_fe3_scalers", ids=("FE2", "FE3a", "FE3b"), sql=lambda: with_views("base") + f"""
, s AS (SELECT {', '.join(f'avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}, '
                          f'quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}' for c in NUM)} FROM base)
SELECT row_id, {', '.join(
    f"round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END, 6) AS std_{c}, "
    f"round(({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END, 6) AS mm_{c}, "
    f"round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END, 6) AS rb_{c}"
    for c in NUM)} FROM base, s""")
def fe2_fe3_scalers(spark, d):
    """FE2 standard (population std), FE3a min-max, FE3b robust (median / IQR)."""
    b = V.base(spark, d).select("row_id", *NUM)
    b = b.select("row_id", *[F.col(c).alias(f"{p}_{c}") for p in ("std", "mm", "rb") for c in NUM])
    ops = [FE.StandardScale([f"std_{c}" for c in NUM]), FE.MinMaxScale([f"mm_{c}" for c in NUM]),
           FE.RobustScale([f"rb_{c}" for c in NUM])]
    for op in ops:
        b = op.fit_transform(b)
    return b.select("row_id", *[r6(c).alias(c) for c in b.columns if c != "row_id"])


# ================================================================ FE4 / FE5
_PRIO = V.BASE_ROLES["ordinal"]["o_orderpriority"]


@register("fe4_fe5_encoders", ids=("FE4", "FE5", "C4"), sql=lambda: with_views("base") + f"""
, fit AS (SELECT * FROM base WHERE c_mktsegment <> 'MACHINERY'),
lv AS (SELECT DISTINCT c_mktsegment AS lvl FROM fit),
lvs AS (SELECT list(lvl ORDER BY lvl) AS levels FROM lv),
lv1 AS (SELECT lvl FROM lv WHERE lvl > (SELECT min(lvl) FROM lv))
SELECT b.row_id, 'c_mktsegment_' || lv1.lvl AS feature, CASE WHEN b.c_mktsegment = lv1.lvl THEN 1.0 ELSE 0.0 END AS value
FROM base b, lv1
UNION ALL
SELECT b.row_id, 'o_orderpriority', CAST(coalesce(list_position([{', '.join(repr(x) for x in _PRIO)}], b.o_orderpriority) - 1, -1) AS DOUBLE)
FROM base b
UNION ALL
SELECT b.row_id, 'segment_code', CAST(coalesce(list_position(lvs.levels, b.c_mktsegment) - 1, -1) AS DOUBLE) FROM base b, lvs""")
def fe4_fe5_encoders(spark, d):
    """FE4 ordinal with given order and with sorted-distinct order (unknown -> -1);
    FE5 one-hot with the first level dropped (unknown -> zeros). Fitted without the
    MACHINERY segment so that level is unseen at transform time."""
    b = V.base(spark, d).select("row_id", "o_orderpriority", "c_mktsegment",
                                F.col("c_mktsegment").alias("segment_code"))
    fit = b.filter(F.col("c_mktsegment") != "MACHINERY")
    ordi = FE.OrdinalEncode({"o_orderpriority": _PRIO, "segment_code": None}).fit(fit)
    oh = FE.OneHot(["c_mktsegment"]).fit(fit)
    out = oh.transform(ordi.transform(b))
    return long_form(out, "row_id", oh.outputs() + ["o_orderpriority", "segment_code"])


# ================================================================ FE6 / FE7 / FE8 / FE9
@register("fe6_iqr_clip", ids=("FE6",), sql=lambda: with_views("base") + f"""
, q AS (SELECT {', '.join(f'quantile_cont({c}, [0.25, 0.75]) AS q_{c}' for c in NUM)} FROM base)
SELECT row_id, {', '.join(f'round(least(greatest({c}, q_{c}[1] - 2.0 * (q_{c}[2] - q_{c}[1])), q_{c}[2] + 2.0 * (q_{c}[2] - q_{c}[1])), 6) AS {c}' for c in NUM)}
FROM base, q""")
def fe6_iqr_clip(spark, d):
    b = V.base(spark, d).select("row_id", *NUM)
    return FE.IQRClip(NUM, 2.0).fit_transform(b).select("row_id", *[r6(c).alias(c) for c in NUM])


_VF_COLS = ["const_col", "o_totalprice", "c_acctbal", "days", "month"]


@register("fe7_fe8_variance_filters", ids=("FE7", "FE8", "C3"), sql=lambda: with_views("base") + f"""
, x AS (SELECT row_id, 1.0::DOUBLE AS const_col, o_totalprice, c_acctbal, days, month FROM base),
v AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_VF_COLS))}) t(idx, name)),
l AS ({_unpivot_sql('x', _VF_COLS)}),
s AS (SELECT v.idx, l.name, var_pop(l.value) AS vp FROM l JOIN v USING (name) GROUP BY v.idx, l.name)
SELECT name AS column_name, round(vp, 2) AS var_pop,
  (vp >= 1e-10 OR (NOT EXISTS (SELECT 1 FROM s WHERE vp >= 1e-10) AND idx = 0)) AS kept_constant_rule,
  vp > 13.0 AS kept_threshold FROM s""")
def fe7_fe8_variance_filters(spark, d):
    """FE7 constant remover (var < 1e-10 dropped, first kept if all constant) and FE8
    variance threshold (keep var_pop > t); decisions as rows."""
    b = V.base(spark, d).select("row_id", F.lit(1.0).alias("const_col"), *NUM)
    f7 = FE.VarianceFilter(_VF_COLS, 1e-10, keep_first_if_empty=True, strict_less=True).fit(b)
    f8 = FE.VarianceFilter(_VF_COLS, 13.0, keep_first_if_empty=False, strict_less=False).fit(b)
    rows = [(c, round(f7.state["var"][c], 2), c in f7.outputs(), c in f8.outputs()) for c in _VF_COLS]
    # The decisions are O(columns) values; the variances themselves come from the one-pass fit.
    return spark.createDataFrame(rows, "column_name string, var_pop double, kept_constant_rule boolean, kept_threshold boolean")


_AGG = V.BASE_AGG_SQL
_F_COLS = NUM + [f"{k}_{c}" for c in V.LINE_COLS for k in ("sum", "avg", "max")]


@register("fe9_anova_select", ids=("FE9",), sql=lambda: with_views("base_agg") + f"""
, v AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_F_COLS))}) t(idx, name)),
l AS ({_unpivot_sql('base_agg', _F_COLS + ['label'])}),
y AS (SELECT row_id, value AS label FROM l WHERE name = 'label'),
g AS (SELECT l.name, y.label, count(*) AS n, avg(l.value) AS m, var_pop(l.value) AS vp
      FROM l JOIN y USING (row_id) WHERE l.name <> 'label' GROUP BY 1, 2),
t AS (SELECT name, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS grand FROM g GROUP BY name),
f AS (SELECT g.name, (sum(g.n * (g.m - t.grand) * (g.m - t.grand)) / (max(t.k) - 1))
        / (sum(g.n * g.vp) / (max(t.n) - max(t.k))) AS f FROM g JOIN t USING (name) GROUP BY g.name),
r AS (SELECT f.name, f.f, row_number() OVER (ORDER BY f.f DESC, v.idx) AS rk FROM f JOIN v USING (name))
SELECT name AS column_name, round(f, 6) AS f_stat, rk <= {max(1, int(len(_F_COLS) * 50 / 100))} AS kept FROM r""")
def fe9_anova_select(spark, d):
    """FE9: one-way ANOVA F per column from one grouped pass; keep the top 50 %."""
    b = V.base_agg(spark, d)
    op = FE.SelectPercentileF(_F_COLS, "label", 50).fit(b)
    rows = [(c, round(op.state["f"][c], 6), c in op.outputs()) for c in _F_COLS]
    return spark.createDataFrame(rows, "column_name string, f_stat double, kept boolean")


# ================================================================ FE10-FE17
def _pairs_sql(kind, n_feat, n_in, seed=42):
    ui = sql_uniform(seed, kind, "t", "'i'")
    uj = sql_uniform(seed, kind, "t", "'j'")
    return f"""p_{kind} AS (SELECT t, i, CASE WHEN j0 < i THEN j0 ELSE j0 + 1 END AS j FROM (
  SELECT t, CAST(floor({ui} * {n_in}) AS INTEGER) AS i, CAST(floor({uj} * {n_in - 1}) AS INTEGER) AS j0
  FROM range(0, {n_feat}) r(t)) q)"""


_PAIR_OPS = {"ratio": "a.value / (b.value + 1e-8)", "product": "a.value * b.value",
             "difference": "a.value - b.value", "sum": "a.value + b.value"}
_TAG = {"ratio": "ratio", "product": "product", "difference": "diff", "sum": "sum"}


@register("fe10_fe13_random_pairs", ids=("FE10", "FE11", "FE12", "FE13", "FE40"), sql=lambda: with_views("base") + ", "
          + ", ".join(_pairs_sql(k, 5, 4) for k in _PAIR_OPS) + f"""
, cols AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(NUM))}) t(idx, name)),
l AS (SELECT u.row_id, cols.idx, u.value FROM ({_unpivot_sql('base', NUM)}) u JOIN cols USING (name))
""" + " UNION ALL ".join(
    f"SELECT a.row_id, '{_TAG[k]}_' || p.i || '_' || p.j || CASE WHEN p.k > 1 THEN '_' || p.k ELSE '' END AS feature, round({_PAIR_OPS[k]}, 6) AS value "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY t) AS k FROM p_{k}) p JOIN l a ON a.idx = p.i JOIN l b ON b.idx = p.j AND b.row_id = a.row_id" for k in _PAIR_OPS))
def fe10_fe13_random_pairs(spark, d):
    """FE10-FE13: five hash-drawn pairs per kind (ratio, product, difference, sum), one scan; a
    pair that is drawn again is a feature of its own."""
    b = V.base(spark, d).select("row_id", *NUM)
    ops = [FE.RandomPairs(NUM, kind, 5, seed=42) for kind in _PAIR_OPS]
    exprs = {n: e for op in ops for n, e in op.expressions().items()}
    return long_form(b.select("row_id", *[e.alias(n) for n, e in exprs.items()]), "row_id", list(exprs))


@register("fe14_fe17_unary", ids=("FE14", "FE15", "FE16", "FE17", "F1"), sql=lambda: with_views("base") + f"""
SELECT row_id, {', '.join(
    f"round(1.0 / ({c} + 1e-8), 6) AS inv_{c}, round({c} * {c}, 6) AS {c}_sq, "
    f"round(sqrt(abs({c})) * sign({c}), 6) AS sqrt_{c}, round(ln(abs({c}) + 1) * sign({c}), 6) AS log_{c}"
    for c in ['c_acctbal', 'days'])} FROM base""")
def fe14_fe17_unary(spark, d):
    b = V.base(spark, d).select("row_id", "c_acctbal", "days")
    exprs = {n: e for kind in FE.UNARY for n, e in FE.Unary(["c_acctbal", "days"], kind).expressions().items()}
    return b.select("row_id", *[r6(e).alias(n) for n, e in exprs.items()])


# ================================================================ FE18 binning
@register("fe18_binning", ids=("FE18", "C10"), sql=lambda: with_views("base") + f"""
, e AS (SELECT {', '.join(f"list_sort(list_distinct(quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS qe_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUM)} FROM base)
SELECT row_id, {', '.join(
    f"CAST(len(list_filter(qe_{c}[2:len(qe_{c}) - 1], lambda x: x <= {c})) AS DOUBLE) AS q_{c}, "
    f"CAST((CASE WHEN {c} >= lo_{c} + (hi_{c} - lo_{c}) * 1 / 4 THEN 1 ELSE 0 END + CASE WHEN {c} >= lo_{c} + (hi_{c} - lo_{c}) * 2 / 4 THEN 1 ELSE 0 END"
    f" + CASE WHEN {c} >= lo_{c} + (hi_{c} - lo_{c}) * 3 / 4 THEN 1 ELSE 0 END) AS DOUBLE) AS u_{c}" for c in NUM)}
FROM base, e""")
def fe18_binning(spark, d):
    """FE18: quantile bins (5, linear percentiles, equal edges merged, e.g. month) and
    uniform bins (4); ordinal code = number of inner edges <= x."""
    b = V.base(spark, d).select("row_id", *[F.col(c).alias(f"q_{c}") for c in NUM], *[F.col(c).alias(f"u_{c}") for c in NUM])
    q = FE.Binning([f"q_{c}" for c in NUM], 5, "quantile").fit(b)
    u = FE.Binning([f"u_{c}" for c in NUM], 4, "uniform").fit(b)
    out = u.transform(q.transform(b))
    cols = q.outputs() + u.outputs()
    return out.select("row_id", *[F.col(c).alias(c.replace("binned_", "")) for c in cols])


# ================================================================ FE22 noise
def _noise_sql(c, seed=42, lo=0.01, hi=0.2):
    """Noise of a column with its drawn distribution and scale."""
    u, u2 = sql_uniform(seed, f"noise|{c}", "row_id"), sql_uniform(seed, f"noise2|{c}", "row_id")
    pick = sql_uniform(seed, "noisedist", f"'{c}'")
    s = f"(({lo} + ({hi} - {lo}) * {sql_uniform(seed, 'noisescale', repr(c))}) * sd_{c})"
    return f"""CASE CAST(floor({pick} * 4) AS INTEGER)
  WHEN 0 THEN {s} * sqrt(-2.0 * ln(1.0 - {u})) * cos({2 * math.pi!r} * {u2})
  WHEN 1 THEN ({u} - 0.5) * sqrt(12.0) * {s}
  WHEN 2 THEN -({s} / sqrt(2.0)) * sign({u} - 0.5) * ln(1.0 - 2.0 * abs({u} - 0.5))
  ELSE {s} * (-ln(1.0 - {u}) - 1.0) END"""


@register("fe22_noise_injection", ids=("FE22",), sql=lambda: with_views("base") + f"""
, s AS (SELECT {', '.join(f'coalesce(nullif(stddev_pop({c}), 0), 1.0) AS sd_{c}' for c in NUM)} FROM base),
pick AS (SELECT name FROM (VALUES {', '.join(f"('{c}')" for c in NUM)}) t(name)
  ORDER BY {sql_uniform(42, 'noisecol', 'name')}, name LIMIT {int(len(NUM) * 0.8)})
""" + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS feature, round(CASE WHEN '{c}' IN (SELECT name FROM pick) "
    f"THEN {c} + {_noise_sql(c)} ELSE {c} END, 6) AS value FROM base, s" for c in NUM))
def fe22_noise_injection(spark, d):
    """FE22: centred noise on the hash-chosen 80 % of the columns, distribution and scale drawn
    per column; deterministic per (seed, column, row)."""
    b = V.base(spark, d).select("row_id", *NUM)
    op = FE.NoiseInjector(NUM, "row_id", fraction=0.8, seed=42).fit(b)
    return long_form(op.transform(b), "row_id", NUM)


# ================================================================ FE23-FE28
_AP = ["o_totalprice", "c_acctbal", "month"]


@register("fe23_fe25_all_pairs", ids=("FE23", "FE24", "FE25", "FE39"), sql=lambda: with_views("base") + f"""
, m AS (SELECT {', '.join(f'min({c}) AS mn_{c}' for c in _AP)} FROM base)
SELECT row_id, {', '.join(
    [f"round({a} - {b}, 6) AS diff_{a}_{b}, round({a} + {b}, 6) AS sum_{a}_{b}" for i, a in enumerate(_AP) for b in _AP[i + 1:]]
    + [f"round({a} / ({b} + mn_{b} + 1.0), 6) AS ratio_{a}_{b}" for a in _AP for b in _AP if a != b])} FROM base, m""")
def fe23_fe25_all_pairs(spark, d):
    """FE23/FE24 all-pairs difference and sum, FE25 ordered-pair offset ratio; blocks are
    unioned side by side (FE39)."""
    b = V.base(spark, d).select("row_id", *_AP)
    ops = [FE.AllPairs(_AP, "difference"), FE.AllPairs(_AP, "sum"), FE.AllPairs(_AP, "ratio").fit(b)]
    out = b
    for op in ops:
        out = op.transform(out)
    cols = [c for op in ops for c in op.outputs()]
    return out.select("row_id", *[r6(c).alias(c) for c in cols])


@register("fe26_fe28_offset_ops", ids=("FE26", "FE27", "FE28", "T16"), sql=lambda: with_views("base") + f"""
, m AS (SELECT {', '.join(f'min({c}) AS mn_{c}' for c in ['c_acctbal', 'days'])} FROM base)
SELECT row_id, {', '.join(
    f"round(CASE WHEN {c} + mn_{c} + 1.0 <> 0 THEN 1.0 / ({c} + mn_{c} + 1.0) END, 6) AS reciprocal_off_{c}, "
    f"round(CASE WHEN {c} + mn_{c} + 1.0 > 0 THEN ln({c} + mn_{c} + 1.0) END, 6) AS log_off_{c}, "
    f"round(CASE WHEN {c} + mn_{c} + 1.0 >= 0 THEN sqrt({c} + mn_{c} + 1.0) END, 6) AS sqrt_off_{c}"
    for c in ['c_acctbal', 'days'])} FROM base, m""")
def fe26_fe28_offset_ops(spark, d):
    """FE26-FE28 with the reference's x + min + 1 formula; undefined values are null."""
    b = V.base(spark, d).select("row_id", "c_acctbal", "days")
    cols = []
    for kind in ("reciprocal", "log", "sqrt"):
        op = FE.OffsetUnary(["c_acctbal", "days"], kind).fit(b)
        b = op.transform(b)
        cols += op.outputs()
    return b.select("row_id", *[r6(c).alias(c) for c in cols])


# ================================================================ FE29 polynomial
_PL = ["c_acctbal", "days", "month"]


def _poly_sql(io, bias, tag):
    terms = FE.poly_terms(len(_PL), 2, io, bias)
    out = []
    for t in terms:
        name = "poly_1" if not t else "poly_" + "_".join(_PL[i] for i in t)
        expr = "1.0::DOUBLE" if not t else " * ".join(_PL[i] for i in t)
        out.append(f"round({expr}, 6) AS {tag}{name}")
    return ", ".join(out)


@register("fe29_polynomial", ids=("FE29",), sql=lambda: with_views("base") + f"""
SELECT row_id, {_poly_sql(False, True, 'f_')}, {_poly_sql(True, False, 'i_')} FROM base""")
def fe29_polynomial(spark, d):
    """FE29: degree-2 terms in the order 1, x_i, x_i*x_j (i<=j); interaction-only variant
    without bias."""
    b = V.base(spark, d).select("row_id", *_PL)
    full = FE.Polynomial(_PL, 2, False, True)
    inter = FE.Polynomial(_PL, 2, True, False)
    both = {"f_" + n: e for n, e in full.expressions().items()} | {"i_" + n: e for n, e in inter.expressions().items()}
    return b.select("row_id", *[r6(e).alias(n) for n, e in both.items()])


_ROLES = {"numeric": ["o_totalprice", "c_acctbal", "days", "month", "sum_l_quantity", "max_l_discount"],
          "ordinal": {"o_orderpriority": _PRIO}, "nominal": ["c_mktsegment", "c_nationkey"]}


@register("p1_p3_role_projection", ids=("P1", "P3", "J1", "B2"), sql=lambda: with_views("base_agg") + """
SELECT row_id, label, round(o_totalprice, 6) AS o_totalprice, round(c_acctbal, 6) AS c_acctbal, days, month,
  round(sum_l_quantity, 6) AS sum_l_quantity, round(max_l_discount, 6) AS max_l_discount, o_orderpriority, c_mktsegment, c_nationkey
FROM base_agg""")
def p1_p3_role_projection(spark, d):
    """P1/P3 on the wide base_agg view (orders + customer + per-order lineitem aggregates,
    blocks aligned by key, J1): role routing with an 'id' column dropped if present."""
    b = V.base_agg(spark, d).withColumn("id", F.col("row_id"))
    p = FE.project_roles(b, _ROLES, "id", keep=["row_id", "label"])
    return p.select(*[r6(c).alias(c) if c in ("o_totalprice", "c_acctbal", "sum_l_quantity", "max_l_discount") else F.col(c)
                      for c in p.columns])


@register("p2_fe39_shared_column_branches", ids=("P2", "FE39", "FE18", "FE15"), sql=lambda: with_views("base") + """
, e AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS q FROM base)
SELECT row_id, c_acctbal AS pass_c_acctbal,
  CAST(len(list_filter(q[2:len(q) - 1], lambda x: x <= c_acctbal)) AS DOUBLE) AS bin_c_acctbal,
  round(c_acctbal * c_acctbal, 6) AS sq_c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seg_building
FROM base, e""")
def p2_fe39_shared_column_branches(spark, d):
    """P2/FE39: one column feeds several branches (passthrough, quantile bins, square) that
    are unioned side by side in ONE projection, next to a one-hot block."""
    b = V.base(spark, d).select("row_id", "c_acctbal", "c_mktsegment")
    b = b.withColumns({"pass_c_acctbal": F.col("c_acctbal"), "bin_src": F.col("c_acctbal"), "sq_src": F.col("c_acctbal")})
    binning = FE.Binning(["bin_src"], 4, "quantile").fit(b)
    sq = FE.Unary(["sq_src"], "square")
    out = sq.transform(binning.transform(b))
    return out.select("row_id", "pass_c_acctbal", F.col("binned_bin_src").alias("bin_c_acctbal"),
                      r6("sq_src_sq").alias("sq_c_acctbal"),
                      F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("seg_building"))


# ================================================================ generated features at full width
_EMB = 64
_WIDE_SQL = f"""
WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT i::INTEGER AS i FROM range(0, {_EMB}) r(i)),
mn AS (SELECT d.i, coalesce(min(CASE WHEN isfinite(x.e[d.i + 1]) THEN x.e[d.i + 1] END), 0.0) + 1.0 AS off FROM d, x GROUP BY d.i),
t AS (SELECT kind, i, j, (row_number() OVER (ORDER BY kind, (i >= 0)::INTEGER + (j >= 0)::INTEGER, i, j) - 1)::INTEGER AS place FROM (
  SELECT 0 AS kind, a.i, b.i AS j FROM d a JOIN d b ON a.i < b.i
  UNION ALL SELECT 1, a.i, b.i FROM d a JOIN d b ON a.i < b.i
  UNION ALL SELECT 2, a.i, b.i FROM d a JOIN d b ON a.i <> b.i
  UNION ALL SELECT 3, -1, -1 UNION ALL SELECT 3, i, -1 FROM d
  UNION ALL SELECT 3, a.i, b.i FROM d a JOIN d b ON a.i <= b.i)),
raw AS (SELECT x.vec_id, x.label, t.place, CASE t.kind WHEN 0 THEN e[t.i + 1] - e[t.j + 1] WHEN 1 THEN e[t.i + 1] + e[t.j + 1]
    WHEN 2 THEN e[t.i + 1] / nullif(e[t.j + 1] + mn.off, 0) WHEN 3 THEN
      (CASE WHEN t.i < 0 THEN 1.0::DOUBLE ELSE e[t.i + 1] END) * (CASE WHEN t.j < 0 THEN 1.0::DOUBLE ELSE e[t.j + 1] END) END AS v
  FROM t LEFT JOIN mn ON mn.i = t.j, x),
l AS (SELECT vec_id, label, place, CASE WHEN isfinite(v) THEN v END AS v FROM raw),
g AS (SELECT place, label, count(v) AS n, avg(v) AS m, var_pop(v) AS vp FROM l WHERE label IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2),
gr AS (SELECT place, sum(n * m) / sum(n) AS grand FROM g GROUP BY 1),
s AS (SELECT place, sum(n) AS n, count(*) AS k, sum(n * (m - grand) * (m - grand)) AS ssb, sum(n * vp) AS ssw FROM g JOIN gr USING (place) GROUP BY 1),
f AS (SELECT t.place, CASE WHEN k < 2 OR n <= k THEN NULL WHEN ssw > 0 THEN (ssb / (k - 1)) / (ssw / (n - k))
    WHEN ssb > 0 THEN 'Infinity'::DOUBLE END AS f FROM t LEFT JOIN s USING (place)),
r AS (SELECT *, row_number() OVER (ORDER BY coalesce(f, -1) DESC, place) AS rk, count(*) OVER () AS w FROM f)"""


def _components(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(_EMB)])


def _wide(percentile):
    return WideSelect(WideFeatures([f"e{i}" for i in range(_EMB)], degree=2), "label", percentile)


@register("fe9_wide_anova", ids=("FE9", "FE23", "FE24", "FE25", "FE29"), sql=_WIDE_SQL + """
SELECT place, round(f, 6) AS f_stat, rk <= greatest(1, floor(w * 0.1)) AS kept FROM r""")
def fe9_wide_anova(spark, d):
    """FE9 over all 10,209 differences, sums, ratios and degree-2 terms of 64 columns: the top tenth."""
    op = _wide(10).fit(_components(spark, d))
    keep = set(op.state["keep"])
    rows = [(i, None if f is None else round(f, 6), i in keep) for i, f in enumerate(op.state["f"])]
    return spark.createDataFrame(rows, "place int, f_stat double, kept boolean")


@register("fe23_fe29_wide_selected", ids=("FE23", "FE24", "FE25", "FE29", "FE9", "FE39"), sql=_WIDE_SQL + """
SELECT l.vec_id, l.place, round(l.v, 6) + 0.0 AS value FROM l JOIN r USING (place) WHERE r.rk <= greatest(1, floor(w * 0.01))""")
def fe23_fe29_wide_selected(spark, d):
    """The array column of the top hundredth of all generated features, for every vector; one row a
    feature for the comparison."""
    x = _components(spark, d)
    op = _wide(1).fit(x)
    keep = F.array(*[F.lit(i) for i in op.state["keep"]])
    out = op.transform(x).select("vec_id", F.posexplode("features").alias("at", "v"))
    return out.select("vec_id", F.get(keep, F.col("at")).alias("place"), r6("v").alias("value"))
