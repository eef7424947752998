"""Sampling and splitting queries (SM1-SM12, FE41, P10) over the base view (B1)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import sql_bits, sql_uniform
from ..functions.scalar import r6
from ..operators import sampling as S
from ..operators.spaces import CLASSIFIER_SPACES, draw_rows_sql
from ..sources import views as V
from .registry import register
from .sqlv import with_views


def _rank_sql(salt, strata="label", seed=42):
    part = f"PARTITION BY {strata} " if strata else ""
    return (f"row_number() OVER ({part}ORDER BY {sql_bits(seed, salt, 'row_id')}, row_id) AS rk, "
            f"count(*) OVER ({'PARTITION BY ' + strata if strata else ''}) AS n")


@register("sm1_stratified_split", ids=("SM1", "W7"), sql=lambda: with_views("base") + f"""
, r AS (SELECT row_id, label, {_rank_sql('split')} FROM base)
SELECT row_id, label, CASE WHEN rk <= (n * 600000) // 1000000 THEN 'train'
  WHEN rk <= (n * 950000) // 1000000 THEN 'val1' ELSE 'val2' END AS split FROM r""")
def sm1_stratified_split(spark, d):
    return S.stratified_split(V.base(spark, d).select("row_id", "label"), "row_id", "label")


SM2_FRAC = S.drawn_fraction(0.3, 0.7, seed=42, iteration=3)


@register("sm2_stratified_row_sample", ids=("SM2",), sql=lambda: with_views("base") + f"""
, r AS (SELECT row_id, label, {_rank_sql('rows')} FROM base)
SELECT row_id, label FROM r WHERE rk <= (n * {round(SM2_FRAC * 1e6)}) // 1000000""")
def sm2_stratified_row_sample(spark, d):
    """SM2: fraction drawn in [0.3, 0.7] (reproducible), exact per-class quota."""
    return S.stratified_sample(V.base(spark, d).select("row_id", "label"), "row_id", "label", SM2_FRAC)


_SM3_COLS = ["o_totalprice", "c_acctbal", "days", "month"]
_SM3_PICK = S.sample_columns(_SM3_COLS, None, seed=7, keep_order=False)


@register("sm3_row_then_column_sample", ids=("SM3", "P10"), sql=lambda: with_views("base") + f"""
, r AS (SELECT *, {_rank_sql('rows')} FROM base),
s AS (SELECT * FROM r WHERE rk <= (n * {round(SM2_FRAC * 1e6)}) // 1000000),
picked AS (SELECT name FROM (VALUES {', '.join(f"('{c}')" for c in _SM3_COLS)}) t(name)
  ORDER BY {sql_bits(7, 'col', 'name')}, name LIMIT {len(_SM3_PICK)})
SELECT s.row_id, u.name AS column_name, round(u.value, 6) AS value
FROM s, LATERAL (SELECT * FROM (VALUES {', '.join(f"('{c}', s.{c})" for c in _SM3_COLS)}) v(name, value)) u
WHERE u.name IN (SELECT name FROM picked)""")
def sm3_row_then_column_sample(spark, d):
    """SM3: SM2 rows, then P10 columns (hash-drawn fraction, order by hash); long form."""
    s = S.stratified_sample(V.base(spark, d), "row_id", "label", SM2_FRAC)
    st = s.select("row_id", *_SM3_PICK).unpivot("row_id", _SM3_PICK, "column_name", "value")
    return st.select("row_id", "column_name", r6("value").alias("value"))


@register("sm4_sample_info", ids=("SM4",), sql=lambda: with_views("base") + """
SELECT count(*) AS n_rows, 4 AS n_cols, CAST(floor(count(*) * (0.3 + 0.7) / 2) AS BIGINT) AS expected_rows,
  CAST(floor(4 * (0.5 + 1.0) / 2) AS INTEGER) AS expected_cols FROM base""")
def sm4_sample_info(spark, d):
    """SM4: expected sample size from range midpoints (truncated)."""
    b = V.base(spark, d)
    return b.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(4).alias("n_cols"),
        F.floor(F.col("n_rows") * ((0.3 + 0.7) / 2)).cast("bigint").alias("expected_rows"),
        F.lit(int(math.floor(4 * (0.5 + 1.0) / 2))).alias("expected_cols"))


_CANDS = [(i, S.drawn_fraction(0.05, 0.3, seed=100 + i, salt="cand"), 100 + i) for i in range(8)]


@register("sm5_candidate_presample", ids=("SM5",), sql=lambda: with_views("base") + """
, c AS (SELECT * FROM (VALUES """ + ", ".join(f"({c}, {f}, '{s}')" for c, f, s in _CANDS) + """) t(cid, f, s)),
k AS (SELECT label, count(*) AS nk, sum(count(*)) OVER () AS n FROM base GROUP BY label),
z AS (SELECT cid, s, label, nk, n, least(n, greatest(100, CAST(floor(n * f) AS BIGINT))) AS size FROM c, k),
w AS (SELECT *, CAST((nk * size) // n AS BIGINT) AS whole, CAST((nk * size) % n AS BIGINT) AS rem FROM z),
q AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY cid ORDER BY rem DESC, label)
        <= size - sum(whole) OVER (PARTITION BY cid) THEN 1 ELSE 0 END AS quota FROM w),
r AS (SELECT q.cid, b.row_id, q.quota, row_number() OVER (PARTITION BY q.cid, b.label ORDER BY
        CAST(('0x' || substr(md5(q.s || '|pre|' || CAST(b.row_id AS VARCHAR)), 1, 13)) AS BIGINT), b.row_id) AS rk
      FROM base b JOIN q ON b.label = q.label)
SELECT cid AS candidate_id, row_id FROM r WHERE rk <= quota""")
def sm5_candidate_presample(spark, d):
    """SM5: exact stratified samples of a whole batch in one pass (seed = base + iteration)."""
    return S.candidate_presample(V.base(spark, d).select("row_id", "label"), "row_id", "label", _CANDS)


@register("sm6_sm7_two_disjoint_samples", ids=("SM6", "SM7", "J3"), sql=lambda: with_views("base") + f"""
, s1 AS (SELECT row_id FROM base ORDER BY {sql_bits(42, 'simple', 'row_id')}, row_id LIMIT 2000),
rest AS (SELECT row_id FROM base ANTI JOIN s1 USING (row_id)),
s2 AS (SELECT row_id FROM rest ORDER BY {sql_bits(42, 'second', 'row_id')}, row_id LIMIT 3000)
SELECT row_id, 1 AS sample FROM s1 UNION ALL SELECT row_id, 2 FROM s2""")
def sm6_sm7_two_disjoint_samples(spark, d):
    b = V.base(spark, d).select("row_id")
    s1 = S.simple_sample(b, "row_id", 2000)
    s2 = S.disjoint_second_sample(b, s1, "row_id", 3000)
    return s1.select("row_id", F.lit(1).alias("sample")).unionByName(s2.select("row_id", F.lit(2).alias("sample")))


@register("sm8_random_split", ids=("SM8",), sql=lambda: with_views("base") + f"""
, r AS (SELECT row_id, {_rank_sql('rsplit', strata=None)} FROM base)
SELECT row_id, CASE WHEN rk <= (n * 800000) // 1000000 THEN 'train' ELSE 'test' END AS split FROM r""")
def sm8_random_split(spark, d):
    return S.random_split(V.base(spark, d).select("row_id"), "row_id", 0.8)


@register("sm9_stratified_folds", ids=("SM9",), sql=lambda: with_views("base") + f"""
, r AS (SELECT row_id, label, {_rank_sql('kfold')} FROM base)
SELECT row_id, label, CAST((rk - 1) % 3 AS INTEGER) AS fold FROM r""")
def sm9_stratified_folds(spark, d):
    return S.kfold(V.base(spark, d).select("row_id", "label"), "row_id", "label", k=3)


@register("sm10_founder_sample", ids=("SM10", "EN12"), sql=lambda: with_views("base") + f"""
, r AS (SELECT row_id, label, {_rank_sql('founder')} FROM base)
SELECT label, count(*) AS n FROM r WHERE rk <= (n * 100000) // 1000000 GROUP BY label""")
def sm10_founder_sample(spark, d):
    """SM10: founder sample = 10 % of the pool per class (counts shown)."""
    s = S.stratified_sample(V.base(spark, d).select("row_id", "label"), "row_id", "label", 0.1, salt="founder")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _u(salt):
    return sql_uniform(42, salt, "iteration_num")


def _draws_sql():
    parts = [f"SELECT iteration_num, classifier_type, '{param}' AS param, round({number}, 6) AS number, {text} AS text "
             f"FROM c WHERE classifier_type = '{name}' AND {holds}"
             for name, space in CLASSIFIER_SPACES.items()
             for param, holds, number, text in draw_rows_sql(space, 42, name, "iteration_num")]
    return f"""c AS (SELECT iteration_num, list_extract([{', '.join(f"'{c}'" for c in S.CLASSIFIERS)}],
  CAST(floor({_u('clf')} * {len(S.CLASSIFIERS)}) AS INTEGER) + 1) AS classifier_type FROM runlog)
""" + " UNION ALL ".join(parts)


@register("sm11_sm12_param_draws", ids=("SM11", "SM12", "X3"), sql=lambda: with_views("runlog") + ", " + _draws_sql())
def sm11_sm12_param_draws(spark, d):
    """SM11/SM12: one candidate per logged iteration; its type and every parameter of that
    type's own space, a row each."""
    r = V.runlog(spark, d, with_num_models=False).select("iteration_num")
    p = S.draw_hyperparameters(r, "iteration_num")
    return p.select("iteration_num", "classifier_type", "param", r6("number").alias("number"), "text")


@register("fe41_balanced_weights", ids=("FE41",), sql=lambda: with_views("base") + """
, c AS (SELECT label, count(*) AS nc FROM base GROUP BY label)
SELECT b.row_id, b.label, round((SELECT count(*) FROM base) / ((SELECT count(*) FROM c) * c.nc), 6) AS weight
FROM base b JOIN c USING (label)""")
def fe41_balanced_weights(spark, d):
    w = S.class_weights(V.base(spark, d).select("row_id", "label"), "label")
    return w.select("row_id", "label", r6("weight").alias("weight"))
