"""Ensemble-algebra queries (EN1-EN10, EN13, EN17, EN18) on the long prediction table
and the run log (B5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, sql_bits, sql_uniform
from ..functions.scalar import r6, sigmoid
from ..operators import ensemble as E
from ..operators.metrics import auc, confusion
from ..operators.models import GaussianNB
from ..operators.sampling import stratified_split
from ..sources import views as V
from .q_metrics import auc_sql
from .registry import register
from .sqlv import with_views

ALL = list(range(V.N_MODELS))


@register("en1_en2_row_aggregates", ids=("EN1", "EN2"), sql=lambda: with_views("preds") + """
SELECT row_id, round(least(greatest(avg(p), 0.0), 1.0), 6) AS p_mean, round(least(greatest(median(p), 0.0), 1.0), 6) AS p_median,
  CAST(least(greatest(avg(p), 0.0), 1.0) >= 0.5 AS INTEGER) AS label_mean, count(p) AS n_models FROM preds GROUP BY row_id""")
def en1_en2_row_aggregates(spark, d):
    j = E.aggregate_rows(V.preds(spark, d), ["mean", "median"])
    return j.select("row_id", r6("p_mean").alias("p_mean"), r6("p_median").alias("p_median"),
                    E.hard_label("p_mean").alias("label_mean"), "n_models")


FAILED = 63  # EN18: this model counts as failed


@register("en3_en18_ensemble_auc_cm", ids=("EN3", "EN18", "MT1", "MT3"), sql=lambda: with_views(
    "preds", extra=f"""e AS (SELECT row_id, max(label) AS label, avg(CASE WHEN model_id = {FAILED} THEN 0.0 ELSE p END) AS s FROM preds GROUP BY row_id), """
    + auc_sql("e", "s", "1")) + """
SELECT round(coalesce((SELECT auc FROM a), 0.0), 6) AS auc, CAST(count_if(s < 0.5 AND label = 0) AS BIGINT) AS tn, CAST(count_if(s >= 0.5 AND label = 0) AS BIGINT) AS fp,
  CAST(count_if(s < 0.5 AND label = 1) AS BIGINT) AS fn, CAST(count_if(s >= 0.5 AND label = 1) AS BIGINT) AS tp FROM e""")
def en3_en18_ensemble_auc_cm(spark, d):
    """EN3 mean-aggregated ensemble AUC (empty -> 0) and EN18 confusion counts over all models,
    the failed one as a column of zeros."""
    p = E.with_failed_as_zeros(V.preds(spark, d).filter(F.col("model_id") != FAILED), ALL)
    e = p.groupBy("row_id").agg(F.max("label").alias("label"), F.avg("p").alias("s"))
    a = auc(e, "s", "label").select(F.coalesce("auc", F.lit(0.0)).alias("auc"))
    c = confusion(e, "s", "label", 0.5).drop("accuracy")
    return a.crossJoin(c).select(r6("auc").alias("auc"), "tn", "fp", "fn", "tp")


_META = list(range(40))


@register("en4_hybrid_score", ids=("EN4",), sql=lambda: with_views("preds") + f"""
, g AS (SELECT row_id, max(label) AS label,
  avg(CASE WHEN model_id < 40 THEN score END) AS ms, avg(CASE WHEN model_id >= 40 THEN p END) AS mn
  FROM preds GROUP BY row_id)
SELECT row_id, label, round(((1.0 / (1.0 + exp(-8.0 * ms))) * 40 + mn * 24) / 64, 6) AS p_hybrid FROM g""")
def en4_hybrid_score(spark, d):
    """EN4: (meta * n_old + mean(new) * n_new) / n with 40 meta members of 64. The meta-model
    here is a fixed stacker of the members' raw scores (sigmoid of 8 x their mean)."""
    p = V.preds(spark, d)
    meta = p.filter(F.col("model_id").isin(*_META)).groupBy("row_id").agg(
        sigmoid(F.lit(8.0) * F.avg("score")).alias("p_meta"))
    h = E.hybrid_score(p, ALL, _META, meta, carry=["label"])
    return h.select("row_id", "label", r6("p_ens").alias("p_hybrid"))


_STACKED = list(range(6))  # the meta-model's members, of ten
_TEN = list(range(10))


def _meta_sql():
    """Gaussian naive Bayes of the six stacked probabilities, fitted on s1 and applied to s2."""
    return f"""sp AS (SELECT *, {sql_uniform(42, 'en4', 'row_id')} < 0.5 AS s1 FROM preds WHERE model_id < {len(_TEN)}),
ov AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(p) AS v FROM sp WHERE s1 AND model_id < {len(_STACKED)} GROUP BY model_id)),
st AS (SELECT model_id, label AS k, avg(p) AS m, var_pop(p) + (SELECT eps FROM ov) AS v, count(*) AS n FROM sp WHERE s1 AND model_id < {len(_STACKED)} GROUP BY 1, 2),
pr AS (SELECT k, ln(max(n) / (SELECT sum(n) FROM st WHERE model_id = 0)) AS lp FROM st GROUP BY k),
jl AS (SELECT sp.row_id, st.k, sum(-0.5 * ln(2 * pi() * v) - 0.5 * (sp.p - m) * (sp.p - m) / v) + max(pr.lp) AS q
       FROM sp JOIN st USING (model_id) JOIN pr ON pr.k = st.k WHERE NOT s1 GROUP BY 1, 2),
me AS (SELECT row_id, 1.0 / (1.0 + exp(-(max(CASE WHEN k = 1 THEN q END) - max(CASE WHEN k = 0 THEN q END)))) AS p_meta FROM jl GROUP BY 1),
hy AS (SELECT sp.row_id, max(label) AS label, (max(p_meta) * {len(_STACKED)} + avg(CASE WHEN model_id >= {len(_STACKED)} THEN p END) * {len(_TEN) - len(_STACKED)})
       / {len(_TEN)}.0 AS p_hybrid FROM sp JOIN me USING (row_id) WHERE NOT s1 GROUP BY 1)"""


def _stacked(spark, d):
    """(s1 predictions, s2 predictions, meta probabilities of s2): the meta-model is fitted on s1."""
    p = V.preds(spark, d).filter(F.col("model_id").isin(*_TEN))
    half = hash_uniform(42, "en4", "row_id") < 0.5
    s1, s2 = p.where(half), p.where(~half)
    names = [f"m{m}" for m in _STACKED]

    def wide(rows):
        at = [F.max(F.when(F.col("model_id") == m, F.col("p"))).alias(n) for m, n in zip(_STACKED, names)]
        return rows.where(F.col("model_id").isin(*_STACKED)).groupBy("row_id", "label").agg(*at)

    meta = GaussianNB(names).fit(wide(s1)).transform(wide(s2)).select("row_id", F.col("p").alias("p_meta"))
    return s1, s2, meta


@register("en4_meta_model_rows", ids=("EN4", "EN14"), sql=lambda: with_views("preds", extra=_meta_sql()) + """
SELECT row_id, label, round(p_hybrid, 6) AS p_hybrid FROM hy""")
def en4_meta_model_rows(spark, d):
    """EN4 with a meta-model trained on the stacked probabilities of six members; four are new."""
    _, s2, meta = _stacked(spark, d)
    return E.hybrid_score(s2, _TEN, _STACKED, meta, carry=["label"]).select("row_id", "label", r6("p_ens").alias("p_hybrid"))


@register("en4_evaluate_candidate", ids=("EN4", "EN5", "MT1"), sql=lambda: with_views("preds", extra=_meta_sql()
  + ", " + auc_sql("hy", "p_hybrid", "1") + """,
co AS (SELECT corr(x.p, y.p) AS r FROM sp x JOIN sp y ON x.row_id = y.row_id AND x.model_id < y.model_id WHERE x.s1 GROUP BY x.model_id, y.model_id)""") + """
SELECT round((SELECT auc FROM a), 6) AS score, (SELECT round(avg(r), 6) FROM co) AS diversity, 'hybrid (meta-model of 6, mean of 4)' AS aggregation""")
def en4_evaluate_candidate(spark, d):
    """EN4: AUC of the hybrid score on s2 and diversity on s1, as the search takes them."""
    s1, s2, meta = _stacked(spark, d)
    got = E.evaluate_candidate(s2, s1, _TEN, _STACKED, meta)
    return spark.createDataFrame([(round(got["score"], 6), round(got["diversity"], 6), got["aggregation"])],
                                 "score double, diversity double, aggregation string")


def _corr_pairs_sql(lo, hi):
    return f"""pr AS (SELECT a.model_id AS model_a, b.model_id AS model_b, corr(a.p, b.p) AS r
  FROM preds a JOIN preds b ON a.row_id = b.row_id AND a.model_id < b.model_id
  WHERE a.model_id BETWEEN {lo} AND {hi} AND b.model_id BETWEEN {lo} AND {hi} GROUP BY 1, 2)"""


@register("en5_en7_diversity", ids=("EN5", "EN6", "EN7", "EN9"), sql=lambda: with_views("preds", extra=_corr_pairs_sql(0, 63)) + """
SELECT round(avg(r), 6) AS diversity, round(avg(abs(r)), 6) AS diversity_abs, round(min(r), 6) AS min_corr,
  round(max(r), 6) AS max_corr, round(stddev_pop(r), 6) AS std_corr, count(*) AS n_pairs, 64 AS n_models,
  avg(r) < 0.3 AS is_diverse FROM pr""")
def en5_en7_diversity(spark, d):
    """EN5 mean signed correlation, EN6 mean |r|, EN7 detailed stats, EN9 threshold test;
    all from one distributed Pearson matrix."""
    mat = E.correlation_matrix(V.preds(spark, d), ALL)
    st = E.detailed_diversity(mat)
    row = (round(E.diversity(mat), 6), round(E.diversity_abs(mat), 6), round(st["min_corr"], 6), round(st["max_corr"], 6),
           round(st["std_corr"], 6), st["n_pairs"], st["n_models"], E.diversity(mat) < 0.3)
    return spark.createDataFrame([row], "diversity double, diversity_abs double, min_corr double, max_corr double, "
                                        "std_corr double, n_pairs long, n_models int, is_diverse boolean")


@register("en8_correlation_matrix", ids=("EN8",), sql=lambda: with_views("preds", extra=_corr_pairs_sql(0, 63)) + """
SELECT model_a, model_b, round(r, 6) AS r FROM pr
UNION ALL SELECT model_b, model_a, round(r, 6) FROM pr
UNION ALL SELECT DISTINCT model_id, model_id, 1.0::DOUBLE FROM preds""")
def en8_correlation_matrix(spark, d):
    """EN8: full matrix in long form (diagonal 1)."""
    mat = E.correlation_matrix(V.preds(spark, d), ALL)
    f = E.matrix_frame(spark, mat, ALL)
    return f.select("model_a", "model_b", r6("r").alias("r"))


@register("en9_compare_ensembles", ids=("EN9",), sql=lambda: with_views("preds") + """
, pa AS (SELECT a.model_id AS ma, b.model_id AS mb, corr(a.p, b.p) AS r FROM preds a JOIN preds b
  ON a.row_id = b.row_id AND a.model_id < b.model_id GROUP BY 1, 2),
s AS (SELECT CASE WHEN ma < 32 AND mb < 32 THEN 'A' WHEN ma >= 32 AND mb >= 32 THEN 'B' END AS ens, avg(r) AS div
      FROM pa GROUP BY 1 HAVING ens IS NOT NULL)
SELECT round((SELECT div FROM s WHERE ens = 'A'), 6) AS div_a, round((SELECT div FROM s WHERE ens = 'B'), 6) AS div_b,
  round((SELECT div FROM s WHERE ens = 'B') - (SELECT div FROM s WHERE ens = 'A'), 6) AS delta""")
def en9_compare_ensembles(spark, d):
    p = V.preds(spark, d)
    mat = E.correlation_matrix(p, ALL)
    a, b = E.diversity(mat[:32, :32]), E.diversity(mat[32:, 32:])
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(b - a, 6))], "div_a double, div_b double, delta double")


@register("en10_acceptance_rows", ids=("EN10", "C7"), sql=lambda: with_views("runlog") + f"""
, x AS (SELECT iteration_num, stage1_val_auc - 0.75 AS delta, temperature AS t, {sql_uniform(42, 'accept', 'iteration_num')} AS u FROM runlog),
y AS (SELECT *, CASE WHEN delta >= 0 THEN 1.0 ELSE exp(delta / t) END AS prob FROM x)
SELECT iteration_num, (delta > 0 OR delta = 0 OR u < prob) AS accepted, round(prob, 6) AS accept_prob,
  CASE WHEN delta > 0 THEN 'improvement' WHEN delta = 0 THEN 'equal score' WHEN u < prob THEN 'annealing accept'
       ELSE 'rejected: worse score' END AS reason FROM y""")
def en10_acceptance_rows(spark, d):
    """EN10: decision, probability and reason per candidate against a current score."""
    r = V.runlog(spark, d, with_num_models=False).withColumn("current", F.lit(0.75))
    a = E.acceptance_columns(r, "stage1_val_auc", "current", "temperature", "iteration_num")
    return a.select("iteration_num", "accepted", r6("accept_prob").alias("accept_prob"), "reason")


@register("en13_meta_training_set", ids=("EN13", "J2", "U1"), sql=lambda: with_views("preds") + f"""
, rows AS (SELECT DISTINCT row_id, label FROM preds),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_bits(42, 'split', 'row_id')}, row_id) AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM rows),
s AS (SELECT row_id, CASE WHEN rk <= (n * 600000) // 1000000 THEN 'train' WHEN rk <= (n * 950000) // 1000000 THEN 'val1' ELSE 'val2' END AS split FROM r),
m AS (SELECT s.row_id, s.split, {sql_uniform(42, 'meta', 's.row_id')} AS u FROM s WHERE split <> 'train')
SELECT p.row_id, CASE WHEN m.split = 'val1' OR m.u < 0.9 THEN 'meta_train' ELSE 'meta_holdout' END AS part,
  {', '.join(f'round(max(CASE WHEN p.model_id = {i} THEN p.p END), 6) AS m{i}' for i in ALL)}
FROM preds p JOIN m USING (row_id) GROUP BY p.row_id, part""")
def en13_meta_training_set(spark, d):
    """EN13: stacked model probabilities on val1 + 90 % of val2 (meta_train); the other
    10 % of val2 is held out (T15: never scored on training rows)."""
    p = V.preds(spark, d)
    rows = p.select("row_id", "label").distinct()
    s = stratified_split(rows, "row_id", "label").filter(F.col("split") != "train")
    from ..functions.hashing import hash_uniform

    s = s.withColumn("part", F.when((F.col("split") == "val1") | (hash_uniform(42, "meta", "row_id") < 0.9), "meta_train")
                     .otherwise("meta_holdout")).select("row_id", "part")
    wide = E.wide_matrix(p, ALL)
    return wide.join(s, "row_id").select("row_id", "part", *[r6(str(i)).alias(f"m{i}") for i in ALL])


@register("en17_retrain_schedule", ids=("EN17",), sql=lambda: with_views("runlog") + """
SELECT run_id, iteration_num, num_models, CAST(floor(num_models / 5) AS INTEGER) AS retrain_batch,
  (floor(num_models / 5) IN (1, 2) OR floor(num_models / 5) % 3 = 0) AS optimise,
  CASE WHEN floor(num_models / 5) = 1 THEN 10 WHEN floor(num_models / 5) = 2 THEN 8 ELSE 5 END AS trials
FROM runlog WHERE accepted = 1 AND num_models % 5 = 0""")
def en17_retrain_schedule(spark, d):
    r = V.runlog(spark, d).filter(F.col("accepted") == 1)
    s = E.retrain_schedule(r, 5)
    return s.select("run_id", "iteration_num", "num_models", "retrain_batch", "optimise", "trials")
