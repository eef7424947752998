"""Pseudo-labelling queries (PL1-PL6, U1) on documents + labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_bits
from ..functions.scalar import r6
from ..operators import pseudo as PL
from ..sources import views as V
from .registry import register
from .sqlv import with_views

T = 0.8
RATIO = 0.3

_CONF = f"""c AS (SELECT row_id, p, CAST(p >= 0.5 AS INTEGER) AS pseudo_label FROM semiview
  WHERE label IS NULL AND (p >= {T} OR p <= 1.0 - {T})),
k AS (SELECT CAST(count_if(pseudo_label = 1) AS BIGINT) AS npos, CAST(count_if(pseudo_label = 0) AS BIGINT) AS nneg FROM c)"""


def _ranked(salt):
    return f"""r AS (SELECT c.*, row_number() OVER (PARTITION BY pseudo_label ORDER BY {sql_bits(42, salt, 'row_id')}, row_id) AS rk FROM c)"""


_QUOTAS = f"""q AS (SELECT npos, nneg, CAST(floor((npos + nneg) * {RATIO}::DOUBLE) AS BIGINT) AS want_pos FROM k),
qq AS (SELECT CASE WHEN npos = 0 OR nneg = 0 THEN npos WHEN npos < want_pos THEN npos
                   WHEN nneg < (npos + nneg) - want_pos THEN least(npos, CAST(floor(nneg * {RATIO}::DOUBLE / (1 - {RATIO}::DOUBLE)) AS BIGINT))
                   ELSE want_pos END AS qpos,
              CASE WHEN npos = 0 OR nneg = 0 THEN nneg WHEN npos < want_pos THEN least(nneg, CAST(floor(npos * (1 - {RATIO}::DOUBLE) / {RATIO}::DOUBLE) AS BIGINT))
                   WHEN nneg < (npos + nneg) - want_pos THEN nneg ELSE (npos + nneg) - want_pos END AS qneg FROM q)"""
_DRAWN = f"""d AS (SELECT * FROM r, qq WHERE rk <= CASE WHEN pseudo_label = 1 THEN qpos ELSE qneg END ORDER BY abs(p - 0.5) DESC, row_id LIMIT 60)"""


@register("pl1_pseudo_labels", ids=("PL1", "P8", "C9"), sql=lambda: with_views("semiview", extra=_CONF) + """
SELECT row_id, round(p, 6) AS p, pseudo_label FROM c""")
def pl1_pseudo_labels(spark, d):
    s = V.semi(spark, d).filter(F.col("label").isNull())
    return PL.confident(s, T).select("row_id", r6("p").alias("p"), "pseudo_label")


def _generate(spark, d):
    return PL.generate(V.semi(spark, d).filter(F.col("label").isNull()), "row_id", threshold=T, max_samples=60, ratio=RATIO)


@register("pl1_generate_rows", ids=("PL1", "PL3", "PL4"), sql=lambda: with_views("semiview", extra=_CONF + ", " + _ranked("pl")) + f"""
, {_QUOTAS}, {_DRAWN}
SELECT row_id, round(p, 6) AS p, pseudo_label FROM d""")
def pl1_generate_rows(spark, d):
    """PL1 in one call: confident rows drawn to the target ratio, then the 60 most confident."""
    rows, _ = _generate(spark, d)
    return rows.select("row_id", r6("p").alias("p"), "pseudo_label")


@register("pl1_generate_counts", ids=("PL1", "PL6"), sql=lambda: with_views("semiview", extra=_CONF + ", " + _ranked("pl")) + f"""
, {_QUOTAS}, {_DRAWN}, u AS (SELECT count(*) AS n FROM semiview WHERE label IS NULL)
SELECT count(*) AS n_total, CAST(count_if(pseudo_label = 1) AS BIGINT) AS n_positive, CAST(count_if(pseudo_label = 0) AS BIGINT) AS n_negative,
  round(avg(greatest(p, 1.0 - p)), 6) AS mean_confidence, {T}::DOUBLE AS min_confidence, (SELECT n FROM u) AS test_set_size,
  round(count(*) * 100.0 / (SELECT n FROM u), 6) AS coverage FROM d""")
def pl1_generate_counts(spark, d):
    _, stats = _generate(spark, d)
    return stats.withColumn("mean_confidence", r6("mean_confidence")).withColumn("coverage", r6("coverage"))


@register("pl2_balanced_pseudo", ids=("PL2",), sql=lambda: with_views("semiview", extra=_CONF + ", " + _ranked("pl")) + """
SELECT row_id, pseudo_label FROM r, k WHERE npos > 0 AND nneg > 0 AND rk <= least(npos, nneg)
UNION ALL SELECT row_id, pseudo_label FROM r, k WHERE NOT (npos > 0 AND nneg > 0)""")
def pl2_balanced_pseudo(spark, d):
    """PL2: both classes cut to the smaller count by exact hash-ranked quotas."""
    c = PL.confident(V.semi(spark, d).filter(F.col("label").isNull()), T)
    q = PL.quotas_balance(PL.class_counts(c))
    return PL.pick_quotas(c, "row_id", "pseudo_label", q).select("row_id", "pseudo_label")


@register("pl3_target_ratio", ids=("PL3", "C8"), sql=lambda: with_views("semiview", extra=_CONF + ", " + _ranked("pl")) + f"""
, {_QUOTAS}
SELECT row_id, pseudo_label FROM r, qq WHERE rk <= CASE WHEN pseudo_label = 1 THEN qpos ELSE qneg END""")
def pl3_target_ratio(spark, d):
    """PL3: match a target positive share (0.3), shrinking the other class when one is short."""
    c = PL.confident(V.semi(spark, d).filter(F.col("label").isNull()), T)
    q = PL.quotas_ratio(PL.class_counts(c), RATIO)
    return PL.pick_quotas(c, "row_id", "pseudo_label", q).select("row_id", "pseudo_label")


@register("pl4_confidence_cap", ids=("PL4", "O2"), sql=lambda: with_views("semiview", extra=_CONF) + """
SELECT row_id, round(p, 6) AS p, pseudo_label FROM c ORDER BY abs(p - 0.5) DESC, row_id LIMIT 40""")
def pl4_confidence_cap(spark, d):
    c = PL.confident(V.semi(spark, d).filter(F.col("label").isNull()), T)
    return PL.cap_by_confidence(c, 40, "row_id").select("row_id", r6("p").alias("p"), "pseudo_label")


@register("pl5_augmented_pool", ids=("PL5", "U1"), sql=lambda: with_views("semiview", extra=_CONF) + f"""
, lab AS (SELECT row_id, label FROM semiview WHERE label IS NOT NULL),
cap AS (SELECT CAST(floor((SELECT count(*) FROM lab) * 0.2::DOUBLE / (1 - 0.2::DOUBLE)) AS BIGINT) AS m),
r AS (SELECT c.*, row_number() OVER (ORDER BY {sql_bits(42, 'augment', 'row_id')}, row_id) AS rk FROM c)
SELECT row_id, label, false AS is_pseudo FROM lab
UNION ALL SELECT row_id, pseudo_label, true FROM r, cap WHERE rk <= m""")
def pl5_augmented_pool(spark, d):
    """PL5: labelled pool + pseudo rows capped at int(n f / (1 - f)), f = 0.2."""
    s = V.semi(spark, d)
    lab = s.filter(F.col("label").isNotNull()).select("row_id", "label")
    c = PL.confident(s.filter(F.col("label").isNull()), T).select("row_id", F.col("pseudo_label").alias("label"))
    return PL.augment(lab, c, "row_id", 0.2).select("row_id", "label", "is_pseudo")


@register("pl6_pseudo_stats", ids=("PL6",), sql=lambda: with_views("semiview", extra=_CONF) + """
SELECT (SELECT count(*) FROM c) AS n_pseudo, (SELECT count(*) FROM semiview WHERE label IS NULL) AS n_unlabelled,
  round((SELECT avg(greatest(p, 1 - p)) FROM c), 6) AS mean_confidence,
  round(100.0 * (SELECT count(*) FROM c) / (SELECT count(*) FROM semiview WHERE label IS NULL), 6) AS coverage_pct,
  round((SELECT avg(label) FROM semiview WHERE label IS NOT NULL), 6) AS pos_rate_before,
  round((SELECT (sum(label) + (SELECT sum(pseudo_label) FROM c)) / (count(*) + (SELECT count(*) FROM c))
         FROM semiview WHERE label IS NOT NULL), 6) AS pos_rate_after""")
def pl6_pseudo_stats(spark, d):
    """PL6: totals, mean confidence max(p, 1-p), coverage %, positive rate before/after."""
    s = V.semi(spark, d)
    unl = s.filter(F.col("label").isNull())
    c = PL.confident(unl, T)
    a = c.agg(F.count(F.lit(1)).alias("n_pseudo"), F.avg(F.greatest("p", F.lit(1.0) - F.col("p"))).alias("mc"),
              F.sum("pseudo_label").alias("sp"))
    b = s.agg(F.count_if(F.col("label").isNull()).alias("n_unlabelled"), F.avg("label").alias("before"),
              F.sum("label").alias("sl"), F.count("label").alias("nl"))
    j = a.crossJoin(b)
    return j.select("n_pseudo", "n_unlabelled", r6("mc").alias("mean_confidence"),
                    r6(F.lit(100.0) * F.col("n_pseudo") / F.col("n_unlabelled")).alias("coverage_pct"),
                    r6("before").alias("pos_rate_before"),
                    r6((F.col("sl") + F.col("sp")) / (F.col("nl") + F.col("n_pseudo"))).alias("pos_rate_after"))
