"""Flagship query (slice 0): base view -> exact stratified split -> role preprocessing
fitted on train (FE2 + FE4 + FE5) -> Gaussian naive Bayes (M8) -> exact AUC (MT1) and
confusion counts (MT3) per split."""

from __future__ import annotations

from ..session import track

from pyspark.sql import functions as F

from ..functions.hashing import sql_bits
from ..functions.scalar import r6
from ..operators.features import OneHot, OrdinalEncode, StandardScale, apply_chain, fit_chain
from ..operators.metrics import auc, confusion
from ..operators.models import GaussianNB
from ..operators.sampling import stratified_split
from ..sources.views import BASE_ROLES, BASE_SQL, base
from .registry import register

NUMERIC = BASE_ROLES["numeric"]
ORDINAL = {"o_orderpriority": BASE_ROLES["ordinal"]["o_orderpriority"]}
NOMINAL = ["c_mktsegment"]


def score_pipeline(spark, d, seed=42):
    b = base(spark, d).select("row_id", *NUMERIC, *ORDINAL, *NOMINAL, "label")
    s = track(stratified_split(b, "row_id", "label", seed=seed))
    train = s.filter(F.col("split") == "train")
    onehot = OneHot(NOMINAL)
    ops = fit_chain([StandardScale(NUMERIC), OrdinalEncode(ORDINAL), onehot], train)
    feats = NUMERIC + list(ORDINAL) + onehot.outputs()
    nb = GaussianNB(feats).fit(apply_chain(ops, train))
    return nb.transform(apply_chain(ops, s)).select("row_id", "split", "label", "p")


@register("flagship_nb_split_auc", ids=("SM1", "P1", "FE2", "FE4", "FE5", "M8", "MT1", "MT3", "A13"),
          sql=lambda: FLAGSHIP_SQL)
def flagship(spark, d):
    scored = score_pipeline(spark, d)
    a = auc(scored, "p", "label", by=["split"]).select("split", "auc")
    c = confusion(scored, "p", "label", by=["split"])
    n = scored.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("label").alias("pos_rate"))
    return (n.join(a, "split").join(c, "split")
            .select("split", "n_rows", r6("pos_rate").alias("pos_rate"), r6("auc").alias("auc"),
                    "tp", "fp", "tn", "fn"))


def _split_sql(seed=42):
    return f"""h AS (SELECT *, {sql_bits(seed, 'split', 'row_id')} AS h FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, row_id) AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM h),
s AS (SELECT * EXCLUDE (h, rk, n), CASE WHEN rk <= (n * 600000) // 1000000 THEN 'train'
              WHEN rk <= (n * 950000) // 1000000 THEN 'val1' ELSE 'val2' END AS split FROM r)"""


_LEVELS = ", ".join(f"'{x}'" for x in BASE_ROLES["ordinal"]["o_orderpriority"])
_num_long = "\n  UNION ALL ".join(
    f"SELECT row_id, label, split, '{c}' AS f, (s.{c} - st.m_{c}) / CASE WHEN st.s_{c} = 0 THEN 1 ELSE st.s_{c} END AS v FROM s, st"
    for c in NUMERIC)

FLAGSHIP_SQL = f"""WITH b AS ({BASE_SQL}),
{_split_sql()},
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in NUMERIC)} FROM s WHERE split = 'train'),
lv AS (SELECT DISTINCT c_mktsegment AS lvl FROM s WHERE split = 'train' AND c_mktsegment IS NOT NULL),
lv1 AS (SELECT lvl FROM lv WHERE lvl > (SELECT min(lvl) FROM lv)),
lng AS ({_num_long}
  UNION ALL SELECT row_id, label, split, 'o_orderpriority', CAST(coalesce(list_position([{_LEVELS}], o_orderpriority) - 1, -1) AS DOUBLE) FROM s
  UNION ALL SELECT row_id, label, split, 'c_mktsegment_' || lvl, CASE WHEN c_mktsegment = lvl THEN 1.0 ELSE 0.0 END FROM s, lv1),
cls AS (SELECT label, count(*) AS nc FROM s WHERE split = 'train' GROUP BY label),
fs AS (SELECT label, f, avg(v) AS mu, var_pop(v) AS va FROM lng WHERE split = 'train' GROUP BY label, f),
eps AS (SELECT 1e-9 * max(va) AS e FROM (SELECT f, var_pop(v) AS va FROM lng WHERE split = 'train' GROUP BY f) q),
prm AS (SELECT fs.label, fs.f, fs.mu, fs.va + eps.e AS va FROM fs, eps),
jl AS (SELECT l.row_id, l.split, l.label AS y, p.label AS k,
              sum(-0.5 * ln(2 * pi() * p.va) - 0.5 * (l.v - p.mu) * (l.v - p.mu) / p.va) AS ll
       FROM lng l JOIN prm p ON l.f = p.f GROUP BY 1, 2, 3, 4),
jp AS (SELECT j.*, j.ll + ln(c.nc / (SELECT sum(nc) FROM cls)) AS jll FROM jl j JOIN cls c ON j.k = c.label),
sc AS (SELECT row_id, split, y AS label,
              1.0 / (1.0 + exp(-(max(CASE WHEN k = 1 THEN jll END) - max(CASE WHEN k = 0 THEN jll END)))) AS p
       FROM jp GROUP BY 1, 2, 3),
g AS (SELECT split, p, sum(label) AS pos, count(*) - sum(label) AS neg FROM sc GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM g),
a AS (SELECT split, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY split),
cm AS (SELECT split, count(*) AS n_rows, round(avg(label), 6) AS pos_rate,
              CAST(count_if(p >= 0.5 AND label = 1) AS BIGINT) AS tp, CAST(count_if(p >= 0.5 AND label = 0) AS BIGINT) AS fp,
              CAST(count_if(p < 0.5 AND label = 0) AS BIGINT) AS tn, CAST(count_if(p < 0.5 AND label = 1) AS BIGINT) AS fn FROM sc GROUP BY split)
SELECT cm.split, cm.n_rows, cm.pos_rate, round(a.auc, 6) AS auc, cm.tp, cm.fp, cm.tn, cm.fn
FROM cm JOIN a USING (split)"""
