"""Run-log analytics queries over the `events` table re-read as the training log (B5/B6),
plus joins, set operations and scalar-function queries (S, P, J, A, W, O, U, F rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import PIPELINE_STEPS, hash_uniform, pipeline_hash_col, sql_bits, sql_uniform
from ..functions.scalar import clock_text, last_token_int, r6, runtime_text
from ..operators import logs as L
from ..operators.features import DropConstant
from ..operators.metrics import auc
from ..operators.sampling import CLASSIFIERS, draw_params, kfold, sample_columns, simple_sample, stratified_split
from ..operators.stats import grouped_quantiles
from ..sources import views as V
from ..sources.tables import read_table
from .registry import register
from .sqlv import r6 as s6
from .sqlv import ts_sql, with_views


def ts_str(c):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


# ================================================================ S: log scans and state
@register("s4_iteration_log_rows", ids=("S4", "A10-schema"), sql=lambda: with_views("runlog") + """
SELECT iteration_num, run_id, classifier_type, round(stage1_val_auc, 6) AS stage1_val_auc,
  0.0::DOUBLE AS stage2_val_auc, CAST(NULL AS DOUBLE) AS diversity_score, round(temperature, 6) AS temperature,
  accepted, CASE WHEN accepted = 1 THEN '' ELSE 'rejected' END AS rejection_reason, num_models, timeout
FROM runlog""")
def s4_iteration_log_rows(spark, d):
    """Normalised log rows with optional fields defaulted ('' / 0 / NULL)."""
    r = V.runlog(spark, d)
    return r.select("iteration_num", "run_id", "classifier_type", r6("stage1_val_auc").alias("stage1_val_auc"),
                    F.lit(0.0).alias("stage2_val_auc"), F.lit(None).cast("double").alias("diversity_score"),
                    r6("temperature").alias("temperature"), "accepted",
                    F.when(F.col("accepted") == 1, "").otherwise("rejected").alias("rejection_reason"),
                    "num_models", "timeout")


@register("s6_worker_state", ids=("S6", "S9", "B6"), sql=lambda: with_views("wstate") + f"""
SELECT worker_id, status, iteration_num, batch_num, classifier_type, {ts_sql('start_time')} AS start_time,
  {ts_sql('end_time')} AS end_time, round(runtime_sec, 6) AS runtime_sec, pipeline_hash, {ts_sql('last_update')} AS last_update
FROM wstate""")
def s6_worker_state(spark, d):
    s = L.worker_state(V.workers(spark, d))
    return s.select("worker_id", "status", "iteration_num", "batch_num", "classifier_type",
                    ts_str("start_time").alias("start_time"), ts_str("end_time").alias("end_time"),
                    r6("runtime_sec").alias("runtime_sec"), "pipeline_hash", ts_str("last_update").alias("last_update"))


@register("s9_batch_status", ids=("S9",), sql=lambda: with_views("wstate") + """
SELECT worker_id, status, iteration_num, batch_num, round(runtime_sec, 6) AS runtime_sec
FROM wstate ORDER BY worker_id""")
def s9_batch_status(spark, d):
    """The newest state of every worker in the order of workers."""
    s = L.batch_status(V.workers(spark, d))
    return s.select("worker_id", "status", "iteration_num", "batch_num", r6("runtime_sec").alias("runtime_sec"))


@register("s7_newest_iterations", ids=("S7", "O1"), sql=lambda: with_views("runlog") + """
SELECT iteration_num, run_id, classifier_type, round(stage1_val_auc, 6) AS stage1_val_auc, accepted
FROM runlog ORDER BY iteration_num DESC LIMIT 25""")
def s7_newest_iterations(spark, d):
    """Newest first with LIMIT (the limit is the feature)."""
    r = V.runlog(spark, d, with_num_models=False)
    return (r.orderBy(F.desc("iteration_num")).limit(25)
            .select("iteration_num", "run_id", "classifier_type", r6("stage1_val_auc").alias("stage1_val_auc"), "accepted"))


@register("s8_epochs_of_ensemble", ids=("S8", "O1"), sql=lambda: with_views("epochs") + """
SELECT ensemble_id, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss
FROM epochs WHERE ensemble_id = 7 ORDER BY epoch DESC LIMIT 10""")
def s8_epochs_of_ensemble(spark, d):
    e = L.epochs(V.runlog(spark, d, with_num_models=False))
    return (e.filter(F.col("ensemble_id") == 7).orderBy(F.desc("epoch")).limit(10)
            .select("ensemble_id", "epoch", r6("train_loss").alias("train_loss"), r6("val_loss").alias("val_loss")))


@register("s10_current_batch_state", ids=("S10",), sql=lambda: with_views("workers") + f"""
, cur AS (SELECT * FROM workers WHERE batch_num = (SELECT max(batch_num) FROM workers))
SELECT worker_id, arg_max(status, (ts, event_id)) AS status, arg_max(classifier_type, (ts, event_id)) AS classifier_type,
  round(arg_max(runtime_sec, (ts, event_id)), 6) AS runtime_sec, count(*) AS n_events
FROM cur GROUP BY worker_id""")
def s10_current_batch_state(spark, d):
    """The state is 'cleared' at batch start by scoping it to the newest batch."""
    w = V.workers(spark, d)
    mx = w.agg(F.max("batch_num").alias("_mb"))
    cur = w.join(F.broadcast(mx), w.batch_num == mx._mb).drop("_mb")  # one-row side
    seq = F.struct("ts", "event_id")
    return cur.groupBy("worker_id").agg(
        F.max_by("status", seq).alias("status"), L.last_non_null("classifier_type", seq).alias("classifier_type"),
        F.round(L.last_non_null("runtime_sec", seq), 6).alias("runtime_sec"), F.count(F.lit(1)).alias("n_events"))


@register("s14_newest_run", ids=("S14",), sql=lambda: with_views("runlog") + """
SELECT max(run_id) AS newest_run, count(DISTINCT run_id) AS n_runs FROM runlog""")
def s14_newest_run(spark, d):
    r = V.runlog(spark, d, with_num_models=False)
    return r.agg(F.max("run_id").alias("newest_run"), F.count_distinct("run_id").alias("n_runs"))


# ================================================================ P: projections and predicates
@register("p4_accepted_rows", ids=("P4",), sql=lambda: with_views("runlog") + """
SELECT iteration_num, run_id, round(stage1_val_auc, 6) AS stage1_val_auc FROM runlog WHERE accepted = 1""")
def p4_accepted_rows(spark, d):
    r = V.runlog(spark, d, with_num_models=False)
    return r.filter(F.col("accepted") == 1).select("iteration_num", "run_id", r6("stage1_val_auc").alias("stage1_val_auc"))


@register("p5_not_in_classes", ids=("P5",), sql=lambda: with_views("runlog") + """
SELECT iteration_num, classifier_type FROM runlog WHERE classifier_type NOT IN ('view', 'click')""")
def p5_not_in_classes(spark, d):
    r = V.runlog(spark, d, with_num_models=False)
    return r.filter(~F.col("classifier_type").isin("view", "click")).select("iteration_num", "classifier_type")


@register("p6_not_null_runtime", ids=("P6", "F8"), sql=lambda: with_views("workers") + """
SELECT iteration_num, round(runtime_sec, 6) AS runtime_sec, coalesce(classifier_type, 'none') AS classifier_type
FROM workers WHERE runtime_sec IS NOT NULL""")
def p6_not_null_runtime(spark, d):
    w = V.workers(spark, d)
    return w.filter(F.col("runtime_sec").isNotNull()).select(
        "iteration_num", r6("runtime_sec").alias("runtime_sec"),
        F.coalesce("classifier_type", F.lit("none")).alias("classifier_type"))


@register("p7_every_tenth_model", ids=("P7",), sql=lambda: with_views("runlog") + """
SELECT run_id, iteration_num, num_models, round(stage1_val_auc, 6) AS stage1_val_auc
FROM runlog WHERE accepted = 1 AND num_models % 10 = 0""")
def p7_every_tenth_model(spark, d):
    r = V.runlog(spark, d)
    return r.filter((F.col("accepted") == 1) & (F.pmod("num_models", F.lit(10)) == 0)).select(
        "run_id", "iteration_num", "num_models", r6("stage1_val_auc").alias("stage1_val_auc"))


@register("p8_confident_predictions", ids=("P8",), sql=lambda: with_views("preds") + """
SELECT row_id, model_id, round(p, 6) AS p FROM preds WHERE p >= 0.9 OR p <= 1.0 - 0.9""")
def p8_confident_predictions(spark, d):
    p = V.preds(spark, d)
    t = 0.9
    return p.filter((F.col("p") >= t) | (F.col("p") <= F.lit(1.0) - F.lit(t))).select("row_id", "model_id", r6("p").alias("p"))


_AGG_COLS = ["o_totalprice", "c_acctbal", "days", "month"] + [f"{k}_{c}" for c in V.LINE_COLS for k in ("sum", "avg", "max")]


def _col_pick_sql(seed, frac):
    k = max(1, int(len(_AGG_COLS) * frac))
    names = ", ".join(f"('{c}')" for c in _AGG_COLS)
    return f"""picked AS (SELECT name FROM (VALUES {names}) t(name)
  ORDER BY {sql_bits(seed, 'col', 'name')}, name LIMIT {k})"""


@register("p9_random_column_subset", ids=("P9", "P2"), sql=lambda: with_views("base_agg", extra=_col_pick_sql(42, 0.4)) + f"""
SELECT b.row_id, u.name AS column_name, round(u.value, 6) AS value
FROM base_agg b, LATERAL (SELECT * FROM (VALUES {', '.join(f"('{c}', b.{c})" for c in _AGG_COLS)}) v(name, value)) u
WHERE u.name IN (SELECT name FROM picked)""")
def p9_random_column_subset(spark, d):
    """max(1, int(n*f)) columns with the smallest hash of (seed, name), order kept; shown
    in long form (row_id, column_name, value)."""
    cols = sample_columns(_AGG_COLS, 0.4, seed=42, keep_order=True)
    b = V.base_agg(spark, d).select("row_id", *cols)
    stacked = b.unpivot("row_id", cols, "column_name", "value")
    return stacked.select("row_id", "column_name", r6("value").alias("value"))


@register("p11_nonconstant_columns", ids=("P11",), sql=lambda: with_views("dirty") + """
SELECT column_name FROM (
  SELECT 'o_totalprice' AS column_name, count(DISTINCT o_totalprice) AS n_distinct FROM dirty UNION ALL
  SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM dirty UNION ALL
  SELECT 'days', count(DISTINCT days) FROM dirty UNION ALL
  SELECT 'month', count(DISTINCT month) FROM dirty UNION ALL
  SELECT 'const_col', count(DISTINCT const_col) FROM dirty UNION ALL
  SELECT 'null_col', count(DISTINCT null_col) FROM dirty) q WHERE n_distinct > 1""")
def p11_nonconstant_columns(spark, d):
    """Columns with more than one distinct value: minimum below maximum, one aggregation."""
    df = V.dirty(spark, d)
    cols = V.DIRTY_NUMERIC
    row = df.agg(*[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(c) for c in cols])
    return row.unpivot([], cols, "column_name", "varies").filter("varies").select("column_name")


_P11_TRAIN = f"{sql_uniform(42, 'p11', 'row_id')} < 0.8"


@register("p11_drop_constant_columns", ids=("P11",), sql=lambda: with_views("dirty") + f"""
SELECT row_id, round(o_totalprice, 6) AS o_totalprice, round(c_acctbal, 6) AS c_acctbal, round(days, 6) AS days, round(month, 6) AS month
FROM dirty WHERE NOT ({_P11_TRAIN})""")
def p11_drop_constant_columns(spark, d):
    """P11 fitted on the train rows and applied to the others, which keep the train rows' choice."""
    df = V.dirty(spark, d).select("row_id", *V.DIRTY_NUMERIC)
    u = hash_uniform(42, "p11", "row_id")
    op = DropConstant(V.DIRTY_NUMERIC).fit(df.where(u < 0.8))
    out = op.transform(df.where(u >= 0.8))
    return out.select("row_id", *[r6(c).alias(c) for c in out.columns if c != "row_id"])


_P12_SQL = """CASE WHEN dim_reduction IS NULL OR use_pca = 0 THEN 'None'
  WHEN dim_reduction <> 'numeric' THEN dim_reduction
  WHEN pca_components < 1 THEN 'PCA (variance)' ELSE 'PCA/Other' END"""


@register("p12_reduction_label", ids=("P12",), sql=lambda: with_views("runlog") + f"""
, r AS (SELECT CAST(classifier_type <> 'view' AS INTEGER) AS use_pca,
  CASE classifier_type WHEN 'view' THEN NULL WHEN 'signup' THEN 'FastICA' ELSE 'numeric' END AS dim_reduction,
  CASE classifier_type WHEN 'click' THEN training_time_sec / 1000.0 WHEN 'purchase' THEN training_time_sec + 1 END AS pca_components
  FROM runlog)
SELECT {_P12_SQL} AS reduction, count(*) AS n FROM r GROUP BY 1""")
def p12_reduction_label(spark, d):
    r = V.runlog(spark, d, with_num_models=False).select(
        (F.col("classifier_type") != "view").cast("int").alias("use_pca"),
        F.when(F.col("classifier_type") == "view", F.lit(None)).when(F.col("classifier_type") == "signup", "FastICA")
        .otherwise("numeric").alias("dim_reduction"),
        F.when(F.col("classifier_type") == "click", F.col("training_time_sec") / 1000.0)
        .when(F.col("classifier_type") == "purchase", F.col("training_time_sec") + 1).alias("pca_components"))
    lab = (F.when(F.col("dim_reduction").isNull() | (F.col("use_pca") == 0), "None")
           .when(F.col("dim_reduction") != "numeric", F.col("dim_reduction"))
           .when(F.col("pca_components") < 1, "PCA (variance)").otherwise("PCA/Other"))
    return r.groupBy(lab.alias("reduction")).agg(F.count(F.lit(1)).alias("n"))


# Status -> display symbol.
STATUS_SYMBOL = {"running": "\U0001f504", "completed": "\u2705", "timeout": "\u23f1\ufe0f", "error": "\u274c"}


@register("p13_p14_status_report", ids=("P13", "P14", "F4", "F5"), sql=lambda: with_views("wstate") + f"""
SELECT worker_id AS "Worker", status AS "Status",
  CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_SYMBOL.items())} END AS "Symbol",
  coalesce(classifier_type, '-') AS "Classifier",
  CASE WHEN rt IS NULL THEN 'N/A' WHEN rt < 60 THEN CAST(floor(rt) AS BIGINT) || 's'
       ELSE CAST(floor(rt / 60) AS BIGINT) || 'm' END AS "Runtime",
  strftime(last_update, '%I:%M:%S %p') AS "Updated"
FROM (SELECT *, CASE WHEN start_time IS NULL THEN NULL
  WHEN end_time IS NOT NULL THEN (epoch_us(end_time) - epoch_us(start_time)) / 1e6
  WHEN status = 'running' THEN (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(start_time)) / 1e6
  ELSE coalesce(runtime_sec, 0.0) END AS rt FROM wstate) q""")
def p13_p14_status_report(spark, d):
    """P13 status map, P14 select+rename, F5 runtime text ('now' is a parameter), F4 clock."""
    s = L.worker_state(V.workers(spark, d))
    m = F.create_map(*[F.lit(x) for kv in STATUS_SYMBOL.items() for x in kv])
    return s.select(F.col("worker_id").alias("Worker"), F.col("status").alias("Status"),
                    m[F.col("status")].alias("Symbol"),
                    F.coalesce("classifier_type", F.lit("-")).alias("Classifier"),
                    runtime_text("runtime_sec", "status", "start_time", "end_time", "2024-01-31 00:00:00").alias("Runtime"),
                    clock_text("last_update").alias("Updated"))


# ================================================================ J: joins
@register("j2_stacked_predictions", ids=("J2", "EN13"), sql=lambda: with_views("preds") + f"""
SELECT row_id, {', '.join(f'round(max(CASE WHEN model_id = {m} THEN p END), 6) AS m{m}' for m in range(V.N_MODELS))}
FROM preds GROUP BY row_id""")
def j2_stacked_predictions(spark, d):
    """Rows x models matrix from the long table (pivot with an explicit level list, so
    no distinct-values job)."""
    p = V.preds(spark, d)
    wide = p.groupBy("row_id").pivot("model_id", list(range(V.N_MODELS))).agg(F.first("p"))
    return wide.select("row_id", *[r6(str(m)).alias(f"m{m}") for m in range(V.N_MODELS)])


@register("j3_rows_outside_sample", ids=("J3", "U3", "SM6"), sql=lambda: with_views("base") + f"""
, s AS (SELECT row_id FROM base ORDER BY {sql_bits(42, 'simple', 'row_id')}, row_id LIMIT 1000)
SELECT b.row_id, b.label FROM base b ANTI JOIN s USING (row_id)""")
def j3_rows_outside_sample(spark, d):
    b = V.base(spark, d).select("row_id", "label")
    s = simple_sample(b, "row_id", 1000)
    return b.join(s.select("row_id"), "row_id", "left_anti")


@register("j4_j5_timeout_rate_aligned", ids=("J4", "J5", "A9", "P5"), sql=lambda: with_views("runlog") + """
, att AS (SELECT classifier_type, count(*) AS attempts FROM runlog WHERE classifier_type NOT IN ('view') GROUP BY 1),
to_ AS (SELECT classifier_type, count(*) AS timeouts FROM runlog WHERE timeout = 1 GROUP BY 1)
SELECT coalesce(a.classifier_type, t.classifier_type) AS classifier_type, coalesce(a.attempts, 0) AS attempts,
  coalesce(t.timeouts, 0) AS timeouts,
  round(coalesce(100.0 * t.timeouts / a.attempts, 0.0), 6) AS timeout_pct
FROM att a FULL OUTER JOIN to_ t ON a.classifier_type = t.classifier_type""")
def j4_j5_timeout_rate_aligned(spark, d):
    """J4 full-outer align of two count series + J5 default 0; A9 timeout rate per class."""
    r = V.runlog(spark, d, with_num_models=False)
    att = r.filter(~F.col("classifier_type").isin("view")).groupBy("classifier_type").agg(F.count(F.lit(1)).alias("attempts"))
    to = r.filter(F.col("timeout") == 1).groupBy("classifier_type").agg(F.count(F.lit(1)).alias("timeouts"))
    j = att.join(to, "classifier_type", "full_outer")
    return j.select("classifier_type", F.coalesce("attempts", F.lit(0)).alias("attempts"),
                    F.coalesce("timeouts", F.lit(0)).alias("timeouts"),
                    r6(F.coalesce(F.try_divide(F.lit(100.0) * F.col("timeouts"), F.col("attempts")), F.lit(0.0))).alias("timeout_pct"))


@register("j6_j8_labelled_documents", ids=("J6", "J8", "U3"), sql="""
SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE d.doc_id IN (SELECT doc_id FROM labels)""")
def j6_j8_labelled_documents(spark, d):
    """J6 semi join by key list, J8 label lookup (inner equi-join)."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    lab = read_table(spark, d, "labels")
    return docs.join(lab, "doc_id", "inner")  # the label lookup keeps the keys of the list, as the semi join does


@register("u3_unlabelled_keys", ids=("U3",), sql="SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def u3_unlabelled_keys(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id")
    lab = read_table(spark, d, "labels").select("doc_id")
    return docs.exceptAll(lab)


@register("u2_drop_duplicate_texts", ids=("U2",), sql="""
SELECT md5(text) AS text_md5, lang, CAST(length(text) AS INTEGER) AS n_chars FROM (SELECT DISTINCT text, lang FROM documents) q""")
def u2_drop_duplicate_texts(spark, d):
    """Exact duplicate rows removed over the whole text (output keyed by its digest)."""
    u = V.dups(spark, d).dropDuplicates()
    return u.select(F.md5("text").alias("text_md5"), "lang", F.length("text").alias("n_chars"))


# ================================================================ A: aggregations
@register("a1_worker_summary", ids=("A1",), sql=lambda: with_views("wstate") + """
SELECT count(*) AS total, CAST(count_if(status = 'running') AS BIGINT) AS running, CAST(count_if(status = 'completed') AS BIGINT) AS completed,
  CAST(count_if(status = 'timeout') AS BIGINT) AS timeouts, CAST(count_if(status = 'error') AS BIGINT) AS errors,
  round(coalesce(avg(CASE WHEN status = 'completed' THEN runtime_sec END), 0.0), 6) AS avg_runtime,
  round(coalesce(max(CASE WHEN status = 'completed' THEN runtime_sec END), 0.0), 6) AS max_runtime,
  coalesce(max(batch_num), 0) AS max_batch FROM wstate""")
def a1_worker_summary(spark, d):
    s = L.worker_summary(L.worker_state(V.workers(spark, d)))
    return s.withColumn("avg_runtime", r6("avg_runtime")).withColumn("max_runtime", r6("max_runtime"))


@register("a2_run_summary", ids=("A2", "W3", "F4", "A12"), sql=lambda: with_views("runlog") + """
, g AS (SELECT run_id, count(*) AS total, CAST(count_if(accepted = 1) AS BIGINT) AS accepted, CAST(count_if(accepted <> 1) AS BIGINT) AS rejected,
  coalesce(arg_max(num_models, CASE WHEN accepted = 1 THEN iteration_num END), 0) AS ensemble_size,
  max(CASE WHEN accepted = 1 THEN stage1_val_auc END) AS best_auc,
  arg_max(temperature, iteration_num) AS last_temperature, max(timestamp) AS last_time,
  CAST(count_if(timeout = 0) AS BIGINT) AS nt, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9 AS hours
  FROM runlog GROUP BY run_id)
SELECT run_id, total, accepted, rejected, ensemble_size, round(best_auc, 6) AS best_auc,
  round(last_temperature, 6) AS last_temperature, strftime(last_time, '%Y-%m-%d %H:%M:%S.%f') AS last_time,
  CASE WHEN ensemble_size < 10 THEN 'Simple Mean' ELSE 'DNN Weighted' END AS aggregation,
  round(CASE WHEN hours > 0 THEN nt / hours ELSE 0.0 END, 6) AS models_per_hour,
  round(accepted / total, 6) AS acceptance_rate
FROM g""")
def a2_run_summary(spark, d):
    s = L.run_summary(V.runlog(spark, d))
    return s.select("run_id", "total", "accepted", "rejected", "ensemble_size", r6("best_auc").alias("best_auc"),
                    r6("last_temperature").alias("last_temperature"), ts_str("last_time").alias("last_time"),
                    "aggregation", r6("models_per_hour").alias("models_per_hour"),
                    r6(F.try_divide(F.col("accepted"), F.col("total"))).alias("acceptance_rate"))


@register("a2_whole_log_summary", ids=("A2", "W3"), sql=lambda: with_views("runlog") + """
, g AS (SELECT count(*) AS total, CAST(count_if(accepted = 1) AS BIGINT) AS accepted, CAST(count_if(accepted <> 1) AS BIGINT) AS rejected,
  coalesce(arg_max(num_models, CASE WHEN accepted = 1 THEN iteration_num END), 0) AS ensemble_size,
  coalesce(max(CASE WHEN accepted = 1 THEN stage1_val_auc END), 0.0) AS best_auc, coalesce(arg_max(temperature, iteration_num), 0.0) AS last_temperature,
  CAST(count_if(timeout = 0) AS BIGINT) AS nt, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9 AS hours FROM runlog)
SELECT total, accepted, rejected, ensemble_size, round(best_auc, 6) AS best_auc, round(last_temperature, 6) AS last_temperature,
  CASE WHEN total = 0 THEN 'N/A' WHEN ensemble_size < 10 THEN 'Simple Mean' ELSE 'DNN Weighted' END AS aggregation,
  round(CASE WHEN hours > 0 THEN nt / hours ELSE 0.0 END, 6) AS models_per_hour FROM g""")
def a2_whole_log_summary(spark, d):
    """A2 of the whole log: one row, of zeros where the log is empty."""
    s = L.run_summary(V.runlog(spark, d), by=[])
    return s.select("total", "accepted", "rejected", "ensemble_size", r6("best_auc").alias("best_auc"),
                    r6("last_temperature").alias("last_temperature"), "aggregation", r6("models_per_hour").alias("models_per_hour"))


@register("a3_global_summary", ids=("A3", "A12"), sql=lambda: with_views("runlog") + """
SELECT count(*) AS total_iterations, CAST(count_if(accepted = 1) AS BIGINT) AS accepted,
  round(max(stage1_val_auc), 6) AS best_stage1, round(arg_max(temperature, iteration_num), 6) AS latest_temperature,
  round(CAST(count_if(accepted = 1) AS BIGINT) / count(*), 6) AS acceptance_rate, round(CAST(count_if(timeout = 1) AS BIGINT) / count(*), 6) AS timeout_rate
FROM runlog""")
def a3_global_summary(spark, d):
    r = V.runlog(spark, d, with_num_models=False)
    return r.agg(F.count(F.lit(1)).alias("total_iterations"), F.count_if(F.col("accepted") == 1).alias("accepted"),
                 r6(F.max("stage1_val_auc")).alias("best_stage1"),
                 r6(F.max_by("temperature", "iteration_num")).alias("latest_temperature"),
                 r6(F.try_divide(F.count_if(F.col("accepted") == 1), F.count(F.lit(1)))).alias("acceptance_rate"),
                 r6(F.try_divide(F.count_if(F.col("timeout") == 1), F.count(F.lit(1)))).alias("timeout_rate"))


@register("a4_class_counts", ids=("A4",), sql=lambda: with_views("runlog") + """
SELECT classifier_type, count(*) AS n FROM runlog GROUP BY 1 ORDER BY n DESC, classifier_type""")
def a4_class_counts(spark, d):
    r = V.runlog(spark, d, with_num_models=False)
    return r.groupBy("classifier_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "classifier_type")


@register("a5_transformer_usage", ids=("A5", "F3", "F9"), sql=lambda: with_views("lists") + """
, t AS (SELECT CASE WHEN trim(x) = '' THEN 'None' ELSE trim(x) END AS transformer
  FROM lists, unnest(string_split(transformers_used, ',')) u(x) WHERE transformers_used IS NOT NULL)
SELECT transformer, count(*) AS n FROM t GROUP BY 1""")
def a5_transformer_usage(spark, d):
    l = V.lists(spark, d).filter(F.col("transformers_used").isNotNull())
    t = l.select(F.explode(F.split("transformers_used", ",")).alias("x"))
    t = t.select(F.when(F.trim("x") == "", "None").otherwise(F.trim("x")).alias("transformer"))
    return t.groupBy("transformer").agg(F.count(F.lit(1)).alias("n"))


@register("a6_a7_runtime_distribution", ids=("A6", "A7", "A10"), sql=lambda: with_views("runlog") + """
SELECT classifier_type, round(median(training_time_sec), 6) AS median_time,
  round(quantile_cont(training_time_sec, 0.0), 6) AS q0, round(quantile_cont(training_time_sec, 0.25), 6) AS q1,
  round(quantile_cont(training_time_sec, 0.5), 6) AS q2, round(quantile_cont(training_time_sec, 0.75), 6) AS q3,
  round(quantile_cont(training_time_sec, 1.0), 6) AS q4, round(min(training_time_sec), 6) AS min_time,
  round(avg(training_time_sec), 6) AS avg_time, round(max(training_time_sec), 6) AS max_time
FROM runlog GROUP BY 1""")
def a6_a7_runtime_distribution(spark, d):
    """A6 median per group, A7 five-number summary, A10 min/avg/max: exact ranks over the distinct
    values of each group, dealt by range."""
    q = grouped_quantiles(V.runlog(spark, d, with_num_models=False), ["classifier_type"], ["training_time_sec"],
                          [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select("classifier_type", r6(F.col("q")[2]).alias("median_time"), *[r6(F.col("q")[i]).alias(f"q{i}") for i in range(5)],
                    r6("least").alias("min_time"), r6("mean").alias("avg_time"), r6("greatest").alias("max_time"))


@register("a8_runtime_histogram", ids=("A8",), sql=lambda: with_views("runlog") + """
, mm AS (SELECT min(training_time_sec) AS mn, max(training_time_sec) AS mx FROM runlog)
SELECT CAST(least(floor((training_time_sec - mn) / (mx - mn) * 30), 29) AS INTEGER) AS bin, count(*) AS n,
  round(min(mn + (mx - mn) * least(floor((training_time_sec - mn) / (mx - mn) * 30), 29) / 30), 6) AS bin_lo
FROM runlog, mm GROUP BY 1""")
def a8_runtime_histogram(spark, d):
    r = V.runlog(spark, d, with_num_models=False)
    mm = r.agg(F.min("training_time_sec").alias("mn"), F.max("training_time_sec").alias("mx"))
    j = r.crossJoin(F.broadcast(mm))  # one-row side
    b = F.least(F.floor((F.col("training_time_sec") - F.col("mn")) / (F.col("mx") - F.col("mn")) * 30), F.lit(29))
    j = j.withColumn("bin", b.cast("int")).withColumn("_lo", F.col("mn") + (F.col("mx") - F.col("mn")) * b / 30)
    return j.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.min("_lo")).alias("bin_lo"))


@register("a10_worker_runtime_means", ids=("A10", "F8"), sql=lambda: with_views("workers") + """
SELECT status, count(*) AS n, count(runtime_sec) AS n_runtime, round(avg(runtime_sec), 6) AS mean_runtime,
  round(min(runtime_sec), 6) AS min_runtime, round(max(runtime_sec), 6) AS max_runtime FROM workers GROUP BY 1""")
def a10_worker_runtime_means(spark, d):
    w = V.workers(spark, d)
    return w.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("runtime_sec").alias("n_runtime"),
                                   r6(F.avg("runtime_sec")).alias("mean_runtime"),
                                   r6(F.min("runtime_sec")).alias("min_runtime"), r6(F.max("runtime_sec")).alias("max_runtime"))


@register("a11_accepted_first_seen", ids=("A11", "O3"), sql=lambda: with_views("runlog") + """
SELECT run_id AS ensemble_id, min(iteration_num) AS first_iteration FROM runlog WHERE accepted = 1
GROUP BY 1 ORDER BY first_iteration""")
def a11_accepted_first_seen(spark, d):
    r = V.runlog(spark, d, with_num_models=False).filter(F.col("accepted") == 1)
    return (r.groupBy(F.col("run_id").alias("ensemble_id")).agg(F.min("iteration_num").alias("first_iteration"))
            .orderBy("first_iteration"))


@register("a13_split_sizes", ids=("A13", "SM1"), sql=lambda: with_views("base") + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_bits(42, 'split', 'row_id')}, row_id) AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM base),
s AS (SELECT label, CASE WHEN rk <= (n * 600000) // 1000000 THEN 'train'
              WHEN rk <= (n * 950000) // 1000000 THEN 'val1' ELSE 'val2' END AS split FROM r)
SELECT coalesce(split, 'total') AS split, count(*) AS n_rows, round(avg(label), 6) AS pos_rate
FROM s GROUP BY ROLLUP (split)""")
def a13_split_sizes(spark, d):
    """Sizes and positive rate per split with a total row (rollup)."""
    s = stratified_split(V.base(spark, d).select("row_id", "label"), "row_id", "label")
    g = s.rollup("split").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("label")).alias("pos_rate"))
    return g.select(F.coalesce("split", F.lit("total")).alias("split"), "n_rows", "pos_rate")


_PROFILE = [("row_id", "bigint"), ("o_totalprice", "double"), ("c_acctbal", "double"), ("days", "double"),
            ("month", "double"), ("o_orderpriority", "string"), ("c_mktsegment", "string"), ("c_nationkey", "int"),
            ("label", "int")]


@register("a14_column_profile", ids=("A14",), sql=lambda: with_views("base") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct FROM base"
    for c, t in _PROFILE))
def a14_column_profile(spark, d):
    """Dtype, non-null count and exact distinct count per column: cells grouped by (column,
    value) with partial aggregation, then counted per column."""
    b = V.base(spark, d)
    types = dict(b.dtypes)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, (c, _) in enumerate(_PROFILE)]))
    values = b.select(cells.alias("s")).groupBy("s.i", "s.v").agg(F.count("s.v").alias("n"))
    name = F.element_at(F.array(*[F.lit(c) for c, _ in _PROFILE]), F.col("i") + 1)
    kind = F.element_at(F.array(*[F.lit(types[c]) for c, _ in _PROFILE]), F.col("i") + 1)
    return values.groupBy("i").agg(F.sum("n").alias("non_null"), F.count("v").alias("n_distinct")).select(
        name.alias("column_name"), kind.alias("dtype"), "non_null", "n_distinct")


@register("a15_class_distribution", ids=("A15", "S3"), sql=lambda: with_views("base") + """
SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM base), 6) AS share FROM base GROUP BY label""")
def a15_class_distribution(spark, d):
    b = V.base(spark, d)
    cnt = b.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    tot = b.agg(F.count(F.lit(1)).alias("_t"))
    return cnt.crossJoin(F.broadcast(tot)).select("label", "n", r6(F.col("n") / F.col("_t")).alias("share"))


@register("a16_mt13_best_epochs", ids=("A16", "O4", "MT13", "S5"), sql=lambda: with_views("epochs") + """
SELECT ensemble_id, max(epoch) AS last_epoch, round(arg_max(val_loss, epoch), 6) AS last_val_loss,
  arg_min(epoch, (val_loss, epoch)) AS best_epoch, round(min(val_loss), 6) AS best_val_loss,
  round(max(val_loss - train_loss), 6) AS max_overfit_gap, count(*) AS n_epochs
FROM epochs GROUP BY 1""")
def a16_mt13_best_epochs(spark, d):
    e = L.epochs(V.runlog(spark, d, with_num_models=False))
    return e.groupBy("ensemble_id").agg(
        F.max("epoch").alias("last_epoch"), r6(F.max_by("val_loss", "epoch")).alias("last_val_loss"),
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), r6(F.min("val_loss")).alias("best_val_loss"),
        r6(F.max(F.col("val_loss") - F.col("train_loss"))).alias("max_overfit_gap"), F.count(F.lit(1)).alias("n_epochs"))


@register("a17_distinct_runs", ids=("A17",), sql=lambda: with_views("runlog") + """
SELECT DISTINCT CAST(run_id AS VARCHAR) AS run_name FROM runlog ORDER BY 1""")
def a17_distinct_runs(spark, d):
    r = V.runlog(spark, d, with_num_models=False)
    return r.select(F.col("run_id").cast("string").alias("run_name")).distinct().orderBy("run_name")


@register("a18_fold_score_spread", ids=("A18", "SM9", "MT5", "MT1"), sql=lambda: with_views("base") + f"""
, r AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {sql_bits(42, 'kfold', 'row_id')}, row_id) - 1) % 3 AS fold FROM base),
g AS (SELECT fold, o_totalprice AS score, sum(label) AS pos, count(*) - sum(label) AS neg FROM r GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM g),
a AS (SELECT fold, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY fold)
SELECT round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, count(*) AS n_folds FROM a""")
def a18_fold_score_spread(spark, d):
    """Mean and population std of per-fold AUCs (SM9 folds, MT1 per fold)."""
    f = kfold(V.base(spark, d).select("row_id", "o_totalprice", "label"), "row_id", "label", k=3)
    a = auc(f, "o_totalprice", "label", by=["fold"])
    return a.agg(r6(F.avg("auc")).alias("mean_auc"), r6(F.stddev_pop("auc")).alias("std_auc"),
                 F.count(F.lit(1)).alias("n_folds"))


def _clf_sql(seed=42):
    arr = ", ".join(f"'{c}'" for c in CLASSIFIERS)
    u = f"({sql_bits(seed, 'clf', 'iteration_num')} / 4503599627370496.0::DOUBLE)"
    return f"list_extract([{arr}], CAST(floor({u} * {len(CLASSIFIERS)}) AS INTEGER) + 1)"


def _cores():
    return F.when(F.col("classifier_type").isin("random_forest", "extra_trees", "knn"), 2).otherwise(1)


@register("a19_batch_summary", ids=("A19", "SM12", "F9"), sql=lambda: with_views("runlog") + f"""
, c AS (SELECT batch_num, {_clf_sql()} AS clf FROM runlog),
k AS (SELECT batch_num, clf, count(*) AS n FROM c GROUP BY 1, 2)
SELECT batch_num, CAST(sum(n) AS BIGINT) AS jobs,
  CAST(sum(n * CASE WHEN clf IN ('random_forest', 'extra_trees', 'knn') THEN 2 ELSE 1 END) AS BIGINT) AS cores_total,
  round(sum(n * CASE WHEN clf IN ('random_forest', 'extra_trees', 'knn') THEN 2 ELSE 1 END) / sum(n), 6) AS cores_avg,
  string_agg(clf || ':' || n, ',' ORDER BY clf) AS per_class
FROM k GROUP BY batch_num""")
def a19_batch_summary(spark, d):
    """Per batch: jobs, cores (2 for tree/kNN models, else 1), average, count per class."""
    r = V.runlog(spark, d, with_num_models=False).select("iteration_num", "batch_num")
    c = draw_params(r, "iteration_num", carry=["batch_num"])
    g = L.batch_summary(c, _cores(), by=["batch_num"])
    return g.select("batch_num", "jobs", "cores_total", r6("cores_avg").alias("cores_avg"), "per_class")


@register("a19_all_batches", ids=("A19", "SM12"), sql=lambda: with_views("runlog") + f"""
, k AS (SELECT {_clf_sql()} AS clf, count(*) AS n FROM runlog GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS jobs, CAST(sum(n * CASE WHEN clf IN ('random_forest', 'extra_trees', 'knn') THEN 2 ELSE 1 END) AS BIGINT) AS cores_total,
  round(sum(n * CASE WHEN clf IN ('random_forest', 'extra_trees', 'knn') THEN 2 ELSE 1 END) / sum(n), 6) AS cores_avg,
  string_agg(clf || ':' || n, ',' ORDER BY clf) AS per_class FROM k""")
def a19_all_batches(spark, d):
    """A19 over all jobs: one row, of zeros where there are none."""
    c = draw_params(V.runlog(spark, d, with_num_models=False).select("iteration_num"), "iteration_num")
    g = L.batch_summary(c, _cores())
    return g.select("jobs", "cores_total", r6("cores_avg").alias("cores_avg"), "per_class")


@register("a20_overall_mean_line", ids=("A20",), sql=lambda: with_views("runlog") + """
SELECT iteration_num, round(training_time_sec, 6) AS training_time_sec,
  round(avg(training_time_sec) OVER (PARTITION BY run_id), 9) AS run_mean,
  round(sum(training_time_sec) OVER (PARTITION BY run_id) / 60.0, 9) AS run_total_min FROM runlog""")
def a20_overall_mean_line(spark, d):
    """Each row with its run's mean and total minutes (per-run aggregate joined back;
    the aggregate is partial-combined so hot runs are cheap)."""
    r = V.runlog(spark, d, with_num_models=False)
    g = r.groupBy("run_id").agg(F.avg("training_time_sec").alias("_m"), F.sum("training_time_sec").alias("_s"))
    return r.join(g, "run_id").select("iteration_num", r6("training_time_sec").alias("training_time_sec"),
                                      F.round("_m", 9).alias("run_mean"), F.round(F.col("_s") / 60.0, 9).alias("run_total_min"))


# ================================================================ W: ordered logic
@register("w1_w2_rolling_auc", ids=("W1", "W2"), sql=lambda: with_views("runlog") + """
, a AS (SELECT * FROM runlog WHERE accepted = 1),
w AS (SELECT run_id, iteration_num, row_number() OVER (PARTITION BY run_id ORDER BY iteration_num) AS ensemble_size,
  avg(stage1_val_auc) OVER (PARTITION BY run_id ORDER BY iteration_num ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m,
  stddev_samp(stage1_val_auc) OVER (PARTITION BY run_id ORDER BY iteration_num ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s
  FROM a)
SELECT run_id, iteration_num, ensemble_size, round(m, 9) AS roll_mean, round(s, 9) AS roll_std,
  round(m - s, 9) AS band_lo, round(m + s, 9) AS band_hi FROM w""")
def w1_w2_rolling_auc(spark, d):
    r = L.rolling_auc(V.runlog(spark, d, with_num_models=False), k=10)
    # nine places: means of a few 5-decimal values sit on rounding ties at six
    return r.select("run_id", "iteration_num", "ensemble_size",
                    *[F.round(c, 9).alias(c) for c in ("roll_mean", "roll_std", "band_lo", "band_hi")])


@register("w3_first_last", ids=("W3",), sql=lambda: with_views("runlog") + """
SELECT run_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS first_time,
  strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS last_time,
  round(arg_min(stage1_val_auc, iteration_num), 6) AS first_auc, round(arg_max(stage1_val_auc, iteration_num), 6) AS last_auc,
  round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 6e7, 6) AS span_min
FROM runlog GROUP BY run_id""")
def w3_first_last(spark, d):
    """first/last by order without a window (min_by / max_by aggregates)."""
    r = V.runlog(spark, d, with_num_models=False)
    return r.groupBy("run_id").agg(
        ts_str_col(F.min("timestamp")).alias("first_time"), ts_str_col(F.max("timestamp")).alias("last_time"),
        r6(F.min_by("stage1_val_auc", "iteration_num")).alias("first_auc"),
        r6(F.max_by("stage1_val_auc", "iteration_num")).alias("last_auc"),
        r6(F.expr("timestampdiff(MICROSECOND, min(timestamp), max(timestamp))") / 6e7).alias("span_min"))


def ts_str_col(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@register("w4_plateau_counter", ids=("W4",), sql=lambda: with_views("runlog") + """
, a AS (SELECT run_id, iteration_num, stage1_val_auc,
  max(stage1_val_auc) OVER (PARTITION BY run_id ORDER BY iteration_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb,
  row_number() OVER (PARTITION BY run_id ORDER BY iteration_num) AS idx FROM runlog),
b AS (SELECT *, (bb IS NULL OR stage1_val_auc > bb) AS new_best FROM a),
c AS (SELECT *, max(CASE WHEN new_best THEN idx END) OVER (PARTITION BY run_id ORDER BY iteration_num
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lb FROM b)
SELECT run_id, iteration_num, round(greatest(bb, stage1_val_auc), 6) AS running_best, new_best,
  idx - lb AS plateau, (idx - lb) >= 20 AS stop FROM c""")
def w4_plateau_counter(spark, d):
    p = L.plateau(V.runlog(spark, d, with_num_models=False), limit=20)
    return p.select("run_id", "iteration_num", r6("running_best").alias("running_best"), "new_best",
                    "plateau", "stop")


@register("w5_temperature_path", ids=("W5",), sql=lambda: with_views("runlog") + """
, a AS (SELECT run_id, iteration_num, batch_num, row_number() OVER (PARTITION BY run_id ORDER BY iteration_num) AS step,
  avg(CAST(accepted AS DOUBLE)) OVER (PARTITION BY run_id ORDER BY iteration_num ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rate
  FROM runlog),
b AS (SELECT *, max(CASE WHEN step < 20 OR rate >= 0.1 THEN step END) OVER (PARTITION BY run_id ORDER BY iteration_num
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS calm FROM a)
SELECT run_id, iteration_num, step, round(rate, 6) AS accept_rate, round(0.01 * pow(0.995, step - 1), 9) AS temperature_closed,
  round(0.01 * pow(0.995, calm - 1) * pow(1.2, step - calm), 9) AS adaptive,
  round(0.01 * pow(0.998, batch_num), 9) AS temperature_batch FROM b""")
def w5_temperature_path(spark, d):
    t = L.temperature_path(V.runlog(spark, d, with_num_models=False), batch="batch_num")
    return t.select("run_id", "iteration_num", "step", r6("accept_rate").alias("accept_rate"),
                    *[F.round(c, 9).alias(c) for c in ("temperature_closed", "adaptive", "temperature_batch")])


# ================================================================ O: sort / top-k
@register("o2_top_confident", ids=("O2", "PL4"), sql=lambda: with_views("preds") + """
SELECT row_id, model_id, round(p, 6) AS p FROM preds ORDER BY abs(p - 0.5) DESC, row_id, model_id LIMIT 50""")
def o2_top_confident(spark, d):
    """O2: top-n by confidence |p - 0.5| with a key tie-break (TakeOrderedAndProject)."""
    p = V.preds(spark, d)
    return (p.orderBy(F.desc(F.abs(F.col("p") - 0.5)), "row_id", "model_id").limit(50)
            .select("row_id", "model_id", r6("p").alias("p")))


# ================================================================ F: scalar functions
@register("f1_f2_math", ids=("F1", "F2"), sql=lambda: with_views("base") + """
SELECT row_id, round(exp(-days / 1000.0), 6) AS e, round(ln(o_totalprice), 6) AS lg, round(sqrt(abs(c_acctbal)), 6) AS sq,
  CAST(sign(c_acctbal) AS INTEGER) AS sg, round(pow(month, 2), 6) AS pw, floor(o_totalprice / 1000.0) AS fl,
  least(month, 6.0) AS lo, greatest(month, 6.0) AS hi, round(least(greatest(c_acctbal, 0.0), 5000.0), 6) AS clipped,
  round(1.0 / (1.0 + exp(-c_acctbal / 1000.0)), 6) AS sig FROM base""")
def f1_f2_math(spark, d):
    from ..functions.scalar import clip, sigmoid

    b = V.base(spark, d)
    return b.select("row_id", r6(F.exp(-F.col("days") / 1000.0)).alias("e"), r6(F.log("o_totalprice")).alias("lg"),
                    r6(F.sqrt(F.abs("c_acctbal"))).alias("sq"), F.signum("c_acctbal").cast("int").alias("sg"),
                    r6(F.pow("month", 2)).alias("pw"), F.floor(F.col("o_totalprice") / 1000.0).cast("double").alias("fl"),
                    F.least("month", F.lit(6.0)).alias("lo"), F.greatest("month", F.lit(6.0)).alias("hi"),
                    r6(clip("c_acctbal", 0.0, 5000.0)).alias("clipped"),
                    r6(sigmoid(F.col("c_acctbal") / 1000.0)).alias("sig"))


@register("f3_string_tokens", ids=("F3",), sql="""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: trim(x)), ',') AS joined,
  TRY_CAST(string_split(p_brand, '#')[-1] AS INTEGER) AS brand_no,
  TRY_CAST(string_split(p_type, '#')[-1] AS INTEGER) AS bad_no FROM part""")
def f3_string_tokens(spark, d):
    """split + trim + join; last token to int with failures -> null."""
    p = read_table(spark, d, "part")
    return p.select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), F.trim), ",").alias("joined"),
                    last_token_int("p_brand", "#").alias("brand_no"), last_token_int("p_type", "#").alias("bad_no"))


def _draw_sql(salt):
    return sql_uniform(42, salt, "iteration_num")


@register("f6_config_hash", ids=("F6", "SM11"), sql=lambda: with_views("runlog") + f"""
, c AS (SELECT iteration_num, {_clf_sql()} AS classifier_type, round(0.1 + 0.8 * {_draw_sql('rowfrac')}, 4) AS row_sample_pct,
  round(0.5 + 0.5 * {_draw_sql('colfrac')}, 4) AS col_sample_pct FROM runlog)
SELECT iteration_num, classifier_type, row_sample_pct, col_sample_pct,
  substr(sha256('{{"classifier": "' || classifier_type || '", "col_sample_pct": ' || col_sample_pct::VARCHAR
    || ', "dim_reduction": null, "pipeline_steps": ["{'", "'.join(PIPELINE_STEPS)}"], "row_sample_pct": '
    || row_sample_pct::VARCHAR || ', "transformers": []}}'), 1, 16) AS pipeline_hash
FROM c""")
def f6_config_hash(spark, d):
    """first 16 hex of SHA-256 of the key-sorted JSON of a candidate's six identifying keys."""
    r = V.runlog(spark, d, with_num_models=False).select("iteration_num")
    p = draw_params(r, "iteration_num").select(
        "iteration_num", "classifier_type", F.round("row_fraction", 4).alias("row_sample_pct"),
        F.round("column_fraction", 4).alias("col_sample_pct"))
    none = F.array().cast("array<string>")
    return p.withColumn("pipeline_hash", pipeline_hash_col(
        F.col("classifier_type"), none, F.lit(None).cast("string"), F.col("row_sample_pct"), F.col("col_sample_pct")))


@register("f7_json_props", ids=("F7",), sql="""
SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n,
  to_json({'k': CAST(json_extract_string(props, '$.k') AS INTEGER), 'n': count(*)})::VARCHAR AS doc
FROM events GROUP BY 1""")
def f7_json_props(spark, d):
    e = read_table(spark, d, "events")
    g = e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("doc", F.to_json(F.struct("k", "n")))


# ================================================================ W6 annealing fold
@register("w6_anneal_fold", ids=("W6", "EN10", "W5"), sql=lambda: "WITH RECURSIVE " + with_views("runlog")[5:] + f"""
, x AS (SELECT run_id, iteration_num, stage1_val_auc AS c, temperature AS t,
        {sql_uniform(42, 'anneal', 'iteration_num')} AS u,
        row_number() OVER (PARTITION BY run_id ORDER BY iteration_num) AS k FROM runlog),
f AS (SELECT run_id, k, iteration_num, true AS accepted, c AS cur FROM x WHERE k = 1
      UNION ALL
      SELECT x.run_id, x.k, x.iteration_num,
             (x.c > f.cur OR x.c = f.cur OR x.u < exp((x.c - f.cur) / x.t)) AS accepted,
             CASE WHEN (x.c > f.cur OR x.c = f.cur OR x.u < exp((x.c - f.cur) / x.t)) THEN x.c ELSE f.cur END AS cur
      FROM f JOIN x ON x.run_id = f.run_id AND x.k = f.k + 1)
SELECT run_id, iteration_num, accepted, round(cur, 6) AS current_score FROM f""")
def w6_anneal_fold(spark, d):
    """Per-run annealing acceptance as an exact chunked composition (see
    operators/anneal.py); the oracle is a recursive CTE."""
    from ..operators.anneal import anneal_fold

    r = V.runlog(spark, d, with_num_models=False)
    a = anneal_fold(r)
    return a.select("run_id", "iteration_num", "accepted", r6("current_score").alias("current_score"))
