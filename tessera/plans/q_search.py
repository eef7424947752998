"""Search-loop, bundle, resume and sink queries (EN11, EN12, EN14, EN16, EN19, S1-S3,
S11-S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import py_uniform, sql_uniform
from ..functions.scalar import r6
from ..operators import models as M
from ..operators.ensemble import aggregate_rows
from ..operators.metrics import auc
from ..operators.pipeline import NEEDS_CLEAN, apply_pipeline, draw_spec, fit_pipeline
from ..operators.pool import fit_classifier
from ..operators.search import SearchConfig, accept, ensemble_probability, meta_frame, meta_learner, run_search
from ..session import scratch_path, stored, track
from ..sources import sinks
from ..sources import views as V
from ..sources.saved import load_fitted, save_fitted
from ..sources.tables import read_csv
from .q_models import ABOVE, X, XW, _z_sql, planted_frame, wide_frame
from .registry import register
from .sqlv import with_views


_CFG = dict(n_batches=2, batch_size=3, models=["naive_bayes", "lda", "qda", "sgd_classifier", "ridge", "logistic"])
_SPECS = [draw_spec(XW, 42, it, _CFG["models"], SearchConfig.row_fraction, SearchConfig.column_fraction) for it in range(7)]


def replay(spark, res: dict, pool) -> dict[int, tuple[bool, bool]]:
    """Decisions taken again from the written predictions and log, candidate after candidate, with
    AUCs of plain means: iteration -> (score as logged, decision as logged)."""
    log = {r["iteration_num"]: r for r in sinks.read_log(spark, res["log"]).filter(F.col("run_id") == res["run_id"]).collect()}
    preds = spark.read.option("recursiveFileLookup", True).schema("row_id bigint, model_id int, p double").parquet(res["preds"])
    y = stored(pool.filter(F.col("split") == "val1").select("row_id", "label"), "replay-labels")  # its plan would be part of each AUC's
    out, inside, current = {0: (True, not log[0]["accepted"])}, [], 0.0
    for it in sorted(i for i in log if i):
        r = log[it]
        # added up in one order for every row: a sum in the order of arrival splits rows that tie
        total = sum((F.max(F.when(F.col("model_id") == m, F.col("p"))) for m in inside + [it]), F.lit(0.0))
        mine = preds.filter(F.col("model_id").isin(*inside, it)).groupBy("row_id").agg((total / F.lit(len(inside) + 1.0)).alias("p"), F.count(F.lit(1)).alias("n"))
        got = auc(mine.filter(F.col("n") == len(inside) + 1).join(y, "row_id"), "p", "label").first()
        score = got["auc"] if got and got["auc"] is not None else float("nan")
        if score != score:
            out[it] = (r["stage1_val_auc"] == 0.0, not r["accepted"])
            continue
        ok, _ = accept(score - current, r["temperature"], py_uniform(42, "accept", it))
        out[it] = (abs(score - r["stage1_val_auc"]) < 1e-9, ok == r["accepted"])
        if r["accepted"]:
            inside.append(it)
            current = r["stage1_val_auc"]
    return out


@register("en11_search_loop", ids=("EN11", "EN12", "EN19", "SM5", "SM11", "SM12", "EN10", "FE38", "S4"), sql=lambda: "SELECT * FROM (VALUES " + ", ".join(
    f"({s.iteration}, '{s.model}', '{s.hash()}', true, true, false)" for s in _SPECS)
    + ") t(iteration_num, classifier_type, pipeline_hash, score_replayed, decision_replayed, timeout)")
def en11_search_loop(spark, d):
    """EN11: two batches of three random pipelines (founder first): exact pre-samples, fits in a
    thread pool with deadlines, sequential acceptance. The log's scores and decisions are held
    against a replay from the written predictions."""
    pool = wide_frame(spark, d)
    res = run_search(spark, pool, XW, SearchConfig(**_CFG), scratch_path(spark, "search"))
    seen = replay(spark, res, pool)
    marks = spark.createDataFrame([(i, a, b) for i, (a, b) in seen.items()], "iteration_num long, score_replayed boolean, decision_replayed boolean")
    log = sinks.read_log(spark, res["log"]).select(F.col("iteration_num").cast("long"), "classifier_type", "pipeline_hash", "timeout")
    return log.join(marks, "iteration_num").select(F.col("iteration_num").cast("int"), "classifier_type", "pipeline_hash", "score_replayed",
                                                   "decision_replayed", "timeout")


@register("s13_resume_search", ids=("S13", "EN11"), sql="SELECT 7 AS n_logged, true AS same_log, true AS same_ensemble, true AS score_is_saved_auc, 3 AS n_states")
def s13_resume_search(spark, d):
    """A search that stops after one batch, loses the start of the next (files without their
    state row) and goes on gives the same log and ensemble as an uninterrupted one; the stored
    score is the AUC of the stored ensemble."""
    pool = wide_frame(spark, d)
    a, b = scratch_path(spark, "search-resume"), scratch_path(spark, "search-full")
    one = run_search(spark, pool, XW, SearchConfig(**{**_CFG, "n_batches": 1}), a)
    torn = spark.read.option("recursiveFileLookup", True).schema("row_id bigint, model_id int, p double").parquet(f"{one['preds']}/batch=1")
    torn.write.mode("overwrite").parquet(f"{one['preds']}/batch=2")  # a batch cut off before it was committed
    one = run_search(spark, pool, XW, SearchConfig(**_CFG), a)
    two = run_search(spark, pool, XW, SearchConfig(**_CFG), b)
    cols = ["iteration_num", "classifier_type", "accepted", "rejection_reason", "num_models", "pipeline_hash", "timeout"]

    def logged(res):
        return sorted(tuple(r) for r in sinks.read_log(spark, res["log"]).select(*cols, F.round("stage1_val_auc", 9)).collect())

    x, y = ensemble_probability(spark, one), ensemble_probability(spark, two)
    far = x.join(y.select("row_id", F.col("p").alias("q")), "row_id").agg(F.max(F.abs(F.col("p") - F.col("q"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    saved = auc(x, "p", "label").first()["auc"]
    la, lb = logged(one), logged(two)
    history = sinks.read_history(spark, one["state"], one["run_id"])
    return spark.createDataFrame([(len(la), la == lb, far["m"] < 1e-12 and far["n"] == x.count(),
                                   abs(saved - one["final"]["current_score"]) < 1e-9, history.count())],
                                 "n_logged int, same_log boolean, same_ensemble boolean, score_is_saved_auc boolean, n_states int")


_META_MODELS = ["naive_bayes", "lda", "qda", "sgd_classifier"]


@register("en14_en16_meta_learner", ids=("EN14", "EN16", "EN13", "T15"), sql=lambda: _z_sql() + f""",
m AS (SELECT row_id, split = 'val1' OR {sql_uniform(42, 'meta', 'row_id')} < 0.9 AS fit FROM z WHERE split <> 'train')
SELECT f.form, {len(_META_MODELS)} AS n_models, (SELECT count(*) FROM m WHERE fit) AS n_train, (SELECT count(*) FROM m WHERE NOT fit) AS n_holdout,
  true AS separates, true AS near_the_mean FROM (VALUES ('logistic'), ('mlp')) f(form)""")
def en14_en16_meta_learner(spark, d):
    """EN14/EN16: logistic and MLP meta-learners on the models' stacked probabilities (val1 and 90 %
    of val2), hyper-parameters drawn and tuned, scored on the held-out tenth only."""
    z = wide_frame(spark, d)
    train, rest = z.filter(F.col("split") == "train"), z.filter(F.col("split") != "train")
    long = None
    for i, name in enumerate(_META_MODELS):
        p = fit_classifier(name, {"reg_param": 0.01}, train, XW).transform(rest).select("row_id", "split", "label", F.lit(i).alias("model_id"), "p")
        long = p if long is None else long.unionByName(p)
    frame = track(meta_frame(long, list(range(len(_META_MODELS)))))
    rows = []
    for form in ("logistic", "mlp"):
        m = meta_learner(frame, len(_META_MODELS), form, n_draws=3)
        rows.append((form, m["n_models"], m["n_train"], m["n_holdout"], m["meta_auc"] > ABOVE, m["meta_auc"] > m["mean_auc"] - 0.05))
    return spark.createDataFrame(rows, "form string, n_models int, n_train long, n_holdout long, separates boolean, near_the_mean boolean")


@register("s12_bundle_roundtrip", ids=("S12", "X2"), sql=lambda: _z_sql() + """
SELECT count(*) AS n_rows, 0.0::DOUBLE AS max_abs_diff, 'mean' AS aggregation FROM z""")
def s12_bundle_roundtrip(spark, d):
    """Fitted models saved as a bundle (JSON states + pyspark.ml writer), loaded back
    and re-scored: the difference to the in-memory scores must be zero."""
    z = planted_frame(spark, d)
    train = z.filter(F.col("split") == "train")
    nb = M.GaussianNB(X).fit(train)
    lda = M.LDA(X).fit(train)
    path = scratch_path(spark, "bundle")
    sinks.save_bundle(spark, path, [{"kind": "naive_bayes", "features": X, "state": nb.state},
                                    {"kind": "lda", "features": X, "state": lda.state}],
                      {"roles": {"numeric": X}, "aggregation": "mean"})
    entries, meta = sinks.load_bundle(spark, path)
    nb2 = M.GaussianNB(entries[0]["features"])
    nb2.state = {int(k): v for k, v in entries[0]["state"].items()}
    lda2 = M.LDA(entries[1]["features"])
    lda2.state = entries[1]["state"]
    a = z.withColumn("p1", nb.decision()).withColumn("p2", lda.decision())
    b = a.withColumn("q1", nb2.decision()).withColumn("q2", lda2.decision())
    return b.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.max(F.abs(F.col("p1") - F.col("q1")) + F.abs(F.col("p2") - F.col("q2"))).alias("max_abs_diff"),
                 F.lit(meta["aggregation"]).alias("aggregation"))


_SAVED = [draw_spec(XW, 5, it, ["naive_bayes", "lda", "qda", "extra_trees"]) for it in range(1, 4)]


@register("s12_saved_pipelines", ids=("S12", "X2", "FE38"), sql=lambda: _z_sql() + """
SELECT t.*, (SELECT count(*) FROM z WHERE split <> 'train') AS n_scored, 0.0::DOUBLE AS max_abs_diff FROM (VALUES """ + ", ".join(
    f"({s.iteration}, '{s.model}')" for s in _SAVED) + ") t(iteration, classifier_type)")
def s12_saved_pipelines(spark, d):
    """Three hash-drawn pipelines saved whole, loaded and applied: the same probabilities."""
    z = wide_frame(spark, d)
    train, rest = z.filter(F.col("split") == "train"), z.filter(F.col("split") != "train")
    rows = None
    for spec in _SAVED:
        ops, _, model = fit_pipeline(spec, train)
        path = scratch_path(spark, "pipeline")
        save_fitted(spark, path, {"ops": ops, "model": model})
        back = load_fitted(spark, path)
        a = apply_pipeline(ops, model, rest).select("row_id", "p")
        b = apply_pipeline(back["ops"], back["model"], rest).select("row_id", F.col("p").alias("q"))
        far = a.join(b, "row_id").agg(F.count(F.lit(1)).alias("n_scored"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_abs_diff"))
        far = far.select(F.lit(spec.iteration).alias("iteration"), F.lit(spec.model).alias("classifier_type"), "n_scored", "max_abs_diff")
        rows = far if rows is None else rows.unionByName(far)
    return rows


@register("s1_s2_s3_prediction_files", ids=("S1", "S2", "S3"), sql=lambda: with_views("preds") + """
SELECT row_id AS id, round(avg(p), 6) AS probability, CAST(avg(p) >= 0.5 AS INTEGER) AS label FROM preds GROUP BY row_id""")
def s1_s2_s3_prediction_files(spark, d):
    """S2/S3 write the ensemble mean of all models as (id, probability) and (id, label) CSV files
    without an index; S1 reads them back with a declared schema and header."""
    p = aggregate_rows(V.preds(spark, d), "mean").withColumnRenamed("p_ens", "p")
    pp, pl = scratch_path(spark, "pred-csv"), scratch_path(spark, "label-csv")
    sinks.write_predictions(p, pp)
    sinks.write_hard_labels(p, pl)
    a = read_csv(spark, pp, "id BIGINT, probability DOUBLE")
    b = read_csv(spark, pl, "id BIGINT, label INT")
    return a.join(b, "id").select("id", r6("probability").alias("probability"), "label")


@register("s5_epoch_log", ids=("S5",), sql=lambda: with_views("epochs") + """
SELECT CAST(ensemble_id AS VARCHAR) AS ensemble_id, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss,
  round(train_auc, 6) AS train_auc, round(val_auc, 6) AS val_auc, true AS has_time FROM epochs""")
def s5_epoch_log(spark, d):
    """Epoch records appended in two writes (odd and even epochs) and read back."""
    from ..operators.logs import epochs

    e = epochs(V.runlog(spark, d, with_num_models=False)).withColumn("timestamp", F.current_timestamp())
    path = scratch_path(spark, "epoch-log")
    for odd in (1, 0):
        sinks.append_epochs(e.where(F.col("epoch") % 2 == odd), path)
    return sinks.read_epochs(spark, path).select("ensemble_id", "epoch", *[r6(c).alias(c) for c in ("train_loss", "val_loss", "train_auc", "val_auc")],
                                                 F.col("timestamp").isNotNull().alias("has_time"))


@register("s11_epoch_json_lines", ids=("S11", "S5", "F7"), sql=lambda: with_views("epochs") + """
SELECT ensemble_id, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss FROM epochs""")
def s11_epoch_json_lines(spark, d):
    from ..operators.logs import epochs

    e = epochs(V.runlog(spark, d, with_num_models=False))
    path = scratch_path(spark, "epochs-json")
    sinks.append_json_lines(e, path)
    back = spark.read.schema("ensemble_id BIGINT, epoch BIGINT, train_loss DOUBLE, val_loss DOUBLE, train_auc DOUBLE, "
                             "val_auc DOUBLE").json(path)
    return back.select("ensemble_id", "epoch", r6("train_loss").alias("train_loss"), r6("val_loss").alias("val_loss"))


_CHAINS = [draw_spec(XW, 7, it) for it in range(1, 5)]


def _chain(spec) -> str:
    steps = [f"subset{len(spec.columns)}", "constant_remover", spec.scaler]
    for name, _ in spec.feature_ops:
        steps += (["clean"] if name in NEEDS_CLEAN else []) + [name]
    return " > ".join([*steps, "nan_inf_cleaner", *([spec.reduction[0]] if spec.reduction else []), "scaler", spec.model])


@register("fe38_random_pipelines", ids=("FE38", "P9", "FE7", "FE1", "FE30", "X1", "X2"), sql=lambda: _z_sql() + """
SELECT t.*, (SELECT count(*) FROM z WHERE split <> 'train') AS n_scored, true AS all_probabilities FROM (VALUES """ + ", ".join(
    f"({s.iteration}, '{_chain(s)}', '{s.hash()}')" for s in _CHAINS) + ") t(iteration, chain, pipeline_hash)")
def fe38_random_pipelines(spark, d):
    """FE38: four hash-drawn pipelines in the reference's stage order over the whole operator
    registry, fitted on the train split and scored on the rest; one row per pipeline."""
    z = wide_frame(spark, d)
    train, rest = z.filter(F.col("split") == "train"), z.filter(F.col("split") != "train")
    rows = None
    for spec in _CHAINS:
        ops, _, model = fit_pipeline(spec, train)
        a = apply_pipeline(ops, model, rest).agg(F.count(F.lit(1)).alias("n_scored"), F.count_if((F.col("p") >= 0) & (F.col("p") <= 1)).alias("good"))
        a = a.select(F.lit(spec.iteration).alias("iteration"), F.lit(spec.describe()).alias("chain"), F.lit(spec.hash()).alias("pipeline_hash"),
                     "n_scored", (F.col("good") == F.col("n_scored")).alias("all_probabilities"))
        rows = a if rows is None else rows.unionByName(a)
    return rows


@register("x5_training_history", ids=("X5", "MT13"), sql=lambda: with_views("runlog") + """
SELECT 'objective' AS source, true AS has_steps, true AS never_rises, NULL::BIGINT AS n_rows
UNION ALL SELECT 'stream_rows', true, NULL, (SELECT count(*) FROM runlog)""")
def x5_training_history(spark, d):
    """The per-iteration objective of a pyspark.ml fit, and the input rows that the
    micro-batches of a replayed log report (read from the query's own progress)."""
    from ..streaming.log_stream import dedup_stream, run_with_progress
    from .q_streaming import _replay_runlog

    z = planted_frame(spark, d)
    train = z.filter(F.col("split") == "train")
    model = M.ml_estimator("logistic", {"C": 1.0}, n_rows=train.count()).setMaxIter(15).fit(M.assemble(train, X))
    hist = model.summary.objectiveHistory
    _, progress = run_with_progress(spark, _replay_runlog(spark, d), dedup_stream, "x5")
    rows = [("objective", len(hist) > 1, all(b <= a + 1e-9 for a, b in zip(hist, hist[1:])), None),
            ("stream_rows", len(progress) > 0, None, sum(n for _, n in progress))]
    return spark.createDataFrame(rows, "source string, has_steps boolean, never_rises boolean, n_rows long")
