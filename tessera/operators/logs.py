"""Run-log analytics (S6-S10, A1-A3, W1-W5): batch views over the append-only log.

Group-by operators rely on partial (map-side) aggregation, so a hot run or worker only
costs one partial row per map task. Ordered logic per run goes through the chunked
scans in ``scan`` so no run is ever sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import id_chunk, prefix_sums, rolling_rows


def _seq(ts: str = "ts", tie: str = "event_id") -> Column:
    return F.struct(F.col(ts), F.col(tie))


def last_non_null(c: str, seq: Column) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq))


def worker_state(events: DataFrame, key: str = "worker_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """S6 upsert semantics as an aggregation over status events: status and counters take
    the newest value; classifier, end time, runtime and hash keep the newest NON-NULL value;
    start_time is the first one (never changes on update)."""
    seq = _seq(ts, tie)
    return events.groupBy(key).agg(
        F.max_by("status", seq).alias("status"),
        F.max_by("iteration_num", seq).alias("iteration_num"),
        F.max_by("batch_num", seq).alias("batch_num"),
        last_non_null("classifier_type", seq).alias("classifier_type"),
        F.min_by("start_time", seq).alias("start_time"),
        last_non_null("end_time", seq).alias("end_time"),
        last_non_null("runtime_sec", seq).alias("runtime_sec"),
        last_non_null("pipeline_hash", seq).alias("pipeline_hash"),
        F.max(ts).alias("last_update"),
    )


def worker_summary(state: DataFrame) -> DataFrame:
    """A1: total / running / completed / timeout / error, avg and max runtime of completed,
    max batch; NULL -> 0."""
    done = F.col("status") == "completed"
    return state.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.avg(F.when(done, F.col("runtime_sec"))), F.lit(0.0)).alias("avg_runtime"),
        F.coalesce(F.max(F.when(done, F.col("runtime_sec"))), F.lit(0.0)).alias("max_runtime"),
        F.coalesce(F.max("batch_num"), F.lit(0)).alias("max_batch"),
    )


def run_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A2 per run: totals, accepted, rejected, ensemble size at the last accepted row, best
    AUC, last temperature, last time, aggregation name, models per hour (non-timeout rows /
    hours between first and last row, 0 when not positive). ``by=[]`` sums up the whole log in one
    row: zeros, no last time and the aggregation 'N/A' where the log is empty."""
    by = ["run_id"] if by is None else list(by)
    acc = F.col("accepted") == 1
    it = F.col("iteration_num")
    # timestampdiff on the stored wall-clock values: independent of the session time zone
    hours = F.expr("timestampdiff(MICROSECOND, min(timestamp), max(timestamp))") / F.lit(3.6e9)
    size = F.coalesce(F.max_by(F.col("num_models"), F.when(acc, it)), F.lit(0))
    whole = (lambda c: c) if by else (lambda c: F.coalesce(c, F.lit(0.0)))
    out = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(acc).alias("accepted"),
        F.count_if(~acc).alias("rejected"),
        size.alias("ensemble_size"),
        whole(F.max(F.when(acc, F.col("stage1_val_auc")))).alias("best_auc"),
        whole(F.max_by("temperature", it)).alias("last_temperature"),
        F.max("timestamp").alias("last_time"),
        F.count_if(F.col("timeout") == 0).alias("_nt"),
        hours.alias("_hours"),
    )
    name = F.when(F.col("total") == 0, "N/A").when(F.col("ensemble_size") < 10, "Simple Mean").otherwise("DNN Weighted")
    return (out.withColumn("aggregation", name)
            .withColumn("models_per_hour", F.when(F.col("_hours") > 0, F.col("_nt") / F.col("_hours")).otherwise(F.lit(0.0)))
            .drop("_nt", "_hours"))


def batch_summary(jobs: DataFrame, cores: Column, by: list[str] | None = None) -> DataFrame:
    """Jobs, cores in total and on average, and ``class:count`` pairs by name, per ``by`` or (none
    given) over all jobs in one row: zeros and no pairs where there are none. Jobs are counted per
    class first, so a group is gathered as a row per class."""
    by = list(by or [])
    k = jobs.groupBy(*by, "classifier_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cores).alias("c"))
    g = k.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("jobs"), F.coalesce(F.sum("c"), F.lit(0)).alias("cores_total"),
                           F.array_sort(F.collect_list(F.struct("classifier_type", "n"))).alias("pairs"))
    named = F.transform("pairs", lambda s: F.concat(s["classifier_type"], F.lit(":"), s["n"].cast("string")))
    return g.select(*by, "jobs", "cores_total", F.coalesce(F.try_divide("cores_total", "jobs"), F.lit(0.0)).alias("cores_avg"),
                    F.array_join(named, ",").alias("per_class"))


def batch_status(events: DataFrame) -> DataFrame:
    """The newest state of every worker, ordered by worker (a row per worker)."""
    return worker_state(events).orderBy("worker_id")


def rolling_auc(log: DataFrame, k: int = 10) -> DataFrame:
    """Over accepted rows per run, rolling mean and SAMPLE std of the last k rows
    (min_periods=1, std null on a first row) and the mean +/- std band; plus W2 ensemble
    size (row index among accepted rows)."""
    acc = log.filter(F.col("accepted") == 1)
    r = rolling_rows(acc, ["run_id"], "iteration_num", k, {
        "roll_mean": lambda w: F.avg("stage1_val_auc").over(w),
        "roll_std": lambda w: F.stddev_samp("stage1_val_auc").over(w),
    })
    return (r.withColumnRenamed("_idx", "ensemble_size")
            .withColumn("band_lo", F.col("roll_mean") - F.col("roll_std"))
            .withColumn("band_hi", F.col("roll_mean") + F.col("roll_std")))


def plateau(log: DataFrame, value: str = "stage1_val_auc", limit: int = 20) -> DataFrame:
    """Running best per run; a row is a new best when strictly above every earlier
    row; the plateau counter resets to 0 on a new best and grows by 1 otherwise; ``stop``
    marks rows where the counter reached ``limit``."""
    ch = id_chunk("iteration_num")
    a = prefix_sums(log, ["run_id"], ["iteration_num"], ch, {"_before": F.lit(1)},
                    maxes={"_best_before": F.col(value)}, exclusive=True)
    a = (a.withColumn("_idx", F.col("_before") + 1)
         .withColumn("new_best", F.col("_best_before").isNull() | (F.col(value) > F.col("_best_before"))))
    # second pass: index of the latest new-best row at or before each row
    c = prefix_sums(a, ["run_id"], ["iteration_num"], ch, {}, maxes={"_lb": F.when(F.col("new_best"), F.col("_idx"))})
    return (c.withColumn("running_best", F.greatest(F.col("_best_before"), F.col(value)))
            .withColumn("plateau", F.col("_idx") - F.col("_lb"))
            .withColumn("stop", F.col("plateau") >= F.lit(limit))
            .drop("_best_before", "_before", "_lb"))


def temperature_path(log: DataFrame, base: float = 0.01, decay: float = 0.995, k: int = 20,
                     low_rate: float = 0.1, boost: float = 1.2, batch: str | None = None,
                     batch_decay: float = 0.998) -> DataFrame:
    """W5, three rules. Closed form: base * decay^i (i = 0-based row index in the run). Adaptive:
    once a run has ``k`` decisions, a row whose last-k acceptance rate is below ``low_rate``
    multiplies the CURRENT temperature by ``boost``, so consecutive low rows compound; any
    other row returns to the closed form. In closed form again: the value at the latest row that
    wasn't low, times boost^(rows since). Per batch (with ``batch``): base * batch_decay^batch."""
    r = rolling_rows(log, ["run_id"], "iteration_num", k, {
        "accept_rate": lambda w: F.avg(F.col("accepted").cast("double")).over(w)})
    low = (F.col("_idx") >= F.lit(k)) & (F.col("accept_rate") < F.lit(low_rate))
    r = prefix_sums(r, ["run_id"], ["iteration_num"], id_chunk("iteration_num"), {},
                    maxes={"_calm": F.when(~low, F.col("_idx"))})
    closed = lambda i: F.lit(base) * F.pow(F.lit(decay), (i - 1).cast("double"))
    out = (r.withColumn("temperature_closed", closed(F.col("_idx")))
           .withColumn("adaptive", closed(F.col("_calm")) * F.pow(F.lit(boost), (F.col("_idx") - F.col("_calm")).cast("double"))))
    if batch:
        out = out.withColumn("temperature_batch", F.lit(base) * F.pow(F.lit(batch_decay), F.col(batch).cast("double")))
    return out.drop("_calm").withColumnRenamed("_idx", "step")


def epochs(log: DataFrame) -> DataFrame:
    """Epoch log (A11 shape) derived from the run log: one epoch per 'view' row."""
    v = log.filter(F.col("classifier_type") == "view")
    return v.select(F.col("run_id").alias("ensemble_id"), F.col("iteration_num").alias("epoch"),
                    (F.col("training_time_sec") / 1000.0).alias("train_loss"),
                    (F.col("training_time_sec") / 900.0 + 0.01).alias("val_loss"),
                    (F.lit(1.0) - F.col("training_time_sec") / 1000.0).alias("train_auc"),
                    (F.lit(0.98) - F.col("training_time_sec") / 1100.0).alias("val_auc"))
