"""Structured Streaming twins of the log operators (ST1-ST7).

The live training log is an append-only folder of Parquet files. Each operator here is a
``readStream`` over that folder with a watermark on the event time, and every sink is a
``foreachBatch`` writer that stores batch ``b`` under ``<out>/batch=<b>`` with overwrite,
so a replayed micro-batch (after an executor or driver failure) rewrites the same folder:
the sink is idempotent and the checkpoint makes the stream exactly-once end to end.

``replay`` delivers a log in slices of event time: a slice is written by as many tasks as it has
partitions, then the stream runs over everything available (``trigger(availableNow=True)``, one
checkpoint for all slices). It returns the sink as a batch DataFrame; that is how the registered
queries compare each streaming operator with its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.anneal import anneal_fold
from ..session import scratch_path

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def as_instant(df: DataFrame, c: str):
    """Event time as a TIMESTAMP instant (watermarks need one) that reads the stored
    wall-clock value as UTC, independent of the session time zone."""
    if df.schema[c].dataType.simpleString() == "timestamp_ntz":
        return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, `{c}`)"))
    return F.col(c)


def utc_wallclock(c: str):
    """An instant back to its UTC wall clock as TIMESTAMP_NTZ (session-zone independent)."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), {EPOCH_NTZ})")


def utc_text(c: str, fmt: str = "yyyy-MM-dd HH:mm:ss.SSSSSS"):
    """Format an instant as its UTC wall clock, independent of the session time zone."""
    return F.date_format(utc_wallclock(c), fmt)


def time_slices(df: DataFrame, ts: str, n: int = 4) -> list[DataFrame]:
    """A log frame in ``n`` slices of event time, oldest first; ``ts`` becomes a TIMESTAMP
    (watermarks need it). Bounds come from approximate quantiles: no global sort."""
    d = df.withColumn(ts, as_instant(df, ts))
    us = F.unix_micros(F.col(ts))
    cuts = d.select(us.alias("us")).approxQuantile("us", [i / n for i in range(1, n)], 0.001) if n > 1 else []
    bounds = [None, *sorted(set(cuts)), None]
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = d
        if lo is not None:
            part = part.filter(us >= F.lit(lo))
        if hi is not None:
            part = part.filter(us < F.lit(hi))
        out.append(part)
    return out


def heartbeats(df: DataFrame, ts: str, key: str, sentinel=-1) -> list[DataFrame]:
    """End-of-replay markers for append-mode windowed / session aggregations: two slices of one row
    (key = ``sentinel``) one and two days after the last event advance the watermark past every
    open window, so the final windows are emitted; callers drop the sentinel."""
    last_us = df.agg(F.max(F.unix_micros(as_instant(df, ts))).alias("_m")).first()["_m"]
    base = df.limit(1).withColumn(key, F.lit(sentinel).cast(df.schema[key].dataType))
    return [base.withColumn(ts, F.timestamp_micros(F.lit(last_us + days * 86_400_000_000))) for days in (1, 2)]


def run_with_progress(spark: SparkSession, slices: list[DataFrame], make: Callable[[DataFrame], DataFrame], name: str,
                      mode: str = "append", state_partitions: int | None = None, sink: Callable | None = None
                      ) -> tuple[DataFrame | None, list[tuple[int, int]]]:
    """Deliver ``slices`` one after the other to the stream ``make(source)``; returns its sink as a
    batch frame and (batch, input rows) of every micro-batch as the query reports them.

    The stream runs in a session of its own, whose shuffle setting is the number of state-store
    partitions: that number is recorded in the checkpoint at the first start and can't change
    later, so it is chosen (``state_partitions``, default: the cluster's parallelism) instead of
    being whatever the caller's session has. ``sink(batch, batch_id, out)`` replaces the writer."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    source, out, ckpt = (scratch_path(spark, f"{name}-{what}") for what in ("in", "out", "ckpt"))

    def write(batch: DataFrame, batch_id: int) -> None:
        if sink is not None:
            sink(batch, batch_id, out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    schema, progress = None, {}
    for part in slices:
        part.write.mode("append").parquet(source)
        schema = schema or part.schema
        stream = make(own.readStream.schema(schema).parquet(source))
        q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        progress.update({p["batchId"]: p["numInputRows"] for p in q.recentProgress if p["numInputRows"]})
    return read_sink(spark, out), sorted(progress.items())


def replay(spark: SparkSession, slices: list[DataFrame], make: Callable[[DataFrame], DataFrame], name: str, mode: str = "append",
           state_partitions: int | None = None, sink: Callable | None = None) -> DataFrame | None:
    return run_with_progress(spark, slices, make, name, mode, state_partitions, sink)[0]


def read_sink(spark: SparkSession, out: str) -> DataFrame | None:
    """The sink as a batch frame; None if no batch produced any row."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Final value per key of an update-mode sink: the row of the newest batch."""
    cols = [c for c in df.columns if c not in keys + ["batch"]]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in cols])


# ---------------------------------------------------------------- ST1
def dedup_stream(s: DataFrame, ts: str = "timestamp", key: str = "iteration_num", delay: str = "1 hour") -> DataFrame:
    """At-least-once ingestion made exactly-once: duplicates within the watermark are
    dropped (state expires with the watermark); rows older than the watermark are late
    and dropped."""
    return s.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# ---------------------------------------------------------------- ST2 / ST3
def windowed_rates(s: DataFrame, ts: str = "timestamp", width: str = "1 day", delay: str = "1 hour",
                   slide: str | None = None) -> DataFrame:
    """Acceptance and timeout counts per window and class, tumbling or sliding (update mode)."""
    return (s.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), "classifier_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("accepted").alias("accepted"), F.sum("timeout").alias("timeouts")))


def models_per_hour(s: DataFrame, ts: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    return (s.withWatermark(ts, delay).filter(F.col("timeout") == 0).groupBy(F.window(ts, "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("models")))


# ---------------------------------------------------------------- ST6
def sessions(s: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Batch boundaries by inactivity: a session closes after ``gap`` without events."""
    return (s.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events")))


# ---------------------------------------------------------------- ST4 worker state
def worker_state_stream(s: DataFrame) -> DataFrame:
    """Upsert semantics of the worker table as a streaming aggregation (update mode), each field
    by its own sequence: newest status; newest NON-NULL classifier, end time, runtime and hash;
    the first start_time. A late event changes exactly the fields that it is the newest for."""
    seq = F.col("event_id")
    newest = lambda c, v: F.max_by(v, F.when(v.isNotNull(), seq)).alias(c)
    return s.groupBy("worker_id").agg(
        F.max_by("status", seq).alias("status"), newest("classifier_type", F.col("classifier_type")),
        F.min_by(utc_text("start_time"), seq).alias("start_time"), newest("end_time", utc_text("end_time")),
        newest("runtime_sec", F.col("runtime_sec")), newest("pipeline_hash", F.col("pipeline_hash")), F.max(seq).alias("seq"))


# ---------------------------------------------------------------- ST5 annealing state per run
ANNEAL_STATE = ("run_id bigint, current_score double, best_score double, temperature double, plateau bigint, last_step bigint, "
                "ignored bigint")


def anneal_sink(state_path: str, seed: int = 42) -> Callable[[DataFrame, int, str], None]:
    """Streaming twin of W6 for ``replay``: every micro-batch goes through the chunked fold from
    the runs' states, so no run's steps meet in one task, and writes its decisions and the new
    states under its own number (a batch that is run again starts from the state before it).

    A run's state holds its current and best score, the temperature of its last step, the steps
    since the best and the last step. Decisions are final, so a step that arrives after a later
    one was decided is ignored and counted; a step without a score is rejected."""

    def sink(batch: DataFrame, batch_id: int, out: str) -> None:
        spark = batch.sparkSession
        before = (spark.read.schema(ANNEAL_STATE).parquet(f"{state_path}/batch={batch_id - 1}") if batch_id
                  else spark.createDataFrame([], ANNEAL_STATE))
        known = before.select("run_id", "last_step", "current_score")
        joined = batch.select("run_id", "iteration_num", "stage1_val_auc", "temperature").join(known, "run_id", "left")
        fresh = joined.filter(F.col("last_step").isNull() | (F.col("iteration_num") > F.col("last_step")))
        late = joined.filter(F.col("iteration_num") <= F.col("last_step")).groupBy("run_id").agg(F.count(F.lit(1)).alias("_late"))
        steps = fresh.select("run_id", "iteration_num", "stage1_val_auc", "temperature")
        start = before.select("run_id", F.col("current_score").alias("s0"))
        decided = anneal_fold(steps, seed=seed, start=start)
        decided.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        decided = spark.read.schema(decided.schema).parquet(f"{out}/batch={batch_id}")
        scored = decided.join(steps.select("run_id", "iteration_num", "temperature"), ["run_id", "iteration_num"])
        own = scored.groupBy("run_id").agg(
            F.max_by("current_score", "iteration_num").alias("_cur"), F.max_by("temperature", "iteration_num").alias("_t"),
            F.max("iteration_num").alias("_last"), F.count(F.lit(1)).alias("_n"), F.max("current_score").alias("_best"))
        # steps since the batch's best was first reached
        after = (scored.join(own.select("run_id", "_best"), "run_id").groupBy("run_id").agg(
            F.min(F.when(F.col("current_score") == F.col("_best"), F.col("iteration_num"))).alias("_at")))
        since = scored.join(after, "run_id").groupBy("run_id").agg(F.count_if(F.col("iteration_num") > F.col("_at")).alias("_since"))
        new = before.join(own.join(since, "run_id"), "run_id", "full_outer").join(late, "run_id", "left")
        higher = F.col("best_score").isNull() | (F.col("_best") > F.col("best_score"))
        new.select(
            "run_id", F.coalesce("_cur", "current_score").alias("current_score"),
            F.when(F.col("_n").isNull(), F.col("best_score")).otherwise(F.greatest("best_score", "_best")).alias("best_score"),
            F.coalesce("_t", "temperature").alias("temperature"),
            F.when(F.col("_n").isNull(), F.col("plateau")).when(higher, F.col("_since")).otherwise(F.col("plateau") + F.col("_n")).alias("plateau"),
            F.coalesce("_last", "last_step").alias("last_step"),
            (F.coalesce("ignored", F.lit(0)) + F.coalesce("_late", F.lit(0))).cast("bigint").alias("ignored"),
        ).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return sink
