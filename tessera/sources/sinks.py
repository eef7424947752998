"""Sinks (S2-S5, S11-S13): predictions, the append-only run log, epoch JSON lines, model
bundles and search-state checkpoints. Every writer targets a folder the caller names,
normally under the cluster's shared ``spark.checkpoint.dir``; nothing goes through the
driver except O(models) metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the iteration log.
LOG_SCHEMA = (
    "timestamp TIMESTAMP, iteration_num BIGINT, run_id STRING, ensemble_id STRING, stage1_val_auc DOUBLE, "
    "stage2_val_auc DOUBLE, diversity_score DOUBLE, temperature DOUBLE, accepted BOOLEAN, rejection_reason STRING, "
    "num_models BIGINT, classifier_type STRING, transformers_used ARRAY<STRING>, use_pca BOOLEAN, dim_reduction STRING, "
    "pca_components DOUBLE, pipeline_hash STRING, training_memory_mb DOUBLE, stage2_memory_mb DOUBLE, "
    "training_time_sec DOUBLE, single_auc DOUBLE, stage2_time_sec DOUBLE, timeout BOOLEAN, stage2_tp BIGINT, stage2_fp BIGINT, "
    "stage2_tn BIGINT, stage2_fn BIGINT"
)
LOG_DEFAULTS = {"rejection_reason": "", "stage2_val_auc": 0.0, "num_models": 0, "timeout": False, "use_pca": False}


def to_log_schema(df: DataFrame) -> DataFrame:
    """Project a frame onto the iteration-log schema; absent optional fields get their
    defaults ('' / 0 / false) or NULL."""
    fields = [f.strip().split(" ", 1) for f in LOG_SCHEMA.split(", ")]
    cols = []
    for name, typ in fields:
        if name in df.columns:
            c = F.col(name).cast(typ)
        elif name in LOG_DEFAULTS:
            c = F.lit(LOG_DEFAULTS[name]).cast(typ)
        else:
            c = F.lit(None).cast(typ)
        if name in LOG_DEFAULTS:
            c = F.coalesce(c, F.lit(LOG_DEFAULTS[name]).cast(typ))
        cols.append(c.alias(name))
    return df.select(*cols)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log reader tolerant to added columns (``ALTER TABLE ADD COLUMN`` equivalent); S4/S5: the
    log is partitioned by run and batch, and readers prune by run."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_predictions(df: DataFrame, path: str, key: str = "row_id", p: str = "p", fmt: str = "csv") -> None:
    """(id, probability) without an index column."""
    out = df.select(F.col(key).alias("id"), F.col(p).alias("probability"))
    (out.write.mode("overwrite").option("header", True).csv(path) if fmt == "csv" else out.write.mode("overwrite").parquet(path))


def write_hard_labels(df: DataFrame, path: str, key: str = "row_id", p: str = "p", threshold: float = 0.5) -> None:
    """S3: (id, label) with label = p >= threshold."""
    df.select(F.col(key).alias("id"), (F.col(p) >= threshold).cast("int").alias("label")) \
        .write.mode("overwrite").option("header", True).csv(path)


# The columns of the epoch log.
EPOCH_SCHEMA = ("timestamp TIMESTAMP, ensemble_id STRING, epoch BIGINT, train_loss DOUBLE, val_loss DOUBLE, "
                "train_auc DOUBLE, val_auc DOUBLE")


def append_epochs(df: DataFrame, path: str) -> None:
    """Epoch records appended in the columns of the epoch log. Every column is required: a
    frame without one fails here, and a null in one fails the write."""
    cols = []
    for name, typ in (f.split(" ") for f in EPOCH_SCHEMA.split(", ")):
        if name not in df.columns:
            raise ValueError(f"epoch records need {name}")
        value = F.col(name).cast(typ)
        cols.append(F.coalesce(value, F.raise_error(F.lit(f"epoch records need {name}")).cast(typ)).alias(name))
    df.select(*cols).write.mode("append").parquet(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EPOCH_SCHEMA).parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per epoch row, appended."""
    df.write.mode("append").json(path)


# ---------------------------------------------------------------- S12 bundles
def save_bundle(spark: SparkSession, path: str, models: list[dict], metadata: dict) -> None:
    """Models are small fitted states (dicts of numbers) plus their kind and feature
    roles; one JSON row per model and one metadata row. ``pyspark.ml`` models in the
    entries (key ``ml_model``) are saved with their own writer next to it."""
    rows = []
    for i, m in enumerate(models):
        ml = m.get("ml_model")
        ml_path = None
        if ml is not None:
            ml_path = f"{path}/ml/{i}"
            ml.write().overwrite().save(ml_path)
        rows.append((i, m["kind"], json.dumps(m.get("features", [])), json.dumps(m.get("state", {})), ml_path))
    spark.createDataFrame(rows, "model_id int, kind string, features string, state string, ml_path string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/models")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> tuple[list[dict], dict]:
    rows = spark.read.schema("model_id int, kind string, features string, state string, ml_path string") \
        .json(f"{path}/models").orderBy("model_id").collect()
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
    return [{"kind": r["kind"], "features": json.loads(r["features"]), "state": json.loads(r["state"]),
             "ml_path": r["ml_path"]} for r in rows], meta


# ---------------------------------------------------------------- S13 search-state checkpoints
STATE_SCHEMA = ("run_id STRING, batch BIGINT, temperature DOUBLE, current_score DOUBLE, best_score DOUBLE, plateau INT, "
                "accepted ARRAY<STRUCT<batch: BIGINT, iteration: BIGINT>>")


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """The state row of one batch, in a folder of its own with overwrite (a batch that is
    run again replaces its row). All batches' rows together are the search history."""
    row = (state["run_id"], state["batch"], state["temperature"], state["current_score"], state["best_score"],
           state["plateau"], [tuple(a) for a in state["accepted"]])
    spark.createDataFrame([row], STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{state['run_id']}/{state['batch']}")


def read_history(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """Every batch's state row of a run; None if the run has none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(STATE_SCHEMA).option("recursiveFileLookup", True).parquet(f"{path}/{run_id}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_state(spark: SparkSession, path: str, run_id: str) -> dict | None:
    """The newest state row of a run: where a restarted search goes on."""
    rows = read_history(spark, path, run_id)
    r = rows.orderBy(F.desc("batch")).first() if rows is not None else None
    if r is None:
        return None
    return {**r.asDict(), "accepted": [(a["batch"], a["iteration"]) for a in r["accepted"]]}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a sink where it is there, through Spark's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
