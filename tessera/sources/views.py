"""Derived views over the driver tables (FIXTURES part B), each with a DuckDB twin.

Every view is a lazy DataFrame: Catalyst prunes unused columns down to the parquet scan
and pushes filters through it. The ``*_SQL`` strings are the same definitions for the
oracle; they are used as CTEs in ``oracle_sql()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, sql_uniform
from ..functions.scalar import sigmoid
from ..operators.scan import id_chunk, prefix_sums
from .tables import read_table

SEED = 42

# ---------------------------------------------------------------- B1 base
BASE_SQL = """SELECT o.o_orderkey AS row_id, o.o_totalprice, c.c_acctbal,
  CAST(datediff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) AS DOUBLE) AS days,
  CAST(month(o.o_orderdate) AS DOUBLE) AS month, o.o_orderpriority, c.c_mktsegment, c.c_nationkey,
  CAST(o.o_orderstatus = 'F' AS INTEGER) AS label
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

# Role spec of B1 (ordinal levels in their business order).
BASE_ROLES = {
    "numeric": ["o_totalprice", "c_acctbal", "days", "month"],
    "ordinal": {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]},
    "nominal": ["c_mktsegment", "c_nationkey"],
}


def base(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    c = read_table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("c_acctbal").cast("double").alias("c_acctbal"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("days"),
        F.month("o_orderdate").cast("double").alias("month"),
        "o_orderpriority", "c_mktsegment", "c_nationkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


# ---------------------------------------------------------------- B2 base_agg
LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BASE_AGG_SQL = f"""SELECT b.*, {', '.join(f"coalesce(a.sum_{c}, 0.0) AS sum_{c}, coalesce(a.avg_{c}, 0.0) AS avg_{c}, coalesce(a.max_{c}, 0.0) AS max_{c}" for c in LINE_COLS)}
FROM ({BASE_SQL}) b LEFT JOIN (SELECT l_orderkey, {', '.join(f"sum({c}) AS sum_{c}, avg({c}) AS avg_{c}, max({c}) AS max_{c}" for c in LINE_COLS)}
  FROM lineitem GROUP BY l_orderkey) a ON b.row_id = a.l_orderkey"""


def base_agg(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    aggs = []
    for c in LINE_COLS:
        aggs += [F.sum(c).alias(f"sum_{c}"), F.avg(c).alias(f"avg_{c}"), F.max(c).alias(f"max_{c}")]
    # Partial aggregation before the shuffle: one row per order leaves each map task.
    a = li.groupBy("l_orderkey").agg(*aggs)
    b = base(spark, d)
    j = b.join(a, b.row_id == a.l_orderkey, "left").drop("l_orderkey")
    for c in LINE_COLS:
        for k in ("sum", "avg", "max"):
            j = j.withColumn(f"{k}_{c}", F.coalesce(F.col(f"{k}_{c}"), F.lit(0.0)))
    return j


# ---------------------------------------------------------------- B3 dirty
DIRTY_SQL = f"""SELECT row_id,
  CASE WHEN row_id % 17 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS o_totalprice,
  CASE WHEN row_id % 19 = 0 THEN 'inf'::DOUBLE ELSE c_acctbal END AS c_acctbal,
  CASE WHEN row_id % 23 = 0 THEN '-inf'::DOUBLE ELSE days END AS days,
  CASE WHEN row_id % 29 = 0 THEN NULL ELSE month END AS month,
  1.0::DOUBLE AS const_col, CAST(NULL AS DOUBLE) AS null_col,
  o_orderpriority, c_mktsegment, c_nationkey, label
FROM ({BASE_SQL}) b"""

DIRTY_NUMERIC = ["o_totalprice", "c_acctbal", "days", "month", "const_col", "null_col"]


def dirty(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    k = F.col("row_id")
    return b.select(
        "row_id",
        F.when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 19 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 23 == 0, F.lit(float("-inf"))).otherwise(F.col("days")).alias("days"),
        F.when(k % 29 == 0, F.lit(None).cast("double")).otherwise(F.col("month")).alias("month"),
        F.lit(1.0).alias("const_col"), F.lit(None).cast("double").alias("null_col"),
        "o_orderpriority", "c_mktsegment", "c_nationkey", "label",
    )


# ---------------------------------------------------------------- B4 preds (long table)
N_MODELS = 64
PREDS_SQL = """SELECT e.vec_id AS row_id, CAST(m.model_id AS INTEGER) AS model_id,
  CAST(e.embedding[m.model_id + 1] AS DOUBLE) AS score,
  1.0 / (1.0 + exp(-8.0 * CAST(e.embedding[m.model_id + 1] AS DOUBLE))) AS p,
  CAST(e.label = 0 AS INTEGER) AS label
FROM embeddings e CROSS JOIN range(0, 64) m(model_id)"""


def preds(spark: SparkSession, d: str) -> DataFrame:
    """Long prediction table (row_id, model_id, score, p, label): one row per row x model."""
    e = read_table(spark, d, "embeddings")
    x = e.select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("label"),
                 F.posexplode("embedding").alias("model_id", "score"))
    return x.select("row_id", F.col("model_id").cast("int").alias("model_id"),
                    F.col("score").cast("double").alias("score"),
                    sigmoid(F.lit(8.0) * F.col("score").cast("double")).alias("p"), "label")


# ---------------------------------------------------------------- B5 runlog
RUNLOG_SQL = """SELECT event_id AS iteration_num, user_id AS run_id, ts AS timestamp, event_type AS classifier_type,
  0.5 + value / 1000.0 AS stage1_val_auc, CAST(event_type = 'error' AS INTEGER) AS timeout,
  CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS accepted, value AS training_time_sec,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS batch_num,
  0.01 * pow(0.999, event_id / 100.0) AS temperature,
  CAST(sum(CAST(event_type IN ('purchase', 'signup') AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS num_models
FROM events"""


def runlog(spark: SparkSession, d: str, with_num_models: bool = True) -> DataFrame:
    ev = read_table(spark, d, "events")
    r = ev.select(
        F.col("event_id").alias("iteration_num"), F.col("user_id").alias("run_id"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("classifier_type"),
        (F.lit(0.5) + F.col("value") / F.lit(1000.0)).alias("stage1_val_auc"),
        (F.col("event_type") == "error").cast("int").alias("timeout"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("accepted"),
        F.col("value").alias("training_time_sec"),
        F.get_json_object("props", "$.k").cast("int").alias("batch_num"),
        (F.lit(0.01) * F.pow(F.lit(0.999), F.col("event_id") / F.lit(100.0))).alias("temperature"),
    )
    if not with_num_models:
        return r
    # Running count of accepted models per run: chunked prefix sum, never one task per run.
    return prefix_sums(r, ["run_id"], ["iteration_num"], id_chunk("iteration_num"),
                       {"num_models": F.col("accepted").cast("bigint")})


# ---------------------------------------------------------------- B6 workers (status events)
WORKERS_SQL = """SELECT user_id % 16 AS worker_id, event_id AS iteration_num, ts, event_id,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS batch_num,
  CASE WHEN event_type = 'view' THEN 'running' WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status,
  CASE WHEN event_type <> 'view' THEN event_type END AS classifier_type,
  ts AS start_time,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN ts END AS end_time,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN value END AS runtime_sec,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 16) END AS pipeline_hash
FROM events"""


def workers(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events")
    done = F.col("event_type").isin("click", "purchase", "signup")
    return ev.select(
        (F.col("user_id") % 16).alias("worker_id"), F.col("event_id").alias("iteration_num"), "ts", "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("batch_num"),
        F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "error")
        .otherwise("completed").alias("status"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("classifier_type"),
        F.col("ts").alias("start_time"),
        F.when(done, F.col("ts")).alias("end_time"),
        F.when(done, F.col("value")).alias("runtime_sec"),
        F.when(done, F.substring(F.md5(F.col("event_id").cast("string")), 1, 16)).alias("pipeline_hash"),
    )


# ---------------------------------------------------------------- B7 lists
LISTS_SQL = """SELECT p_partkey AS iteration_num, array_to_string(string_split(p_name, ' '), ',') AS transformers_used,
  p_type AS classifier_type FROM part"""


def lists(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("iteration_num"),
                    F.array_join(F.split("p_name", " "), ",").alias("transformers_used"),
                    F.col("p_type").alias("classifier_type"))


# ---------------------------------------------------------------- B8 semi
LANG_COEF = {"en": 0.5, "de": -0.25, "fr": 0.25}
SEMI_SQL = """SELECT d.doc_id AS row_id, d.lang, CAST(d.n_chars AS DOUBLE) AS n_chars, l.quality AS label,
  1.0 / (1.0 + exp(-(-3.0 + 0.45 * ln(1.0 + d.n_chars)
     + CASE d.lang WHEN 'en' THEN 0.5 WHEN 'de' THEN -0.25 WHEN 'fr' THEN 0.25 ELSE 0.0 END))) AS p
FROM documents d LEFT JOIN labels l USING (doc_id)"""


def semi(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    lab = read_table(spark, d, "labels")
    coef = F.lit(0.0)
    for lang, v in reversed(list(LANG_COEF.items())):
        coef = F.when(F.col("lang") == lang, F.lit(v)).otherwise(coef)
    z = F.lit(-3.0) + F.lit(0.45) * F.log(F.lit(1.0) + F.col("n_chars")) + coef
    j = docs.select("doc_id", "lang", "n_chars").join(lab.select("doc_id", "quality"), "doc_id", "left")
    return j.select(F.col("doc_id").alias("row_id"), "lang", F.col("n_chars").cast("double").alias("n_chars"),
                    F.col("quality").alias("label"), sigmoid(z).alias("p"))


# ---------------------------------------------------------------- B9 sizes
SIZES_SQL = """SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS sample_size, CAST(1 + l_suppkey % 32 AS DOUBLE) AS n_iter,
  sum(l_quantity) AS runtime_seconds, sum(l_extendedprice) / 1000.0 AS peak_memory_mb
FROM lineitem GROUP BY l_suppkey"""


def sizes(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).cast("double").alias("sample_size"),
        F.sum("l_quantity").alias("runtime_seconds"),
        (F.sum("l_extendedprice") / F.lit(1000.0)).alias("peak_memory_mb"),
    ).withColumn("n_iter", (F.lit(1) + F.col("l_suppkey") % 32).cast("double"))


# ---------------------------------------------------------------- B10 dups
DUPS_SQL = "SELECT text, lang FROM documents"


def dups(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("text", "lang")


# ---------------------------------------------------------------- B11 planted
def planted_sql(seed: int = SEED) -> str:
    return f"""SELECT b.*, CAST({sql_uniform(seed, 'planted', 'b.row_id')} < 1.0 / (1.0 + exp(-(
   1.5 * (b.o_totalprice - s.mp) / s.sp - (b.c_acctbal - s.ma) / s.sa))) AS INTEGER) AS y
FROM ({BASE_SQL}) b CROSS JOIN (SELECT avg(o_totalprice) mp, stddev_pop(o_totalprice) sp,
  avg(c_acctbal) ma, stddev_pop(c_acctbal) sa FROM ({BASE_SQL}) q) s"""


def planted(spark: SparkSession, d: str, seed: int = SEED) -> DataFrame:
    b = base(spark, d)
    s = b.agg(F.avg("o_totalprice").alias("mp"), F.stddev_pop("o_totalprice").alias("sp"),
              F.avg("c_acctbal").alias("ma"), F.stddev_pop("c_acctbal").alias("sa"))
    z = (F.lit(1.5) * (F.col("o_totalprice") - F.col("mp")) / F.col("sp")
         - (F.col("c_acctbal") - F.col("ma")) / F.col("sa"))
    # One-row statistics frame: broadcast is size-bounded by construction (1 row).
    return (b.crossJoin(F.broadcast(s))
            .withColumn("y", (hash_uniform(seed, "planted", "row_id") < sigmoid(z)).cast("int"))
            .drop("mp", "sp", "ma", "sa"))
