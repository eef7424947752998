"""Quality classifier by hierarchical empirical Bayes.

A logistic model of shape features of the whole text (letter case, symbols, repetition, word
lengths) gives each document its own evidence: the log of how much more likely its features
are for a good text than for a bad one. Documents belong to paths and paths to hosts. Soft
counts of good documents are summed per path and per host; each level's good rate is shrunk
towards the level above (path to host, host to the global rate) by a beta prior whose
strength is fitted to the spread between groups by moments, so sparse sites stay near the
global prior and large ones speak for themselves. A document's posterior joins its evidence
with the shrunk rate of its path, its own part left out.

Features are computed per row in the tasks; all else is grouped aggregation and joins with
the aggregates. The logistic model is fitted on at most ``TRAIN_ROWS`` labelled documents
chosen by id hash; the sums and rates cover all documents.

Defined results: null and empty texts have zero features and no words; a null host or path
is a group of its own; labels that are null or repeated with both values are counted as they
stand; without labels of both kinds the evidence is 0 and the global rate 0.5, so all is
kept; repeated rows count each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, text_slices, tidy, written
from .language_id import fresh_name

#: Bound of the labelled sample that the logistic model is fitted on.
TRAIN_ROWS = 20_000
FEATURES = ("log_words", "word_length", "upper", "digit", "space", "newline", "mark", "symbol", "bar", "high",
            "distinct", "again", "stop")
#: Bounds of a level's fitted prior strength; without spread between groups it is the larger one.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in "*$%&#@^~<>{}[]\\/+=_"]] = 6
_KIND[ord("|")] = 7
_KIND[128:] = 8
_KIND[[ord(c) for c in ".,;:"]] = 9


def features(column) -> np.ndarray:
    """[text, feature] of an Arrow string column."""
    out = np.zeros((len(column), len(FEATURES)))
    for row, to, starts, raw in text_slices(column):
        n = to - row
        length = np.diff(starts)
        owner = np.repeat(np.arange(n, dtype=np.int64), length)
        kinds = np.bincount(owner * 10 + _KIND[raw], minlength=n * 10).reshape(n, 10) / np.maximum(length, 1)[:, None]
        whole = raw.tobytes()
        for i in np.flatnonzero(length):
            words = whole[starts[i]:starts[i + 1]].split()
            if not words:
                continue
            k = len(words)
            same = sum(map(bytes.__eq__, words, words[1:]))
            out[row + i, 0] = np.log1p(k)
            out[row + i, 1] = min(20.0, length[i] / k)
            # distinct words grow more slowly than words in any text
            out[row + i, 10] = min(4.0, len(set(words)) / k**0.8)
            out[row + i, 11] = same / k
        for f, kind in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (9, 8), (12, 9)):
            out[row:to, f] = kinds[:, kind]
    return out


@dataclass
class Evidence:
    """Logistic model on standardised features; ``base`` is the log odds of its sample."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    base: float
    rate: float

    def log_factor(self, x: np.ndarray) -> np.ndarray:
        """Log of the Bayes factor for a good text, held within +-12."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(np.c_[np.ones(len(z)), z] @ self.weight - self.base, -12, 12)


def fit_evidence(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Evidence:
    """Newton steps on the penalised likelihood."""
    n, p = x.shape if len(x) else (0, len(FEATURES))
    if n == 0 or y.min() == y.max():
        return Evidence(np.zeros(p), np.ones(p), np.zeros(p + 1), 0.0, 0.5)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.c_[np.ones(n), np.clip((x - mean) / scale, -8, 8)]
    weight = np.zeros(p + 1)
    penalty = np.diag([0.0] + [ridge] * p)
    for _ in range(steps):
        prob = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
        gradient = z.T @ (y - prob) - penalty @ weight
        hessian = (z * (prob * (1 - prob) + 1e-9)[:, None]).T @ z + penalty + 1e-9 * np.eye(p + 1)
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        weight += step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    return Evidence(mean, scale, weight, float(np.log(rate / (1 - rate))), rate)


def with_features(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            x = features(b.column(at))
            got = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)),
                                           pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=schema.names)

    return bound_batches(docs).mapInArrow(tidy(run), schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          quality_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Evidence:
    """Fit on the labelled documents with the smallest id hashes. Only features of at most
    ``train_rows`` rows come to the driver: of rows that repeat an id the one with the least text counts."""
    order = F.xxhash64(F.col("id").cast("string"), F.lit("quality"))
    chosen = (labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("id"), F.col(quality_col).cast("double").alias("y"))
              .withColumn("o", order).orderBy("o", "id", "y").limit(train_rows).select("id", "y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "id")
    rows = with_features(texts.select("text", "y", "id"), "text", "x").select("x", "y", "id").toArrow()
    if len(rows) == 0:
        return fit_evidence(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    order_ = np.lexsort((*x.T, rows["id"].to_numpy()))
    return fit_evidence(x[order_], rows["y"].to_numpy()[order_])


def log_odds(p):
    return F.log(p / (1 - p))


def strength(groups: DataFrame, n: str, mean: str, prior: str) -> float:
    """Beta strength of a level by moments over all groups: the spread of their rates about their
    priors, less what sampling alone explains, sets how far a group may move. A group counts by its
    size, so sparse ones add little each and their sampling noise is taken off."""
    r = groups.agg(
        F.sum(n).alias("w"),
        F.sum(F.col(n) * F.pow(F.col(mean) - F.col(prior), 2)).alias("spread"),
        F.sum(F.col(prior) * (1 - F.col(prior))).alias("noise"),
        F.sum(F.col(n) * F.col(prior) * (1 - F.col(prior))).alias("scale")).first()
    if not r["scale"]:
        return MOST_STRENGTH
    between = (r["spread"] - r["noise"]) / r["w"]
    unit = r["scale"] / r["w"]
    if between <= unit / MOST_STRENGTH:
        return MOST_STRENGTH
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, unit / between - 1)))


def site_rates(spark: SparkSession, scored: DataFrame, rate: float) -> tuple[DataFrame, float]:
    """(host, path, n, good, host_rate) of every path, and the strength of the path level.
    ``scored`` has host, path and p, a document's probability by its own evidence."""
    paths = written(spark, scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("good")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = total["good"] / total["n"] if total["n"] else rate
    hosts = hosts.withColumn("m", F.col("host_good") / F.col("host_n")).withColumn("prior", F.lit(float(overall)))
    k_host = strength(hosts, "host_n", "m", "prior")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("host_good") + k_host * overall)
                                                    / (F.col("host_n") + k_host)).alias("host_rate"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = strength(joined.withColumn("m", F.col("good") / F.col("n")), "n", "m", "host_rate")
    return joined, k_path


def score(spark: SparkSession, docs: DataFrame, evidence: Evidence, host, path, id_col: str = "doc_id",
          text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: id, host, path, log_factor, site_rate, quality (posterior
    probability of a good text); with ``carry`` the struct ``row`` of all its columns too."""
    name = fresh_name(docs, "log_factor")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = evidence.log_factor(features(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=schema.names)

    rows = bound_batches(docs).mapInArrow(tidy(run), schema)
    base = float(np.log(evidence.rate / (1 - evidence.rate)))
    rows = rows.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"),
                       F.col(name).alias("log_factor"), (1 / (1 + F.exp(-(F.col(name) + base)))).alias("p"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    if not carry:
        rows = written(spark, rows, "quality-scored")
    sites, k = site_rates(spark, rows.select("host", "path", "p"), evidence.rate)
    sites = written(spark, sites.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "good",
                                        "host_rate"), "quality-sites")
    rate = (k * F.col("host_rate") + F.col("good") - F.col("p")) / (k + F.col("n") - 1)
    rate = F.least(F.lit(0.999), F.greatest(F.lit(0.001), rate))
    return (rows.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")), "left")
            .withColumn("site_rate", rate)
            .withColumn("quality", 1 / (1 + F.exp(-(F.col("log_factor") + log_odds(F.col("site_rate"))))))
            .select(F.col("id").alias(id_col), "host", "path", "log_factor", "site_rate", "quality",
                    *(["row"] if carry else [])))


def keep_good(spark: SparkSession, docs: DataFrame, evidence: Evidence, host, path, least: float = 0.5,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose posterior probability of a good text is at least ``least``."""
    scored = score(spark, docs, evidence, host, path, id_col, text_col, carry=True)
    return scored.where(F.col("quality") >= least).select("row.*")
