"""Ensemble search loop (EN11, EN12, EN14, EN16, EN19, S12, S13).

The driver loop holds only tiny state (current score, temperature, plateau counter, accepted
ids). Data stays in Spark:

  * a candidate is a random pipeline over the whole model pool (FE38), fitted on its own exact
    stratified pre-sample of the pool (SM5, one pass for the batch), in a driver thread pool;
    each fits and writes its validation predictions in its own job group and scheduler pool. A timer
    sets the candidate's event and cancels the group, and the deadline is checked again before every
    stage (EN19): what fails or times out, in fitting or in scoring, is a rejected row;
  * the batch's predictions are read back as one array per row, next to the ensemble's sums;
  * candidates are decided in order, each against the ensemble with the accepted ones before it:
    one pass scores all, and only an acceptance scores the rest again. The current score is
    always the AUC of the saved ensemble. The search starts from an empty ensemble with score 0;
    the founder (EN12) is scored as a baseline and not added;
  * every batch writes its predictions, log, ensemble sums and at last its state under folders of
    its own number with overwrite: the state row commits the batch, and a batch that was cut off
    is written again, so a restarted driver resumes exactly once (S13).
"""

from __future__ import annotations

import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, py_uniform
from ..session import stored
from ..sources import sinks
from . import ensemble as E
from .metrics import auc
from .models import ml_probability
from .pipeline import apply_pipeline, draw_spec, fit_pipeline
from .sampling import candidate_presample, stratified_sample


@dataclass
class SearchConfig:
    run_id: str = "run-0"
    seed: int = 42
    n_batches: int = 3
    batch_size: int = 4
    t0: float = 0.01
    decay: float = 0.9
    plateau_limit: int = 100
    row_fraction: tuple = (0.2, 0.6)
    column_fraction: tuple = (0.5, 1.0)
    models: list | None = None  # None: every enabled model of the pool
    timeout_sec: float = 900.0
    parallelism: int = 2


class CandidateTimeout(Exception):
    pass


class Deadline:
    """A candidate's time limit: an event that a timer sets, while it cancels the job group."""

    def __init__(self, spark: SparkSession, group: str, seconds: float):
        self.sc, self.group, self.seconds, self.passed = spark.sparkContext, group, seconds, threading.Event()

    def _end(self):
        self.passed.set()
        self.sc.cancelJobGroup(self.group)

    def check(self):
        if self.passed.is_set():
            raise CandidateTimeout(f"{self.group} passed {self.seconds} s")

    def run(self, fn):
        self.sc.setJobGroup(self.group, f"candidate {self.group}", interruptOnCancel=True)
        self.sc.setLocalProperty("spark.scheduler.pool", self.group)
        timer = threading.Timer(self.seconds, self._end)
        timer.start()
        try:
            out = fn()
            self.check()
            return out
        except Exception:
            self.check()  # a cancelled job fails with an error of its own
            raise
        finally:
            timer.cancel()
            self.sc.setLocalProperty("spark.jobGroup.id", None)
            self.sc.setLocalProperty("spark.scheduler.pool", None)


def accept(delta: float, temperature: float, u: float) -> tuple[bool, str]:
    import math

    if delta != delta:
        return False, "rejected: no score"
    if delta > 0:
        return True, "improvement"
    if delta == 0:
        return True, "equal score"
    if u < math.exp(delta / temperature):
        return True, "annealing accept"
    return False, "rejected: worse score"


def score_candidates(sums: DataFrame, n_models: int, width: int, added: list[int], candidates: list[int]) -> dict[int, float | None]:
    """AUC of the ensemble (``n_models`` summed in sum_p, plus the batch's ``added`` positions) with
    each of ``candidates`` on top: one pass. ``sums`` has label, sum_p and the array p."""
    base = F.col("sum_p") + sum((F.col("p")[i] for i in added), F.lit(0.0))
    n = n_models + len(added) + 1
    rows = sums.select("label", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), ((base + F.col("p")[i]) / F.lit(float(n))).alias("s"))
                                                    for i in candidates])).alias("x")).select("label", "x.*")
    return {r["c"]: r["auc"] for r in auc(rows, "s", "label", by=["c"]).collect()}


def run_search(spark: SparkSession, pool: DataFrame, features: list[str], cfg: SearchConfig, base_path: str) -> dict:
    """Run (or resume) a search; returns the paths of the log, predictions and state tables."""
    paths = {k: f"{base_path}/{k}" for k in ("log", "preds", "ensemble", "state")}
    # written, not kept: the plan of a kept frame is part of every plan that reads it, and the driver holds these by the hundred
    train = stored(pool.filter(F.col("split") == "train").select("row_id", "label", *features), "search-train")
    val = stored(pool.filter(F.col("split") == "val1").select("row_id", "label", *features), "search-val")
    temperature = E.Temperature(cfg.t0)

    st = sinks.load_state(spark, paths["state"], cfg.run_id)
    if st is None:
        # EN12 founder: one random pipeline on 10 % of the pool, scored, not added; it is batch 0.
        spec = draw_spec(features, cfg.seed, 0, cfg.models, cfg.row_fraction, cfg.column_fraction)
        sample = stored(stratified_sample(train, "row_id", "label", 0.1, seed=cfg.seed, salt="founder"), "search-founder")
        ops, _, model = fit_pipeline(spec, sample)
        score = auc(apply_pipeline(ops, model, val).select("p", "label"), "p", "label").first()["auc"] or 0.0
        _write_log(spark, paths["log"], cfg, 0, [{"iteration_num": 0, "stage1_val_auc": float(score), "rejection_reason": "founder baseline",
                                                  "temperature": cfg.t0, **_described(spec)}])
        val.select("row_id", "label", F.lit(0.0).alias("sum_p")).write.mode("overwrite").parquet(f"{paths['ensemble']}/batch=0")
        st = {"run_id": cfg.run_id, "batch": 0, "temperature": cfg.t0, "current_score": 0.0, "best_score": 0.0, "plateau": 0, "accepted": []}
        sinks.save_state(spark, paths["state"], st)
    temperature.set(st["temperature"])

    for b in range(st["batch"] + 1, cfg.n_batches + 1):
        if st["plateau"] >= cfg.plateau_limit:
            break
        its = [(b - 1) * cfg.batch_size + i + 1 for i in range(cfg.batch_size)]
        specs = [draw_spec(features, cfg.seed, it, cfg.models, cfg.row_fraction, cfg.column_fraction) for it in its]
        member = stored(candidate_presample(train, "row_id", "label", [(s.iteration, s.row_fraction, cfg.seed + s.iteration) for s in specs]), "search-members")
        sinks.remove(spark, f"{paths['preds']}/batch={b}")  # of a batch that was cut off
        results = _fit_batch(spark, cfg, specs, train, member, val, f"{paths['preds']}/batch={b}")
        st = _decide_batch(spark, cfg, paths, st, b, specs, results, val, temperature)
    return {**paths, "final": st, "run_id": cfg.run_id}


def _described(spec) -> dict:
    return {"classifier_type": spec.model, "transformers_used": [n for n, _ in spec.feature_ops],
            "use_pca": spec.reduction is not None, "dim_reduction": spec.reduction[0] if spec.reduction else None,
            "pca_components": float(spec.reduction[1]["n_components"]) if spec.reduction else None, "pipeline_hash": spec.hash()}


def _fit_batch(spark, cfg, specs, train, member, val, folder: str) -> list[tuple]:
    """(done, reason, seconds, timed out) of each candidate, in order. The predictions of one that is
    done are in a folder of its own."""

    def job(spec):
        began = time.time()
        deadline = Deadline(spark, f"{cfg.run_id}-{spec.iteration}", cfg.timeout_sec)
        try:
            sample = train.join(member.filter(F.col("candidate_id") == spec.iteration).select("row_id"), "row_id", "left_semi")

            def fit_and_score():
                ops, _, model = fit_pipeline(spec, sample, check=deadline.check)
                p = apply_pipeline(ops, model, val).select("row_id", F.lit(spec.iteration).alias("model_id"), F.col("p").cast("double").alias("p"))
                p.write.mode("overwrite").parquet(f"{folder}/candidate={spec.iteration}")

            deadline.run(fit_and_score)
            return True, "", time.time() - began, False
        except CandidateTimeout:
            return False, "timeout", time.time() - began, True
        except Exception as e:  # noqa: BLE001 - EN19: a failed candidate becomes a rejected row
            return False, f"error: {type(e).__name__}", time.time() - began, False

    with ThreadPoolExecutor(max_workers=max(1, cfg.parallelism)) as ex:
        return list(ex.map(job, specs))


def _decide_batch(spark, cfg, paths, st, b, specs, results, val, temperature) -> dict:
    fitted = [i for i, (done, _, _, _) in enumerate(results) if done]
    own, log, accepted = f"{paths['preds']}/batch={b}", [], []
    sums = spark.read.parquet(f"{paths['ensemble']}/batch={st['batch']}")
    if fitted:
        preds = read_predictions(spark, [f"{own}/candidate={specs[i].iteration}" for i in fitted])
        cell = lambda i: F.max(F.when(F.col("model_id") == specs[i].iteration, F.col("p")))
        sums = sums.join(preds.groupBy("row_id").agg(F.array(*[cell(i) for i in fitted]).alias("p")), "row_id").persist(StorageLevel.MEMORY_AND_DISK)
        earlier = _accepted_predictions(spark, paths, st["accepted"])
        models = [it for _, it in st["accepted"]] + [specs[i].iteration for i in fitted]
        mat = E.correlation_matrix(preds if earlier is None else earlier.unionByName(preds), models)
        place = {it: k for k, it in enumerate(models)}
        alone = {r["model_id"]: r["auc"] for r in auc(preds.join(val.select("row_id", "label"), "row_id"), "p", "label", by=["model_id"]).collect()}
        scores = score_candidates(sums, len(st["accepted"]), len(fitted), [], list(range(len(fitted))))
    score, best, plateau, taken = st["current_score"], st["best_score"], st["plateau"], list(st["accepted"])
    for i, (spec, (done, reason, seconds, late)) in enumerate(zip(specs, results, strict=True)):
        row = {"iteration_num": spec.iteration, "temperature": temperature.value, "training_time_sec": seconds, "timeout": late, **_described(spec)}
        k = fitted.index(i) if done else None
        got = scores.get(k) if k is not None else None
        if got is None:
            plateau += 1
            log.append({**row, "stage1_val_auc": 0.0, "accepted": False, "rejection_reason": reason or "no score", "num_models": len(taken)})
            continue
        ok, why = accept(got - score, temperature.value, py_uniform(cfg.seed, "accept", spec.iteration))
        members = [place[it] for _, it in taken] + [place[spec.iteration]]
        log.append({**row, "stage1_val_auc": float(got), "single_auc": alone.get(spec.iteration), "accepted": ok, "rejection_reason": "" if ok else why,
                    "diversity_score": E.diversity_abs(mat[members][:, members]), "num_models": len(taken) + ok})
        if ok:
            score = float(got)
            taken.append((b, spec.iteration))
            accepted.append(k)
            rest = [j for j in range(k + 1, len(fitted))]
            if rest:  # the others now stand against a larger ensemble
                scores.update(score_candidates(sums, len(st["accepted"]), len(fitted), accepted, rest))
        if ok and score > best:
            best, plateau = score, 0
        else:
            plateau += 1
    _write_log(spark, paths["log"], cfg, b, log)
    added = sum((F.col("p")[k] for k in accepted), F.lit(0.0)) if accepted else F.lit(0.0)
    sums.select("row_id", "label", (F.col("sum_p") + added).alias("sum_p")).write.mode("overwrite").parquet(f"{paths['ensemble']}/batch={b}")
    if fitted:
        sums.unpersist()
    temperature.decay(cfg.decay)
    st = {"run_id": cfg.run_id, "batch": b, "temperature": temperature.value, "current_score": score, "best_score": best, "plateau": plateau,
          "accepted": taken}
    sinks.save_state(spark, paths["state"], st)  # commits the batch
    return st


def _accepted_predictions(spark, paths, accepted: list) -> DataFrame | None:
    if not accepted:
        return None
    return read_predictions(spark, [f"{paths['preds']}/batch={b}/candidate={it}" for b, it in accepted])


def read_predictions(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).schema("row_id bigint, model_id int, p double").parquet(*folders)


def _write_log(spark, path: str, cfg, b: int, rows: list[dict]) -> None:
    schema = ("iteration_num long, stage1_val_auc double, single_auc double, accepted boolean, rejection_reason string, diversity_score double, "
              "classifier_type string, transformers_used array<string>, use_pca boolean, dim_reduction string, pca_components double, "
              "temperature double, pipeline_hash string, training_time_sec double, timeout boolean, num_models long")
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple({"accepted": False, "timeout": False, "num_models": 0, **r}.get(n) for n in names) for r in rows], schema)
    df = df.withColumn("ensemble_id", F.concat(F.lit("ensemble_"), F.col("iteration_num"))).withColumn("timestamp", F.current_timestamp())
    out = sinks.to_log_schema(df).drop("run_id")
    out.write.mode("overwrite").parquet(f"{path}/run_id={cfg.run_id}/batch={b}")


def ensemble_probability(spark: SparkSession, res: dict) -> DataFrame:
    """(row_id, label, p) of the saved ensemble on the validation rows: the mean of the accepted."""
    st = res["final"]
    n = max(1, len(st["accepted"]))
    sums = spark.read.parquet(f"{res['ensemble']}/batch={st['batch']}")
    return sums.select("row_id", "label", (F.col("sum_p") / F.lit(float(n))).alias("p"))


# ---------------------------------------------------------------- EN14 / EN16 meta-learner
#: Rows of the stacked frame for each task of a meta-learner's fit.
META_ROWS = 1 << 14


def meta_frame(probabilities: DataFrame, models: list[int], seed: int = 42) -> DataFrame:
    """EN13 rows: every val1 row and the 90 % of val2 below the hash level train the
    meta-learner, the rest of val2 is held out. ``probabilities`` is (row_id, split, label,
    model_id, p); the stacked row has the array ``v`` in the order of ``models``."""
    at = F.array(*[F.coalesce(F.max(F.when(F.col("model_id") == m, F.col("p"))), F.lit(0.0)) for m in models])
    part = F.when((F.col("split") == "val1") | (hash_uniform(seed, "meta", "row_id") < 0.9), "meta_train").otherwise("meta_holdout")
    return (probabilities.filter(F.col("model_id").isin(*models)).groupBy("row_id", "split", "label").agg(at.alias("v"))
            .withColumn("part", part))


def meta_learner(frame: DataFrame, n_models: int, form: str = "logistic", n_draws: int = 4, seed: int = 42) -> dict:
    """EN14: a meta-learner of the stacked probabilities, ``logistic`` or ``mlp``; EN16: its
    hyper-parameters are drawn ``n_draws`` times and chosen by the AUC on a hash-held fifth of
    the meta-train rows; the result is scored on the held-out rows only.

    A fit is some hundred passes over rows of a few numbers, so the rows stand in as many
    partitions as they fill (``META_ROWS``), not as many as the shuffle before made, and the draws
    are fitted side by side."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    d = frame.withColumn("features", array_to_vector("v")).withColumn("label", F.col("label").cast("double"))
    d = d.withColumn("fold", F.when(hash_uniform(seed, "metafold", "row_id") < 0.2, "tune").otherwise("fit")).persist(StorageLevel.MEMORY_AND_DISK)
    kept, d = d, d.coalesce(max(1, -(-d.count() // META_ROWS)))
    train, hold = d.filter(F.col("part") == "meta_train"), d.filter(F.col("part") == "meta_holdout")

    def estimator(i):
        u = lambda salt: py_uniform(seed, f"meta|{salt}", i)
        if form == "logistic":
            params = {"regParam": 10 ** (-4 + 3 * u("reg")), "elasticNetParam": u("mix")}
            return params, LogisticRegression(**params, maxIter=200)
        params = {"hidden": 4 + int(u("hidden") * 13), "stepSize": 10 ** (-2 + u("step"))}
        return params, MultilayerPerceptronClassifier(layers=[n_models, params["hidden"], 2], stepSize=params["stepSize"], maxIter=100, seed=seed)

    scored = lambda m, part: ml_probability(m.transform(part)).select("p", "label")

    def trial(i):
        params, est = estimator(i)
        model = est.fit(train.filter(F.col("fold") == "fit"))
        return auc(scored(model, train.filter(F.col("fold") == "tune")), "p", "label").first()["auc"] or 0.0, -i, params, est

    with ThreadPoolExecutor(max_workers=n_draws) as ex:
        best = max(ex.map(trial, range(n_draws)), key=lambda t: t[:2])
    model = best[3].fit(train)
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.lit(float(n_models))
    out = {"n_models": n_models, "form": form, "params": json.dumps(best[2], sort_keys=True), "tune_auc": float(best[0]),
           "meta_auc": auc(scored(model, hold), "p", "label").first()["auc"],
           "mean_auc": auc(hold.withColumn("m", mean), "m", "label").first()["auc"],
           "n_train": train.count(), "n_holdout": hold.count(), "model": model}
    kept.unpersist()
    return out
