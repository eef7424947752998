"""MT7: random search with cross-validation over several model families at once.

A draw picks a family, then every parameter of the family's space, all by hash. Each draw is fitted
on every fold's other rows, in a driver thread pool as the fits are independent; the held-out rows' scores of all
draws are written as (group, label, score), one group a draw and fold, and one pass gives all
AUCs. The best mean wins, ties to the earlier draw, and is fitted again on all rows.

A draw whose fit or scoring fails on some fold has no mean and can't win; if all fail, the search does.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import py_uniform
from ..session import scratch_path, track
from .metrics import auc
from .pool import POOL, enabled
from .sampling import kfold
from .spaces import draw


@dataclass(frozen=True)
class Trial:
    draw: int
    family: str
    params: dict


def draw_trials(n: int, families: dict[str, dict], seed: int = 42) -> list[Trial]:
    """``families``: name -> space of its parameters."""
    names = list(families)
    picked = [names[int(py_uniform(seed, "family", i) * len(names))] for i in range(n)]
    return [Trial(i, f, draw(families[f], seed, f"tune|{f}", i)) for i, f in enumerate(picked)]


def random_search(df: DataFrame, features: list[str], n_draws: int = 10, families: dict[str, dict] | None = None,
                  fits: dict[str, Callable] | None = None, key: str = "row_id", label: str = "label", k: int = 3, seed: int = 42,
                  parallelism: int = 4) -> dict:
    """trials [(trial, mean AUC or None, AUCs of the folds)] in order, best (a trial) and model (the
    best refitted on ``df``). ``families`` are the pool's spaces if not given; ``fits`` overrides the pool's
    fit functions by name."""
    families = families or {f: POOL[f].space for f in enabled()}
    fits = fits or {}
    trials = draw_trials(n_draws, families, seed)
    folds = track(kfold(df.select(key, label, *features), key, label, k=k, seed=seed))
    path = scratch_path(df.sparkSession, "random-search")

    def fit(t: Trial, rows: DataFrame):
        return fits.get(t.family, POOL[t.family].fit if t.family in POOL else None)(t.params, rows, list(features), label, key, seed)

    def job(at):
        t, fold = at
        group = t.draw * k + fold
        try:
            model = fit(t, folds.where(F.col("fold") != fold).drop("fold"))
            held = folds.where(F.col("fold") == fold)
            # margins where a model has them: probabilities near 0 and 1 would tie
            scored = held.withColumn("s", model.decision()) if hasattr(model, "decision") else model.transform(held).withColumn("s", F.col("p"))
            scored.select(F.col(label).cast("int").alias("label"), F.col("s").cast("double").alias("s")).write.parquet(f"{path}/g={group}")
            return group
        except Exception:  # noqa: BLE001 - a draw that can't be fitted or scored loses
            return None

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        done = [g for g in ex.map(job, [(t, f) for t in trials for f in range(k)]) if g is not None]
    if not done:
        raise RuntimeError("no draw could be fitted")
    parts = df.sparkSession.read.option("basePath", path).schema("label int, s double, g int").parquet(*[f"{path}/g={g}" for g in done])
    got = {r["g"]: r["auc"] for r in auc(parts, "s", "label", by=["g"]).collect()}  # draws x folds numbers
    table = []
    for t in trials:
        own = [got.get(t.draw * k + f) for f in range(k)]
        mean = sum(own) / k if all(a is not None and a == a for a in own) else None
        table.append((t, mean, own))
    scored = [r for r in table if r[1] is not None]
    if not scored:
        raise RuntimeError("no draw was scored on all folds")
    best = max(scored, key=lambda r: (r[1], -r[0].draw))[0]
    return {"trials": table, "best": best, "model": fit(best, df)}
