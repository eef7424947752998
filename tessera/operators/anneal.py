"""Simulated-annealing acceptance fold (W6, EN10, ST5) without a single-task fold per run.

Per run, step i with candidate score c_i, temperature T_i and hash-uniform u_i updates the
current score s: accept when c_i > s, c_i == s, or u_i < exp((c_i - s) / T_i); on accept
s := c_i. The first step of a run starts from s = -inf (always accepted).

Each step is the map f(s) = c if s < thr else s, with thr = c - T ln(u) >= c (a temperature of
0 or less gives thr = c). Two such maps in a row are again one: a state below either bound ends
at one constant, as the first map's constant isn't above its own bound. So the steps of a chunk
amount to a pair (top, k), the map s -> k if s < top else s, where top is the greatest bound and k
the state that the chunk reaches from -inf. That gives an exact parallel plan:

  1. every (run, chunk) of at most ``chunk`` (2^20) steps gives its pair;
  2. up a tree, ``FAN`` (2^16) neighbouring pairs are folded into one, until a run has no more than
     ``FAN`` of them;
  3. down the tree, each group of ``FAN`` pairs is folded from its incoming state, which gives the
     incoming state of each of its members, and at last of each chunk;
  4. every (run, chunk) replays its steps from the incoming state with the original test
     and emits per-step decisions.

No group is larger than one chunk of steps or ``FAN`` pairs, whatever the log looks like. Runs of one
chunk need no tree. A task goes through the groups of its partition in order, batch after batch, so many
small groups cost no more than a large one of as many steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..session import ship_package, stored

CHUNK = 1 << 20
#: Neighbouring pairs that a task of the tree folds.
FAN = 1 << 16
NEG_INF = float("-inf")


def _thresholds(c, t, u):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(t > 0, c - t * np.log(u), c)


def apply_pair(top: float, k: float, s: float) -> float:
    return k if s < top else s


def compose_pairs(tops, ks) -> tuple[float, float]:
    """Maps s -> k if s < top else s, one after the other, as one such map."""
    top, k = NEG_INF, NEG_INF
    for bound, c in zip(tops, ks):
        if k < bound:
            k = c
        if bound > top:
            top = bound
    return top, k


def compose_chunk(c: np.ndarray, t: np.ndarray, u: np.ndarray) -> tuple[float, float]:
    """The pair of a chunk's steps; a step without a score or temperature leaves every state."""
    real = ~(np.isnan(c) | np.isnan(t))
    c, t, u = c[real], t[real], u[real]
    return compose_pairs(_thresholds(c, t, u).tolist(), c.tolist())


def replay(c, t, u, s0: float):
    c, t, u = list(map(float, c)), list(map(float, t)), list(map(float, u))
    acc, cur = [False] * len(c), [0.0] * len(c)
    s = s0
    exp = math.exp
    for i in range(len(c)):
        d = c[i] - s
        ok = d >= 0 or (d == d and t[i] > 0 and u[i] < exp(d / t[i]))  # not-a-number is rejected
        if ok:
            s = c[i]
        acc[i] = ok
        cur[i] = s
    return np.array(acc, dtype=bool), np.array(cur)


def in_order(df: DataFrame, group: str, order: str) -> DataFrame:
    """Every (run, ``group``) in one partition, whole and in order; a partition holds many of them. Python is
    CPU-bound: the number of partitions is pinned, so runtime coalescing by bytes doesn't squeeze it into a few tasks."""
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n_parts, "run", group).sortWithinPartitions("run", group, order)


def segments(batches, group: str):
    """(run, group, columns as arrays) of the stretches of equal (run, ``group``) in Arrow batches. A group that
    goes over the end of a batch comes in several stretches, one after the other."""
    for b in batches:
        x = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns)}
        run, key = x["run"], x[group]
        cuts = np.flatnonzero((run[1:] != run[:-1]) | (key[1:] != key[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(run)]):
            if hi > lo:
                yield run[lo], key[lo], {n: c[lo:hi] for n, c in x.items()}


#: Rows that a task gathers before it hands them on.
ROWS_OUT = 1 << 14


def gathered(parts):
    """``parts`` gives columns as arrays; they go on in batches of about ``ROWS_OUT`` rows."""
    def run(batches):
        import pyarrow as pa

        def batch(held):
            return pa.RecordBatch.from_pydict({n: pa.array(np.concatenate([h[n] for h in held])) for n in held[0]})

        held, rows = [], 0
        for part in parts(batches):
            held.append(part)
            rows += len(part["run"])
            if rows >= ROWS_OUT:
                yield batch(held)
                held, rows = [], 0
        if held:
            yield batch(held)

    return run


def folding(group: str, pair):
    """A task's (run, group) as one pair each: ``pair`` gives the bounds and constants of a stretch."""
    def parts(batches):
        held, top, k = None, NEG_INF, NEG_INF
        row = lambda: {"run": np.array([held[0]]), "node": np.array([held[1]]), "top": np.array([top]), "k": np.array([k])}
        for run, key, x in segments(batches, group):
            if (run, key) != held:
                if held:
                    yield row()
                held, top, k = (run, key), NEG_INF, NEG_INF
            tops, ks = pair(x)
            top, k = compose_pairs([top, *np.asarray(tops).tolist()], [k, *np.asarray(ks).tolist()])
        if held:
            yield row()

    return gathered(parts)


def incoming_states(nodes: DataFrame, pairs: DataFrame, last: int, fan: int = FAN) -> DataFrame:
    """(run, node, s): the state before every chunk. ``nodes`` is (run, node, s0) with the runs'
    first states, ``pairs`` (run, node, top, k) of the chunks, ``last`` the greatest node."""

    def follow(batches):
        held, s = None, NEG_INF
        for run, over, x in segments(batches, "over"):
            if (run, over) != held:
                held, s = (run, over), float(x["s"][0])
            states = []
            for top, k in zip(x["top"].tolist(), x["k"].tolist()):
                states.append(s)
                s = apply_pair(top, k, s)
            yield {"run": x["run"], "node": x["node"], "s": np.array(states)}

    over = F.floor(F.col("node") / F.lit(fan)).cast("bigint")
    levels = [stored(pairs.withColumn("over", over), "anneal-level")]
    while last >= fan:
        up = in_order(levels[-1], "over", "node").mapInArrow(folding("over", lambda x: (x["top"], x["k"])), "run long, node long, top double, k double")
        levels.append(stored(up.withColumn("over", over), "anneal-level"))
        last //= fan
    states = nodes.where("node = 0").select("run", "node", F.col("s0").alias("s"))
    for level in reversed(levels):
        known = states.select("run", F.col("node").alias("over"), "s")
        states = in_order(level.join(known, ["run", "over"]), "over", "node").mapInArrow(gathered(follow), "run long, node long, s double")
    return states


def anneal_fold(df: DataFrame, run: str = "run_id", step: str = "iteration_num", score: str = "stage1_val_auc",
                temperature: str = "temperature", seed: int = 42, chunk: int = CHUNK, start: DataFrame | None = None,
                fan: int = FAN) -> DataFrame:
    """(run, step, accepted, current_score) for every step; see module doc. ``start`` (run, s0)
    gives runs the score that they go on from; a run without one starts from -inf."""
    d = df.select(F.col(run).alias("run"), F.col(step).alias("step"), F.col(score).cast("double").alias("c"),
                  F.col(temperature).cast("double").alias("t"), hash_uniform(seed, "anneal", step).alias("u"))
    d = d.withColumn("chunk", F.floor(F.col("step") / F.lit(chunk)).cast("bigint"))

    # a row per chunk: its place among the run's chunks and the run's first state
    place = F.row_number().over(Window.partitionBy("run").orderBy("chunk")) - 1
    chunks = d.groupBy("run", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("node", place.cast("bigint"))
    if start is None:
        chunks = chunks.withColumn("s0", F.lit(NEG_INF))
    else:
        known = start.select(F.col(run).alias("run"), F.col("s0").cast("double").alias("_s0"))
        chunks = chunks.join(known, "run", "left").withColumn("s0", F.coalesce("_s0", F.lit(NEG_INF)))
    nodes = stored(chunks.select("run", "chunk", "node", "s0"), "anneal-chunks")
    last = nodes.agg(F.max("node")).first()[0] or 0
    starts = nodes.select("run", "chunk", "s0")
    if last:
        def pair(x):
            top, k = compose_chunk(x["c"], x["t"], x["u"])
            return [top], [k]

        pairs = (in_order(d.join(nodes.select("run", "chunk", "node"), ["run", "chunk"]), "node", "step")
                 .mapInArrow(folding("node", pair), "run long, node long, top double, k double"))
        states = incoming_states(nodes, pairs, last, fan)
        starts = nodes.join(states, ["run", "node"]).select("run", "chunk", F.col("s").alias("s0"))

    def steps(batches):
        held, s = None, NEG_INF
        for own, key, x in segments(batches, "chunk"):
            if (own, key) != held:
                held, s = (own, key), float(x["s0"][0])
            acc, cur = replay(x["c"], x["t"], x["u"], s)
            s = float(cur[-1])
            yield {"run": x["run"], "step": x["step"], "accepted": acc, "current_score": cur}

    ship_package(df.sparkSession)
    out = in_order(d.join(starts, ["run", "chunk"]), "chunk", "step").mapInArrow(
        gathered(steps), "run long, step long, accepted boolean, current_score double")
    return out.withColumnRenamed("run", run).withColumnRenamed("step", step)
