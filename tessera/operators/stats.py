"""Column statistics in one pass (D5, D6): every fit collects O(columns) numbers.

``exact_quantiles`` returns linear-interpolated quantiles equal to numpy's default / DuckDB
``quantile_cont`` by one plan at every size, for all columns and ranks together:

1. approximate values at the wanted places and at the sketch's error beside them, one aggregation;
2. exact counts, minima and maxima of the buckets between these edges, one aggregation. A value that
   is an edge has a bucket of its own, so most wanted ranks are settled here;
3. a bucket that still holds a wanted rank between its least and largest value gets ``EDGES`` more
   edges from a sketch of its own, and step 2 is taken again.

No rows are sorted or gathered: a task holds sketches and counts (its batches are placed between the
edges by binary search and added up), and an open bucket shrinks by the number of its edges in each round.

``grouped_quantiles`` gives the same quantiles for any number of groups, which stay in Spark: the
distinct values of each (group, column) are counted on the map side, dealt by range over (group,
value), and running counts over these ranges find each wanted rank. A group of any size is spread
over as many ranges as it fills.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import double_array, finite_or_null
from ..session import ship_package, stored
from .scan import prefix_sums

#: Edges that an open bucket gets in a round, and the accuracy of the sketches.
EDGES, ACCURACY = 64, 10_000


def _targets(n: int, p: float):
    h = (n - 1) * p
    lo = int(math.floor(h))
    return lo, min(lo + 1, n - 1), h - lo


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], clean: bool = True, accuracy: int = ACCURACY) -> dict:
    """{col: [q(p) for p in probs]} with None for columns without finite values."""
    if not cols:
        return {}
    values = [finite_or_null(c) if clean else F.col(c).cast("double") for c in cols]
    step = 1.5 / accuracy
    near = double_array(sorted({min(1.0, max(0.0, p + e)) for p in probs for e in (-step, 0.0, step)}))
    first = df.agg(*[F.percentile_approx(v, near, accuracy).alias(f"e{i}") for i, v in enumerate(values)]).first()
    edges = {i: np.unique(first[f"e{i}"]).tolist() for i in range(len(cols)) if first[f"e{i}"]}
    counts, found = [0] * len(cols), {}
    open_: dict[int, list[int] | None] = dict.fromkeys(edges)  # wanted ranks of the columns not settled
    while open_:
        spans: dict[int, list] = {i: [] for i in open_}
        for r in _counted(df, values, edges).collect():
            spans[r["c"]].append((r["b"], r["n"], r["lo"], r["hi"]))  # a row for each bucket between edges
        wide: dict[int, set] = {}
        for i, ks in list(open_.items()):
            buckets, starts, below = sorted(spans[i]), [], 0
            for _, size, _, _ in buckets:
                starts.append(below)
                below += size
            if ks is None:
                counts[i], ks = below, sorted({k for p in probs for k in _targets(below, p)[:2]})
            left = []
            for k in ks:
                at = bisect.bisect_right(starts, k) - 1
                b, size, lo, hi = buckets[at]
                if lo == hi or lo != lo or k == starts[at]:
                    found[i, k] = lo
                elif k == starts[at] + size - 1:
                    found[i, k] = hi
                else:
                    left.append(k)
                    wide.setdefault(i, set()).add(b)
            open_[i] = left
        open_ = {i: ks for i, ks in open_.items() if ks}
        if open_:
            levels = double_array([(j + 0.5) / EDGES for j in range(EDGES)])
            finer = _cells(df, values, edges, wide).groupBy("c", "b").agg(F.percentile_approx("x", levels, accuracy).alias("e"))
            more: dict[int, set] = {}
            for r in finer.collect():
                more.setdefault(r["c"], set()).update(r["e"])
            edges = {i: np.unique([*edges[i], *more.get(i, ())]).tolist() for i in open_}
    out = {}
    for i, c in enumerate(cols):
        n = counts[i]
        ends = [_targets(n, p) for p in probs] if n else []
        out[c] = [found[i, lo] + (found[i, hi] - found[i, lo]) * f for lo, hi, f in ends] if n else [None] * len(probs)
    return out


def grouped_quantiles(df: DataFrame, by: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """One row per group and column: the columns of ``by``, ``column`` (name), ``n`` (values that
    aren't null), ``least``, ``mean``, ``greatest`` and ``q``, the linear-interpolated quantiles at
    ``probs``. Null is a group of its own; a group without values has n = 0 and nulls; NaN is above
    all numbers; an empty table gives no rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(by)]).alias("g"), F.explode(cells).alias("c"))
    rows = rows.select(F.struct("g", F.col("c.column").alias("column")).alias("key"), F.col("c.x").alias("x"))
    counts = rows.groupBy("key", "x").agg(F.count("x").alias("w"))
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as a partition number must not be derived twice
    dealt = stored(counts.repartitionByRange(n_ranges, "key", "x").withColumn("range", F.spark_partition_id().cast("bigint")),
                   "grouped-quantiles")
    ranked = prefix_sums(dealt, ["key"], ["x"], F.col("range"), {"upto": F.col("w")}, group_totals=True)
    aggs, spots = [F.max("upto_total").alias("n"), F.min("x").alias("least"), (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"),
                   F.max("x").alias("greatest")], []
    for i, p in enumerate(probs):
        place = (F.col("upto_total") - 1) * F.lit(float(p))
        low = F.floor(place)
        for name, k in (("a", low), ("b", F.least(low + 1, F.col("upto_total") - 1))):
            aggs.append(F.max(F.when((F.col("upto") - F.col("w") <= k) & (k < F.col("upto")), F.col("x"))).alias(f"{name}{i}"))
        end = (F.col("n") - 1) * F.lit(float(p))
        spots.append(F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}"))
                     .otherwise(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (end - F.floor(end))))
    out = ranked.groupBy("key").agg(*aggs)
    return out.select(*[F.col(f"key.g.g{i}").alias(c) for i, c in enumerate(by)], F.col("key.column").alias("column"),
                      "n", "least", "mean", "greatest", F.array(*spots).alias("q"))


def _counted(df: DataFrame, values: list[Column], edges: dict[int, list[float]]) -> DataFrame:
    """(c, b, n, lo, hi): rows, least and greatest value of each bucket of the columns that have edges.
    A task adds its batches up, so it gives one row a bucket, whatever it reads."""
    at = list(edges)

    def run(batches):
        sums = [(np.zeros(2 * len(edges[i]) + 1, np.int64), np.full(2 * len(edges[i]) + 1, np.nan), np.full(2 * len(edges[i]) + 1, -np.inf)) for i in at]
        for x_all in batches:
            for (n, lo, hi), i, c in zip(sums, at, x_all.columns, strict=True):
                x = c.drop_null().to_numpy(zero_copy_only=False)
                b = place(x, edges[i])
                n += np.bincount(b, minlength=len(n))
                np.fmin.at(lo, b, x)  # not-a-number is above all numbers
                np.maximum.at(hi, b, x)
        for (n, lo, hi), i in zip(sums, at, strict=True):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some]),
                                              pa.array(lo[some]), pa.array(hi[some])], names=["c", "b", "n", "lo", "hi"])

    place = _bucket
    parts = _columns(df, values, at).mapInArrow(run, "c int, b int, n long, lo double, hi double")
    return parts.groupBy("c", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _cells(df: DataFrame, values: list[Column], edges: dict[int, list[float]], wide: dict[int, set] | None = None) -> DataFrame:
    """(c, b, x): the values of the columns that have edges with their buckets, of the buckets ``wide`` if given."""
    at, place = list(edges if wide is None else wide), _bucket

    def run(batches):
        for x_all in batches:
            for i, c in zip(at, x_all.columns, strict=True):
                x = c.drop_null().to_numpy(zero_copy_only=False)
                b = place(x, edges[i])
                here = np.ones(len(b), dtype=bool) if wide is None else np.isin(b, list(wide[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(here.sum(), i, np.int32)), pa.array(b[here].astype(np.int32)), pa.array(x[here])],
                                                 names=["c", "b", "x"])

    return _columns(df, values, at).mapInArrow(run, "c int, b int, x double")


def _columns(df: DataFrame, values: list[Column], at: list[int]) -> DataFrame:
    ship_package(df.sparkSession)
    return df.select(*[values[i].alias(f"x{i}") for i in at])


def _bucket(x: np.ndarray, e: list[float]) -> np.ndarray:
    """2 * (edges below x) for a value between edges, one more for an edge."""
    below, upto = np.searchsorted(e, x, side="left"), np.searchsorted(e, x, side="right")
    return 2 * below + (upto > below)


def moments(df: DataFrame, cols: list[str], clean: bool = False) -> dict:
    """count, mean, population std/var, sample var, min, max per column in one aggregation."""
    val = (lambda c: finite_or_null(c)) if clean else (lambda c: F.col(c).cast("double"))
    aggs = []
    for i, c in enumerate(cols):
        v = val(c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"),
                 F.var_pop(v).alias(f"vp{i}"), F.var_samp(v).alias(f"vs{i}"), F.min(v).alias(f"lo{i}"),
                 F.max(v).alias(f"hi{i}")]
    r = df.agg(*aggs).first()
    return {c: dict(n=r[f"n{i}"], mean=r[f"m{i}"], std=r[f"s{i}"], var=r[f"vp{i}"], var_samp=r[f"vs{i}"],
                    min=r[f"lo{i}"], max=r[f"hi{i}"]) for i, c in enumerate(cols)}


def distinct_levels(df: DataFrame, cols: list[str], limit: int | None = None) -> dict:
    """Sorted distinct non-null values per categorical column. The levels become columns or
    codes, so they come to the driver; a caller that can't trust its columns passes ``limit``,
    and a column with more levels fails (counted exactly)."""
    out = {}
    for c in cols:
        vals = df.select(c).filter(F.col(c).isNotNull()).distinct()
        rows = vals.collect() if limit is None else vals.limit(limit + 1).collect()
        if limit is not None and len(rows) > limit:
            raise ValueError(f"column {c} has more than {limit} levels")
        out[c] = sorted(r[0] for r in rows)
    return out
