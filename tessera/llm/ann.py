"""Nearest neighbours by shifted space-filling curves.

Unit vectors are projected to a few random directions, shifted and squashed to a grid, and
numbered along a Hilbert curve; several curves with projections and shifts of their own make
several orderings. Each ordering is range-partitioned and sorted in Spark, and every query is
compared with the keys in a window around its own. The windows' results merge and are
reranked by exact cosine.

That alone can't reach a fixed recall where no low dimension holds the neighbourhoods, so an
exact step follows: runs of the first ordering make blocks with a centre and a radius, queries
make blocks alike, and a pair of blocks is compared in full unless the triangle inequality on
angles rules out anything as near as each query's k-th best so far. The better the windows
did and the more structure the vectors have, the more blocks are ruled out; the result is
exact in any case. It is a stated query set against all rows, in blocks: no pairs of rows are
listed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components and
rows with a null id take no part; vectors of different lengths are not compared; a query's own
id is never a candidate; equal scores go to the smaller id; repeated rows of an id count once,
with their best score; a query without candidates has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .embed_dedup import matrix, unit_rows, usable

CURVES, DIMS, BITS = 4, 9, 7
WINDOW = 64
BLOCK_ROWS, QUERY_ROWS = 2048, 256


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points [row, dimension] with ``bits`` bits a
    dimension: the transposed index by reflections and swaps from the top bit down, its Gray
    code undone, then the bits interleaved."""
    x = grid.astype(np.int64).copy()
    n, dims = x.shape
    for shift in range(bits - 1, 0, -1):
        bit, low = 1 << shift, (1 << shift) - 1
        for i in range(dims):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    fix = np.zeros(n, np.int64)
    for shift in range(bits - 1, 0, -1):
        fix ^= np.where(x[:, -1] & (1 << shift), (1 << shift) - 1, 0)
    x ^= fix[:, None]
    key = np.zeros(n, np.int64)
    for shift in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> shift) & 1)
    return key


def curve_keys(x: np.ndarray, curve: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng([seed, curve, x.shape[1]])
    dims = min(DIMS, x.shape[1])
    q, _ = np.linalg.qr(rng.normal(size=(x.shape[1], dims)))
    y = (np.tanh(unit_rows(x) @ q * np.sqrt(x.shape[1]) / 1.5) + 1) / 2
    grid = np.floor((0.75 * y + 0.25 * rng.random(dims)) * (1 << BITS)).astype(np.int64)
    return hilbert_keys(np.clip(grid, 0, (1 << BITS) - 1), BITS)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with rows, by plain sums: equal rows get equal scores."""
    return (x * q).sum(1) / np.sqrt((x * x).sum(1) * (q * q).sum())


def _keyed(points: DataFrame, curves: int) -> DataFrame:
    def run(batches):
        for b in batches:
            lengths = np.asarray(b.column(2).value_lengths())
            keys = np.zeros((b.num_rows, curves), np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = matrix(b.column(2).take(pa.array(at)))
                for c in range(curves):
                    keys[at, c] = curve_keys(x, c)
            got = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * curves), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths.astype(np.int32)), got],
                                             names=["id", "is_query", "vector", "dim", "keys"])

    return points.mapInArrow(run, "id long, is_query boolean, vector array<double>, dim int, keys array<long>")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best distinct ids, ties to the smaller one."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _windows(ordered: DataFrame, k: int, width: int) -> DataFrame:
    """Each query's best within ``width`` places either side in its partition's order."""

    def found(curve, dim, ids, queries, x, lo, hi):
        out = []
        for i in range(lo, hi):
            if not queries[i]:
                continue
            a, b = max(0, i - width), min(len(ids), i + width + 1)
            ok = np.flatnonzero((curve[a:b] == curve[i]) & (dim[a:b] == dim[i]) & (ids[a:b] != ids[i])) + a
            if len(ok):
                own = x[i]
                scores = cosines(own, np.stack([x[j] for j in ok]))
                top = best(ids[ok], scores, k)
                out.append((np.full(len(top), ids[i]), ids[ok][top], scores[top]))
        if not out:
            return None
        q, v, s = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    def run(batches):
        held = None  # rows whose windows may reach into the next batch, and the width before them
        done = 0
        for b in batches:
            rows = (np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)),
                    b.column(3).to_numpy(zero_copy_only=False), [np.asarray(v) for v in
                                                                 b.column(4).to_numpy(zero_copy_only=False)])
            if held is None:
                held = rows
            else:
                held = tuple(x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
            n = len(held[0])
            if n - done > 2 * width:
                got = found(*held, done, n - width)
                if got:
                    yield got
                start = max(0, n - 2 * width)
                done = n - width - start
                held = tuple(z[start:] for z in held)
        if held is not None:
            got = found(*held, done, len(held[0]))
            if got:
                yield got

    return ordered.select("curve", "dim", "id", "is_query", "vector").mapInArrow(
        run, "query_id long, vec_id long, score double")


def _blocks(ordered: DataFrame, rows_in_block: int, with_limit: bool) -> DataFrame:
    """Runs of ``ordered`` rows (id, dim, vector[, bar]) as one row each: ids and vectors as
    bytes, centre (a unit vector) and radius (largest angle to it)."""
    names = ["block", "dim", "ids", "vectors", "centre", "radius", "bar", "bars"]

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            dims = np.asarray(b.column(1))
            cuts = np.flatnonzero(np.diff(dims)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(dims)], strict=True):
                for at in range(lo, hi, rows_in_block):
                    to = min(hi, at + rows_in_block)
                    ids = np.asarray(b.column(0))[at:to]
                    x = matrix(b.column(2).slice(at, to - at))
                    u = unit_rows(x)
                    c = u.sum(0)
                    norm = np.sqrt((c * c).sum())
                    c = c / norm if norm > 1e-9 else u[0]
                    radius = float(np.arccos(np.clip((u @ c).min(), -1, 1)))
                    bars = np.asarray(b.column(3))[at:to] if with_limit else np.full(to - at, -2.0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(part << 32) + made]), pa.array([int(dims[at])], pa.int32()), pa.array([ids.tobytes()]),
                         pa.array([x.tobytes()]), pa.array([c.tolist()]), pa.array([radius]), pa.array([float(bars.min())]),
                         pa.array([bars.astype(np.float64).tobytes()])], names=names)
                    made += 1

    columns = ["id", "dim", "vector"] + (["bar"] if with_limit else [])
    return ordered.select(*columns).mapInArrow(
        run, "block long, dim int, ids binary, vectors binary, centre array<double>, radius double, bar double, bars binary")


def _compared(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query of a query block within a block of vectors."""

    def run(group: pa.Table) -> pa.Table:
        queries, vectors, scores_ = [], [], []
        for r in group.to_pylist():
            dim = r["dim"]
            qi, vi = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q = np.frombuffer(r["q_vectors"]).reshape(-1, dim)
            v = np.frombuffer(r["vectors"]).reshape(-1, dim)
            bars = np.frombuffer(r["q_bars"])
            rough = unit_rows(q) @ unit_rows(v).T
            rough[qi[:, None] == vi[None, :]] = -3
            for i in range(len(qi)):
                bar = bars[i]
                if len(vi) > k:  # the k-th best of this block bounds too; distinct ids may be fewer
                    kth = np.partition(rough[i], len(vi) - k)[len(vi) - k]
                    bar = max(bar, kth) if len(np.unique(vi[rough[i] >= kth - 1e-9])) >= k else bar
                at = np.flatnonzero((rough[i] >= bar - 1e-9) & (rough[i] > -2.5))
                if len(at):
                    s = cosines(q[i], v[at])
                    top = best(vi[at], s, k)
                    queries.append(np.full(len(top), qi[i]))
                    vectors.append(vi[at][top])
                    scores_.append(s[top])
        cat = [np.concatenate(z) if z else np.zeros(0) for z in (queries, vectors, scores_)]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)),
                         "score": pa.array(cat[2].astype(np.float64))})

    return pairs.groupBy("block", "q_block").applyInArrow(run, "query_id long, vec_id long, score double")


def top(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", curves: int = CURVES, width: int = WINDOW, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score. Without ``exact`` only the windows' candidates count."""
    points = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
                            F.col(vector_col).cast("array<double>").alias("vector"))
    points = points.where(F.col("id").isNotNull() & usable(F.col("vector")))
    keyed = written(spark, _keyed(points, curves), "ann-keyed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = keyed.select("id", "is_query", "dim", "vector", F.posexplode("keys").alias("curve", "key"))
    ordered = entries.repartitionByRange(parts, "curve", "dim", "key", "id").sortWithinPartitions("curve", "dim", "key", "id")
    near = written(spark, top(_windows(ordered, k, width), k), "ann-windows")
    if not exact:
        return near

    bars = near.where(F.col("rank") == k).select(F.col("query_id").alias("b_id"), F.col("score").alias("bar"))
    first = keyed.withColumn("key", F.col("keys")[0])

    def by_curve(df):
        return df.repartitionByRange(parts, "dim", "key", "id").sortWithinPartitions("dim", "key", "id")

    blocks = written(spark, _blocks(by_curve(first), BLOCK_ROWS, False), "ann-blocks")
    queries = first.where("is_query").join(bars, F.col("id") == F.col("b_id"), "left").withColumn(
        "bar", F.coalesce("bar", F.lit(-2.0)))
    q_blocks = written(spark, _blocks(by_curve(queries), QUERY_ROWS, True), "ann-queries")
    bins = max(1, blocks.count() // 256)
    sides = q_blocks.select(F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("centre").alias("q_centre"),
                            F.col("radius").alias("q_radius"), F.col("bar").alias("q_bar"),
                            F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    ahead = blocks.select("block", "dim", "centre", "radius", F.pmod(F.xxhash64("block"), F.lit(bins)).cast("int").alias("bin"))
    dot = F.aggregate(F.zip_with("centre", "q_centre", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("radius") - F.col("q_radius")
    may = F.cos(F.greatest(F.lit(0.0), angle)) >= F.col("q_bar") - 1e-6
    pairs = ahead.join(sides, "bin").where((F.col("dim") == F.col("q_dim")) & may).select("block", "q_block")
    full = (pairs.join(q_blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"),
                                       F.col("vectors").alias("q_vectors"), F.col("bars").alias("q_bars")), "q_block")
            .join(blocks.select("block", "dim", "ids", "vectors"), "block"))
    return top(near.select("query_id", "vec_id", "score").union(_compared(full, k)), k)
