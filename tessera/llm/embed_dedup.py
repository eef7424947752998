"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosines and components.

Each table hashes a vector to the signs of ``bits`` random projections; a bucket is a table, a
label, a length and a sign pattern. ``bits`` is the logarithm of the number of vectors, so that
buckets of unrelated vectors stay small at any size, and the number of tables follows from it:
a pair at the threshold is in no common bucket with a probability of at most ``MISS``.

Equal vectors of a label become one class with a weight. Vectors of shared buckets go to tasks
in tiles: a bucket beyond ``BLOCK`` members is dealt out in blocks, every pair of blocks making
a tile, so no task holds a large bucket. A tile computes its cosines in double precision,
counts each vector's links and returns one star per local component, never the pairs. A pair
is counted only in the first table that it shares, seen from the codes of all tables that the
rows carry. Links are summed and components taken over the stars.

Defined results: vectors that are null, empty, zero or hold null or non-finite components and
rows with a null label are linked with nothing and kept; vectors of different lengths are not
compared; rows that share an id and a vector count as separate vectors of one node; a null id
takes no part, has no component and is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import components

MISS = 1e-6
BLOCK = 1024
MOST_BITS = 30
#: Cosines this near to the threshold are computed again by a plain sum.
EDGE = 1e-9


def tables_for(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = int(min(MOST_BITS, max(8, np.ceil(np.log2(max(n, 2))))))
    agree = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, int(np.ceil(np.log(miss) / np.log1p(-agree)))


def usable(vector: Column) -> Column:
    """True for a vector with finite components that aren't all zero."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """[row, component] in double precision of an Arrow list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hashed(classes: DataFrame, bits: int, tables: int, seed: int = 3) -> DataFrame:
    """(rep, label, weight, vector, codes): one code per table."""

    def run(batches):
        power = 1 << np.arange(bits, dtype=np.int64)
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            lengths = np.asarray(b.column(3).value_lengths())
            codes = np.zeros((b.num_rows, tables), np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).normal(size=(dim, bits * tables))
                x = unit_rows(matrix(b.column(3).take(pa.array(at))))
                for t in range(tables):
                    codes[at, t] = ((x @ planes[dim][:, t * bits:(t + 1) * bits]) >= 0) @ power
            got = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables),
                                           pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=["rep", "label", "weight", "vector", "codes"])

    return classes.select("rep", "label", "weight", "vector").mapInArrow(
        run, "rep long, label string, weight long, vector array<double>, codes array<long>")


def tile_result(ids, weight, block, x, codes, table, pair_blocks, threshold):
    """(links counted per member, star links) of one tile. ``pair_blocks``: (p, q), p <= q."""
    u = unit_rows(x)
    p, q = pair_blocks
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    n = len(ids)
    links, label = np.zeros(n, np.int64), np.arange(n)
    near_all = []
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        cos = u[rows] @ u[right].T
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) < EDGE), strict=True):
            cos[i, j] = plain_cosine(x[rows[i]], x[right[j]])
        near = (cos >= threshold) & (ids[rows][:, None] != ids[right][None, :])
        if p == q:
            near &= rows[:, None] < right[None, :]
        a, b = np.nonzero(near)
        if len(a):
            a, b = rows[a], right[b]
            near_all.append((a, b))
            first = ~(codes[a, :table] == codes[b, :table]).any(1) if table else np.ones(len(a), bool)
            np.add.at(links, a[first], weight[b[first]])
            np.add.at(links, b[first], weight[a[first]])
    if near_all:
        a, b = (np.concatenate(z) for z in zip(*near_all, strict=True))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        label = rank.copy()
        while True:  # smallest rank among linked members, until nothing changes
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = np.minimum(new, new[order[new]])
            if (new == label).all():
                break
            label = new
        label = order[label]
    return links, label


def plain_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept: vectors of one label are linked if their cosine is at
    least ``threshold``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    takes_part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    rows = written(spark, rows.withColumn("part", takes_part), "vectors")
    classes = written(spark, rows.where("part").groupBy("label", "vector").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    bits, tables = tables_for(classes.count(), threshold)
    coded = written(spark, hashed(classes, bits, tables), "vector-codes")
    bucket = ["table", "label", "dim", "code"]
    entries = coded.select("rep", "label", F.size("vector").alias("dim"), F.posexplode("codes").alias("table", "code"))
    shared = entries.join(entries.groupBy(*bucket).count().where("count > 1").withColumnRenamed("count", "size"), bucket)
    # small buckets are many: those of one hash slice make a group, each still its own tile
    slices = max(16, classes.count() * tables // 20_000)
    by_bucket = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*bucket), F.lit(slices))).otherwise(
        F.pmod(F.xxhash64(*bucket, "p", "q"), F.lit(1 << 40)) + slices)
    tiles = (shared.withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)))
             .withColumn("block", F.pmod(F.xxhash64("rep", "table"), F.col("blocks")))
             .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
             .select(*bucket, "blocks", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                     "block", "rep")
             .withColumn("slice", by_bucket).drop("blocks"))
    tiles = tiles.join(coded.select("rep", "label", "weight", "vector", "codes"), ["rep", "label"])

    def run(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        keys = [np.asarray(g[c]) for c in ("table", "dim", "code", "p", "q")]
        _, name = np.unique(np.asarray(g["label"].to_pylist(), dtype=object).astype(str), return_inverse=True)
        order = np.lexsort((name, *keys))
        same = np.ones(len(order), bool)
        for k in (name, *keys):
            k = k[order]
            same[1:] &= k[1:] == k[:-1]
        cuts = np.concatenate([np.flatnonzero(~same | (np.arange(len(order)) == 0)), [len(order)]])
        ids_all, weight_all, block_all = (np.asarray(g[c]) for c in ("rep", "weight", "block"))
        vectors_, codes_ = g["vector"].combine_chunks(), g["codes"].combine_chunks()
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            ids = ids_all[at]
            links, label = tile_result(
                ids, weight_all[at], block_all[at], matrix(vectors_.take(pa.array(at))),
                matrix(codes_.take(pa.array(at))).astype(np.int64), int(keys[0][at[0]]),
                (int(keys[3][at[0]]), int(keys[4][at[0]])), threshold)
            hit = (links > 0) | (label != np.arange(len(at)))
            out.append((ids[hit], links[hit], ids[label[hit]]))
        cat = [np.concatenate(z) if out else np.zeros(0, np.int64) for z in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({"rep": pa.array(cat[0], pa.int64()), "links": pa.array(cat[1], pa.int64()),
                         "star": pa.array(cat[2], pa.int64())})

    found = written(spark, tiles.groupBy("slice").applyInArrow(run, "rep long, links long, star long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = written(spark, components(spark, found.select("rep", "star")), "vector-components")
    reps = (classes.join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
            .select(F.col("label").alias("c_label"), F.col("vector").alias("c_vector"), "weight",
                    F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")))
    out = rows.join(reps, F.col("part") & (F.col("label") == F.col("c_label")) & (F.col("vector") == F.col("c_vector")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col),
                      F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
