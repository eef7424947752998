"""Connected components of a link table, distributed.

First every partition replaces its links by stars of its own union-find (no more links than
nodes remain). Then large-star and small-star steps alternate: each node's larger neighbours
are linked to its smallest one, then its smaller neighbours and itself; written after each
round, until a round changes nothing. All links then run from a node to its component's
smallest node. No task needs more than its partition of links; groups are only aggregated
(minimum per node) and joined, so a node with very many links is no group in memory.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

LINKS = "src long, dst long"


def union_find(pairs, root: dict | None = None) -> dict:
    """node -> smallest node of its component."""
    root = {} if root is None else root

    def find(x):
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
        root.setdefault(min(x, y), min(x, y))
    return {x: find(x) for x in list(root)}


def _local_stars(batches):
    root: dict = {}
    for b in batches:
        root = union_find(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), root)
    links = [(n, r) for n, r in root.items() if n != r]
    for at in range(0, len(links), 50_000):
        part = links[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()),
                                          pa.array([y for _, y in part], pa.int64())], names=["src", "dst"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("src", "dst").union(links.select(F.col("dst"), F.col("src"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("m")).select(
        F.col("node").alias("at"), F.least("node", "m").alias("m"))
    return (both.where("other > node").join(least, F.col("node") == F.col("at"))
            .select(F.col("other").alias("src"), F.col("m").alias("dst")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("at"), "m")
    joined = links.join(least, F.col("src") == F.col("at"))
    others = joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return others.union(least.select(F.col("at").alias("src"), F.col("m").alias("dst"))).distinct()


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with a link to another one; component is the smallest
    node reachable. ``links`` has two long columns; loops and repeated links do no harm."""
    links = links.toDF("src", "dst").where("src <> dst")
    # written before the Python step: the links may come from one, and a task with two holds two workers
    links = written(spark, links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), "links")
    links = written(spark, links.mapInArrow(_local_stars, LINKS), "links")
    seen = None
    for _ in range(most_rounds):
        links = written(spark, _small_star(_large_star(links)), "links")
        state = links.agg(F.count(F.lit(1)), F.sum("dst"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return links.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
