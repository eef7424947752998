"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` places on a ring, given by a hash of its name. A document's key
hash gives its place; the places fall in ``2**cell_bits`` equal cells, and a cell belongs to
the next virtual node clockwise. No shard may hold more than (1 + ``slack``) times the mean
load; cells that a full shard can't take continue clockwise to the next virtual node of a
shard with room. Large cells are placed before small ones, so that what continues is small
and few documents move. Only the cells' totals, a table of fixed size, reach the driver;
documents are assigned by a join with the cells' places, and numbered by a cell's offset
plus their rank within the cell. So no task holds a whole shard.

Law ``bytes``: the sizes of the shards are near equal.

Defined results: a null text has no bytes and counts its fixed 16; a null id is keyed by its
text's checksum and size; rows that share an id are spread over the cells by their place in
the written table of sizes; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

CELL_BITS = 16
VNODES = 64
SLACK = 0.002
#: Bytes that a document weighs besides its text.
ROW_BYTES = 16


def ring(n_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in [0, 2**64), shards) of all virtual nodes, clockwise."""
    nodes = sorted((int.from_bytes(hashlib.md5(f"shard-{s}-{v}".encode()).digest()[:8], "big"), s)
                   for s in range(n_shards) for v in range(vnodes))
    return np.array([p for p, _ in nodes], np.uint64), np.array([s for _, s in nodes], np.int64)


def place_cells(cells: np.ndarray, sizes: np.ndarray, n_shards: int, vnodes: int, slack: float,
                cell_bits: int) -> np.ndarray:
    """Shard of each cell. Cells come largest first, equal ones by number; each goes to the
    first shard clockwise from its place that still has room for it. Where none has (a cell
    larger than the room that slack leaves anywhere), it goes to the least loaded shard, the
    first such one clockwise."""
    places, owners = ring(n_shards, vnodes)
    at = np.searchsorted(places, cells.astype(np.uint64) << np.uint64(64 - cell_bits)) % len(places)
    limit = sizes.sum() / n_shards * (1 + slack)
    loads = np.zeros(n_shards)
    out = np.empty(len(cells), np.int64)
    clockwise: dict[int, list[int]] = {}
    for i in np.lexsort((cells, -sizes)):
        home = int(at[i])
        way = clockwise.get(home)
        if way is None:
            turned = np.roll(owners, -home)
            way = clockwise[home] = list(dict.fromkeys(turned.tolist()))
        size = sizes[i]
        shard = next((s for s in way if loads[s] + size <= limit), None)
        if shard is None:
            shard = min(way, key=loads.__getitem__)
        loads[shard] += size
        out[i] = shard
    return out


def shard(spark: SparkSession, docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          vnodes: int = VNODES, slack: float = SLACK, cell_bits: int = CELL_BITS) -> DataFrame:
    """id, size, text_crc32, shard and slot (gapless from 0 within the shard) of every row."""
    text = F.col(text_col)
    sized = written(spark, docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "shard-sizes")
    repeated = sized.groupBy("id").count().where("count > 1").select(F.col("id").alias("again"))
    key = F.when(F.col("again").isNotNull(), F.xxhash64("id", "row")) \
        .when(F.col("id").isNull(), F.xxhash64("text_crc32", "size", "row")).otherwise(F.xxhash64("id"))
    keyed = (sized.join(repeated, F.col("id") == F.col("again"), "left").withColumn("key", key).drop("again")
             .withColumn("cell", F.shiftrightunsigned("key", 64 - cell_bits)))
    totals = keyed.groupBy("cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toPandas()
    totals = totals.sort_values("cell", ignore_index=True)
    totals["shard"] = place_cells(totals["cell"].to_numpy(np.int64), totals["size"].to_numpy(np.float64), n_shards,
                                  vnodes, slack, cell_bits)
    totals["first"] = totals.groupby("shard")["n"].cumsum() - totals["n"]
    places = spark.createDataFrame(pd.DataFrame({"cell": totals["cell"].astype("int64"),
                                                 "shard": totals["shard"].astype("int32"),
                                                 "first": totals["first"].astype("int64")}),
                                   "cell long, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "id", "row"))
    # at most 2**cell_bits rows of 20 bytes: the bound of what is broadcast
    return (keyed.withColumn("rank", rank).join(F.broadcast(places), "cell")
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("first") + F.col("rank") - 1).cast("long").alias("slot")))
