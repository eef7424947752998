"""Skew-safe ordered operators: running sums, exact ranks and row-count frames.

A plain ``Window.partitionBy(run).orderBy(it)`` sends a whole group to one task; when one
run (or one class) holds a third of all rows that task is the job. The helpers here split
every group into bounded chunks of the ordering key, compute the ordered logic inside
each chunk in parallel, and add per-chunk offsets computed on the (tiny) table of chunk
totals. Results are exact and independent of partitioning.

  prefix_sums      inclusive running sums per group (W2, W4-helpers, A-running counts)
  exact_rank       1-based rank by (hash, key) inside a stratum (D3 exact quotas)
  rolling_rows     aggregates over the last k rows per group (W1, W5 last-20 rate)
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per chunk of a unique ordering key: bounds the size of one window task.
DEFAULT_CHUNK = 1 << 20


def prefix_sums(df: DataFrame, part: list[str], order: list, chunk: Column, sums: dict[str, Column],
                maxes: dict[str, Column] | None = None, exclusive: bool = False,
                group_totals: bool = False) -> DataFrame:
    """Add inclusive running sums (``sums``: out name -> value column) and running maxima
    (``maxes``) per ``part`` ordered by ``order``.

    With ``exclusive=True`` the current row is left out (running values of the rows
    strictly before; sums start at 0, maxima at null). ``group_totals=True`` also adds
    ``<name>_total`` (the whole group's sum) from the chunk-total table: no extra pass.

    ``chunk`` must be monotone in ``order`` within a group (e.g. ``floor(id / 2^20)``);
    each (group, chunk) is one bounded window partition and the chunk offsets come from a
    window over the chunk-total table, which has rows/chunk_size rows.
    """
    maxes = maxes or {}
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    d = df.withColumn("_chunk", chunk)
    for name, v in {**sums, **maxes}.items():
        d = d.withColumn(f"_v_{name}", v)
    w_local = Window.partitionBy(*part, "_chunk").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    for name in sums:
        d = d.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(w_local))
    for name in maxes:
        d = d.withColumn(f"_l_{name}", F.max(f"_v_{name}").over(w_local))
    # Chunk totals: a map-side partially aggregated group-by over the input (only one row
    # per (group, chunk) and task is shuffled); the full-size shuffle happens once, for
    # the local window.
    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums] + [F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes]
    tot = d.groupBy(*part, "_chunk").agg(*aggs)
    w_chunks = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot
    for n in sums:
        offs = offs.withColumn(f"_o_{n}", F.coalesce(F.sum(f"_t_{n}").over(w_chunks), F.lit(0)))
    for n in maxes:
        offs = offs.withColumn(f"_o_{n}", F.max(f"_t_{n}").over(w_chunks))
    totals = []
    if group_totals:
        w_all = Window.partitionBy(*part)
        for n in sums:
            offs = offs.withColumn(f"{n}_total", F.sum(f"_t_{n}").over(w_all))
            totals.append(f"{n}_total")
    offs = offs.select(*part, "_chunk", *[f"_o_{n}" for n in list(sums) + list(maxes)], *totals)
    out = d.join(offs, on=[*part, "_chunk"], how="inner")
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_o_{n}"))
    for n in maxes:
        out = out.withColumn(n, F.greatest(F.col(f"_l_{n}"), F.col(f"_o_{n}")))
    drop = ["_chunk"] + [f"_{p}_{n}" for n in list(sums) + list(maxes) for p in ("v", "l", "o")]
    return out.drop(*drop)


def id_chunk(order_col: str, size: int = DEFAULT_CHUNK) -> Column:
    """Chunk id for a unique integer ordering key."""
    return F.floor(F.col(order_col) / F.lit(size)).cast("bigint")


def choose_bits(max_group_rows: int, target: int = 1 << 16) -> int:
    """Number of leading hash bits so that one (group, bucket) holds about ``target`` rows."""
    if max_group_rows <= target:
        return 0
    return min(40, int(math.ceil(math.log2(max_group_rows / target))))


def exact_rank(df: DataFrame, strata: list[str], hbits: str, key: str, max_group_rows: int | None = None,
               out: str = "_rank", bits: int | None = None) -> DataFrame:
    """1-based rank of each row inside its stratum ordered by (52-bit hash, key), plus the
    stratum size ``<out>_total``.

    Equals ``row_number() OVER (PARTITION BY strata ORDER BY hbits, key)`` without ever
    sorting a whole stratum in one task: rows are bucketed by the leading ``bits`` hash bits
    (by default from the largest stratum's size, which one narrow count gives, so that a bucket
    holds about 2^16 rows), ranked inside (stratum, bucket), and shifted by the counts of the
    lower buckets.
    """
    if bits is None:
        if max_group_rows is None:
            sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")) if strata else df.agg(F.count(F.lit(1)).alias("n"))
            max_group_rows = sizes.agg(F.max("n")).first()[0] or 0
        bits = choose_bits(max_group_rows)
    chunk = F.shiftright(F.col(hbits), 52 - bits) if bits > 0 else F.lit(0)
    if not strata:
        d = df.withColumn("_all", F.lit(0))
        return prefix_sums(d, ["_all"], [hbits, key], chunk, {out: F.lit(1)}, group_totals=True).drop("_all")
    return prefix_sums(df, strata, [hbits, key], chunk, {out: F.lit(1)}, group_totals=True)


def rolling_rows(df: DataFrame, part: list[str], order: str, k: int, aggs: dict[str, callable],
                 chunk_rows: int = DEFAULT_CHUNK) -> DataFrame:
    """Aggregates over the frame of the last ``k`` rows (current included) per group ordered
    by ``order`` (a unique key within the group).

    ``aggs`` maps output name -> function(frame_window) returning a Column. Steps: exact
    row index per group (``prefix_sums``), dense chunks of ``chunk_rows`` indices, the last
    k-1 rows of every chunk copied into the next chunk, one bounded window per chunk, copies
    dropped. Equivalent to ``rowsBetween(-(k-1), 0)`` over the whole group.
    """
    assert chunk_rows >= k
    idx = prefix_sums(df, part, [order], id_chunk(order) if isinstance(order, str) else order,
                      {"_idx": F.lit(1)})
    idx = idx.withColumn("_c", F.floor((F.col("_idx") - 1) / F.lit(chunk_rows)).cast("bigint"))
    tail = (idx.filter(((F.col("_idx") - 1) % F.lit(chunk_rows)) >= F.lit(chunk_rows - (k - 1)))
            .withColumn("_c", F.col("_c") + 1).withColumn("_borrowed", F.lit(True)))
    both = idx.withColumn("_borrowed", F.lit(False)).unionByName(tail)
    w = Window.partitionBy(*part, "_c").orderBy("_idx").rowsBetween(-(k - 1), 0)
    for name, fn in aggs.items():
        both = both.withColumn(name, fn(w))
    return both.filter(~F.col("_borrowed")).drop("_c", "_borrowed")


def searchsorted(df: DataFrame, edges: str, x: str, n: int, out: str) -> DataFrame:
    """Number of entries <= x in the ascending array column ``edges`` of length n: binary
    lifting over ceil(log2(n+1)) steps inside ONE ``aggregate`` expression (a chain of
    self-referencing columns would be inlined into an exponential expression tree)."""
    bits = max(n, 1).bit_length()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    e, v = F.col(edges), F.col(x)

    def lift(acc, s):
        cand = acc + s
        return F.when(cand <= F.lit(n), F.when(F.element_at(e, cand) <= v, cand).otherwise(acc)).otherwise(acc)

    return df.withColumn(out, F.aggregate(steps, F.lit(0), lift))
