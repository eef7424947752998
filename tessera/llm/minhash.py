"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

Each distinct word shingle draws, level by level, a random rank and the next place of its own
random permutation of the signature; a place keeps its smallest (level, rank). A document
stops as soon as no place can improve, so long texts need one or two levels and the ranks
within a signature are correlated, which lowers the estimate's variance. The levels of all
documents of a batch are computed together in numpy.

Equal sets become one class by a 128-bit sum over the set; the smallest id stands for it.
Signatures are cut in bands; classes that share a band are candidates. Candidates are checked
on full sets in two steps that lose no link between components and list no bucket's pairs:

1. Every member of a bucket is compared with one pivot of that bucket (another one in each
   band, by hash). The links' connected components are taken.
2. Buckets whose members still lie in several components are checked for links across
   components: their sets go to tasks in tiles of bounded size, where an inverted index
   counts all intersections at once, and one link per pair of components is returned. A
   bucket beyond one tile is dealt out in blocks, every pair of blocks making a tile.

The number of bands is such that a pair at the threshold is missed with a probability of at
most ``MISS``; more similar pairs are missed far less often.

Defined results: A-Z are lower-cased, words are runs without ASCII white space; a text with
fewer words than a shingle has its whole sequence as its one shingle; a text that is null or
without words has an empty set, is linked with nothing and kept; rows that share an id are one
node, linked if any of them is, and each gets its own row; a null id takes no part, has no
component and is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, mix64, shingle_hashes, text_slices, tidy, word_hashes, written
from .components import components

MISS = 1e-5
MOST_RANKS = 128
#: A tile of step 2 holds at most two blocks of about this many members and shingles.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2_000, 2_000_000
_GOLD = 0x9E3779B97F4A7C15


def banding(threshold: float, miss: float = MISS, most: int = MOST_RANKS) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band that keep to ``miss`` within ``most``
    ranks."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no banding for threshold {threshold}")


def super_minhash(shingle: np.ndarray, row: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """[row, m] signature ranks (level in the top byte, random rank below) of the distinct
    shingles of each row; all ones for a row without shingles."""
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    sign = np.full(n_rows * m, worst, np.uint64)
    h, owner = shingle, row
    swaps: list[np.ndarray] = []
    for level in range(m):
        if level:
            top = sign.reshape(n_rows, m).max(1)
            active = top[owner] >= np.uint64(level << 56)
            if not active.any():
                break
            if not active.all():
                h, owner, swaps = h[active], owner[active], [k[active] for k in swaps]
        if not len(h):
            break
        draw = mix64(h + np.uint64((level + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        slot = (level + ((mix64(draw ^ np.uint64(_GOLD)) >> np.uint64(33)) % np.uint64(m - level)).astype(np.int64)
                ).astype(np.uint8)
        place = slot.copy()  # where the permutation's swaps so far put this slot's content
        for i in range(level - 1, -1, -1):
            place[place == swaps[i]] = i
        swaps.append(slot)
        np.minimum.at(sign, owner * m + place, (draw >> np.uint64(8)) | np.uint64(level << 56))
    return sign.reshape(n_rows, m)


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[row, band] 64-bit keys; the band is part of the key."""
    out = np.empty((len(sign), bands), np.int64)
    for b in range(bands):
        key = np.full(len(sign), np.uint64(b + 1), np.uint64)
        for j in range(rows):
            key = mix64(key * np.uint64(_GOLD) + sign[:, b * rows + j])
        out[:, b] = key.view(np.int64)
    return out


def _sets(column, width: int):
    """Runs of rows with their shingle sets: (first row, row after the last, owner, hash)."""
    for row, to, starts, raw in text_slices(column):
        word, owner, _, _ = word_hashes(raw, starts)
        yield row, to, *shingle_hashes(word, owner, to - row, width)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, f1, f2, bands) of (id, text) rows; no bands for an empty set."""

    def run(batches):
        for b in batches:
            for row, to, owner, shingle in _sets(b.column(1), width):
                n = to - row
                count = np.bincount(owner, minlength=n)
                keys = band_keys(super_minhash(shingle, owner, n, bands * rows), bands, rows)
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    run_ = np.concatenate([[np.uint64(0)], np.cumsum(mix64(shingle ^ np.uint64(salt)), dtype=np.uint64)])
                    ends = np.cumsum(count)
                    sums.append((run_[ends] - run_[ends - count]).view(np.int64))
                full = count > 0
                offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, n), pa.array(count.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))],
                    names=["id", "n", "f1", "f2", "bands"])

    return docs.mapInArrow(tidy(run), "id long, n long, f1 long, f2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, shingles) with the sorted 64-bit hashes as bytes, of (id, text) rows."""

    def run(batches):
        for b in batches:
            for row, to, owner, shingle in _sets(b.column(1), width):
                n = to - row
                count = np.bincount(owner, minlength=n)
                offsets = np.concatenate([[0], np.cumsum(count * 8)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(shingle.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), pa.array(count.astype(np.int64)), data],
                                                 names=["id", "n", "shingles"])

    return docs.mapInArrow(tidy(run), "id long, n long, shingles binary")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst, a, b) whose sets' Jaccard similarity is at least ``percent`` / 100."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(a.as_buffer(), np.uint64)
                y = np.frombuffer(b.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(tidy(run), "src long, dst long")


def tile_links(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links across components among a tile's members: for each member outside the largest
    component, one linked partner in every other component that has any."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    _, code = np.unique(flat, return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(code))])
    posting = owner[order]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    names, which, counts = np.unique(groups, return_inverse=True, return_counts=True)
    largest = counts.argmax()
    out = []
    for i in np.flatnonzero(which != largest):
        own = code[begin[i]:begin[i + 1]]
        lengths = bounds[own + 1] - bounds[own]
        index = np.repeat(bounds[own] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[index], minlength=n)
        linked = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[i] + sizes - both)) & (which != which[i]))
        _, first = np.unique(which[linked], return_index=True)
        out += [(int(ids[i]), int(ids[j])) for j in linked[first]]
    return out


def _tiles_linked(members: DataFrame, percent: int) -> DataFrame:
    """Links of tiles given as rows (tile, id, component, shingles)."""

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for c in group["shingles"].chunks for s in c]
        links = tile_links(group["id"].to_numpy(), group["component"].to_numpy(), sets, percent)
        return pa.table({"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())})

    return members.groupBy("bucket", "x", "y").applyInArrow(run, "src long, dst long")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: documents are linked if their sets' Jaccard
    similarity is at least ``percent`` / 100."""
    bands, rows = banding(percent / 100)
    texts = bound_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    signed = written(spark, signatures(texts, width, bands, rows), "minhash-signatures")
    classes = written(spark, signed.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands")), "minhash-classes")
    # the classes of an id with several sets are linked through the id
    own = classes.select("n", "f1", "f2", "rep")
    of_id = signed.where("n > 0 and id is not null").select("id", "n", "f1", "f2")
    one = F.struct("n", "f1", "f2")
    several = of_id.groupBy("id").agg(F.min(one).alias("s1"), F.max(one).alias("s2")).where("s1 <> s2").select("id")
    same_id = (of_id.join(several, "id", "left_semi").join(own, ["n", "f1", "f2"])
               .select(F.col("id").alias("src"), F.col("rep").alias("dst")))

    entries = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"),
        F.min_by("rep", F.xxhash64("bucket", "rep")).alias("pivot"))
    shared = entries.join(buckets.where("size > 1"), "bucket")
    shared = written(spark, shared.select("bucket", "rep", "n", "size", "shingles", "pivot"), "minhash-shared")

    sizes = classes.select(F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"))
    pairs = shared.where("rep <> pivot").select("pivot", "rep", "n").distinct()
    pairs = (pairs.join(sizes, "pivot").where(f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)")
             .select(F.col("pivot").alias("src"), F.col("rep").alias("dst")))
    pairs = written(spark, pairs.distinct(), "minhash-pairs")
    wanted = written(spark, pairs.select("src").union(pairs.select("dst")).distinct().toDF("w"), "minhash-wanted")
    sets = shingle_sets(texts.join(wanted, F.col("id") == F.col("w"), "left_semi"), width)
    sets = written(spark, sets, "minhash-sets")
    a = sets.select(F.col("id").alias("src"), F.col("shingles").alias("a"))
    b = sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b"))
    links = _verified(pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b"), percent).union(same_id)
    found = written(spark, components(spark, links), "minhash-components")

    placed = (shared.where("size > 2").join(found, F.col("rep") == F.col("node"), "left")
              .select("bucket", "rep", "n", "size", "shingles", F.coalesce("component", "rep").alias("component")))
    mixed = (placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
             .where("c1 <> c2").select("bucket"))
    left = written(spark, placed.join(mixed, "bucket"), "minhash-left")
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK_MEMBERS)), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES)))
    tiles = (left.withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")))
             .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
             .select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", "component"))
    wanted2 = written(spark, left.select("rep").distinct().toDF("w"), "minhash-wanted")
    sets2 = shingle_sets(texts.join(wanted2, F.col("id") == F.col("w"), "left_semi"), width)
    across = _tiles_linked(tiles.join(sets2, F.col("rep") == F.col("id"))
                           .select("bucket", "x", "y", F.col("rep").alias("id"), "component", "shingles"), percent)
    across = written(spark, across, "minhash-across")
    if not across.isEmpty():
        found = written(spark, components(spark, found.toDF("src", "dst").union(across)), "minhash-components")

    own = own.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("n").alias("c_n"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.coalesce("component", "rep").alias("component"))
    out = signed.join(own, (F.col("n") == F.col("c_n")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without the near duplicates of another: the smallest id of each group
    stays. Of rows that repeat an id and a text one stays."""
    from pyspark.sql import Window

    found = written(spark, near_duplicates(spark, docs, width, percent, id_col, text_col), "minhash-result")
    dropped = written(spark, found.where("not kept").select(F.col(id_col).alias("dropped_id")).distinct(), "minhash-dropped")
    repeated = written(spark, found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("again_id")).count()
                       .where("count > 1").select("again_id"), "minhash-repeated")
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key, text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")
    out = docs.join(dropped, key == F.col("dropped_id"), "left_anti")
    if repeated.isEmpty():
        return out.select("row.*")
    once = out.join(repeated, key == F.col("again_id"), "left_anti")
    again = (out.join(repeated, key == F.col("again_id"), "left_semi")
             .withColumn("r", F.row_number().over(Window.partitionBy(key, F.xxhash64(text)).orderBy(text)))
             .where("r = 1").drop("r"))
    return once.union(again).select("row.*")
