"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table under the shared checkpoint folder and read it back: the
    lineage is cut and a lost executor costs no more than the tasks it was running."""
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of text that a Python task takes at a time.
BATCH_ROWS = 1_000


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, after making the session hand texts to Python in batches of at most BATCH_ROWS rows:
    the default of 10,000 rows of some kilobytes would take a worker's memory many times over."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that was written under the checkpoint folder and is no longer read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_key(seed: str, *cols: Column) -> Column:
    """Hash-random key of a row: 32 hex digits, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]))


def unit(hex32: Column) -> Column:
    """The first 12 hex digits of a key as a double in [0, 1)."""
    return F.conv(F.substring(hex32, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


# ------------------------------------------------------------------ numpy, inside tasks
def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, and what a
    worker's allocators hold back counts against the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A task's generator of batches that gives memory back when it is done."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column without a copy; a null has no bytes."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends, raw


def text_slices(column, limit: int = 1 << 18):
    """Cut an Arrow string column in runs of rows of about ``limit`` bytes (one row at the
    least): yields (first row, row after the last, start of each row and end of the last,
    bytes), the starts counted from the run's first byte."""
    offsets, raw = string_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to, offsets[at:to + 1] - offsets[at], raw[offsets[at]:offsets[to]]
        at = to


_POWERS: dict[int, np.ndarray] = {}
#: Odd multipliers of two independent polynomial hashes modulo 2**64, with their inverses.
_BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        full = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=np.uint64)
        full[0] = 1
        got = _POWERS[base] = np.multiply.accumulate(full)
    return got[:n]


def span_hash(raw: np.ndarray, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes [a, b) for each span: a polynomial over the bytes, taken as a
    difference of one running sum, with the length, then mixed; equal spans have equal hashes."""
    base, inverse = _BASES[which]
    n = len(raw)
    if len(a) == 0:
        return np.zeros(0, np.uint64)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=run[1:])
    value = (run[b] - run[a]) * _powers(inverse, n + 1)[a]  # an empty span may begin at the end
    return mix64(value + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte after the last) of every word in concatenated texts, in order. A
    text's end ends a word."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = starts[1:-1]
    cut = cut[cut < n]
    first[cut] = solid[cut]  # a text's first byte begins a word
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = cut[cut > 0] - 1
    last[before] = solid[before]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(starts, a, side="right") - 1, a, b


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, byte after the last) of every word, A-Z lower-cased."""
    row, a, b = word_spans(raw, starts)
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    return span_hash(low, a, b), row, a, b


def shingle_hashes(word: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``width``-word shingles of each row, sorted by both. A row
    with fewer words has its whole sequence as its one shingle; without words it has none."""
    counts = np.bincount(row, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    total = len(word)
    if total == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(total) - begin[row]
    value = np.full(total, np.uint64(width), np.uint64)
    left = counts[row]
    for j in range(width):
        use = np.minimum(np.arange(total) + j, total - 1)
        inside = at + j < left
        step = mix64(value ^ (word[use] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        value = np.where(inside, step, value)
    keep = (at + width <= left) | (at == 0)
    value, owner = value[keep], row[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]
