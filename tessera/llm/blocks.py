"""Looking up every distinct term of a corpus once, and joining the answers back by position.

Tasks cut their rows in blocks of some megabytes of text and split each block's texts in
terms. A block sends each of its distinct terms once, dealt to buckets by the term's hash; so a
term that a third of all rows hold is sent once a block. A bucket's task keeps a table of its
distinct terms and answers every block's request in the request's order. The block's documents
(as positions in the block's list of terms) meet the answers again by block number.

The split runs in both branches of the plan (terms and documents), as that costs less than
keeping its output; both come to the same blocks, since a block is a run of rows of one
partition of a table scan. A checksum of a block's terms travels with both sides, and a lost
or different block fails the job instead of mixing up answers. ``docs`` must therefore be a
scan with row-wise steps only; write it first where it isn't.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, give_back, span_hash, string_buffers, tidy, written

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes of stored input for each bucket of terms.
BUCKET_BYTES = 64 << 20
#: Lengths in bytes of the prefixes that a term's bucket may depend on; past the last, the whole term.
DEPTHS = (4, 8, 16, 32, 64)


def squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def stretch(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack(x: np.ndarray) -> bytes:
    """A non-negative integer array as compressed byte planes, so that small values are
    small; its length and width come first."""
    x = np.ascontiguousarray(x.astype(np.uint64))
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + bytes([width]) + squeeze(planes)


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(stretch(data[9:], n * width), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64).astype(np.int64)


@dataclass
class Block:
    """Rows in order: their ids (an Arrow array), each row's number of positions, the positions
    in the list of distinct terms, and the terms' buckets. ``terms(bucket)`` packs the terms of
    a bucket in list order, ``extra`` is what the block's finish needs besides."""

    ids: pa.Array
    lengths: np.ndarray
    codes: np.ndarray
    buckets: np.ndarray
    check: int
    terms: Callable[[np.ndarray], bytes]
    extra: bytes = b""


def text_runs(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """(id, text) rows in runs of about ``size`` bytes of text, in order, independent of how
    the rows came in batches."""
    held, weight = [], 0
    for b in batches:
        offsets, _ = string_buffers(b.column(1))
        lengths = offsets[1:] - offsets[0]
        at = 0
        while at < b.num_rows:
            base = lengths[at - 1] if at else 0
            to = int(np.searchsorted(lengths, base + size - weight)) + 1
            if to > b.num_rows:
                held.append(b.slice(at))
                weight += int(lengths[-1] - base)
                break
            held.append(b.slice(at, to - at))
            yield pa.Table.from_batches(held).combine_chunks()
            held, weight, at = [], 0, to
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def positions(buckets: np.ndarray) -> dict[int, np.ndarray]:
    """Bucket -> places of its terms in the block's list, ascending."""
    order = np.argsort(buckets, kind="stable")
    own, first = np.unique(buckets[order], return_index=True)
    return dict(zip(own.tolist(), np.split(order, first[1:]), strict=True)) if len(order) else {}


def _number(made: int) -> int:
    return (TaskContext.get().partitionId() << 24) + made


def lookup(docs: DataFrame, blocks: Callable[[pa.Table], Block], answer: Callable[[], Callable[[list], list[bytes]]],
           finish: Callable, id_type: str, out: str, buckets: int, hold: bool = False, size: int | None = None) -> DataFrame:
    """``docs`` is (id, text). ``blocks`` makes a block of a run of rows. ``answer()`` makes a
    task's function from packed requests to packed answers: called with one request at a time,
    or with all of the task's requests where an answer needs them together (``hold``); answers may
    then come one after the other.
    ``finish(ids, lengths, codes, buckets, answers, extra)`` makes the block's result, with
    ``answers`` by bucket; ``out`` is its schema. ``size`` is a block's bytes of text
    (``BLOCK_BYTES`` if not given)."""
    size = size or BLOCK_BYTES


    def requests(batches):
        for made, run in enumerate(text_runs(batches, size)):
            b = blocks(run)
            rows = [(x, b.terms(at)) for x, at in positions(b.buckets).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in rows], pa.int32()), pa.array([_number(made)] * len(rows), pa.int64()),
                 pa.array([b.check] * len(rows), pa.int64()), pa.array([t for _, t in rows], pa.binary())],
                names=["bucket", "block", "mark", "data"])
            give_back()

    def kept(batches):
        for made, run in enumerate(text_runs(batches, size)):
            b = blocks(run)
            ids = pa.RecordBatch.from_arrays([b.ids], names=["id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            raw = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([_number(made)], pa.int64()), pa.array([b.check], pa.int64()),
                 pa.array([squeeze(raw)]), pa.array([len(raw)], pa.int64()),
                 pa.array([pack(b.lengths)]), pa.array([pack(b.codes)]), pa.array([pack(b.buckets)]), pa.array([b.extra], pa.binary())],
                names=["block", "mark", "ids", "ids_size", "lengths", "codes", "buckets", "extra"])
            give_back()

    def answered(batches):
        give = answer()
        rows = (r for b in batches for r in b.to_pylist())
        if hold:
            rows = list(rows)
            pairs = zip(rows, give([r["data"] for r in rows]), strict=True)
        else:
            pairs = ((r, give([r["data"]])[0]) for r in rows)
        for r, a in pairs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["bucket"]], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([r["mark"]], pa.int64()),
                 pa.array([a], pa.binary())], names=["bucket", "block", "mark", "data"])

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = left.to_pylist()
        if len(mine) != 1:
            raise RuntimeError(f"{len(mine)} blocks of one number: docs must be a scan with row-wise steps")
        r = mine[0]
        which = unpack(r["buckets"])
        got = {x["bucket"]: x for x in right.to_pylist()}
        if {*np.unique(which).tolist()} != {*got} or any(x["mark"] != r["mark"] for x in got.values()):
            raise RuntimeError("a block's terms differ between the branches: docs must be a scan with row-wise steps")
        with pa.ipc.open_stream(stretch(r["ids"], r["ids_size"])) as s:
            ids = s.read_all().column(0).combine_chunks()
        out = finish(ids, unpack(r["lengths"]), unpack(r["codes"]), which, {k: x["data"] for k, x in got.items()}, r["extra"])
        give_back()
        return out

    docs = bound_batches(docs)
    asked = docs.mapInArrow(tidy(requests), "bucket int, block long, mark long, data binary")
    replies = asked.repartition(buckets, "bucket").mapInArrow(tidy(answered), "bucket int, block long, mark long, data binary")
    rows = docs.mapInArrow(tidy(kept), "block long, mark long, ids binary, ids_size long, lengths binary, codes binary, "
                                 "buckets binary, extra binary")
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(joined, out)


# ------------------------------------------------------------------ blocks of words
#: A slice of rows as spans of bytes: (bytes, row, first byte, byte after the last), in order.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def prefix_length(word: bytes, hot: set[bytes]) -> int:
    """The first of ``DEPTHS`` at which the word's prefix isn't hot, or the word's length."""
    for depth in DEPTHS:
        if depth >= len(word) or word[:depth] not in hot:
            return depth
    return len(word)


def hot_prefixes(docs: DataFrame, spans: Callable, buckets: int) -> set[bytes]:
    """Prefixes of the lengths ``DEPTHS`` that hold more than about half a bucket's share of the
    requested words, at each length. A block reports what has over a quarter of a bucket's share of
    its own words, so a prefix with half a share in all is reported with a quarter at the least;
    the reports are added up, held against the total and written by Spark, and only hot prefixes, at
    most ``4 * len(DEPTHS)`` a bucket, reach the driver."""

    def reports(batches):
        for run in text_runs(batches):
            words: list[bytes] = []
            word_block(spans, 1, words)(run)
            found = [(None, len(words))]
            for depth in DEPTHS:
                counts = Counter(w[:depth] for w in words if len(w) > depth)
                found += [(p, n) for p, n in counts.items() if n * 4 * buckets > len(words)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())],
                                             names=["prefix", "n"])

    seen = bound_batches(docs).mapInArrow(tidy(reports), "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    seen = written(docs.sparkSession, seen, "prefix-counts")
    total = seen.where(F.col("prefix").isNull()).agg(F.sum("n")).first()[0] or 0
    hot = seen.where(F.col("prefix").isNotNull() & (F.col("n") > 1) & (F.col("n") * F.lit(4 * buckets) >= F.lit(total)))
    return {bytes(r["prefix"]) for r in hot.select("prefix").collect()}


def word_block(spans: Callable[[pa.Array], Iterator[tuple[int, int, Spans]]], buckets: int, listed: list | None = None,
               hot: set[bytes] | None = None) -> Callable[[pa.Table], Block]:
    """Blocks whose terms are strings without line feeds. ``spans`` cuts a column of texts in
    slices (first row, row after the last, spans). Equal spans are found by two independent
    64-bit hashes. A term's bucket depends on all its bytes, or with ``hot`` on its shortest prefix
    (``DEPTHS``) that isn't in there. The block's terms are added to ``listed``."""

    def make(run: pa.Table) -> Block:
        column = flat(run.column(1))
        lengths = np.zeros(len(column), np.int64)
        codes, keys, checks, words = [], [], [], []
        known = 0
        for row, to, (raw, owner, a, b) in spans(column):
            lengths[row:to] = np.bincount(owner, minlength=to - row)
            own, first, code = np.unique(span_hash(raw, a, b), return_index=True, return_inverse=True)
            second = span_hash(raw, a, b, 1)
            if not np.array_equal(second, second[first][code]):
                raise RuntimeError("two terms have the same hash")
            data = raw.tobytes()
            words += [data[x:y] for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True)]
            codes.append(code + known)
            keys.append(own)
            checks.append(second[first])
            known += len(own)
        if not words:
            return Block(flat(run.column(0)), lengths, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, lambda at: b"")
        key, check = np.concatenate(keys), np.concatenate(checks)
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        if not np.array_equal(check, check[first][same]):
            raise RuntimeError("two terms have the same hash")
        code = same[np.concatenate(codes)]
        order = np.argsort(-np.bincount(code, minlength=len(first)), kind="stable")  # frequent terms get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        terms_ = [words[i] for i in first[order].tolist()]
        if listed is not None:
            listed.extend(terms_)
        which = np.fromiter((zlib.crc32(w if hot is None else w[:prefix_length(w, hot)]) % buckets for w in terms_), np.int64, len(terms_))

        def terms(at: np.ndarray) -> bytes:
            data = b"\n".join([terms_[i] for i in at])
            return len(data).to_bytes(8, "little") + squeeze(data)

        return Block(flat(run.column(0)), lengths, rank[code], which, zlib.crc32(b"\n".join(terms_)), terms)

    return make


def flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks or [pa.array([], column.type)])


def asked_words(request: bytes) -> list[str]:
    return stretch(request[8:], int.from_bytes(request[:8], "little")).decode().split("\n")


def word_table(encode: Callable[[list[str]], list]) -> Callable[[list[str]], list]:
    """A task's table of distinct words: ``encode`` sees each word once."""
    table: dict = {}

    def get(words: list[str]) -> list:
        new = [w for w in words if w not in table]
        if new:
            table.update(zip(new, encode(new), strict=True))
        return [table[w] for w in words]

    return get


def bucket_count(docs: DataFrame) -> int:
    """Buckets of terms: as many as the session's shuffles have partitions, or one for every
    ``BUCKET_BYTES`` of the scanned files if that is more."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:  # Spark knows no size
        size = 0
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
