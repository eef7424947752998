"""Alignment of two tokenizers' tokens over a corpus, with corpus-wide counts of linked ids.

Every document is a space and its text, encoded by a byte-level BPE (A) and by a piece BPE with byte
fallback (B). Offsets where tokens of both end cut the tokens into groups; a token of A and one
of B in one group are linked. Neither vocabulary has an entry that goes on over a space after a
non-space, so a text falls apart there into chunks that are encoded and aligned once a block.

1. One pass over the texts: blocks of them give the distinct linked id pairs of each document, counted
   per block and dealt to ``BUCKETS`` hash buckets, and all that needs no corpus-wide count: the documents'
   other columns, their chunks, and each chunk's links as places in the block's sorted pairs.
2. The blocks' pairs are united up a tree, and each bucket's distinct pairs get a minimal perfect
   hash: levels of bits, where a pair that is alone at its place of a level stays there and the
   others go to the next; the place is the number of set bits before. The pairs stand at their
   places and verify each look-up.
3. Branches of the tree add their blocks' counts in dense vectors indexed by the hash, and the
   vectors are summed up the tree. The highest count of each id of A is one number an entry.
4. The blocks' pairs are looked up, the answers meet the blocks' documents by block number, and the
   counts of each document's links are added up; no text is read or aligned twice.

A group of a task is a branch's part of a bucket or a block; nothing grows with the corpus in one
task, on the driver or in a broadcast. Blocks are runs of rows of a partition and are written once; a
checksum of a block's pairs travels with its documents (a pair without a count fails the job).

Defined results: null and empty texts, and those that a tokenizer's bytes don't give back (U+2581
in a text), have no tokens, zeros and '' for the digest; repeated rows are documents of their own and
count as such; a null id is kept; special tokens' strings are plain text; an empty table gives an
empty table; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .bpe import byte_letters
from .common import bound_batches, give_back, mix64, text_slices, tidy, written

#: Hash buckets of pairs.
BUCKETS = 128
#: Partitions' (then branches') results that one task of the tree takes together.
FAN = 256
#: Chunks whose alignment a task keeps for its next blocks.
KEPT_CHUNKS = 400_000
#: Chunks that are encoded together.
SLICE = 20_000
#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ------------------------------------------------------------------ tokenizers, inside tasks
@lru_cache(maxsize=2)
def loaded_a(source: str):
    """(encoding, bytes of each id) of a byte-level BPE given as JSON; ids rank its merges."""
    import tiktoken

    spec = json.loads(source)
    special = {t["content"] for t in spec["added_tokens"]}
    back = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    entries = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        entries[i] = raw
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), entries


@lru_cache(maxsize=2)
def loaded_b(model: bytes):
    """(processor, bytes of each id) of a piece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    entries = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
    return sp, entries


def space_before(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of spaces, but for a text's last byte, that follow a byte of it which can't end white space."""
    at = np.flatnonzero(raw == 32)
    if len(at) == 0:
        return at
    at = at[~np.isin(at, starts[:-1]) & ~np.isin(at + 1, starts[1:])]
    last = raw[at - 1]
    odd = (last == 32) | ((last >= 9) & (last <= 13)) | ((last >= 28) & (last <= 31))
    # two and three bytes long: U+0085, U+00A0, U+1680, U+2000 to U+3000 by their last and first bytes
    tail = ((last >= 0x80) & (last <= 0x8A)) | np.isin(last, [0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
    two, three = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    return at[~(odd | (tail & ((two == 0xC2) | np.isin(three, [0xE1, 0xE2, 0xE3]))))]


def chunk_spans(column: pa.Array):
    """Slices of a column of texts as spans of their chunks, without the space before each."""
    for row, to, starts, raw in text_slices(column):
        cuts = space_before(raw, starts)
        full = np.flatnonzero(starts[1:] > starts[:-1])
        owner = np.concatenate([full, np.searchsorted(starts, cuts, side="right") - 1])
        a = np.concatenate([starts[full], cuts + 1])
        order = np.lexsort((a, owner))
        owner, a = owner[order], a[order]
        b = starts[owner + 1]
        inner = owner[1:] == owner[:-1]
        b[:-1][inner] = a[1:][inner] - 1
        yield row, to, (raw, owner, a, b)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``begin``, one after the other."""
    total = int(size.sum())
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)


class Aligned:
    """Chunks with their alignment, by number; arrays of pairs are (begin, size) runs."""

    def __init__(self, source: str, model: bytes, digests: bool):
        self.source, self.model, self.digests = source, model, digests
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.numbers = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whole
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text: list[str] = []

    def places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of a block's chunks; new ones are aligned first."""
        if len(self.known) > KEPT_CHUNKS:
            self.clear()
        known = self.known
        new = [w for w in words if w not in known]
        for at in range(0, len(new), SLICE):
            part = new[at:at + SLICE]
            first = len(known)
            known.update(zip(part, range(first, first + len(part)), strict=True))
            self._add(part)
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def _encoded(self, part: list[bytes]):
        """Flat ids of A and of B with their chunks."""
        enc, _ = loaded_a(self.source)
        sp, _ = loaded_b(self.model)
        texts = [w.decode() for w in part]
        b_ids = sp.encode(texts, num_threads=1)
        a_ids = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and not t[0].isspace() and not t[-1].isspace()]
        for i in set(range(len(texts))).difference(plain):
            a_ids[i] = enc.encode_ordinary(" " + texts[i])
        a_len = _lengths_a(self.source)
        together = np.array(enc.encode_ordinary("".join([" " + texts[i] for i in plain])), np.int64) if plain else np.zeros(0, np.int64)
        ends = np.cumsum([len(part[i]) + 1 for i in plain])
        chunk = np.searchsorted(ends, np.cumsum(a_len[together]), side="left")
        others = [i for i in range(len(texts)) if a_ids[i] is not None]
        a = np.concatenate([together, np.array([x for i in others for x in a_ids[i]], np.int64)])
        a_of = np.concatenate([np.array(plain, np.int64)[chunk], np.repeat(np.array(others, np.int64), [len(a_ids[i]) for i in others])])
        order = np.argsort(a_of, kind="stable")
        sizes = [len(x) for x in b_ids]
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, sum(sizes))
        return a[order], a_of[order], b, np.repeat(np.arange(len(part)), sizes)

    def _add(self, part: list[bytes]) -> None:
        a, a_of, b, b_of = self._encoded(part)
        n = len(part)
        (_, a_bytes), (_, b_bytes) = loaded_a(self.source), loaded_b(self.model)

        def bytes_of(ids, of, entries):
            at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).tolist()
            got = [entries[i] for i in ids.tolist()]
            return [b"".join(got[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]

        def kept(ids, of, entries, lengths):
            """All chunks of the slice have their length and its joined bytes are theirs."""
            return (np.array_equal(np.bincount(of, lengths[ids], n), want)
                    and b"".join([entries[i] for i in ids.tolist()]) == joined)

        want = np.fromiter(map(len, part), np.int64, n) + 1
        joined = b" " + b" ".join(part)
        if kept(a, a_of, a_bytes, _lengths_a(self.source)) and kept(b, b_of, b_bytes, _lengths_b(self.model)):
            whole = np.ones(n, bool)
        else:
            whole = np.array([x == y == b" " + w for x, y, w in
                              zip(bytes_of(a, a_of, a_bytes), bytes_of(b, b_of, b_bytes), part, strict=True)], bool)
        keep_a, keep_b = whole[a_of], whole[b_of]
        a, a_of, b, b_of = a[keep_a], a_of[keep_a], b[keep_b], b_of[keep_b]

        # both sides have the same bytes in all, so running sums of lengths are offsets of one text
        a_end, b_end = np.cumsum(_lengths_a(self.source)[a]), np.cumsum(_lengths_b(self.model)[b])
        cut = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cut, a_end), np.searchsorted(cut, b_end)
        in_a, in_b = np.bincount(a_group, minlength=len(cut)), np.bincount(b_group, minlength=len(cut))
        of = np.zeros(len(cut), np.int64)
        of[a_group] = a_of
        links = np.zeros(n, np.int64)
        np.add.at(links, of, in_a * in_b)
        numbers = np.stack([np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n), np.bincount(of, minlength=n), links, whole], 1)

        # distinct ids of a group with their times, then the pairs of a group
        ga, ta = np.unique(a_group << 17 | a, return_counts=True)
        gb, tb = np.unique(b_group << 17 | b, return_counts=True)
        size_b = np.bincount(gb >> 17, minlength=len(cut))
        begin_b = np.cumsum(size_b) - size_b
        mine = size_b[ga >> 17]
        right = ragged(begin_b[ga >> 17], mine)
        left = np.repeat(np.arange(len(ga)), mine)
        pair, times = (ga[left] & 0x1FFFF) << 32 | (gb[right] & 0x1FFFF), ta[left] * tb[right]
        chunk = of[ga[left] >> 17]
        order = np.lexsort((pair, chunk))
        pair, times, chunk = pair[order], times[order], chunk[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (chunk[1:] != chunk[:-1])
        at = np.flatnonzero(new)
        times = np.add.reduceat(times, at) if len(at) else times
        size = np.bincount(chunk[at], minlength=n)
        self.begin = np.concatenate([self.begin, len(self.pair) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pair, self.times = np.concatenate([self.pair, pair[at]]), np.concatenate([self.times, times])
        self.numbers = np.concatenate([self.numbers, numbers])
        if self.digests:
            self.text += group_texts(a, a_group, b, b_group, of, n)


@lru_cache(maxsize=2)
def _lengths_a(source: str) -> np.ndarray:
    return np.array([len(x) for x in loaded_a(source)[1]], np.int64)


@lru_cache(maxsize=2)
def _lengths_b(model: bytes) -> np.ndarray:
    return np.array([len(x) for x in loaded_b(model)[1]], np.int64)


def group_texts(a, a_group, b, b_group, of, n) -> list[str]:
    """Each chunk's groups as text: ids of A by commas, a bar, ids of B by commas; groups by semicolons."""
    ids = np.concatenate([a, b])
    group = np.concatenate([a_group, b_group])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, group))  # stable: the order of tokens stays
    ids, group, side = ids[order].tolist(), group[order], side[order]
    chunk = of[group]
    last_side, last_chunk = np.ones(len(ids), bool), np.ones(len(ids), bool)
    last_side[:-1] = (side[1:] != side[:-1]) | (group[1:] != group[:-1])
    last_chunk[:-1] = chunk[1:] != chunk[:-1]
    after = np.where(last_chunk, 3, np.where(last_side, np.where(side == 0, 1, 2), 0)).tolist()
    pieces = [f"{i}{',|; '[k]}" for i, k in zip(ids, after, strict=True)]
    out, found = [""] * n, "".join(pieces).split(" ")
    for c, text in zip(chunk[last_chunk].tolist(), found, strict=False):
        out[c] = text
    return out


# ------------------------------------------------------------------ minimal perfect hash
def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the levels, bits of all levels) of distinct keys: a level has twice as many bits as
    keys are left; a key alone at its bit sets it, the others go on."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(8, 2 * len(left))
        at = _places(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
        if len(sizes) > 200:
            raise RuntimeError("keys of a perfect hash must be distinct")
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def hashed(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Index of each key, from 0 without gaps; -1 (or another key's) for a key that isn't in it."""
    rank, out = np.cumsum(bits) - 1, np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        at = base + _places(keys[left], level, size)
        here = bits[at]
        out[left[here]] = rank[at[here]]
        left, base = left[~here], base + size
    return out


def verified(keys: np.ndarray, row: dict) -> np.ndarray:
    """Indices of keys that are all in the bucket's table."""
    at = hashed(keys, row["sizes"], row["bits"])
    if (at < 0).any() or not np.array_equal(row["keys"][at], keys):
        raise RuntimeError("a pair is missing from the table")
    return at


def _flat(column) -> np.ndarray:
    return B.flat(column).flatten().to_numpy(zero_copy_only=False)


def _hash_row(table: pa.Table) -> dict:
    keys = _flat(table["keys"])
    sizes = _flat(table["sizes"])
    bits = np.unpackbits(np.frombuffer(table["bits"][0].as_py(), np.uint8))[:int(sizes.sum())].astype(bool)
    return {"keys": keys, "sizes": sizes, "bits": bits} | ({"counts": _flat(table["counts"])} if "counts" in table.column_names else {})


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


# ------------------------------------------------------------------ Spark steps
def block_number(made: int) -> int:
    return B._number(made)


#: A block's documents: their finished columns, chunks in each, the chunks' numbers, links of each chunk,
#: their places in the block's sorted pairs and how often they occur.
DOCS = ["docs", "lengths", "codes", "sizes", "places", "times"]


def aligned_blocks(docs: DataFrame, source: str, model: bytes) -> DataFrame:
    """Rows of two kinds. (bucket, block, keys, counts): each block's distinct pairs (id of A << 32 |
    id of B) with the number of its documents that hold them. Without a bucket, a row for each block:
    its documents (``DOCS``), the size of ``docs`` and a checksum of all its pairs. ``docs`` is (id, text)."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                        *[(c, pa.binary()) for c in DOCS], ("docs_size", pa.int64()), ("mark", pa.int64())])

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        chunks = Aligned(source, model, digests=True)
        for made, rows in enumerate(B.text_runs(batches)):
            words: list[bytes] = []
            block = B.word_block(chunk_spans, 1, words)(rows)
            place = chunks.places(words)
            doc = np.repeat(np.arange(len(block.lengths)), block.lengths)
            good = _good(block, chunks, place, doc)
            number = block_number(made)

            # chunks of documents that keep their bytes, and the links of each
            lengths, codes = np.where(good, block.lengths, 0), block.codes[good[doc]]
            used = np.unique(codes)
            codes = np.searchsorted(used, codes)
            size, mine = chunks.size[place[used]], ragged(chunks.begin[place[used]], chunks.size[place[used]])
            keys, at = np.unique(chunks.pair[mine], return_inverse=True)
            each = np.unique(doc[good[doc]] * max(len(used), 1) + codes)
            owner, word = each // max(len(used), 1), each % max(len(used), 1)
            held = np.repeat(owner, size[word]) * max(len(keys), 1) + at[ragged((np.cumsum(size) - size)[word], size[word])]
            counts = np.bincount(np.unique(held) % max(len(keys), 1), minlength=len(keys))

            done = _columns(block.ids, lengths, codes, [chunks.numbers[place[used], k] for k in range(4)])
            done = done.append_column("groups_sha256", pa.array(_digests(lengths, codes, [chunks.text[p] for p in place[used].tolist()]), pa.string()))
            raw = _ipc(done)
            packed = [B.squeeze(raw), *(B.pack(x) for x in (lengths, codes, size, at, chunks.times[mine]))]
            yield batch(1, block=pa.array([number], pa.int64()), docs_size=pa.array([len(raw)], pa.int64()),
                        mark=pa.array([zlib.crc32(keys.tobytes())], pa.int64()),
                        **{c: pa.array([x], pa.binary()) for c, x in zip(DOCS, packed, strict=True)})
            if len(keys):
                bucket = (mix64(keys.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                which, n = np.unique(bucket, return_counts=True)
                ends = np.cumsum(n)
                yield batch(len(which), bucket=pa.array(which, pa.int32()), block=pa.array(np.full(len(which), number), pa.int64()),
                            keys=_lists(keys[order], ends, pa.int64()), counts=_lists(counts[order], ends, pa.int32()))

    names = ", ".join(f"{c} binary" for c in DOCS)
    return bound_batches(docs).mapInArrow(tidy(run), f"bucket int, block long, keys array<long>, counts array<int>, {names}, docs_size long, mark long")


def _columns(ids: pa.Array, lengths: np.ndarray, codes: np.ndarray, by_chunk: list[np.ndarray]) -> pa.Table:
    """Numbers of chunks added up for each document, beside its id."""
    limits, columns = np.concatenate([[0], np.cumsum(lengths)]), []
    for x in by_chunk:
        total = np.concatenate([[0], np.cumsum(x[codes])])
        columns.append(pa.array(total[limits[1:]] - total[limits[:-1]], pa.int64()))
    return pa.table([ids, *columns], names=["id", *[f"n{k}" for k in range(len(columns))]])


def _digests(lengths: np.ndarray, codes: np.ndarray, texts: list[str]) -> list[str]:
    out, at, codes = [], 0, codes.tolist()
    for n in lengths.tolist():
        text = ";".join([texts[c] for c in codes[at:at + n]])
        out.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        at += n
    return out


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _good(block: B.Block, chunks: Aligned, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Documents whose chunks all keep their bytes."""
    good = np.ones(len(block.lengths), bool)
    if len(doc):
        good[doc[chunks.numbers[place[block.codes], 4] == 0]] = False
    return good


def _one(bucket, branch, **columns) -> pa.Table:
    kinds = {"keys": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "sums": pa.list_(pa.int64()), "bits": pa.binary()}
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "branch": pa.array([branch], pa.int64())}
                    | {k: pa.array([v], kinds[k]) for k, v in columns.items()})


def _unite(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    out = _one(key[0].as_py(), key[1].as_py(), keys=np.unique(_flat(table["keys"])))
    give_back()
    return out


def _hash(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys = np.unique(_flat(table["keys"]))
    sizes, bits = perfect_hash(keys)
    at = hashed(keys, sizes, bits)
    placed = np.empty_like(keys)
    placed[at] = keys
    out = _one(key[0].as_py(), key[1].as_py(), keys=placed, sizes=sizes, bits=np.packbits(bits).tobytes())
    give_back()
    return out


def _sum_counts(key: tuple[pa.Scalar, ...], pairs: pa.Table, hashes: pa.Table) -> pa.Table:
    row = _hash_row(hashes)
    at = verified(_flat(pairs["keys"]), row)
    sums = np.bincount(at, _flat(pairs["counts"]), len(row["keys"])).astype(np.int64)
    out = _one(key[0].as_py(), key[1].as_py(), sums=sums)
    give_back()
    return out


def _sum_vectors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(v.values) for v in table["sums"]], axis=0)
    return _one(key[0].as_py(), key[1].as_py(), sums=total)


def _answer(key: tuple[pa.Scalar, ...], pairs: pa.Table, hashes: pa.Table) -> pa.Table:
    row = _hash_row(hashes)
    keys = B.flat(pairs["keys"])
    counts = row["counts"][verified(_flat(pairs["keys"]), row)]
    ends = np.cumsum(np.diff(keys.offsets.to_numpy(zero_copy_only=False)))
    out = pa.table({"block": pairs["block"], "keys": pairs["keys"], "counts": _lists(counts, ends, pa.int64())})
    give_back()
    return out


def pair_counts(spark: SparkSession, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with their branch, table): the table has a row for each bucket and branch with the
    bucket's perfect hash, its pairs in place and their counts over the whole corpus."""
    top = pairs.agg(F.max("block")).first()[0]
    partitions = 0 if top is None else top >> 24
    pairs = pairs.withColumn("branch", F.floor(F.shiftright("block", 24) / FAN))
    up = F.floor(F.col("branch") / FAN)
    sides, branches = "bucket int, branch long", partitions // FAN
    keys, level = pairs.select("bucket", "branch", "keys"), branches
    while level:
        keys = keys.groupBy("bucket", "branch").applyInArrow(_unite, f"{sides}, keys array<long>").withColumn("branch", up)
        level //= FAN
        if level == 0:
            keys = keys.withColumn("branch", F.lit(0).cast("long"))
    hashes = keys.groupBy("bucket", "branch").applyInArrow(_hash, f"{sides}, keys array<long>, sizes array<long>, bits binary")
    hashes = written(spark, hashes.drop("branch"), "pair-hashes")
    own = written(spark, pairs.select("bucket", "branch").distinct(), "pair-branches")

    sums = (pairs.groupBy("bucket", "branch").cogroup(own.join(hashes, "bucket").groupBy("bucket", "branch"))
            .applyInArrow(_sum_counts, f"{sides}, sums array<long>"))
    level = branches
    while level:
        level //= FAN
        sums = sums.withColumn("branch", up if level else F.lit(0).cast("long"))
        sums = sums.groupBy("bucket", "branch").applyInArrow(_sum_vectors, f"{sides}, sums array<long>")
    table = written(spark, hashes.join(sums.select("bucket", F.col("sums").alias("counts")), "bucket"), "pair-counts")
    return pairs, own.join(table, "bucket")


def align(spark: SparkSession, docs: DataFrame, source: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = written(spark, aligned_blocks(rows, source, model), "aligned-blocks")
    pairs, table = pair_counts(spark, blocks.filter(F.col("bucket").isNotNull()).select("bucket", "block", "keys", "counts"))
    each = table.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select(F.shiftright("x.keys", 32).alias("a"), F.col("x.counts").alias("n"))
    most = each.groupBy("a").agg(F.max("n").alias("n")).collect()  # a row for each entry of A's vocabulary at most
    best = np.zeros(max([r["a"] for r in most], default=0) + 1, np.int64)
    best[[r["a"] for r in most]] = [r["n"] for r in most]
    answers = (pairs.select("bucket", "branch", "block", "keys").groupBy("bucket", "branch")
               .cogroup(table.groupBy("bucket", "branch")).applyInArrow(_answer, "block long, keys array<long>, counts array<long>"))

    out = T.StructType([T.StructField(id_col, rows.schema["id"].dataType),
                        *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                        T.StructField("groups_sha256", T.StringType())])

    def joined(mine: pa.Table, answers: pa.Table) -> pa.Table:
        if mine.num_rows != 1:
            raise RuntimeError(f"{mine.num_rows} blocks of one number")
        r = mine.to_pylist()[0]
        keys, counts = _flat(answers["keys"]), _flat(answers["counts"])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        if zlib.crc32(keys.tobytes()) != r["mark"]:
            raise RuntimeError("a block's pairs differ from their answers")
        lengths, codes, size, at, times = (B.unpack(r[c]) for c in DOCS[1:])
        ends = np.concatenate([[0], np.cumsum(size)])
        count, times = counts[at], times.astype(np.int64)

        def per_chunk(x):
            total = np.concatenate([[0], np.cumsum(x)])
            return total[ends[1:]] - total[ends[:-1]]

        sums = [per_chunk(times * (count == best[keys >> 32][at])), per_chunk(times * count)]
        with pa.ipc.open_stream(B.stretch(r["docs"], r["docs_size"])) as stream:
            done = stream.read_all().combine_chunks()
        summed = _columns(done.column(0), lengths, codes, sums)
        result = pa.table([*done.columns[:5], *summed.columns[1:], done.column(5)], names=out.names)
        give_back()
        return result

    docs_of = blocks.filter(F.col("bucket").isNull()).select("block", *DOCS, "docs_size", "mark")
    return docs_of.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined, out)
