"""BPE encoding and decoding through a table of distinct words.

Texts are normalised and split in words in the tasks; every distinct word of a bucket is
encoded once; the ids are joined back by position. Decoding joins ids to their pieces. The
tokenizer file is a parameter; it is read on the driver and shipped with the tasks.

The split repeats the tokenizer's own steps. Texts within Latin letters and common
punctuation, for which the normal form is the text itself, are lower-cased and split by tables
over their bytes; any other text goes through the tokenizer's own normaliser and pre-tokenizer.

Defined results: a null text is empty; an empty text has no ids and decodes to the empty
text; special tokens in a text become their ids; repeated rows each get their row; a null id is
kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import text_slices

#: Bytes of text in a block: half the words of larger ones, so two tasks of an executor stay small.
BLOCK_BYTES = 2 << 20
#: A word that stands for a special token begins with a space, which no other word holds.
SPECIAL = " "


#: Kinds of a character: white space, letter, number (a word of its own each), any other.
WHITE, LETTER, NUMBER, OTHER = range(4)
#: Code points below this are split by tables; white space here is that of the tokenizer's pattern.
LIMIT = 0x300
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_KIND = np.array([WHITE if chr(c) in _WHITE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
                  for c in range(LIMIT)], np.uint8)
_LOWER = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(LIMIT)], np.int64)
#: Letters whose lower case is longer in UTF-8.
_GROWS = np.array([len(chr(c).lower().encode()) != len(chr(c).encode()) for c in range(LIMIT)])
#: The endings that the pattern splits off with their apostrophe, in its order.
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def plain_words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, row, first byte, byte after the last, rows to be split otherwise) of
    concatenated texts. Split by tables are texts of code points below LIMIT and of the common
    dashes and quotes U+2010 to U+2027, whose normal form is the text itself, unless a lower case
    is longer."""
    n, rows = len(raw), len(starts) - 1
    none = np.zeros(0, np.int64)
    if n == 0:
        return raw, none, none, none, none
    kind, low, lead = _KIND[np.minimum(raw, 127)], raw.copy(), np.ones(n, bool)
    capital = (raw >= 65) & (raw <= 90)
    low[capital] += 32
    bad = []
    high = np.flatnonzero(raw >= 128)
    if len(high):
        lead[high] = raw[high] >= 0xC0
        two = high[(raw[high] >= 0xC2) & (raw[high] <= 0xCB)]
        point = ((raw[two].astype(np.int64) & 31) << 6) | (raw[two + 1] & 63)
        kind[two] = kind[two + 1] = _KIND[point]
        to = _LOWER[point]
        low[two], low[two + 1] = 0xC0 | (to >> 6), 0x80 | (to & 63)
        bad.append(two[_GROWS[point]])
        top = high[raw[high] >= 0xCC]
        dash = top[(raw[top] == 0xE2) & (raw[np.minimum(top + 1, n - 1)] == 0x80)]
        mark = raw[np.minimum(dash + 2, n - 1)]
        dash = dash[(mark >= 0x90) & (mark <= 0xA7)]
        for j in range(3):
            kind[dash + j] = OTHER
        bad.append(np.setdiff1d(top, dash))
    odd = np.unique(np.searchsorted(starts, np.concatenate(bad), side="right") - 1) if bad else none

    begins = np.zeros(n + 1, bool)
    begins[0] = True
    begins[1:n] = kind[1:] != kind[:-1]
    begins[starts] = True
    begins[:n] |= kind == NUMBER
    begins[:n] &= lead
    edge = np.flatnonzero(begins)
    a = edge[edge < n]
    b = np.append(a[1:], n)
    keep = kind[a] != WHITE
    a, b = a[keep], b[keep]
    # an apostrophe that is a word by itself takes one of the endings from the letters after it
    lone = np.flatnonzero((low[a] == 39) & (b - a == 1))
    lone = lone[lone + 1 < len(a)]
    lone = lone[(a[lone + 1] == b[lone]) & (kind[a[lone + 1]] == LETTER)]
    row = np.searchsorted(starts, a, side="right") - 1
    lone = lone[row[lone] == row[lone + 1]]
    for i in lone.tolist():
        letters = low[a[i + 1]:min(b[i + 1], a[i + 1] + 2)].tobytes()
        for e in ENDINGS:
            if letters.startswith(e):
                b[i] += len(e)
                a[i + 1] += len(e)
                break
    full = a < b
    return low, row[full], a[full], b[full], odd


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: bytes that print stand for
    themselves, the others count up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE = byte_letters()


@lru_cache(maxsize=4)
def loaded(source: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(source)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Words:
    """Splitting and encoding of a word-level BPE tokenizer given as its JSON text."""

    def __init__(self, source: str):
        self.source = source
        spec = json.loads(source)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, names))) if names else None
        self.special_bytes = re.compile(b"|".join(re.escape(x.encode()) for x in names)) if names else None

    def spans(self, column: pa.Array):
        """Slices of a column of texts as spans of their words' bytes."""
        for row, to, starts, raw in text_slices(column):
            low, owner, a, b, odd = plain_words(raw, starts)
            if self.special:
                data = raw.tobytes()
                hits = [m.start() for m in self.special_bytes.finditer(data)] if any(s.encode() in data for s in self.special) else []
                odd = np.union1d(odd, np.searchsorted(starts, np.array(hits, np.int64), side="right") - 1)
            if len(odd):  # these rows' words go behind the others' bytes, and in their place
                plain = ~np.isin(owner, odd)
                parts, sizes, owners, at = [low.tobytes()], [], [], len(low)
                for i in odd.tolist():
                    words = [w.encode() for w in self.split(column[row + i].as_py() or "")]
                    parts += words
                    sizes += map(len, words)
                    owners += [i] * len(words)
                ends = at + np.cumsum(np.array(sizes, np.int64))
                low = np.frombuffer(b"".join(parts), np.uint8)
                owner, a, b = (np.concatenate(z) for z in ((owner[plain], np.array(owners, np.int64)), (a[plain], ends - np.array(sizes, np.int64)), (b[plain], ends)))
                order = np.argsort(owner, kind="stable")
                owner, a, b = owner[order], a[order], b[order]
            yield row, to, (low, owner, a, b)

    def split(self, text: str) -> list[str]:
        """Words in order by the tokenizer's own steps; a special token's word has a space before
        its text."""
        out, at = [], 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            out += self._words(text[at:m.start()])
            out.append(SPECIAL + m.group())
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        tok, back = loaded(self.source), _letters_to_bytes()
        pieces = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))
        return [bytes(back[c] for c in p).decode() for p, _ in pieces]

    def encode(self, words: list[str]) -> list[np.ndarray]:
        model = loaded(self.source).model
        out = []
        for w in words:
            if w.startswith(SPECIAL):
                ids = [self.special[w[1:]]]
            else:
                ids = [t.id for t in model.tokenize("".join(map(_BYTE.__getitem__, w.encode())))]
            out.append(ids)
        return out

    def pieces(self) -> list[str]:
        tok = loaded(self.source)
        return [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]


@lru_cache(maxsize=1)
def _letters_to_bytes() -> dict[str, int]:
    return {c: b for b, c in _BYTE.items()}


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def piece_table(spark: SparkSession, words: Words) -> DataFrame:
    """(id, piece): a row for each entry of the vocabulary."""
    return spark.createDataFrame(list(enumerate(words.pieces())), "id int, piece string")


def decode(spark: SparkSession, encoded: DataFrame, words: Words, ids_col: str = "ids", text_name: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of an array of ids: ids are joined to their pieces (the
    vocabulary bounds the broadcast side), which are put back in order and joined by spaces."""
    keyed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"))
    distinct = keyed.select(F.col(f"row.`{ids_col}`").alias("ids")).where("ids is not null").distinct()
    exploded = distinct.select("ids", F.posexplode("ids").alias("at", "id")).join(F.broadcast(piece_table(spark, words)), "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    texts = exploded.groupBy("ids").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("text"))
    return (keyed.join(texts, F.col(f"row.`{ids_col}`") == F.col("ids"), "left")
            .select("row.*", F.when(F.col(f"row.`{ids_col}`").isNotNull(), F.coalesce("text", F.lit(""))).alias(text_name)))


def _answers(words: Words):
    def start():
        get = B.word_table(words.encode)

        def give(requests: list[bytes]) -> list[bytes]:
            out = []
            for r in requests:
                ids = get(B.asked_words(r))
                counts = B.pack(np.array([len(x) for x in ids]))
                out.append(len(counts).to_bytes(8, "little") + counts + B.pack(np.array([i for x in ids for i in x], np.int64)))
            return out

        return give

    return start


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the
    ids themselves as little-endian unsigned 32-bit integers and the decoded text."""
    words = Words(tokenizer)
    buckets = B.bucket_count(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        out = out.add("ids", T.BinaryType()).add("decoded", T.StringType())
    vocabulary = words.pieces()

    def finish(ids, lengths, codes, which, answers, extra):
        parts, texts, counts = [b""] * len(which), [""] * len(which), np.zeros(len(which), np.int64)
        places = B.positions(which)
        for b, a in answers.items():
            size = int.from_bytes(a[:8], "little")
            n, flat = B.unpack(a[8:8 + size]), B.unpack(a[8 + size:])
            data, ends = flat.astype("<u4").tobytes(), np.cumsum(n).tolist()
            pieces = [vocabulary[i] for i in flat.tolist()]  # ids joined to their pieces
            at = places[b]
            counts[at] = n
            start = 0
            for i, end in zip(at.tolist(), ends, strict=True):
                parts[i], texts[i] = data[4 * start:4 * end], " ".join(pieces[start:end])
                start = end
        ends = np.concatenate([[0], np.cumsum(lengths)])
        total, h1, h2, all_ids, all_texts = [], [], [], [], []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            own = codes[lo:hi]
            n = counts[own]
            total.append(int(n.sum()))
            if not n.all():  # a word that the vocabulary has nothing for leaves no piece
                own = own[n > 0]
            own = own.tolist()
            data = b"".join([parts[i] for i in own])
            text = " ".join([texts[i] for i in own])
            h1.append(hashlib.sha256(data).hexdigest())
            h2.append(hashlib.sha256(text.encode()).hexdigest())
            if with_ids:
                all_ids.append(data)
                all_texts.append(text)
        columns = {id_col: ids, "n_tokens": pa.array(total, pa.int64()), "ids_sha256": pa.array(h1, pa.string()),
                   "decoded_sha256": pa.array(h2, pa.string())}
        if with_ids:
            columns |= {"ids": pa.array(all_ids, pa.binary()), "decoded": pa.array(all_texts, pa.string())}
        return pa.table(columns)

    return B.lookup(rows, B.word_block(words.spans, buckets), _answers(words), finish, id_type.simpleString(), out, buckets, size=BLOCK_BYTES)
