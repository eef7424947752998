"""Token counts of a unigram vocabulary by dynamic programming shared over a trie.

The distinct pre-tokens of the corpus go to buckets by their first letters, so that words with
common prefixes meet; where many begin alike, by as many more letters as even buckets need. Each bucket inserts its words in a trie by walking them in order; a
node's forward score, the best log probability of segmenting the prefix that it stands for, is
computed once and shared by all words below it. A terminal node stores the token count of its
best segmentation. Documents add up the counts of their pre-tokens by position.

The best segmentation has the largest sum of piece scores; of equal ones that with fewer
tokens. A character that no piece covers costs one token for each of its UTF-8 bytes.

Pre-tokens are runs without ASCII white space, each with the vocabulary's word mark before it.
Defined results: a null or blank text has no pre-tokens and no tokens; repeated rows each get
their row; a null id is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import text_slices, word_spans

#: The mark that begins every pre-token in the vocabulary.
MARK = "▁"


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """piece -> log probability by Zipf's law on the order of the list."""
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces)))) if pieces else 0.0
    out: dict[str, float] = {}
    for i, p in enumerate(pieces):
        out.setdefault(p, -math.log(i + 1) - total)
    return out


def read_pieces(model: bytes) -> list[str]:
    """Ordinary pieces of a sentencepiece model, most frequent first."""
    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
    return [m.id_to_piece(i) for i in sorted(ids, key=lambda i: (-m.get_score(i), i))]


def spans(column: pa.Array):
    for row, to, starts, raw in text_slices(column):
        yield row, to, (raw, *word_spans(raw, starts))


class PrefixTrie:
    """Forward scores along the path of the word inserted last. Words come in code-point
    order, so the path is the part of the trie that later words can share; ``nodes`` counts
    how many nodes were scored in all."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.path = ""
        self.best = [0.0]
        self.tokens = [0]
        self.nodes = 0

    def insert(self, word: str) -> int:
        """Token count of ``word``."""
        shared, most = 0, min(len(self.path), len(word))
        while shared < most and self.path[shared] == word[shared]:
            shared += 1
        best, tokens, scores = self.best, self.tokens, self.scores
        del best[shared + 1:], tokens[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode())
            top = best[end - 1] + size * self.unknown
            n = tokens[end - 1] + size
            for start in range(max(0, end - self.longest), end):
                s = scores.get(word[start:end])
                if s is not None:
                    s += best[start]
                    if s > top or (s == top and tokens[start] + 1 < n):
                        top, n = s, tokens[start] + 1
            best.append(top)
            tokens.append(n)
        self.nodes += len(word) - shared
        self.path = word
        return tokens[-1]


@lru_cache(maxsize=2)
def _scores(model: bytes) -> dict[str, float]:
    return zipf_scores(read_pieces(model))


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens of every document; ``model`` is a sentencepiece model's content."""
    buckets = B.bucket_count(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def answer():
        scores = _scores(model)

        def give(requests: list[bytes]) -> Iterator[bytes]:
            # only the distinct words are held unpacked
            table: dict[str, int] = {}
            for r in requests:
                table.update(dict.fromkeys(B.asked_words(r), 0))
            trie = PrefixTrie(scores)
            for w in sorted(table):
                table[w] = trie.insert(MARK + w)
            for r in requests:
                yield B.pack(np.array([table[w] for w in B.asked_words(r)], np.int64))

        return give

    def finish(ids, lengths, codes, which, answers, extra):
        counts = np.zeros(len(which), np.int64)
        for b, at in B.positions(which).items():
            counts[at] = B.unpack(answers[b])
        run = np.concatenate([[0], np.cumsum(counts[codes])])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return pa.table({id_col: ids, "n_words": pa.array(lengths), "n_tokens": pa.array(run[ends[1:]] - run[ends[:-1]])})

    hot = B.hot_prefixes(rows, spans, buckets)
    return B.lookup(rows, B.word_block(spans, buckets, hot=hot), answer, finish, id_type.simpleString(), out,
                    buckets, hold=True)
