"""Stupid-backoff scores of documents under the corpus's own n-gram counts.

Words and runs of two to ``order`` words of each block of texts are hashed and counted once a block; the count
tables are partitioned by hash: a bucket's task adds up the blocks' counts of its n-grams and
joins the totals back to the blocks that asked. A document is scored with its own occurrences
left out of every count, so a text that nothing else in the corpus resembles scores low, however
often it repeats itself. The counts grow with the corpus; nothing is cut.

With c the count of an n-gram in all other documents and N the words of all others, a word w
after the words v, at most ``order`` - 1 of its document, scores c(v w) / c(v) if c(v w) > 0, else
``backoff`` times its score after v without the first word; without words before it, it has its
unigram score. The unigram score is c(w) / N if c(w) > 0, else ``backoff`` / N (1 for N if that is 0). The sum of the natural logarithms is kept in millionths, rounded per word, so
that it doesn't depend on the order of addition.

Words are runs without ASCII white space with A-Z lower-cased. Defined results: a null or
blank text has no words and score 0; repeated rows are documents of their own; a null id is
kept; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import mix64, text_slices, word_hashes

BACKOFF = 0.4
ORDER = 2
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(mix64(first + _PAIR) ^ (second * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)))


def longer_runs(codes: np.ndarray, lengths: np.ndarray, n_words: int, order: int):
    """For runs of 2 to ``order`` words: the positions where a run begins, the place in the list of
    distinct runs of each, and for each distinct run the place of the one without its last word in
    the list before, its last word and its count."""
    codes = codes.astype(np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    at, place = np.arange(len(codes)), codes
    for size in range(2, order + 1):
        inside = left[at] >= size
        at, place = at[inside], place[inside]
        distinct, place, counts = np.unique(place * max(n_words, 1) + codes[at + size - 1], return_inverse=True, return_counts=True)
        yield at, place, distinct // max(n_words, 1), distinct % max(n_words, 1), counts


def _grams(codes, lengths, word, order):
    """Hashes and block counts of the distinct words, then of the distinct runs of two words and so on."""
    hashes, counts = [word], [np.bincount(codes, minlength=len(word))]
    for _, _, before, last, n in longer_runs(codes, lengths, len(word), order):
        hashes.append(pair_hash(hashes[-1][before], word[last]))
        counts.append(n)
    return np.concatenate(hashes), np.concatenate(counts)


def _block(buckets: int, order: int):
    def make(run: pa.Table) -> B.Block:
        column = B.flat(run.column(1))
        hashes, lengths = [], np.zeros(len(column), np.int64)
        for row, to, starts, raw in text_slices(column):
            h, owner, _, _ = word_hashes(raw, starts)
            hashes.append(h)
            lengths[row:to] = np.bincount(owner, minlength=to - row)
        all_ = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        word, codes, counts = np.unique(all_, return_inverse=True, return_counts=True)
        common = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(common), np.int64)
        rank[common] = np.arange(len(common))
        word, codes = word[common], rank[codes]
        grams, gram_counts = _grams(codes, lengths, word, order)
        which = (grams >> np.uint64(33)).astype(np.int64) % buckets

        def terms(at: np.ndarray) -> bytes:
            data = grams[at].tobytes()
            return len(at).to_bytes(8, "little") + data + B.pack(gram_counts[at])

        return B.Block(B.flat(run.column(0)), lengths, codes, which, zlib.crc32(word.tobytes()), terms, word.tobytes())

    return make


def _totals(requests: list[bytes]) -> list[bytes]:
    grams, counts, sizes = [], [], []
    for r in requests:
        n = int.from_bytes(r[:8], "little")
        grams.append(np.frombuffer(r[8:8 + 8 * n], np.uint64))
        counts.append(B.unpack(r[8 + 8 * n:]).astype(np.int64))
        sizes.append(n)
    if not grams:
        return []
    _, where = np.unique(np.concatenate(grams), return_inverse=True)
    del grams
    total = np.bincount(where, np.concatenate(counts)).astype(np.int64)
    out, at = [], 0
    for n in sizes:
        out.append(B.pack(total[where[at:at + n]]))
        at += n
    return out


def micro_log(x: np.ndarray) -> np.ndarray:
    return np.floor(np.log(x) * 1e6 + 0.5).astype(np.int64)


def scores(lengths: np.ndarray, codes: np.ndarray, word: np.ndarray, totals: np.ndarray, n_corpus: int, backoff: float,
           order: int = ORDER) -> np.ndarray:
    """Micro-logs summed per document of a block; ``totals`` as in ``_grams``' order."""
    n_words = len(word)
    doc = np.repeat(np.arange(len(lengths)), lengths)

    def others(owner, gram, total):
        """Counts without the owner's own, per occurrence."""
        key = owner * (int(gram.max()) + 1 if len(gram) else 1) + gram
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        return total[gram] - count[inverse]

    count = others(doc, codes, totals[:n_words])  # of the runs of one size, by the position where they begin
    rest = np.maximum(n_corpus - lengths, 1)[doc]
    score, done = np.where(count > 0, count, backoff) / rest, n_words
    for size, (at, place, before, _, _) in enumerate(longer_runs(codes, lengths, n_words, order), 2):
        own = others(doc[at], place, totals[done:done + len(before)])
        done += len(before)
        # a document's last run is counted for c(v) as well, as its own occurrences are left out
        seen, word_at = own > 0, at + size - 1
        score[word_at[seen]] = own[seen] / count[at[seen]]
        score[word_at[~seen]] *= backoff
        count = np.zeros(len(codes), np.int64)
        count[at] = own
    run = np.concatenate([[0], np.cumsum(micro_log(score))]) if len(score) else np.zeros(1, np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return run[ends[1:]] - run[ends[:-1]]


def score_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    backoff: float = BACKOFF, order: int = ORDER) -> DataFrame:
    """id, n_words, log_score (sum of natural logs) and mean_log_score of every document."""
    from .common import n_words as words_in

    buckets = 4 * B.bucket_count(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    n_corpus = rows.agg(F.sum(words_in(F.col("text")))).first()[0] or 0
    out = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("micro", T.LongType())])

    def finish(ids, lengths, codes, which, answers, extra):
        totals = np.zeros(len(which), np.int64)
        for b, at in B.positions(which).items():
            totals[at] = B.unpack(answers[b])
        micro = scores(lengths, codes, np.frombuffer(extra, np.uint64), totals, n_corpus, backoff, order)
        return pa.table({"id": ids, "n_words": pa.array(lengths), "micro": pa.array(micro)})

    scored = B.lookup(rows, _block(buckets, order), lambda: _totals, finish, id_type.simpleString(), out, buckets, hold=True)
    log = F.col("micro") / F.lit(1e6)
    return scored.select(F.col("id").alias(id_col), "n_words", log.alias("log_score"),
                         F.when(F.col("n_words") > 0, log / F.col("n_words")).otherwise(0.0).alias("mean_log_score"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM p),
n AS (SELECT r, len(ws) AS own, sum(len(ws)) OVER () AS total FROM d),
u1 AS (SELECT w, count(*) AS c FROM p GROUP BY w),
o1 AS (SELECT r, w, count(*) AS c FROM p GROUP BY r, w),
u2 AS (SELECT v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY r, v, w),
t AS (
  SELECT g.r, g.v, u1.c - o1.c AS cw, coalesce(u2.c - o2.c, 0) AS cvw, uv.c - ov.c AS cv,
         greatest(n.total - n.own, 1)::DOUBLE AS rest
  FROM g JOIN n USING (r) JOIN u1 USING (w) JOIN o1 ON o1.r = g.r AND o1.w = g.w
  LEFT JOIN u2 ON u2.v = g.v AND u2.w = g.w LEFT JOIN o2 ON o2.r = g.r AND o2.v = g.v AND o2.w = g.w
  LEFT JOIN u1 uv ON uv.w = g.v LEFT JOIN o1 ov ON ov.r = g.r AND ov.w = g.v),
s AS (
  SELECT r, CASE WHEN cvw > 0 THEN cvw::DOUBLE / cv
                 WHEN v IS NULL THEN (CASE WHEN cw > 0 THEN cw ELSE 0.4::DOUBLE END) / rest
                 ELSE 0.4::DOUBLE * ((CASE WHEN cw > 0 THEN cw ELSE 0.4::DOUBLE END) / rest) END AS score FROM t),
m AS (SELECT r, sum(floor(ln(score) * 1e6 + 0.5)::BIGINT)::BIGINT AS micro FROM s GROUP BY r)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(micro, 0) / 1e6::DOUBLE AS log_score,
       CASE WHEN len(ws) > 0 THEN coalesce(micro, 0) / 1e6::DOUBLE / len(ws) ELSE 0 END AS mean_log_score
FROM d LEFT JOIN m USING (r)
"""


#: The same at order 3.
SQL_ORDER_3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u,
             lag(i) OVER (PARTITION BY r ORDER BY i) AS j FROM p),
n AS (SELECT r, len(ws) AS own, sum(len(ws)) OVER () AS total FROM d),
u1 AS (SELECT w, count(*) AS c FROM p GROUP BY w),
o1 AS (SELECT r, w, count(*) AS c FROM p GROUP BY r, w),
u2 AS (SELECT v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY r, v, w),
u3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
o3 AS (SELECT r, u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY r, u, v, w),
t AS (
  SELECT g.r, g.i, g.j, g.v, g.u, u1.c - o1.c AS cw, coalesce(u2.c - o2.c, 0) AS cvw, coalesce(u3.c - o3.c, 0) AS cuvw,
         greatest(n.total - n.own, 1)::DOUBLE AS rest
  FROM g JOIN n USING (r) JOIN u1 USING (w) JOIN o1 ON o1.r = g.r AND o1.w = g.w
  LEFT JOIN u2 ON u2.v = g.v AND u2.w = g.w LEFT JOIN o2 ON o2.r = g.r AND o2.v = g.v AND o2.w = g.w
  LEFT JOIN u3 ON u3.u = g.u AND u3.v = g.v AND u3.w = g.w
  LEFT JOIN o3 ON o3.r = g.r AND o3.u = g.u AND o3.v = g.v AND o3.w = g.w),
s AS (
  SELECT t.r, CASE WHEN t.cuvw > 0 THEN t.cuvw::DOUBLE / b.cvw ELSE (CASE WHEN t.u IS NULL THEN 1 ELSE 0.4::DOUBLE END) * (
    CASE WHEN t.cvw > 0 THEN t.cvw::DOUBLE / b.cw ELSE (CASE WHEN t.v IS NULL THEN 1 ELSE 0.4::DOUBLE END) *
      ((CASE WHEN t.cw > 0 THEN t.cw ELSE 0.4::DOUBLE END) / t.rest) END) END AS score
  FROM t LEFT JOIN t b ON b.r = t.r AND b.i = t.j),
m AS (SELECT r, sum(floor(ln(score) * 1e6 + 0.5)::BIGINT)::BIGINT AS micro FROM s GROUP BY r)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(micro, 0) / 1e6::DOUBLE AS log_score,
       CASE WHEN len(ws) > 0 THEN coalesce(micro, 0) / 1e6::DOUBLE / len(ws) ELSE 0 END AS mean_log_score
FROM d LEFT JOIN m USING (r)
"""
