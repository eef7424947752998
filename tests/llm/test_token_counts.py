import random

import numpy as np
import pytest

from tessera.llm import blocks, token_counts as C
from tessera.llm.common import table
from tessera.llm.queries import op4_token_counts, tokenizer_path
from tests.conftest import SF001

from .helpers import edge_docs, empty_docs, saved


def viterbi(word, scores):
    """Best (score, tokens) by a plain walk over all prefixes."""
    unknown = min(scores.values()) - 10.0
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * unknown, best[end - 1][1] + size)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_documents_equal_plain_viterbi(spark, model):
    scores = C.zipf_scores(C.read_pieces(model))
    seen = {}
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF001, "documents").limit(60).collect()}
    got = {r["doc_id"]: r for r in op4_token_counts(spark, SF001).collect()}
    assert len(got) == table(spark, SF001, "documents").count()
    for i, text in texts.items():
        words = [C.MARK + w for w in text.split()]
        for w in set(words) - seen.keys():
            seen[w] = viterbi(w, scores)
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(seen[w] for w in words))


def test_shared_prefixes_are_scored_once():
    scores = {"a": -1.0, "ab": -1.5, "b": -1.0, "abc": -1.7, "c": -2.0}
    trie = C.PrefixTrie(scores)
    words = sorted({"".join(random.Random(i).choices("abcd", k=6)) for i in range(300)})
    assert [trie.insert(w) for w in words] == [viterbi(w, scores) for w in words]
    prefixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert trie.nodes == len(prefixes)


def test_words_of_one_prefix_share_no_bucket(spark, model, tmp_path):
    """A third of the distinct words begin alike; the largest bucket gets near its share."""
    rng = random.Random(2)
    other = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(4000)]
    urls = [f"https://www.example.com/items/{rng.randrange(10**9)}" for _ in range(2000)]
    texts = [(i, " ".join(rng.sample(other + urls, 900))) for i in range(60)]
    df = saved(spark, spark.createDataFrame(texts, "doc_id long, text string"), tmp_path / "h")
    hot = blocks.hot_prefixes(df, C.spans, 16)
    assert b"http" in hot and b"https://" in hot
    run = df.toArrow().combine_chunks()
    sizes = np.bincount(blocks.word_block(C.spans, 16, hot=hot)(run).buckets, minlength=16)
    assert sizes.max() < 2 * sizes.mean()
    scores = C.zipf_scores(C.read_pieces(model))
    got = {r["doc_id"]: r["n_tokens"] for r in C.count_tokens(df, model).where("doc_id < 2").collect()}
    assert got == {i: sum(viterbi(C.MARK + w, scores) for w in t.split()) for i, t in texts[:2]}


def test_hot_prefixes_of_many_buckets(spark, tmp_path):
    """With more buckets than a block has words every prefix is reported; what comes back is what the
    totals make hot."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(3, 12))) for _ in range(300)})
    df = saved(spark, spark.createDataFrame([(i, " ".join(words[i * 10:i * 10 + 200])) for i in range(10)], "doc_id long, text string")
               .coalesce(1), tmp_path / "m")
    for buckets in (8, 64, 5000):
        want = set()
        distinct = sorted({w for i in range(10) for w in words[i * 10:i * 10 + 200]})
        for depth in blocks.DEPTHS:
            for p in {w[:depth] for w in distinct if len(w) > depth}:
                n = sum(w[:depth] == p for w in distinct if len(w) > depth)
                if n > 1 and n * 4 * buckets > len(distinct):
                    want.add(p.encode())
        assert blocks.hot_prefixes(df, C.spans, buckets) == want


def test_buckets_grow_with_the_input(spark, monkeypatch):
    docs = table(spark, SF001, "documents")
    few = blocks.bucket_count(docs)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 1000)
    assert blocks.bucket_count(docs) > 10 * few


def test_edges(spark, model, tmp_path):
    rows = C.count_tokens(saved(spark, edge_docs(spark), tmp_path / "e"), model).collect()
    scores = C.zipf_scores(C.read_pieces(model))
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_tokens"]))
    assert len(rows) == 15 and by[1] == by[2] == by[3] == [(0, 0)]
    assert by[4] == [by[4][0]] * 2 == by[5] * 2
    assert by[6][0][0] == 60_000 and by[6][0][1] == 60_000 * viterbi(C.MARK + "word", scores)
    assert by[7][0][0] == 1 and by[7][0][1] == viterbi(C.MARK + "x" * 2000, scores) * 100 or by[7][0][1] > 0
    assert C.count_tokens(saved(spark, spark.createDataFrame([], edge_docs(spark).schema), tmp_path / "n"), model).count() == 0
    assert empty_docs(spark).count() == 0
