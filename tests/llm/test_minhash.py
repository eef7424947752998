import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash as H
from tessera.llm.common import mix64, shingle_hashes, table, word_hashes
from tessera.llm.queries import op10_near_dedup
from tests.conftest import SF01

from .helpers import components, edge_docs, empty_docs, saved, shingles


def brute(texts, width, percent):
    """id -> (size, component) by an inverted index over all shingles."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    posting = {}
    for i, s in sets.items():
        for g in s:
            posting.setdefault(g, []).append(i)
    links = []
    for i, s in sets.items():
        both = {}
        for g in s:
            for j in posting[g]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        links += [(i, j) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    group = components(texts, links)
    return {i: (len(s), group[i]) for i, s in sets.items()}


def as_dict(df):
    out = {}
    for r in df.collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"])
        out[r["doc_id"]] = (r["n_shingles"], r["component_id"])
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_documents_equal_brute_force(spark, width, percent):
    docs = table(spark, SF01, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = as_dict(op10_near_dedup(spark, SF01) if width == 3 else H.near_duplicates(spark, docs, width, percent))
    assert got == brute(texts, width, percent)


def edited(rng, base, p, vocabulary):
    return " ".join(rng.choice(vocabulary) if rng.random() < p else w for w in base)


def test_group_of_near_copies_about_the_threshold(spark, tmp_path, monkeypatch):
    """Hundreds of copies with 0 to 12 % of words changed: chains of links, outliers that share
    bands with the group, tiles of several blocks."""
    monkeypatch.setattr(H, "BLOCK_MEMBERS", 40)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=160)
    rows = [(i, edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12]), vocabulary)) for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 200)))) for i in range(100)]
    df = saved(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "g")
    assert as_dict(H.near_duplicates(spark, df, 3, 85)) == brute(dict(rows), 3, 85)


def test_tile_links_join_every_linked_component():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10**9, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 10**9, k, dtype=np.uint64)])) for k in (0, 2, 4, 6, 30, 60)] * 2
    ids = np.arange(len(sets))
    groups = np.array([0, 0, 2, 3, 4, 5, 0, 7, 8, 9, 10, 11])
    found = H.tile_links(ids, groups, sets, 85)

    def jaccard(a, b):
        n = len(np.intersect1d(a, b))
        return n / (len(a) + len(b) - n)

    full = [(int(a), int(b)) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.85]
    known = [(int(a), int(b)) for a in ids for b in ids if groups[a] == groups[b]]
    assert set(map(frozenset, found)) <= set(map(frozenset, full))
    assert components(ids.tolist(), found + known) == components(ids.tolist(), full + known)


def sequential(elements, m):
    """SuperMinHash one element after the other with a permutation of its own."""
    out = [2**64 - 1] * m
    for h in elements:
        p = list(range(m))
        for level in range(m):
            draw = int(mix64(np.array([(h + (level + 1) * H._GOLD) % 2**64], np.uint64))[0])
            other = int(mix64(np.array([draw ^ H._GOLD], np.uint64))[0])
            k = level + (other >> 33) % (m - level)
            p[level], p[k] = p[k], p[level]
            out[p[level]] = min(out[p[level]], (draw >> 8) | level << 56)
    return out


def test_signature_equals_the_sequential_form():
    rng = np.random.default_rng(0)
    for m in (4, 20, 100):
        sizes = [1, 2, 5, 40, 300]
        h = rng.integers(0, 2**63, sum(sizes), dtype=np.uint64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        got = H.super_minhash(h, row, len(sizes) + 1, m)
        for i in range(len(sizes)):
            assert got[i].tolist() == sequential([int(x) for x in h[row == i]], m)
        assert (got[-1] == 2**64 - 1).all()


def test_signature_estimates_similarity_with_low_variance():
    rng = np.random.default_rng(1)
    m, error = 100, []
    for _ in range(200):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 20, dtype=np.uint64)]) for _ in range(2))
        s = H.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 100), 2, m)
        error.append((s[0] == s[1]).mean() - 80 / 120)
    plain = (80 / 120 * 40 / 120 / m) ** 0.5
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 1.02 * plain


def test_banding_keeps_to_the_miss_rate():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, rows = H.banding(t)
        assert (1 - t**rows) ** bands <= H.MISS and bands * rows <= H.MOST_RANKS


def test_word_and_shingle_hashes_follow_words():
    texts = ["A b\tC d", "a B c  D", "", " \n", "ab c d", "a bc d", "a", "x" * 500, "É é"]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, row, a, b = word_hashes(np.frombuffer(b"".join(raw), np.uint8), starts)
    got = {}
    for x, r, lo, hi in zip(h, row, a, b, strict=True):
        word = b"".join(raw)[lo:hi].lower()
        assert word in raw[r].lower().split() and got.setdefault(word, x) == x
    assert len(set(got.values())) == len(got)
    owner, s = shingle_hashes(h, row, len(texts), 3)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingles(t, 3)) for t in texts]
    assert (s[owner == 0] == s[owner == 1]).all()


def test_edges(spark, tmp_path):
    df = saved(spark, edge_docs(spark).withColumn("rep", F.lit(1)).withColumn("bucket", F.lit("x")), tmp_path / "e")
    out = H.near_duplicates(spark, df, 3, 85).collect()
    assert len(out) == 15
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert all(got[i]["n_shingles"] == 0 and got[i]["component_id"] == i for i in (1, 2, 3))
    assert got[5]["component_id"] == 4 and not got[5]["kept"] and got[12]["component_id"] == 11
    assert got[6]["n_shingles"] == 1 and got[7]["n_shingles"] == 1
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    kept = H.one_of_each(spark, df, 3, 85)
    assert kept.columns == df.columns
    left = kept.collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert sum(r["doc_id"] is None for r in left) == 2
    empty = saved(spark, empty_docs(spark), tmp_path / "n")
    assert H.near_duplicates(spark, empty).count() == 0 and H.one_of_each(spark, empty).count() == 0


def test_rows_of_one_id_are_one_node(spark, tmp_path):
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    df = saved(spark, spark.createDataFrame([(5, a), (5, b), (1, a), (3, b), (9, "k l m")], "doc_id long, text string"), tmp_path / "d")
    got = sorted((r["doc_id"], r["component_id"]) for r in H.near_duplicates(spark, df, 3, 85).collect())
    assert got == [(1, 1), (3, 1), (5, 1), (5, 1), (9, 9)]
