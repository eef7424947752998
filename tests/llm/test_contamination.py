import hashlib
import re

import duckdb
from .helpers import EDGE_ROWS, edge_docs, empty_docs, saved
from pyspark.sql import functions as F

from tessera.llm import contamination as C

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, ITEM), (2, "short one"), (3, ""), (4, None), (5, "x" * 200_000), (None, "without an id"), (6, "word " * 12),
         (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (8, "漢字 Éàü"), (9, "nowhere at all")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def brute(docs, items, width=10):
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(width, len(iw))
            grams = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if iw else set()
            at = [i for i in range(len(ws) - n + 1) if tuple(ws[i:i + n]) in grams] if grams else []
            hit.update(j for i in at for j in range(i, i + n))
            if at:
                found.add(None if item_id is None else str(item_id))
        names = ",".join(sorted(x for x in found if x is not None))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items_frame(spark, rows=None):
    return spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string")


DOCS = [(r[0], r[1]) for r in EDGE_ROWS] + [
    (20, "before " + ITEM.upper().replace(" ", "--") + " after"), (21, " ".join(ITEM.split()[1:11])), (22, " ".join(ITEM.split()[:9])),
    (23, ("filler " * 50 + ITEM + ". ") * 3), (24, "Short... ONE! not short, one"), (25, "a 漢字  éàü Éàü 漢字 Éàü"), (26, ITEM + " " + ITEM),
    (27, "gamma delta epsilon zeta eta theta iota kappa lambda mu alpha beta"), (28, "without-an-id")]


def test_equals_brute_force_with_edge_rows(spark, tmp_path):
    docs = saved(spark, spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("word", F.lit("x")), tmp_path / "d")
    got = C.decontaminate(spark, docs, items_frame(spark).withColumn("name", F.lit("n")))
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS)


def test_shuffled_joins_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    docs = saved(spark, spark.createDataFrame(DOCS, "doc_id long, text string"), tmp_path / "d")
    got = C.decontaminate(spark, docs, items_frame(spark), width=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS, 3)


def test_sql_equals_brute_force():
    con = duckdb.connect()
    docs = [r for r in DOCS if len(r[1] or "") < 10_000]  # DuckDB's plan copies a text's words for each of its words
    for name, column, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", ITEMS)):
        con.execute(f"create table {name} ({column} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    assert sorted(con.execute(C.SQL).fetchall(), key=str) == brute(docs, ITEMS)


def test_empty_tables(spark, tmp_path):
    assert C.decontaminate(spark, saved(spark, empty_docs(spark), tmp_path / "e"), items_frame(spark)).count() == 0
    none = C.decontaminate(spark, saved(spark, edge_docs(spark), tmp_path / "d"), items_frame(spark, []))
    assert none.where("not contaminated and n_hit = 0 and n_items = 0").count() == len(EDGE_ROWS)


def test_matches_are_the_runs(spark, tmp_path):
    docs = saved(spark, spark.createDataFrame(DOCS, "doc_id long, text string"), tmp_path / "d")
    items = C.item_words(spark, items_frame(spark, [(1, ITEM)]))
    postings = C.build_index(spark, docs, items)
    ids = {r["row"]: r["id"] for r in postings.where("word = ''").collect()}
    got = sorted((ids[r["row"]], r["first"], r["last"]) for r in C.phrase_matches(spark, postings, items).collect())
    assert got == [(20, 1, 12), (21, 0, 9), (23, 50, 61), (23, 112, 123), (23, 174, 185), (26, 0, 11), (26, 12, 23), (27, 0, 9)]


def test_proximity_matches_equal_brute_force(spark, tmp_path):
    items = [(1, "cat mat"), (2, "delta beta alpha"), (3, "short"), (4, "mat nowhere"), (5, "one not short")]
    docs = saved(spark, spark.createDataFrame(DOCS, "doc_id long, text string"), tmp_path / "d")
    item = C.item_words(spark, items_frame(spark, items))
    postings = C.build_index(spark, docs, item)
    ids = {r["row"]: r["id"] for r in postings.where("word = ''").collect()}
    every = [w for _, t in DOCS for w in words(t)]
    for within in (3, 6):
        want = set()
        for doc_id, text in DOCS:
            ws = words(text)
            for name, t in items:
                iw = set(words(t))
                rare = min((every.count(w), w) for w in iw)[1]
                if len(iw) > within:
                    continue
                for p in (i for i, w in enumerate(ws) if w == rare):
                    if any(iw <= set(ws[max(s, 0):s + within]) for s in range(p - within + 1, p + 1)):
                        want.add((doc_id, str(name), p))
        found = C.proximity_matches(spark, postings, item, within).collect()
        assert len(found) == len(set(found)) and {(ids[r["row"]], r["name"], r["pos"]) for r in found} == want
