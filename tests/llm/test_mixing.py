import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tessera.llm.common import n_words, table
from tessera.llm.queries import op5_source_mixing
from tests.conftest import SF01, SF001
from tools.check_oracle import digest

from .helpers import DOCS, edge_docs, empty_docs, saved, words


def targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing again and again, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, stopped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest, weight = total - sum(stopped.values()), sum(w[s] for s in free)
        now = {s: w[s] * rest / weight for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return stopped | now
        stopped |= {s: float(most * sizes[s]) for s in over}


def check_mix(rows, most=3):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-12) for r in own)
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(0 <= r["taken"] <= most * r["size"] for r in own)
        # whole epochs for all, and at most one document cut
        assert sum(r["size"] > 0 and r["taken"] % r["size"] != 0 for r in own) <= 1


def with_source(spark, df, **options):
    out = M.mix(spark, df, carry=df.columns, **options)
    return [r.asDict() | {"source": r["carried"]["source"]} for r in out.collect()]


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_equals_sql(spark, sf):
    df = op5_source_mixing(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    res = con.execute(M.SQL)
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


@pytest.mark.parametrize("chunk_rows", [3, 50, 10**6])
def test_rule_on_documents(spark, chunk_rows):
    rows = with_source(spark, table(spark, SF01, "documents"), chunk_rows=chunk_rows)
    assert len(rows) == 1000
    check_mix(rows)
    again = with_source(spark, table(spark, SF01, "documents").repartition(5), chunk_rows=10**6)
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}


def test_hot_source_and_many_stops(spark):
    """Small sources stop at three times their size, one after the other."""
    rows = [(i, "w " * (1 + i % 7), "en", f"s{min(i // 3, 9):02d}", 1) for i in range(300)]
    check_mix(with_source(spark, spark.createDataFrame(rows, DOCS), chunk_rows=20))


def test_edges(spark, tmp_path):
    df = saved(spark, edge_docs(spark), tmp_path / "e")
    rows = with_source(spark, df)
    assert len(rows) == 15
    check_mix(rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    res = con.execute(M.SQL)
    cols = [d[0] for d in res.description]
    got = M.mix(spark, df)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(cols, res.fetchall())[0]
    assert M.mix(spark, saved(spark, empty_docs(spark), tmp_path / "n")).count() == 0
    blank = df.where("doc_id in (1, 2, 3)")
    assert {(r["taken"], r["target"]) for r in M.mix(spark, blank).collect()} == {(0, 0.0)}


def test_mixed_documents_hold_the_words_taken(spark, tmp_path):
    df = saved(spark, edge_docs(spark).withColumn("chunk", F.lit(7)).withColumn("size", F.lit("x")), tmp_path / "e")
    out = M.mixed_documents(spark, df)
    assert out.columns == df.columns
    want = {}
    for r in with_source(spark, df):
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    got, whole = {}, {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").collect()}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
        if r["doc_id"] is not None:
            assert whole[r["doc_id"]].startswith(r["text"])
    assert got == {k: v for k, v in want.items() if v}


def test_word_count_is_the_contracts(spark):
    df = edge_docs(spark).where("text is not null").select("text", n_words(F.col("text")).alias("n"))
    assert all(r["n"] == len(r["text"].encode().split()) for r in df.collect())
