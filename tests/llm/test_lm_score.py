import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import blocks, lm_score as S
from tessera.llm.common import table
from tessera.llm.queries import op8_lm_scores, op8_lm_scores_order_3
from tests.conftest import SF01, SF001
from tools.check_oracle import digest

from .helpers import edge_docs, empty_docs, saved, words


def plain(texts, backoff=0.4):
    docs = [words(t) for t in texts]
    uni, bi = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:]))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        u, b = uni - Counter(d), bi - Counter(zip(d, d[1:]))
        rest, micro = max(1, total - len(d)), 0
        for i, w in enumerate(d):
            one = (u[w] if u[w] else backoff) / rest
            if i and b[d[i - 1], w]:
                one = b[d[i - 1], w] / u[d[i - 1]]
            elif i:
                one *= backoff
            micro += math.floor(np.log(one) * 1e6 + 0.5)
        out.append((len(d), micro / 1e6))
    return out


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_equals_sql(spark, sf):
    df = op8_lm_scores(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    res = con.execute(S.SQL)
    cols = [d[0] for d in res.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


@pytest.mark.parametrize("size", [5_000, 10**7])
def test_counts_equal_plain_python(spark, size, monkeypatch):
    monkeypatch.setattr(blocks.text_runs, "__defaults__", (size,))
    rows = table(spark, SF001, "documents").collect()
    want = dict(zip([r["doc_id"] for r in rows], plain([r["text"] for r in rows]), strict=True))
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in op8_lm_scores(spark, SF001).collect()}
    assert got.keys() == want.keys()
    for i in got:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-5


def plain_order(texts, order, backoff=0.4):
    """Mean by plain recursion over contexts of any length."""
    docs = [words(t) for t in texts]
    every = Counter(tuple(d[i:i + k]) for d in docs for k in range(1, order + 1) for i in range(len(d) - k + 1))
    out = []
    for d in docs:
        own = Counter(tuple(d[i:i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1))
        rest, micro = max(1, sum(map(len, docs)) - len(d)), 0

        def score(run):
            c = every[run] - own[run]
            if len(run) == 1:
                return (c or backoff) / rest
            return c / (every[run[:-1]] - own[run[:-1]]) if c else backoff * score(run[1:])

        for i in range(len(d)):
            micro += math.floor(np.log(score(tuple(d[max(0, i - order + 1):i + 1]))) * 1e6 + 0.5)
        out.append((len(d), micro / 1e6))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_equal_plain_python(spark, order, monkeypatch):
    monkeypatch.setattr(blocks.text_runs, "__defaults__", (20_000,))
    docs = table(spark, SF001, "documents")
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], plain_order([r["text"] for r in rows], order), strict=True))
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in S.score_documents(spark, docs, order=order).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-4 for i in got)


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_order_3_equals_sql(spark, sf):
    df = op8_lm_scores_order_3(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    res = con.execute(S.SQL_ORDER_3)
    cols = [d[0] for d in res.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


def test_edges(spark, tmp_path):
    df = saved(spark, edge_docs(spark), tmp_path / "e")
    rows = S.score_documents(spark, df).collect()
    texts = [r["text"] for r in df.collect()]
    assert sorted((r["n_words"], round(r["log_score"], 4)) for r in rows) == sorted((n, round(s, 4)) for n, s in plain(texts))
    assert {(r["n_words"], r["log_score"], r["mean_log_score"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, 0.0, 0.0)}
    assert S.score_documents(spark, saved(spark, empty_docs(spark), tmp_path / "n")).count() == 0
