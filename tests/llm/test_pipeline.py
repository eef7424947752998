import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tessera.llm.common import table
from tessera.llm.queries import tokenizer_path
from tests.conftest import SF01

from .helpers import edge_docs, empty_docs, saved, words
from .test_minhash import brute
from .test_mixing import targets


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [table(spark, SF01, "documents")]
    for k, (_, stage) in enumerate(P.STAGES):
        out.append(saved(spark, stage(spark, out[-1], SF01), tmp_path_factory.mktemp("p") / str(k)))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup",
                                        "mixing sources to target weights", "BPE encoding and decoding"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_language_stage_keeps_clean_documents(stages):
    letters = {r["doc_id"] for r in stages[0].collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in stages[1].collect()} == letters


def noise_texts(rng):
    """Letters, codes, markup and numbers with lone letters, long and short."""
    low, code = list("abcdefghijklmnopqrstuvwxyz"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
    for n in (8, 40, 400):
        yield " ".join("".join(rng.choice(low, rng.integers(3, 10))) for _ in range(n))
        yield " ".join("".join(rng.choice(code, rng.integers(6, 12))) for _ in range(n))
        yield " ".join(f'<{rng.choice(["div", "td", "tr"])} id="{rng.integers(1000)}">' for _ in range(n))
        yield " ".join(f"{rng.integers(10**5)} x" for _ in range(n))


def test_language_stage_rejects_planted_letter_noise(spark, stages, tmp_path):
    rng = np.random.default_rng(1)
    texts = [t for _ in range(25) for t in noise_texts(rng)]
    planted = spark.createDataFrame([(-1 - i, t, None, "noise", len(t)) for i, t in enumerate(texts)], stages[0].schema)
    docs = saved(spark, stages[0].unionByName(planted), tmp_path / "planted")
    kept = {r["doc_id"] for r in P.identified(spark, docs, SF01).select("doc_id").collect()}
    assert sum(i < 0 for i in kept) <= 0.01 * len(texts)
    assert {i for i in kept if i >= 0} == {r["doc_id"] for r in stages[1].collect()}
    labelled = {r["doc_id"] for r in stages[0].where("lang is not null").collect() if any(c.isalpha() for c in r["text"] or "")}
    assert len(labelled - kept) <= 0.002 * len(labelled)


def test_quality_stage_drops_bad_and_keeps_good(spark, stages):
    labels = table(spark, SF01, "labels").withColumnRenamed("quality", "label")
    before = {r["doc_id"]: r["label"] for r in stages[1].join(labels, "doc_id").collect()}
    after = {r["doc_id"] for r in stages[2].collect()}
    bad, good = [i for i, y in before.items() if y == 0], [i for i, y in before.items() if y == 1]
    assert sum(i in after for i in good) >= 0.99 * len(good)
    assert sum(i in after for i in bad) <= 0.1 * len(bad)


def test_dedup_stage_equals_brute_force(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    want = {i for i, (_, c) in brute(texts, 5, 80).items() if c == i}
    assert {r["doc_id"] for r in stages[3].collect()} == want


def test_mixing_stage_takes_the_budgets(stages):
    sizes, taken = {}, {}
    for df, into in ((stages[3], sizes), (stages[4], taken)):
        for r in df.collect():
            into[r["source"]] = into.get(r["source"], 0) + len(words(r["text"]))
    want = targets(sizes)
    assert taken == {s: int(t) for s, t in want.items() if int(t)}


def test_encoding_stage_equals_the_library(stages):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = sorted((r["doc_id"], hashlib.sha256(np.array(tok.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest())
                  for r in stages[4].collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in stages[5].collect()) == want


def test_run_equals_the_stages(spark, stages):
    a = sorted(map(tuple, P.run(spark, SF01).drop("ids", "decoded").collect()))
    assert a == sorted(map(tuple, stages[5].drop("ids", "decoded").collect()))


def test_stages_take_edge_rows_and_empty_tables(spark, tmp_path):
    for name, df in (("e", edge_docs(spark).withColumn("row", F.lit(1))), ("n", empty_docs(spark))):
        docs = saved(spark, df, tmp_path / f"{name}-in")
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, SF01)
            assert k == 4 or out.columns == docs.columns
            docs = saved(spark, out, tmp_path / f"{name}-{k}")
        assert (docs.count() == 0) == (name == "n")
