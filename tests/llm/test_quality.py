import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality as Q
from tessera.llm.common import table
from tessera.llm.queries import op6_quality
from tests.conftest import SF01

from .helpers import edge_docs, empty_docs, saved


@pytest.fixture(scope="module")
def evidence(spark):
    return Q.train(table(spark, SF01, "documents"), table(spark, SF01, "labels"))


def test_query_agrees_with_labels(spark):
    labels = table(spark, SF01, "labels").withColumnRenamed("quality", "label")
    got = op6_quality(spark, SF01)
    assert got.count() == 1000
    r = got.join(labels, "doc_id").agg(
        F.avg((F.col("kept") == (F.col("label") == 1)).cast("double")),
        F.sum((~F.col("kept") & (F.col("label") == 1)).cast("int"))).first()
    assert r[0] >= 0.97 and r[1] <= 2


def test_accuracy_on_unseen_labels(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels").withColumnRenamed("quality", "label")
    e = Q.train(docs, labels.where("doc_id % 2 = 0"), quality_col="label")
    got = Q.score(spark, docs, e, F.col("source"), F.col("lang")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    assert got.agg(F.avg(((F.col("quality") >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0] >= 0.95


def test_posterior_equals_plain_shrinkage(spark, evidence):
    rows = Q.score(spark, table(spark, SF01, "documents"), evidence, F.col("source"), F.col("lang")).collect()
    base = np.log(evidence.rate / (1 - evidence.rate))
    p = {r["doc_id"]: 1 / (1 + np.exp(-(r["log_factor"] + base))) for r in rows}
    paths, hosts = {}, {}
    for r in rows:
        for d, k in ((paths, (r["host"], r["path"])), (hosts, r["host"])):
            n, s = d.get(k, (0, 0.0))
            d[k] = (n + 1, s + p[r["doc_id"]])
    overall = sum(p.values()) / len(p)

    def fit(groups):
        use = [(n, s / n, q) for n, s, q in groups]
        w = sum(n for n, _, _ in use)
        between = (sum(n * (m - q) ** 2 for n, m, q in use) - sum(q * (1 - q) for _, _, q in use)) / w
        unit = sum(n * q * (1 - q) for n, _, q in use) / w
        return Q.MOST_STRENGTH if between <= unit / Q.MOST_STRENGTH else min(Q.MOST_STRENGTH, max(Q.LEAST_STRENGTH, unit / between - 1))

    k_host = fit([(n, s, overall) for n, s in hosts.values()])
    rate = {h: (s + k_host * overall) / (n + k_host) for h, (n, s) in hosts.items()}
    k_path = fit([(n, s, rate[h]) for (h, _), (n, s) in paths.items()])
    for r in rows:
        n, s = paths[r["host"], r["path"]]
        site = (k_path * rate[r["host"]] + s - p[r["doc_id"]]) / (k_path + n - 1)
        site = min(0.999, max(0.001, site))
        assert r["site_rate"] == pytest.approx(site, rel=1e-9)
        assert r["quality"] == pytest.approx(1 / (1 + np.exp(-(r["log_factor"] + np.log(site / (1 - site))))), rel=1e-9)


def test_sparse_sites_stay_near_the_prior(spark):
    """A large bad site pulls a doubtful text down; a site of two texts hardly moves."""
    rows = [("big", "x", 0.02)] * 500 + [("fine", "x", 0.95)] * 500 + [("tiny", "x", 0.02)] * 2 + [(None, None, 0.9)] * 3
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    sites, _ = Q.site_rates(spark, scored, 0.8)
    rate = {r["host"]: r["host_rate"] for r in sites.collect()}
    assert rate["big"] < 0.05 and rate["fine"] > 0.9
    assert rate["big"] < rate["tiny"] < rate["fine"] and None in rate


def test_long_tailed_sites_set_the_strength(spark):
    """Thousands of sites of one or two texts: where all rates are alike the prior holds, where sites
    differ it gives way, though no site has five texts."""
    def k(rate):
        rows = [(f"h{i}", "x", rate(i, j)) for i in range(3_000) for j in range(1 + i % 2)]
        scored = spark.createDataFrame(rows, "host string, path string, p double")
        groups = scored.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("p").alias("m")).withColumn("prior", F.lit(0.5))
        return Q.strength(groups, "n", "m", "prior")

    assert k(lambda i, j: float((i * 7 + j * 5) % 11 < 5.5)) > 20
    assert k(lambda i, j: float(i % 4 < 2)) < 3


def test_a_repeated_labelled_id_is_one_row_of_the_fit(spark, monkeypatch):
    docs = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.union(spark.createDataFrame([(8, "another one"), (9, "and one more")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "doc_id long, quality long")
    seen = []
    monkeypatch.setattr(Q, "fit_evidence", lambda x, y: seen.append(len(x)))
    Q.train(docs, labels)
    assert seen == [3]


def test_edges(spark, evidence, tmp_path):
    df = saved(spark, edge_docs(spark).withColumn("row", F.lit("mine")).withColumn("host", F.lit(1)).withColumn("p", F.lit(0)),
               tmp_path / "e")
    out = Q.score(spark, df, evidence, F.col("source"), F.col("lang")).collect()
    assert len(out) == 15 and all(0 <= r["quality"] <= 1 for r in out)
    kept = Q.keep_good(spark, df, evidence, F.col("source"), F.col("lang"))
    assert kept.columns == df.columns and {r["row"] for r in kept.collect()} <= {"mine"}
    none = Q.train(df, table(spark, SF01, "labels").where("quality = 1"))
    assert Q.keep_good(spark, df, none, F.col("source"), F.col("lang")).count() == 15
    empty = saved(spark, empty_docs(spark), tmp_path / "n")
    assert Q.score(spark, empty, evidence, F.col("source"), F.col("lang")).count() == 0
    assert Q.train(empty, table(spark, SF01, "labels")).rate == 0.5
