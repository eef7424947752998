"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints ONE JSON line.

Each query is forced to full computation with the ``noop`` sink (no driver collect) and
timed separately; ``value`` is the sum. ``scoring_rows_per_sec`` is the throughput of the
fitted scoring pipeline (role preprocessing + naive Bayes) over every base row, the
figure that stands beside the reference's single-process inference number."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tessera.session import get_session

    ck = tempfile.mkdtemp(prefix="tessera-bench-ckpt-")
    spark = get_session(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.checkpoint.dir": ck, "spark.driver.memory": "16g"})
    from pyspark.sql import functions as F

    from tessera.operators.features import OneHot, OrdinalEncode, StandardScale, apply_chain, fit_chain
    from tessera.operators.models import GaussianNB
    from tessera.operators.search import SearchConfig, run_search
    from tessera.plans.q_flagship import NOMINAL, NUMERIC, ORDINAL
    from tessera.plans.q_models import X, planted_frame
    from tessera.plans.registry import load_all
    from tessera.session import scratch_path
    from tessera.sources import views as V

    reg = load_all()
    # warm-up (JVM JIT, Python workers) so per-query times measure the queries themselves
    import pandas as pd

    V.base(spark, sf_dir).groupBy("label").count().collect()
    spark.range(1000).withColumn("k", F.col("id") % 4).groupBy("k").applyInPandas(
        lambda p: pd.DataFrame({"k": [int(p["k"].iloc[0])]}), "k long").collect()
    headline = ["flagship_nb_split_auc", "sm1_stratified_split", "mt1_auc_per_model", "en1_en2_row_aggregates",
                "en5_en7_diversity", "a2_run_summary", "w1_w2_rolling_auc", "w4_plateau_counter", "w6_anneal_fold",
                "s6_worker_state", "fe2_fe3_scalers", "fe10_fe13_random_pairs", "fe18_binning", "fe36_yeo_johnson",
                "pl3_target_ratio", "m9_lda", "m14_knn_exact", "st5_anneal_stream"]
    times = {}

    def run(name, fn):
        t0 = time.time()
        df = fn()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    for q in headline:
        run(q, lambda q=q: reg[q].fn(spark, sf_dir))

    # scoring pipeline throughput (fit excluded: fitted once, then every base row scored)
    b = V.base(spark, sf_dir)
    onehot = OneHot(NOMINAL)
    ops = fit_chain([StandardScale(NUMERIC), OrdinalEncode(ORDINAL), onehot], b)
    nb = GaussianNB(NUMERIC + list(ORDINAL) + onehot.outputs()).fit(apply_chain(ops, b))
    n_rows = b.count()
    t0 = time.time()
    nb.transform(apply_chain(ops, b)).select("row_id", "p").write.format("noop").mode("overwrite").save()
    score_sec = time.time() - t0
    times["scoring_pipeline"] = round(score_sec, 3)

    pool = planted_frame(spark, sf_dir)
    run("search_one_batch", lambda: (run_search(spark, pool, X, SearchConfig(n_batches=1, batch_size=4, models=["naive_bayes", "lda", "qda", "ridge", "logistic"]),
                                                scratch_path(spark, "bench-search")) and None))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": int(cpus),
                      "scoring_rows": n_rows, "scoring_rows_per_sec": round(n_rows / score_sec, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
