"""Write PLANS.md: for headline queries, the physical plan's shape (exchanges, broadcasts,
windows, Python stages, codegen stages) and each parquet scan's pruned schema and pushed
filters, taken from ``explain('formatted')`` at sf0.01 with AQE off (static plan)."""

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import get_session  # noqa: E402

HEADLINE = ["flagship_nb_split_auc", "sm1_stratified_split", "mt1_auc_per_model", "w1_w2_rolling_auc",
            "w4_plateau_counter", "w6_anneal_fold", "s6_worker_state", "a2_run_summary", "p4_accepted_rows",
            "p1_p3_role_projection", "fe2_fe3_scalers", "fe36_yeo_johnson", "en1_en2_row_aggregates",
            "j2_stacked_predictions", "u2_drop_duplicate_texts", "pl3_target_ratio", "m14_knn_exact"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    reg = load_all()
    out = ["# PLANS: static physical plans of headline queries", "",
           "Generated by `tools/plan_report.py` (sf0.01, AQE off so the static plan is shown; at runtime AQE may",
           "turn small shuffle joins into broadcasts and coalesce partitions). Counts are operator nodes in",
           "`explain('formatted')`; `scans` lists each parquet scan's ReadSchema and PushedFilters.", ""]
    for name in HEADLINE:
        df = reg[name].fn(spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        txt = buf.getvalue()
        head = txt.split("\n\n(")[0]
        cnt = lambda pat: len(re.findall(pat, head))
        scans = []
        for block in txt.split("\n\n"):
            if re.match(r"\(\d+\) Scan parquet", block.strip()):
                loc = re.search(r"Location: [^\n]*?([a-z_]+)\.parquet", block)
                pf = re.search(r"PushedFilters: ([^\n]*)", block)
                rs = re.search(r"ReadSchema: ([^\n]*)", block)
                scans.append((loc.group(1) if loc else "?", pf.group(1) if pf else "[]", rs.group(1) if rs else "?"))
        out.append(f"## {name}")
        out.append("")
        out.append(f"- shuffles (Exchange): {cnt(r'[+:]- Exchange') + cnt(r'^Exchange')}, broadcasts: {cnt(r'BroadcastExchange')}, "
                   f"reused exchanges: {cnt(r'ReusedExchange')}, windows: {cnt(r'Window ')}, "
                   f"sort-merge joins: {cnt(r'SortMergeJoin')}, broadcast hash joins: {cnt(r'BroadcastHashJoin')}, "
                   f"python stages: {cnt(r'FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython|FlatMapCoGroups')}, "
                   f"codegen stages: {len(set(re.findall(r'codegen id : (\d+)', txt)))}")
        seen = set()
        for table, pf, rs in scans:
            k = (table, pf, rs)
            if k in seen:
                continue
            seen.add(k)
            out.append(f"- scan `{table}`: ReadSchema `{rs}`; PushedFilters `{pf}`")
        out.append("")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write("\n".join(out) + "\n")


if __name__ == "__main__":
    main()
