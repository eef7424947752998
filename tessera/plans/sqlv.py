"""Oracle SQL building blocks: view CTEs and formatting twins of Spark expressions."""

from __future__ import annotations

from ..sources import views as V

EPOCHS_SQL = """SELECT run_id AS ensemble_id, iteration_num AS epoch, training_time_sec / 1000.0 AS train_loss,
  training_time_sec / 900.0 + 0.01 AS val_loss, 1.0 - training_time_sec / 1000.0 AS train_auc,
  0.98 - training_time_sec / 1100.0 AS val_auc FROM runlog WHERE classifier_type = 'view'"""

WSTATE_SQL = """SELECT worker_id, arg_max(status, (ts, event_id)) AS status,
  arg_max(iteration_num, (ts, event_id)) AS iteration_num, arg_max(batch_num, (ts, event_id)) AS batch_num,
  arg_max(classifier_type, (ts, event_id)) AS classifier_type, arg_min(start_time, (ts, event_id)) AS start_time,
  arg_max(end_time, (ts, event_id)) AS end_time, arg_max(runtime_sec, (ts, event_id)) AS runtime_sec,
  arg_max(pipeline_hash, (ts, event_id)) AS pipeline_hash, max(ts) AS last_update
FROM workers GROUP BY worker_id"""

VIEWS = {
    "base": V.BASE_SQL, "base_agg": V.BASE_AGG_SQL, "dirty": V.DIRTY_SQL, "preds": V.PREDS_SQL,
    "runlog": V.RUNLOG_SQL, "workers": V.WORKERS_SQL, "lists": V.LISTS_SQL, "semiview": V.SEMI_SQL,
    "sizes": V.SIZES_SQL, "dups": V.DUPS_SQL, "epochs": EPOCHS_SQL, "wstate": WSTATE_SQL,
}
DEPS = {"epochs": ["runlog"], "wstate": ["workers"]}


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause defining the named views (dependencies first) and optional extra CTEs."""
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def r6(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6)"
