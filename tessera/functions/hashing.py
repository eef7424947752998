"""Deterministic, partition-independent randomness.

Every random decision is a function of (seed, salt, row key): 52 bits of an MD5 digest,
read as an integer and scaled to [0, 1). The same arithmetic exists in DuckDB
(``('0x' || substr(md5(s), 1, 13))::bigint``), which gives every sampling operator an
exact SQL oracle, and the result never depends on partitioning, retries or row order.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(1 << 52)


def _text(seed, salt, keys) -> Column:
    parts = [F.lit(str(seed))]
    if salt is not None:
        parts.append(F.lit(str(salt)))
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        parts.append(c.cast("string"))
    return F.concat_ws("|", *parts)


def hash_bits(seed, salt, *keys) -> Column:
    """52-bit non-negative bigint hash of (seed, salt, keys)."""
    return F.conv(F.substring(F.md5(_text(seed, salt, keys)), 1, 13), 16, 10).cast("bigint")


def hash_uniform(seed, salt, *keys) -> Column:
    """Uniform [0, 1) double from (seed, salt, keys)."""
    return hash_bits(seed, salt, *keys) / F.lit(TWO_52)


def py_uniform(seed, salt, *keys) -> float:
    """Driver-side twin of ``hash_uniform`` for small driver decisions (column picks, pairs)."""
    parts = [str(seed)] + ([str(salt)] if salt is not None else []) + [str(k) for k in keys]
    h = hashlib.md5("|".join(parts).encode()).hexdigest()
    return int(h[:13], 16) / TWO_52


def sql_bits(seed, salt, *key_sql: str) -> str:
    """DuckDB text of ``hash_bits`` (for oracle SQL)."""
    parts = [f"'{seed}'"] + ([f"'{salt}'"] if salt is not None else []) + [f"CAST({k} AS VARCHAR)" for k in key_sql]
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13)) AS BIGINT)"


def sql_uniform(seed, salt, *key_sql: str) -> str:
    return f"({sql_bits(seed, salt, *key_sql)} / 4503599627370496.0::DOUBLE)"


def config_hash(config: dict) -> str:
    """First 16 hex chars of SHA-256 over the key-sorted JSON of a config (``json.dumps``'s
    default separators); floats are rounded to 4 places first (F6)."""

    def norm(v):
        if isinstance(v, float):
            return round(v, 4)
        if isinstance(v, dict):
            return {k: norm(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [norm(x) for x in v]
        return v

    return hashlib.sha256(json.dumps(norm(config), sort_keys=True).encode()).hexdigest()[:16]


#: The steps of every candidate pipeline.
PIPELINE_STEPS = ["preprocessor", "feature_engineering", "classifier"]


def pipeline_hash(classifier: str, transformers: list[str], dim_reduction: str | None, row_sample_pct: float,
                  col_sample_pct: float, steps: list[str] | None = None) -> str:
    """F6 over the six keys that identify a candidate."""
    return config_hash({"classifier": classifier, "col_sample_pct": col_sample_pct, "dim_reduction": dim_reduction,
                        "pipeline_steps": PIPELINE_STEPS if steps is None else steps, "row_sample_pct": row_sample_pct,
                        "transformers": list(transformers)})


def pipeline_hash_col(classifier: Column, transformers: Column, dim_reduction: Column, row_sample_pct: Column,
                      col_sample_pct: Column) -> Column:
    """Column twin of ``pipeline_hash``: the same JSON text, put together by key."""
    names = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    text = F.concat(
        F.lit('{"classifier": "'), classifier, F.lit('", "col_sample_pct": '), F.round(col_sample_pct, 4).cast("string"),
        F.lit(', "dim_reduction": '), F.coalesce(F.concat(F.lit('"'), dim_reduction, F.lit('"')), F.lit("null")),
        F.lit(', "pipeline_steps": ' + json.dumps(PIPELINE_STEPS) + ', "row_sample_pct": '),
        F.round(row_sample_pct, 4).cast("string"), F.lit(', "transformers": '), names(transformers), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)
