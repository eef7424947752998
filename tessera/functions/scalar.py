"""Scalar column helpers (F1-F9). All are built-in Spark expressions, codegen-friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double_array(values) -> Column:
    """A constant array of doubles that the optimizer folds to ONE literal (an expression per
    element would make plans of thousands of nodes). Python's and Java's texts of a double agree."""
    names = {float("inf"): "Infinity", float("-inf"): "-Infinity"}
    text = ",".join("NaN" if v != v else names.get(v) or repr(v) for v in map(float, values))
    return F.split(F.lit(text), ",").cast("array<double>")


def sigmoid(x) -> Column:
    """1/(1+exp(-x)) (F2)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def signed_log(x) -> Column:
    """ln(|x|+1)*sign(x) (FE17)."""
    return F.log1p(F.abs(col(x))) * F.signum(col(x))


def signed_sqrt(x) -> Column:
    """sqrt(|x|)*sign(x) (FE16)."""
    return F.sqrt(F.abs(col(x))) * F.signum(col(x))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo) if not isinstance(lo, Column) else lo),
                   F.lit(hi) if not isinstance(hi, Column) else hi)


def finite_or_null(x) -> Column:
    """NaN, +inf and -inf become null; null stays null (FE1 normalisation)."""
    c = col(x).cast("double")
    return F.when(F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf"))), F.lit(None)).otherwise(c)


def r6(x) -> Column:
    """Output rounding used by every registered query (float sums differ in the last bits
    across partitionings; 6 places keep results comparable)."""
    return F.round(col(x).cast("double"), 6)


def runtime_text(runtime_sec, status=None, start=None, end=None, now=None) -> Column:
    """'12s' below a minute, whole minutes '3m' otherwise, 'N/A' when missing (F5). With the
    other columns given: end - start for a row that has both, now - start for a running one,
    the stored runtime or 0 for any other started row, 'N/A' without a start."""
    rt = col(runtime_sec)
    if status is not None and start is not None and end is not None and now is not None:
        span = lambda a, b: F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") / F.lit(1e6)
        rt = F.when(col(start).isNotNull(),
                    F.when(col(end).isNotNull(), span(start, end))
                    .when(col(status) == F.lit("running"), span(start, f"TIMESTAMP_NTZ'{now}'"))
                    .otherwise(F.coalesce(rt, F.lit(0.0))))
    return (F.when(rt.isNull(), F.lit("N/A"))
            .when(rt < 60, F.concat(F.floor(rt).cast("string"), F.lit("s")))
            .otherwise(F.concat(F.floor(rt / 60).cast("string"), F.lit("m"))))


def last_token_int(x: str, sep: str = "_") -> Column:
    """Last token after ``sep`` as int; failures become null."""
    return F.element_at(F.split(F.col(x), sep), -1).try_cast("int")


def clock_text(ts) -> Column:
    """Format a timestamp as 'hh:mm:ss AM' (F4)."""
    return F.date_format(col(ts), "hh:mm:ss a")
