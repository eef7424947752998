"""Generated features at full width (FE23-FE25, FE29 with FE9; SURVEY D7).

All pairs of 45 columns make some 5,000 features: too many for named columns. They are one
``array<double>`` column here, computed in numpy on Arrow batches that are cut so that a piece
has at most ``CELLS`` numbers at any width. A feature is a row of a small table (kind and the
places of its inputs), so a selection of features is a selection of that table's rows, and a
fitted selector computes only the features that it kept.

The ANOVA scores need no wide rows at all: each task adds up count, mean and squared deviations per
(class, feature) over its rows, as tuples; Spark merges the tuples of all tasks by two aggregations,
first to the means, then to the deviations from them. Nothing is grouped by class alone, and what
reaches the driver is one number a feature.

A feature without a finite value (an input that is null or NaN, a division by zero) is null in the array
and left out of the counts of that feature.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite_or_null
from ..session import track
from .features import Op, poly_terms

#: Numbers in a piece of generated features.
CELLS = 1 << 20
#: Feature kinds: difference and sum over combinations, ratio over ordered pairs with the
#: fitted offset, products of up to four inputs.
KINDS = ("difference", "sum", "ratio", "product")
DEGREE = 4


def wide_terms(n: int, kinds: tuple = ("difference", "sum", "ratio"), degree: int = 0, interaction_only: bool = False,
               bias: bool = True) -> np.ndarray:
    """The table of features of ``n`` inputs [feature, 1 + DEGREE]: the kind's number and the places
    of its inputs, -1 where there are fewer. In the order of ``kinds``, then the polynomial's terms."""
    if degree > DEGREE:
        raise ValueError(f"degree {degree} is over {DEGREE}")
    rows = []
    for kind in kinds:
        pairs = itertools.permutations(range(n), 2) if kind == "ratio" else itertools.combinations(range(n), 2)
        rows += [(KINDS.index(kind), i, j) for i, j in pairs]
    if degree:
        rows += [(KINDS.index("product"), *t) for t in poly_terms(n, degree, interaction_only, bias)]
    out = np.full((len(rows), 1 + DEGREE), -1, np.int64)
    for at, r in enumerate(rows):
        out[at, :len(r)] = r
    return out


def wide_values(x: np.ndarray, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[row, feature] of ``x`` [row, input]; NaN where a feature has no finite value."""
    out = np.empty((len(x), len(terms)))
    with np.errstate(all="ignore"):
        for number, kind in enumerate(KINDS):
            at = np.flatnonzero(terms[:, 0] == number)
            if not len(at):
                continue
            if kind == "product":
                got = np.ones((len(x), len(at)))
                for k in range(1, 1 + DEGREE):
                    own = terms[at, k]
                    has = own >= 0
                    got[:, has] *= x[:, own[has]]
            else:
                a, b = x[:, terms[at, 1]], x[:, terms[at, 2]]
                got = a - b if kind == "difference" else a + b if kind == "sum" else a / (b + offsets[terms[at, 2]])
            out[:, at] = got
    out[~np.isfinite(out)] = np.nan
    return out


def _matrix(batch: pa.RecordBatch, inputs: int) -> np.ndarray:
    """The first ``inputs`` columns of doubles as [row, input], nulls as NaN."""
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(inputs)])


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, width))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class WideFeatures(Op):
    """All pairs and polynomial terms of ``inputs`` as one array column ``out`` (FE23-FE25, FE29). Other
    columns pass through; a column named ``out`` is replaced."""

    def __init__(self, inputs, kinds=("difference", "sum", "ratio"), degree=0, interaction_only=False, bias=True, out="features"):
        self.inputs, self.out = list(inputs), out
        self.terms = wide_terms(len(self.inputs), kinds, degree, interaction_only, bias)
        self.state = {}

    def fit(self, df):
        least = [None] * len(self.inputs)
        if (self.terms[:, 0] == KINDS.index("ratio")).any():
            least = list(df.agg(*[F.min(finite_or_null(c)).alias(f"m{i}") for i, c in enumerate(self.inputs)]).first())
        self.state = {"offset": [(v or 0.0) + 1.0 for v in least]}
        return self

    def outputs(self):
        return [self.out]

    def names(self) -> list[str]:
        """Names of the features in the array's order, as the narrow operators give them."""
        tags = {"difference": "diff", "sum": "sum", "ratio": "ratio", "product": "poly"}
        out = []
        for kind, *places in self.terms.tolist():
            own = [self.inputs[p] for p in places if p >= 0]
            out.append("_".join([tags[KINDS[kind]], *(own or ["1"])]))
        return out

    def _doubles(self, df):
        return [F.col(f"`{c}`").cast("double").alias(f"_in{i}") for i, c in enumerate(self.inputs)]

    def transform(self, df):
        terms, offsets, inputs = self.terms, np.array(self.state["offset"]), len(self.inputs)
        rest = [c for c in df.columns if c != self.out]
        given = df.select(*self._doubles(df), *[F.col(f"`{c}`") for c in rest])
        names = [*rest, self.out]

        def run(batches):
            for b in _pieces(batches, len(terms)):
                v = wide_values(_matrix(b, inputs), terms, offsets)
                flat = pa.array(v.ravel(), pa.float64(), mask=np.isnan(v.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(terms)), flat)
                yield pa.RecordBatch.from_arrays([*b.columns[inputs:], lists], names=names)

        schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(self.out, T.ArrayType(T.DoubleType()))])
        return given.mapInArrow(run, schema)

    def class_sums(self, df: DataFrame, label: str) -> DataFrame:
        """(label, place, n, mean, dev) per task: rows, mean and squared deviations of each feature. Rows
        without a label are left out."""
        terms, offsets, inputs = self.terms, np.array(self.state["offset"]), len(self.inputs)
        given = df.where(F.col(label).isNotNull()).select(*self._doubles(df), F.col(label).cast("string").alias("_label"))

        def run(batches):
            held: dict = {}
            for b in _pieces(batches, len(terms)):
                v = wide_values(_matrix(b, inputs), terms, offsets)
                labels = b.column(inputs).to_numpy(zero_copy_only=False)
                for k in dict.fromkeys(labels.tolist()):
                    own = v[labels == k]
                    good = ~np.isnan(own)
                    n = good.sum(0)
                    mean = np.where(good, own, 0.0).sum(0) / np.maximum(n, 1)
                    dev = (np.where(good, own - mean, 0.0) ** 2).sum(0)
                    if k in held:
                        n0, mean0, dev0 = held[k]
                        total = np.maximum(n0 + n, 1)
                        gap = mean - mean0
                        held[k] = (n0 + n, mean0 + gap * n / total, dev0 + dev + gap * gap * n0 * n / total)
                    else:
                        held[k] = (n, mean, dev)
            for k, (n, mean, dev) in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                                  pa.array(n[at].astype(np.int64)), pa.array(mean[at]), pa.array(dev[at])],
                                                 names=["label", "place", "n", "mean", "dev"])

        return given.mapInArrow(run, "label string, place int, n long, mean double, dev double")


def wide_anova(op: WideFeatures, df: DataFrame, label: str) -> DataFrame:
    """(place, f_stat) of every feature of a fitted ``op``: the one-way ANOVA F over its finite values.
    Null where nothing varies, or fewer than two classes or no spare rows are left; infinite where
    only the classes differ."""
    parts = track(op.class_sums(df, label))  # a row per task, class and feature, however many rows there are; read twice
    # first the means of classes, then the deviations from them: no difference of large sums
    means = parts.groupBy("place", "label").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))
    merged = (parts.join(means, ["place", "label"]).groupBy("place", "label")
              .agg(F.sum("n").alias("n"), F.first("m").alias("m"),
                   F.sum(F.col("dev") + F.col("n") * (F.col("mean") - F.col("m")) * (F.col("mean") - F.col("m"))).alias("dev")))
    grand = merged.groupBy("place").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    gap = F.col("m") - F.col("grand")
    per = merged.join(grand, "place").groupBy("place").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
                                                           F.sum(F.col("n") * gap * gap).alias("between"), F.sum("dev").alias("within"))
    score = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    f = (F.when((F.col("k") < 2) | (F.col("n") <= F.col("k")), F.lit(None))
         .when(F.col("within") > 0, score).when(F.col("between") > 0, F.lit(float("inf"))))
    places = df.sparkSession.range(len(op.terms)).select(F.col("id").cast("int").alias("place"))
    return places.join(per.select("place", f.cast("double").alias("f_stat")), "place", "left")


class WideSelect(Op):
    """FE9 over generated features: the top ``percentile`` % by ANOVA F, ties and features without F to
    the earlier place. ``transform`` computes the kept features only, in their order."""

    def __init__(self, wide: WideFeatures, label, percentile=50):
        self.wide, self.label, self.pct, self.state = wide, label, percentile, {}

    def fit(self, df):
        self.wide.fit(df)
        scores = wide_anova(self.wide, df, self.label)
        f = np.full(len(self.wide.terms), -1.0)
        for r in scores.where(F.col("f_stat").isNotNull()).collect():  # one number a feature
            f[r["place"]] = r["f_stat"]
        k = max(1, int(len(f) * self.pct / 100))
        keep = sorted(np.lexsort((np.arange(len(f)), -f))[:k].tolist())
        self.state = {"keep": keep, "f": [None if v < 0 else float(v) for v in f], "offset": self.wide.state["offset"]}
        return self

    def outputs(self):
        return [self.wide.out]

    def kept(self) -> WideFeatures:
        """The operator of the kept features alone."""
        op = WideFeatures(self.wide.inputs, (), out=self.wide.out)
        op.terms, op.state = self.wide.terms[self.state["keep"]], {"offset": self.state["offset"]}
        return op

    def transform(self, df):
        return self.kept().transform(df)
