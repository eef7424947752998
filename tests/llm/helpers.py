"""Small frames and plain rewrites that the tests of this package share."""

import numpy as np
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

SHINGLE_TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"

#: Nulls in every column, empty and blank texts, a very long text and a very long word, ties, repeated rows.
EDGE_ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "the cat sat on the mat", "en", "a", 22),
    (4, "the cat sat on the mat", "en", "a", 22),
    (5, "the cat sat on the mat", "de", "b", 22),
    (6, "word " * 60_000, "en", "b", 300_000),
    (7, "x" * 200_000, None, "b", 200_000),
    (8, "12 34 !! ??", "en", "c", 11),
    (9, "Éàü ñ ß 漢字 И", "fr", "é", 12),
    (None, "a row without an id", "en", "a", 19),
    (None, None, None, None, None),
    (10, "a\x0bb\x0cc d e", "en", "\U0001f600", 9),
    (11, SHINGLE_TEXT, "en", "z", 80),
    (12, SHINGLE_TEXT.upper(), "en", "z", 80),
]


def edge_docs(spark):
    return spark.createDataFrame(EDGE_ROWS, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def saved(spark, df, path):
    """``df`` read from Parquet, as the operators get their tables."""
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def good_vector(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
