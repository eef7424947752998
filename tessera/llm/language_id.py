"""Language identification with a byte convolutional network.

Bytes fall in classes (letters a-z with case folded, white space, digits, other ASCII, every
byte above 127). Filters of several widths run over fixed-length windows of classes; each
filter keeps its largest response in a window, and a softmax layer makes language
probabilities of these. It is trained in numpy with Adam on windows of labelled documents:
at most ``DOCS_PER_LANGUAGE`` documents of each language, chosen by hash. It is applied to
every window of every whole text in batches inside the tasks; a document's probabilities are
its windows' mean, weighted by letters. Nothing is shuffled.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for all
texts if no labelled document exists; repeated rows get equal results; an empty table gives
an empty table; rows with a null language or id are predicted but not learned from.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import exact_quantiles
from ..session import stored
from .common import bound_batches, text_slices, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bound of the labelled sample, and windows taken from each of its documents.
DOCS_PER_LANGUAGE = 300
WINDOWS_PER_DOC = 4
#: The share of the rightly predicted documents under the least score, and its distance from an even vote.
LOST = 0.001
MARGIN = 0.05
N_CLASSES = 157
SPACE, DIGIT, OTHER, HIGH = 26, 27, 28, 29
UNDETERMINED = "und"
TAGS = ["div", "td", "tr", "span", "li", "a", "p", "img", "ul", "/div", "/td", "/span", "/a", "br", "meta", "link"]
ATTRIBUTES = ["id", "class", "href", "style", "src", "width", "rel", "name"]


def byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for b in range(26):
        out[65 + b] = out[97 + b] = b
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[48:58] = DIGIT
    out[128:] = HIGH + np.arange(128)
    return out


CLASS_OF = byte_classes()
IS_LETTER = (CLASS_OF < 26) | (CLASS_OF >= HIGH)


@dataclass
class ByteConvNet:
    languages: list[str]
    #: for each width w an array [w, class, filter]
    filters: list[np.ndarray] = field(default_factory=list)
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None

    @staticmethod
    def fresh(languages: list[str], seed: int = 7, noise: bool = False) -> ByteConvNet:
        """Untrained; with ``noise`` the softmax has one more class, after the languages."""
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.5 / w, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        k, classes = len(WIDTHS) * FILTERS, len(languages) + noise
        return ByteConvNet(languages, filters, rng.normal(0, k**-0.5, (k, classes)).astype(np.float32),
                           np.zeros(classes, np.float32))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02,
            seed: int = 11) -> ByteConvNet:
        """Adam on the cross entropy. Only a filter's largest response in a window has a
        gradient, so each step touches few entries of the tables."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.weight, self.bias]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                x, y = windows[pick].astype(np.int64), labels[pick]
                rows = np.arange(len(pick))
                pooled, best = [], []
                for f in self.filters:
                    w = len(f)
                    act = sum(f[j][x[:, j:WINDOW - w + 1 + j]] for j in range(w))
                    where = act.argmax(1)
                    best.append(where)
                    pooled.append(np.take_along_axis(act, where[:, None, :], 1)[:, 0, :])
                hidden = np.concatenate(pooled, 1)
                delta = softmax(hidden @ self.weight + self.bias)
                delta[rows, y] -= 1
                delta /= len(pick)
                back = delta @ self.weight.T
                grads = []
                for i, f in enumerate(self.filters):
                    g = np.zeros_like(f)
                    part = back[:, i * FILTERS:(i + 1) * FILTERS]
                    cols = np.broadcast_to(np.arange(FILTERS), part.shape)
                    for j in range(len(f)):
                        np.add.at(g[j], (x[rows[:, None], best[i] + j], cols), part)
                    grads.append(g)
                grads += [hidden.T @ delta, delta.sum(0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        return self

    def compiled(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """Per width the lookups that make a response: (offset, span, [filter, index]) with
        tables over two neighbouring classes where a width allows."""
        plan = []
        for f in self.filters:
            parts, j = [], 0
            while j < len(f):
                if j + 1 < len(f):
                    pair = f[j][:, None, :] + f[j + 1][None, :, :]
                    parts.append((j, 2, np.ascontiguousarray(pair.reshape(-1, FILTERS).T)))
                    j += 2
                else:
                    parts.append((j, 1, np.ascontiguousarray(f[j].T)))
                    j += 1
            plan.append(parts)
        return plan

    def probabilities(self, windows: np.ndarray, plan=None) -> np.ndarray:
        """[window, language] for an array of classes [window, WINDOW]."""
        plan = plan or self.compiled()
        n = len(windows)
        single = windows.astype(np.intp)
        pair = single[:, :-1] * N_CLASSES + single[:, 1:]
        hidden = np.empty((n, len(plan) * FILTERS), np.float32)
        for i, parts in enumerate(plan):
            width = sum(span for _, span, _ in parts)
            places = WINDOW - width + 1
            index = [(pair if span == 2 else single)[:, j:j + places] for j, span, _ in parts]
            for k in range(FILTERS):
                act = parts[0][2][k].take(index[0])
                for (_, _, t), ix in zip(parts[1:], index[1:], strict=True):
                    act += t[k].take(ix)
                hidden[:, i * FILTERS + k] = act.max(1)
        return softmax(hidden @ self.weight + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pad_windows(texts: list[bytes]) -> np.ndarray:
    out = np.full((len(texts), WINDOW), SPACE, np.uint8)
    for i, t in enumerate(texts):
        c = CLASS_OF[np.frombuffer(t[:WINDOW], np.uint8)]
        out[i, :len(c)] = c
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_language: int = DOCS_PER_LANGUAGE, noise: bool = False) -> ByteConvNet:
    """Fit on a bounded sample of ``docs``: of each language the ``docs_per_language`` rows
    with the smallest id hash. Callers pass the rows that may be learned from. With ``noise``
    the network also learns windows without a language (``noise_windows``), which take
    probability from the languages."""
    from pyspark.sql import Window

    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("lang"))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return ByteConvNet([])
    # thin each language by hash to about twice the sample before texts are sorted
    span = 1 << 32
    limits = F.create_map(*[x for k, n in counts.items()
                            for x in (F.lit(k), F.lit(min(span, int(span * 2 * docs_per_language / n))))])
    thinned = labelled.where(F.pmod(order, F.lit(span)) < F.element_at(limits, F.col(lang_col)))
    starts = F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1))
    rows = (
        thinned.select(F.col(lang_col).alias("lang"), F.pmod(order, F.lit(span)).alias("o"), F.col(id_col).alias("id"),
                       F.transform(starts, lambda i: F.substring(
                           F.col(text_col), 1 + F.floor(i * F.length(text_col) / WINDOWS_PER_DOC).cast("int"),
                           F.lit(WINDOW))).alias("windows"))
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "id")))
        .where(F.col("r") <= docs_per_language).select("lang", "windows").collect())
    languages = sorted(counts)
    data = [(w.encode(), languages.index(r["lang"])) for r in rows for w in dict.fromkeys(r["windows"])]
    data = sorted((w, k) for w, k in data if IS_LETTER[np.frombuffer(w[:WINDOW], np.uint8)].sum() >= 8)
    net = ByteConvNet.fresh(languages, noise=noise)
    if data and noise:
        data += [(p, k) for w, k in data for p in [short_piece(w)] if p]
        data += [(w, len(languages)) for w in noise_windows([w for w, _ in data])]
    if data:
        net.fit(pad_windows([w for w, _ in data]), np.array([k for _, k in data]))
    return net


def short_piece(window: bytes) -> bytes:
    """One to five words of a window, so that short texts are learned as well, some of them
    after a number; empty without words."""
    parts = window[:WINDOW].split()[1:-1]  # the outer ones may be cut
    at, n = zlib.crc32(window) % max(len(parts), 1), zlib.crc32(window, 1)
    number = b"+%d (%d) %d " % (n % 100, n % 1000, n) if parts and n % 3 == 0 else b""
    return number + b" ".join(parts[at:at + 1 + n % 5])


def noise_windows(windows: list[bytes], seed: int = 5) -> list[bytes]:
    """One window without a language for each of some with one, in turn: its bytes in random
    order, its letters replaced by random ones, codes, markup, numbers with a few lone letters."""
    rng = np.random.default_rng(seed)
    letters, codes = np.frombuffer(string.ascii_lowercase.encode(), np.uint8), np.frombuffer(
        (string.ascii_uppercase + string.digits + "-_").encode(), np.uint8)
    out = []
    for i, w in enumerate(windows):
        raw = np.frombuffer(w[:WINDOW], np.uint8)
        if i % 5 == 0:
            made = rng.permutation(raw)
        elif i % 5 == 1:
            made = np.where(IS_LETTER[raw], rng.choice(letters, len(raw)), raw)
        elif i % 5 == 2:
            made = np.where(CLASS_OF[raw] == SPACE, raw, rng.choice(codes, len(raw)))
        elif i % 5 == 3:
            tags = [f'<{t} {a}="{n}">' for t, a, n in zip(rng.choice(TAGS, 20), rng.choice(ATTRIBUTES, 20),
                                                       rng.integers(0, 1000, 20), strict=True)]
            made = np.frombuffer(" ".join(tags).encode()[:max(len(raw), 8)], np.uint8)
        else:
            digits = np.where(CLASS_OF[raw] == SPACE, raw, rng.integers(48, 58, len(raw)))
            made = np.where((CLASS_OF[raw] != SPACE) & (rng.random(len(raw)) < 0.05), rng.choice(letters, len(raw)), digits)
        out.append(made.astype(np.uint8).tobytes())
    return out


def classify(net: ByteConvNet, column, plan=None) -> tuple[list[str], np.ndarray]:
    """Languages and scores of an Arrow column of texts."""
    n = len(column)
    names, scores = [UNDETERMINED] * n, np.zeros(n)
    if not net.languages or n == 0:
        return names, scores
    plan = plan or net.compiled()
    for row, to, starts, raw in text_slices(column):
        length = np.diff(starts)
        n_windows = -(-length // WINDOW)
        first = np.concatenate([[0], np.cumsum(n_windows)])
        classes = np.full(first[-1] * WINDOW, SPACE, np.uint8)
        shift = np.repeat(first[:-1] * WINDOW - starts[:-1], length)
        classes[np.arange(len(raw)) + shift] = CLASS_OF[raw]
        windows = classes.reshape(-1, WINDOW)
        letters = ((windows < 26) | (windows >= HIGH)).sum(1)
        probs = np.empty((len(windows), len(net.bias)), np.float64)
        for at in range(0, len(windows), 512):
            probs[at:at + 512] = net.probabilities(windows[at:at + 512], plan)
        owner = np.repeat(np.arange(to - row), n_windows)
        weight = np.bincount(owner, letters, minlength=to - row)
        mean = np.stack([np.bincount(owner, probs[:, k] * letters, minlength=to - row)
                         for k in range(len(net.languages))], 1) / np.maximum(weight, 1)[:, None]
        plain = np.bincount(owner, (windows < 26).sum(1), minlength=to - row) > 0
        for i in np.flatnonzero(weight):
            if plain[i] or any(ch.isalpha() for ch in column[row + int(i)].as_py()):
                k = int(mean[i].argmax())
                names[row + i], scores[row + i] = net.languages[k], min(1.0, mean[i, k])
    return names, scores


def predict(docs: DataFrame, net: ByteConvNet, text_col: str = "text", lang_name: str = "lang_pred",
            score_name: str = "lang_score") -> DataFrame:
    """``docs`` with two more columns; ``lang_name`` and ``score_name`` must be new names."""
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()),
                           T.StructField(score_name, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        plan = net.compiled() if net.languages else None
        for b in batches:
            names, scores = classify(net, b.column(at), plan)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=schema.names)

    return bound_batches(docs).mapInArrow(tidy(run), schema)


def held_out(id_col: Column) -> Column:
    """The test fold: crc32 of the id as text leaves no remainder by 5. A null id is not in it."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def least_score(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> float:
    """The score that all but ``LOST`` of the labelled ``docs`` with the right prediction reach, over all of
    them. Not over 0.5, as a language that is more likely than all else is clear, and at least ``MARGIN`` over
    an even vote of the languages. The scores are written once; the quantile is exact and gathers no rows."""
    floor = min(0.5, 1 / max(len(net.languages), 1) + MARGIN)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    right = predict(labelled, net).where(F.col("lang") == F.col("lang_pred")).select("lang_score")
    found = exact_quantiles(stored(right, "lang-scores"), ["lang_score"], [LOST])["lang_score"][0]
    return floor if found is None else max(floor, min(0.5, found))


def keep_identified(docs: DataFrame, net: ByteConvNet, least_score: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that have a language: a text that is null, has no letter or whose
    best language scores under ``least_score`` is rejected."""
    lang, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "lang_score")
    out = predict(docs, net, text_col, lang, score)
    return out.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least_score)).select(*docs.columns)


def fresh_name(df: DataFrame, base: str) -> str:
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
