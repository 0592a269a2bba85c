"""A quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of a document's bytes and words. Boosting goes round the features in turn, and each step fits a
shallow tree on the bins of that one feature to the residuals and adds it to the feature's lookup table; then the pairs of
features with the strongest remaining interaction get two-way tables in the same manner. A score is the sum of table entries at a
document's bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .sampling import labelled
from .store import arrow_function

PER_CLASS, BINS, PAIR_BINS, ROUNDS, RATE, PAIRS, LEAVES, THRESHOLD = 4000, 48, 12, 150, 0.1, 8, 3, 0.5
FEATURES = ("bytes", "mean_word", "upper", "stops", "symbols", "digits", "foreign", "spaces", "lines", "distinct_words", "long_words", "shouts", "pipes", "glued", "repeats")
U64 = np.uint64


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[[ord(c) for c in chars]] = 1
    return t


_UPPER, _DIGIT, _STOP = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".,;:'\"-()?")
_SYMBOL, _SPACE, _LINE, _SHOUT, _PIPE = _table("#$%&*@^~=+<>{}[]\\/_`"), _table(" \t\r"), _table("\n"), _table("!"), _table("|")
_HIGH = (np.arange(256) >= 128).astype(np.int32)
_ALNUM = ((K._CLASS == 1) | (K._CLASS == 9) | (K._CLASS == 2)).astype(np.int32)
_BYTE_TABLES = (_UPPER, _STOP, _SYMBOL, _DIGIT, _HIGH, _SPACE, _LINE, _SHOUT, _PIPE)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; zeros for a null or empty one."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi, buf, off in K.pieces(texts):
        n = np.diff(off)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        size = n[some].astype(float)
        # a histogram of byte values for each row; every ratio of bytes follows from it
        row = np.repeat(np.arange(len(some)), n[some])
        counts = np.bincount(row * 256 + buf, minlength=len(some) * 256).reshape(-1, 256)
        byte = counts @ np.stack(_BYTE_TABLES, 1)
        h, s, e, first = K.words(buf, off)
        first = np.append(first[:-1][some], first[-1])
        many = np.diff(first)
        w = np.maximum(many, 1)
        of = np.repeat(np.arange(len(some)), many)
        length = e - s
        total = np.bincount(of, length, len(some))
        long = np.bincount(of, length > 14, len(some))
        distinct = np.bincount(_rows_of_distinct(h, of), minlength=len(some))
        after = np.where(e < len(buf), buf[np.minimum(e, len(buf) - 1)], 0)
        glued = np.bincount(of, _SYMBOL[after], len(some))
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        f = [np.log2(1 + size), total / w]
        f += [byte[:, i] / size for i in range(6)]
        f += [byte[:, 6] / w, distinct / w, long / w, byte[:, 7] / w, byte[:, 8] / w, glued / w, np.bincount(of, again, len(some)) / w]
        out[lo + some] = np.stack(f, 1)
    return out


def _rows_of_distinct(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The row of each distinct (row, hash)."""
    key = (h & U64((1 << 40) - 1)) | (of.astype(U64) << U64(40))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return (key[new] >> U64(40)).astype(np.int64)


class Gam:
    """edges: the inner bin edges of each feature; tables: a score for each bin; pairs: (i, j, table over coarse bins)."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.coarse = [_coarsen(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        s = np.full(len(x), self.base)
        for t, k in zip(self.tables, b):
            s += t[k]
        for i, j, t in self.pairs:
            s += t[self.coarse[i][b[i]], self.coarse[j][b[j]]]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _coarsen(n: int) -> np.ndarray:
    return np.arange(n) * min(n, PAIR_BINS) // n


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The step of a regression tree of so many leaves over ordered bins with gradient and hessian sums g and h."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = value(a, c) + value(c, b) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], int(c[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best step of one cut along each axis of a two-way table, and its gain over no cut."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    G = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    H = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None]
    parts = []
    for z in (G, H):
        ll, l, t, whole = z[a, b], z[a, -1], z[-1, b], z[-1, -1]
        parts.append((ll, l - ll, t - ll, whole - l - t + ll))
    gain = sum(x * x / (y + 1.0) for x, y in zip(*parts)) - G[-1, -1] ** 2 / (H[-1, -1] + 1.0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.empty(g.shape)
    q = [x[i, j] / (y[i, j] + 1.0) for x, y in zip(*parts)]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = q
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of features x and labels y (0 or 1). With no rows, or one label only, a constant that favours neither change."""
    if len(y) == 0 or y.min() == y.max():
        return Gam([np.zeros(0)] * x.shape[1], 6.0 if len(y) == 0 or y.min() else -6.0)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # the classes count alike
    m = Gam(edges, 0.0)
    b = m.bins(x)
    s = np.zeros(len(y))

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-s))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for i, t in enumerate(m.tables):
            g, h = residual()
            step = RATE * _tree(np.bincount(b[i], g, len(t)), np.bincount(b[i], h, len(t)), LEAVES)
            t += step
            s += step[b[i]]
    cb = [c[k] for c, k in zip(m.coarse, b)]
    shape = [int(c[-1]) + 1 for c in m.coarse]

    def two_way(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cb[i] * shape[j] + cb[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = residual()
    strength = sorted(((_quadrants(two_way(i, j, g), two_way(i, j, h))[0], i, j) for i in range(len(b)) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in strength[:PAIRS]]
    for _ in range(ROUNDS // 3):
        for i, j, t in m.pairs:
            g, h = residual()
            step = RATE * _quadrants(two_way(i, j, g), two_way(i, j, h))[1]
            t += step
            s += step[cb[i], cb[j]]
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Gam:
    """The model fitted to at most per_class labelled documents of each class (see `sampling.labelled`); only their features reach the driver."""

    def run(texts: pa.Array) -> pa.Array:
        f = features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * np.int32(len(FEATURES))), pa.array(f.ravel()))

    udf = arrow_function(run, T.ArrayType(T.DoubleType()))
    rows = labelled(docs, labels, "quality", per_class).select("doc_id", "y", udf("text").alias("x")).toPandas().sort_values(["doc_id", "y"])
    x = np.stack(rows.x.values) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows.y.to_numpy())


def scorer(model: Gam):
    """text -> probability of good quality; null for a null text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return arrow_function(run, T.DoubleType())


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score) of every row of docs. The score of a null text is null; an empty one is scored by its (zero) features.

    Null and repeated doc_ids are scored like others. With no usable label, or labels of one class only, every score is alike.
    """
    return docs.select("doc_id", scorer(train(docs, labels, per_class))("text").alias("score"))


def accepted_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score) of the rows of docs that score at least threshold: those of `accepted`, without their text."""
    return scored(docs, labels, per_class).where(F.col("score") >= threshold)


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold. Null texts go; with no usable label all others stay. All columns pass."""
    return docs.where(scorer(train(docs, labels, per_class))("text") >= threshold)
