"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over hashed features (its words and their beginnings); the
document's probability is the noisy-or of its sentences', 1 - prod(1 - s). The weights are trained through that from document
labels alone, and then the sentence scores say where the offence is.

In logarithms the noisy-or is a sum of intensities -log(1 - s). Every clean sentence has a small one, and in a text of thousands of
sentences these would add up to a verdict. So the intensity that nearly all sentences of the clean training documents stay below is
the background; only what a sentence has above it counts, however many sentences share the evidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .sampling import SAMPLE_BYTES, labelled
from .store import arrow_function

PER_CLASS, BITS, PREFIXES, STEPS, MIN_DOCS, SHRINK, THRESHOLD = 3000, 20, (4, 5, 6, 7), 150, 4, 0.006, 0.5
BACKGROUND = 0.99  # this share of the clean sentences trained on count as no evidence
U64 = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


def sentences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all sentences and the n+1 boundaries of each row's: cut after a newline, and after the space that follows . ! or ?

    Each row of at least one byte has at least one; a wordless piece counts as a sentence too.
    """
    cut = np.zeros(len(buf) + 1, bool)
    cut[2:] = _SPACE[buf[1:]] & _ENDS[buf[:-1]]
    cut[np.minimum(off[:-1] + 1, len(buf))] = False  # the stop before a row's first byte is another row's
    cut[1:] |= buf == 10
    cut[off[:-1]] = True
    cut[len(buf)] = False
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, off)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features and the byte each belongs to; then sentences' first bytes and rows' boundaries among them."""
    s, e, _, running = K.spans(buf, off)
    f, at = [K.span_hash(running, s, e)], [s]
    for k, n in enumerate(PREFIXES, 1):
        long = e - s > n
        f.append(K.span_hash(running, s[long], s[long] + n) * U64(2 * k + 1))
        at.append(s[long])
    starts, first = sentences(buf, off)
    return (np.concatenate(f) >> U64(64 - BITS)).astype(np.int64), np.concatenate(at), starts, first


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    background: float  # intensity of a sentence that is no evidence


def _intensity(z: np.ndarray) -> np.ndarray:
    """-log(1 - s) of sentences of logit z."""
    return np.log1p(np.exp(np.clip(z, -30, 30)))


def train_rows(texts: pa.Array, y: np.ndarray, steps: int = STEPS, min_docs: int = MIN_DOCS, shrink: float = SHRINK) -> Model:
    """Fitted by Adam with a shrinkage of the weights after each step, on features of at least min_docs documents.

    Without documents of both labels all weights are zero and the bias is -20: nothing is found then.
    """
    weights = np.zeros(1 << BITS, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model(weights, -20.0, 0.0)
    feats, sents, rows, n_sent = [], [], [], 0
    n_docs = np.zeros(1 << BITS, np.int64)  # of each feature
    for lo, _, buf, off in K.pieces(texts):
        f, at, starts, first = tokens(buf, off)
        sent = np.searchsorted(starts, at, "right") - 1
        key = np.unique((sent << BITS) | f)  # each feature once a sentence
        f, own = key & ((1 << BITS) - 1), K.row_of(first)
        n_docs += np.bincount(np.unique((own[key >> BITS] << BITS) | f) & ((1 << BITS) - 1), minlength=1 << BITS)
        feats.append(f.astype(np.int32))
        sents.append(((key >> BITS) + n_sent).astype(np.int32))
        rows.append(own + lo)
        n_sent += len(starts)
    used = np.flatnonzero(n_docs >= min_docs)
    dense = np.full(1 << BITS, -1, np.int32)
    dense[used] = np.arange(len(used))
    for k, f in enumerate(feats):
        keep = dense[f] >= 0
        feats[k], sents[k] = dense[f[keep]], sents[k][keep]
    f, sent, row = np.concatenate(feats).astype(np.int64), np.concatenate(sents).astype(np.int64), np.concatenate(rows)
    del feats, sents, rows
    w, b = np.zeros(len(used)), -5.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(sent, w[f], n_sent) + b, -30, 30)
        s = 1 / (1 + np.exp(-z))
        a = np.bincount(row, _intensity(z), len(y))  # -log of the probability that no sentence offends
        slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(a, 50)), 1e-2), 1.0) * balance
        g_sent = slope[row] * s
        g = np.bincount(f, g_sent[sent], len(used)) + 2e-6 * w
        gb = g_sent.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.15
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * 0.3 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)  # rare chance features fall back to nothing
    weights[used] = w
    w = weights[used].astype(float)  # as they are kept
    clean = _intensity(np.bincount(sent, w[f], n_sent) + b)[(y == 0)[row]]
    return Model(weights, float(b), float(np.quantile(clean, BACKGROUND)) if len(clean) else 0.0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trained in one task on at most per_class labelled documents of each class and sample_bytes of text (see `sampling.labelled`), whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("y", pa.int32()), ("text", pa.string())]))
        m = train_rows(t.column("text").cast(pa.large_string()).combine_chunks(), t.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias]), pa.array([m.background])], names=["w", "b", "g"])

    sample = labelled(docs, labels, "toxic", per_class, sample_bytes).orderBy("doc_id").select("y", "text").coalesce(1)
    got = sample.mapInArrow(run, "w binary, b double, g double").collect()
    return Model(np.frombuffer(got[0].w, np.float32), got[0].b, got[0].g) if got else Model(np.zeros(1 << BITS, np.float32), -20.0, 0.0)


def locate_rows(texts: pa.Array, m: Model, threshold: float) -> list[list[dict]]:
    """Of each text, if its noisy-or reaches threshold: its sentences that do so alone, or else the strongest of them (the first of equals)."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for lo, hi, buf, off in K.pieces(texts):
        f, at, starts, first = tokens(buf, off)
        x = m.weights[f]
        hit = x != 0
        f, x, sent = f[hit], x[hit], np.searchsorted(starts, at[hit], "right") - 1
        key, one = np.unique((sent << BITS) | f, return_index=True)
        above = np.maximum(_intensity(np.bincount(sent[one], x[one], len(starts)) + m.bias) - m.background, 0)
        total = np.bincount(K.row_of(first), above, hi - lo)
        s = 1 - np.exp(-above)
        for i in np.flatnonzero(1 - np.exp(-total) >= threshold):
            own = np.arange(first[i], first[i + 1])
            found = own[s[own] >= threshold]
            for j in found if len(found) else own[[s[own].argmax()]]:
                end = starts[j + 1] if j + 1 < first[i + 1] else off[i + 1]
                text = buf[starts[j] : end].tobytes().decode("utf-8", "replace").strip()
                out[lo + i].append({"sentence_no": int(j - first[i]), "sentence": text, "sentence_score": float(s[j]), "doc_score": float(1 - np.exp(-total[i]))})
    return out


_FOUND = T.ArrayType(T.StructType([T.StructField("sentence_no", T.IntegerType()), T.StructField("sentence", T.StringType()), T.StructField("sentence_score", T.DoubleType()), T.StructField("doc_score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("sentence_no", pa.int32()), ("sentence", pa.string()), ("sentence_score", pa.float64()), ("doc_score", pa.float64())]))


def _locator(held, bias: float, background: float, threshold: float) -> Callable[[pa.Array], pa.Array]:
    def locate(texts: pa.Array) -> pa.Array:
        return pa.array(locate_rows(texts, Model(held.value, bias, background), threshold), _ARROW)

    return locate


def offending_sentences(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, sentence_no, sentence, sentence_score, doc_score) of the offending sentences of each document found toxic.

    sentence_no counts from 0. A document is found toxic if the noisy-or of what its sentences have above the background reaches
    the threshold. Its sentences that reach it alone are reported, or the strongest one where only several together do. Null
    and empty texts have no sentences. A null doc_id is carried as null; repeated rows are each reported. Without labels of
    both classes nothing is found; an empty table gives no rows. Extra columns of either table don't pass.
    """
    m = train(docs, labels, per_class, sample_bytes)
    held = docs.sparkSession.sparkContext.broadcast(m.weights)  # 4 * 2**BITS bytes, whatever the data
    udf = arrow_function(_locator(held, m.bias, m.background, threshold), _FOUND)
    x = docs.where("text is not null").select("doc_id", udf("text").alias("o"))
    return x.where(F.size("o") > 0).select("doc_id", F.explode("o").alias("z")).select("doc_id", "z.*")
