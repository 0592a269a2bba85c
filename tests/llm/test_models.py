"""Trained operators: held-out accuracy, their formulas, and where they point."""

import random

import numpy as np
import pyarrow as pa
from brute import DOCS
from conftest import SF

from cuelattice.llm import quality, toxicity
from cuelattice.llm.store import table

def split(spark, label, size="0.01"):
    docs, labels = (table(spark, SF.replace("0.001", size), t) for t in ("documents", "labels"))
    return docs, labels.where("doc_id % 3 != 0"), {r.doc_id: r[label] for r in labels.where("doc_id % 3 = 0").collect()}


def test_quality_on_held_out_labels(spark):
    docs, train, test = split(spark, "quality")
    got = {r.doc_id: r.score for r in quality.scored(docs, train).collect()}
    right = [(got[i] >= quality.THRESHOLD) == bool(y) for i, y in test.items()]
    good = [got[i] >= quality.THRESHOLD for i, y in test.items() if y]
    assert np.mean(right) >= 0.95 and np.mean(good) >= 0.97
    kept = {r.doc_id for r in quality.accepted(docs, train).collect()}
    assert kept == {i for i, s in got.items() if s >= quality.THRESHOLD} == {r.doc_id for r in quality.accepted_scores(docs, train).collect()}


def test_score_is_a_sum_of_table_entries():
    rnd = np.random.default_rng(1)
    x = rnd.random((400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)  # an interaction alone
    m = quality.fit(x, y)
    assert np.mean((m.score(x) > 0.5) == y) > 0.9
    b = m.bins(x)
    s = m.base + sum(t[k] for t, k in zip(m.tables, b)) + sum(t[m.coarse[i][b[i]], m.coarse[j][b[j]]] for i, j, t in m.pairs)
    assert np.allclose(1 / (1 + np.exp(-s)), m.score(x))


def test_features_by_hand():
    f = dict(zip(quality.FEATURES, quality.features(pa.array(["Ab a a!! |9", ""]))[0]))
    assert f["mean_word"] == 5 / 4 and f["distinct_words"] == 3 / 4 and f["repeats"] == 1 / 4 and f["upper"] == 1 / 11 and f["pipes"] == 1 / 4 and f["shouts"] == 2 / 4


def test_toxicity_on_held_out_labels(spark):
    docs, train, test = split(spark, "toxic", "0.1")  # some hundred toxic documents to learn from
    found = {r.doc_id for r in toxicity.offending_sentences(docs, train).collect()}
    assert np.mean([i in found for i, y in test.items() if y]) >= 0.8
    assert np.mean([i in found for i, y in test.items() if not y]) <= 0.02


def test_toxicity_points_at_the_sentence(spark):
    rnd = random.Random(3)
    clean = lambda: " ".join(rnd.choices(["one", "two", "three", "four", "five"], k=6)).capitalize() + "."
    rows, labels = [], []
    for i in range(300):
        s = [clean() for _ in range(6)]
        if i % 3 == 0:
            s[i % 6] = s[i % 6][:-1] + f" {rnd.choice(['vile', 'scum'])}."
        rows.append((i, " ".join(s), "en", "s", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.offending_sentences(docs, lab).collect()
    assert {(r.doc_id, r.sentence_no) for r in got} == {(i, i % 6) for i in range(0, 300, 3)}
    assert all(("vile" in r.sentence or "scum" in r.sentence) and r.doc_score >= r.sentence_score - 1e-9 for r in got)
    for threshold in (0.5, 0.9999):  # evidence that only several sentences have together: the strongest one is shown
        m = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -0.8, 0.02)
        found = toxicity.locate_rows(pa.array(["One. Two. Three.", "One."]), m, threshold)
        z = np.log1p(np.exp(-0.8)) - 0.02
        want = 1 - np.exp(-3 * z)
        assert [len(x) for x in found] == [int(want >= threshold), 0]
        for r in found[0]:
            assert (r["sentence_no"], r["sentence"]) == (0, "One.") and np.allclose([r["sentence_score"], r["doc_score"]], [1 - np.exp(-z), want])
    long = spark.createDataFrame([(1, " ".join(clean() for _ in range(20_000)), "en", "s", 1)], DOCS)
    assert toxicity.offending_sentences(docs.unionByName(long).where("doc_id % 3 != 0"), lab).count() == 0


def test_sentences():
    buf, off = np.frombuffer(b"A b. C!\nD", np.uint8), np.array([0, 9, 9])
    starts, first = toxicity.sentences(buf, off)
    assert [buf[a:].tobytes()[:1] for a in starts] == [b"A", b"C", b"D"] and list(first) == [0, 3, 3]


def test_noisy_or_by_hand():
    """Training steps and scores against plain loops over documents, sentences and words."""
    texts, y = ["bad one. fine day.", "fine day.", "bad bad. bad.", "fine one.", "day one."], np.array([1, 0, 1, 0, 0])
    m = toxicity.train_rows(pa.array(texts), y, steps=3, min_docs=1, shrink=0.01)
    cut = [[s.strip(" .").split(" ") for s in t.split(". ")] for t in texts]
    names = sorted({w for d in cut for s in d for w in s})
    w, b = dict.fromkeys(names, 0.0), -5.0
    mw, vw, mb, vb = dict(w), dict(w), 0.0, 0.0
    share = y.mean()
    for t in range(1, 4):
        g, gb = dict.fromkeys(names, 0.0), 0.0
        for d, label in zip(cut, y):
            z = [sum(w[x] for x in set(s)) + b for s in d]
            a = sum(np.log1p(np.exp(v)) for v in z)
            slope = (-1 / max(np.expm1(a), 1e-2) * 0.5 / share if label else 0.5 / (1 - share)) / len(y)
            for s, v in zip(d, z):
                gb += slope / (1 + np.exp(-v))
                for x in set(s):
                    g[x] += slope / (1 + np.exp(-v))
        for x in names:
            g[x] += 2e-6 * w[x]
            mw[x], vw[x] = 0.9 * mw[x] + 0.1 * g[x], 0.99 * vw[x] + 0.01 * g[x] ** 2
            w[x] -= 0.15 * (mw[x] / (1 - 0.9**t)) / (np.sqrt(vw[x] / (1 - 0.99**t)) + 1e-8)
            w[x] = np.sign(w[x]) * max(abs(w[x]) - 0.01, 0)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= 0.15 * 0.3 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    slot = {x: toxicity.tokens(*utf8_of(x))[0][0] for x in names}
    assert np.allclose([m.weights[slot[x]] for x in names], [w[x] for x in names], atol=1e-5) and abs(m.bias - b) < 1e-6
    clean = sorted(np.log1p(np.exp(sum(w[x] for x in set(s)) + b)) for d, label in zip(cut, y) if not label for s in d)
    assert abs(m.background - np.quantile(clean, 0.99)) < 1e-6


def utf8_of(text):
    from cuelattice.llm import kernels as K

    return K.utf8(pa.array([text]))
