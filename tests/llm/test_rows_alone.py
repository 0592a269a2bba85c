"""The text kernels give each row the same result whatever rows stand before it, and whatever batches they come in."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cuelattice.llm import ctw, decontam, kernels as K, licenses, minhash, quality, toxicity

BITS = ["a b. ", "vile one.", "\n", "\n\n", "x", " ", "", ".", "! ", "Bye.", "é漢 ", "y\nz", "All rights reserved.", "one two three "]
RND = random.Random(11)
TEXTS = ["".join(RND.choices(BITS, k=RND.randint(0, 7))) for _ in range(120)] + ["", "\n", "\nx y", " vile one.", None]
TEMPLATES = pa.array(["x y z", "vile one", "all rights reserved", "a b"], pa.large_string())


def _model():
    w = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    return toxicity.Model(w, -0.5, 0.01)


def _join(texts, paragraphs):
    v = licenses.Vocabulary(TEMPLATES)
    return licenses.Join(v, list("pqrs"), np.ones(len(v.hashes), np.int64), 0.5).find(texts, paragraphs)


def _per_row(first):
    return np.diff(first).tolist()


KERNELS = {
    "sentences": lambda t: toxicity.locate_rows(t, _model(), 0.4),
    "lines": lambda t: _join(t, False),
    "paragraphs": lambda t: _join(t, True),
    "words": lambda t: [n for _, _, buf, off in K.pieces(t) for n in _per_row(K.words(buf, off)[3])],
    "features": lambda t: quality.features(t).tolist(),
    "signatures": lambda t: [h.item() for h in minhash.signature_rows(t, 8, 3, 1)[0]],
    "overlaps": lambda t: decontam.Index(np.array([1]), pa.array(["one two three " * 6])).find(t),
    "runs": lambda t: [ctw.runs(buf, off, 3)[a:b].tolist() for _, _, buf, off in K.pieces(t) for a, b in zip(off[:-1], off[1:])],
}


@pytest.mark.parametrize("name", KERNELS)
def test_rows_dont_see_each_other(name):
    f = KERNELS[name]
    alone = [f(pa.array([t], pa.string()))[0] for t in TEXTS]
    for seed, size in ((1, len(TEXTS)), (2, 2), (3, 7)):
        order = list(range(len(TEXTS)))
        random.Random(seed).shuffle(order)
        for lo in range(0, len(order), size):
            some = order[lo : lo + size]
            got = f(pa.array([TEXTS[i] for i in some], pa.string()))
            assert [repr(x) for x in got] == [repr(alone[i]) for i in some]
