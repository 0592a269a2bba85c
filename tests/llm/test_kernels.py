import random

import numpy as np
import pyarrow as pa

from cuelattice.llm import kernels as K

ALPHABET = "abcXYZ019 .,\n-éÉß漢字ｅ한글𠀀​　"


def test_words_agree_with_their_definition(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60))) for _ in range(300)] + ["", "a", "é", "漢", None]
    monkeypatch.setattr(K, "PIECE_BYTES", 200)
    seen = {}
    n = 0
    for lo, hi, buf, off in K.pieces(pa.array(texts), 200):
        h, s, e, first = K.words(buf, off)
        for i in range(hi - lo):
            own = slice(first[i], first[i + 1])
            words = [buf[a:b].tobytes().decode().translate(K._ASCII_LOWER) for a, b in zip(s[own], e[own])]
            assert words == K.words_of(texts[lo + i] or "")
            for w, x in zip(words, h[own]):
                assert seen.setdefault(w, x) == x
            n += 1
    assert n == len(texts) and len(set(seen.values())) == len(seen)


def test_shingles():
    h, first = np.arange(6, dtype=np.uint64), np.array([0, 4, 4, 6])
    s, bounds = K.shingles(h, first, 3)
    assert list(bounds) == [0, 2, 2, 3] and len(set(s)) == 3
