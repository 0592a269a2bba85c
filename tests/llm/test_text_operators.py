"""MinHash, line dedup, decontamination, licenses and language-model scores against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from brute import DOCS, components, ctw_bits, dedup_lines, near_pairs, overlap_words

from cuelattice.llm import ctw, decontam, kernels as K, licenses, linededup, minhash

WORDS = [a + b for a in "bcdfgklmnprst" for b in ("a", "e", "ion", "ou", "ing", "er")]


def prose(rnd, n, newline=0.05):
    return "".join(rnd.choice(WORDS) + ("\n" if rnd.random() < newline else " ") for _ in range(n))


def corpus(rnd, n=40):
    out = [prose(rnd, rnd.randint(5, 120)) for _ in range(n)]
    for i in range(0, n, 4):
        words = out[i].split(" ")
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out + [out[0], out[0], out[1]]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def test_minhash_equals_brute_force(spark):
    texts = corpus(random.Random(2))
    got = {(r.doc_a, r.doc_b): r.matches for r in minhash.near_pairs(frame(spark, texts)).collect()}
    want = near_pairs(list(enumerate(texts)))
    assert got == want and len(want) > 8
    rest = {r.doc_id for r in minhash.one_of_each_group(frame(spark, texts)).collect()}
    group = components(want)
    assert rest == {i for i in range(len(texts)) if group.get(i, i) == i}


def test_minhash_recall(spark):
    rnd = random.Random(4)
    texts = corpus(rnd, 80)
    shingles = []
    for t in texts:
        w = K.words_of(t)
        shingles.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))})
    near = {(i, j) for i, j in combinations(range(len(texts)), 2) if len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) >= 0.6}
    found = components((r.doc_a, r.doc_b) for r in minhash.near_pairs(frame(spark, texts)).collect())
    assert sum(found.get(i, i) == found.get(j, j) for i, j in near) >= 0.9 * len(near) > 0


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "doc_a long, doc_b long")
    assert {(r.doc, r.least) for r in minhash.components(pairs).collect()} == {(i, 0) for i in range(1, 201)} | {(501, 500)}


def edited(rnd, line):
    k, c = rnd.randrange(len(line)), rnd.choice("xyzé漢")
    return rnd.choice([line[:k] + line[k + 1 :], line[:k] + c + line[k:], line[:k] + c + line[k + 1 :]])


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_line_dedup_equals_brute_force(spark, parts):
    rnd = random.Random(parts)
    lines = ["".join(rnd.choices("abé ", k=rnd.randint(3, 40))) for _ in range(60)]
    pool = lines + [edited(rnd, x) for x in lines[:40]] + [edited(rnd, edited(rnd, x)) for x in lines[:20]] + ["", "ab"]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randint(1, 9))) for _ in range(50)]
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.dedup_lines(frame(spark, texts), 8, parts, short=False).collect()}
    want = dedup_lines(list(enumerate(texts)), 8, short=False)
    assert {k: v[0] for k, v in got.items()} == want and len(want) < len(texts)
    assert all(n == len(t) for t, n in got.values())


def test_masks_hit_every_overlap():
    for bad in combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(not set(bad) & {s + o for o in m} for m in decontam.MASKS for s in range(decontam.WINDOW - m[-1])), bad


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(7)
    items = [prose(rnd, rnd.randint(5, 40)) for _ in range(12)]
    texts = []
    for _ in range(40):
        words = K.words_of(rnd.choice(items))
        a = rnd.randrange(max(1, len(words) - 12))
        cut = words[a : a + rnd.randint(8, 25)]
        for _ in range(rnd.randint(0, 4)):
            cut[rnd.randrange(len(cut))] = "zz"
        texts.append(prose(rnd, rnd.randint(0, 20)) + " ".join(cut) + " " + prose(rnd, 5))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.words for r in decontam.overlaps(frame(spark, texts), bench).collect()}
    want = {(d, i): n for d, t in enumerate(texts) for i, x in enumerate(items) if (n := overlap_words(t, x))}
    assert got == want and len(want) > 5
    assert {r.doc_id for r in decontam.clean_of(frame(spark, texts), bench).collect()} == set(range(40)) - {d for d, _ in want}


def test_benchmark_in_parts(spark, monkeypatch):
    rnd = random.Random(8)
    items = [prose(rnd, 20) for _ in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = {tuple(r) for r in decontam.overlaps(frame(spark, items), bench).collect()}
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 200)
    assert {tuple(r) for r in decontam.overlaps(frame(spark, items), bench).collect()} == whole
    assert decontam.clean_of(frame(spark, items), bench).count() == 0


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_licenses_equal_brute_force(spark, unit):
    rnd = random.Random(9)
    templates = [(f"t{i}", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 12)))) for i in range(10)]
    texts = []
    for _ in range(60):
        lines = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 6))) for _ in range(3)]
        words = rnd.choice(templates)[1].split()
        lines.insert(rnd.randrange(3), " ".join(rnd.sample(words, rnd.randint(1, len(words))) + rnd.choices(WORDS, k=2)).upper())
        texts.append(rnd.choice(["\n", "\n\n"]).join(lines))
    x = licenses.matches(frame(spark, texts), spark.createDataFrame(templates, "template string, text string"), 0.7, unit)
    got = {(r.doc_id, r.block_no, r.template): (r.matched, r.template_words, round(r.containment, 9)) for r in x.collect()}
    want = {}
    for d, t in enumerate(texts):
        for k, block in enumerate(re.split("\n" if unit == "line" else "\n\n+", t)):
            have = set(K.words_of(block))
            for name, text in templates:
                words = set(K.words_of(text))
                n = len(words & have)
                if n / len(words) >= 0.7:
                    want[d, k, name] = (n, len(words), round(n / len(words), 9))
    assert got == want and len(want) > 10


@pytest.mark.parametrize("depth", [2, 4])
def test_code_lengths_equal_brute_force(spark, depth):
    rnd = random.Random(depth)
    texts = [prose(rnd, rnd.randint(1, 15)) for _ in range(15)] + ["aaaaaaa", "é漢", "x"]
    want = ctw_bits(texts, depth)
    for held in (10**9, 0):
        got = {r.doc_id: r for r in ctw.scored(frame(spark, [*texts, "", None]), depth, held).collect()}
        for i, w in enumerate(want):
            assert got[i].n_bytes == len(texts[i].encode()) and abs(got[i].bits - w) < 1e-4 * (1 + w)
            assert abs(got[i].bits_per_byte - got[i].bits / got[i].n_bytes) < 1e-9
        assert (got[len(texts)].bits, got[len(texts)].bits_per_byte) == (0, None) and got[len(texts) + 1].bits is None


def test_lgamma_and_lookup():
    import math

    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e9])
    assert np.allclose(ctw.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    t = ctw.Lookup(keys, np.arange(len(keys)))
    assert (t.of(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    assert ctw.runs(np.frombuffer(b"abcd", np.uint8), np.array([0, 3, 4]), 2).tolist() == [0x61, 0x6162, 0x616263, 0x64]


def test_pieces_of_long_texts(spark):
    long = "word " * 700_000 + "All rights reserved"
    x = frame(spark, [long, "short"])
    assert [r.block_no for r in licenses.matches(x, licenses.template_table(spark)).collect()] == [0]
    assert minhash.signatures(x).count() == 2
    assert {r.doc_id: r.n_bytes for r in ctw.scored(x).collect()} == {0: len(long), 1: 5}
    assert pa.array([long]).nbytes > K.PIECE_BYTES
