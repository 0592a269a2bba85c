"""Near-duplicate classes and their links, of texts and of vectors, against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from brute import DOCS, components
from conftest import SF, rows_of, sql_rows
from test_structures import vectors
from test_text_operators import corpus, frame

import __spark_entry__
from cuelattice.llm import covertree, minhash


def brute(nodes, linked):
    """nodes: distinct (id, key); linked(key, key) -> {id: (class, links)} of those with a link."""
    links, edges = defaultdict(int), []
    for (i, s), (j, t) in combinations(nodes, 2):
        if s == t or linked(s, t):
            links[i] += 1
            links[j] += 1
            edges.append((i, j))
    group = components(edges)
    return {i: (group[i], n) for i, n in links.items()}


def signed(rows):
    has, sigs = minhash.signature_rows(pa.array([t for _, t in rows]), minhash.COORDINATES, minhash.SHINGLE, minhash.SEED)
    ids = [i for (i, _), h in zip(rows, has) if h]
    return sorted({(i, tuple(s.tolist())) for i, s in zip(ids, sigs)})


def agree(s, t):
    return sum(a == b for a, b in zip(s, t)) >= minhash.THRESHOLD


def test_minhash_classes(spark, tmp_path):
    texts = corpus(random.Random(2))
    texts += [texts[0]] * 4 + [texts[40]] * 3
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = __spark_entry__.queries()["op4_minhash"](spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.class_id, r.links) for r in rows}
    assert got == brute(signed(list(enumerate(texts))), agree) and len(got) == len(rows) > 20
    assert max(n for _, n in got.values()) >= 5


def test_ids_of_two_texts_and_repeated_rows(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "quite another text that has nothing to do with the first of them at all"
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (4, b), (5, a + " thirteen"), (2, a), (None, a), (6, None), (7, ""), (8, "alone in this"), (9, "w " * 40_000), (10, "w " * 40_001)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {r.doc_id: (r.class_id, r.links) for r in minhash.near_classes(docs).collect()}
    assert got == brute(signed([r for r in rows if r[0] is not None and r[1] is not None]), agree)
    assert got[2] == (1, 2) and got[1] == (1, 4) and got[4] == (1, 2) and got[9] == got[10] == (9, 1) and 8 not in got


def test_groups_need_no_pairs(spark):
    rnd = random.Random(5)
    base = [f"word{rnd.randrange(500)}" for _ in range(60)]
    texts = []
    for i in range(60):  # a chain: each text is near to those round it only
        base[i] = f"new{i}"
        texts.append(" ".join(base))
    texts += corpus(rnd, 20)
    docs = frame(spark, texts)
    every = {(r.doc_a, r.doc_b) for r in minhash.near_pairs(docs).collect()}
    reps, _ = minhash._collapsed(docs, minhash.COORDINATES, minhash.SHINGLE, minhash.SEED)
    few = {(r.doc_a, r.doc_b) for r in minhash._linked(reps, minhash.THRESHOLD).collect()}
    want = components(every)
    rest = {r.doc_id for r in minhash.one_of_each_group(docs).collect()}
    assert rest == {i for i in range(len(texts)) if want.get(i, i) == i}
    assert few <= every and len(few) < len(every)


def cosine_links(rows, cosine):
    keys = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows})
    unit = {v: np.array(v) / np.linalg.norm(v) for _, v in keys}
    return brute(keys, lambda s, t: len(s) == len(t) and float(unit[s] @ unit[t]) >= cosine)


@pytest.mark.parametrize("cosine", [0.9, 0.999999])
def test_vector_classes(spark, cosine):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(40, 64))
    x = np.concatenate([base + s * rnd.normal(size=base.shape) for s in (0, 1e-5, 3e-4, 1e-3, 1e-2, 0.2)]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, x[:5]]))] + [(1, [float(v) for v in x[7]])]
    got = {r.vec_id: (r.class_id, r.links) for r in covertree.near_classes(vectors(spark, [(i, v, 0) for i, v in rows]), cosine, 50).collect()}
    want = cosine_links(rows, cosine)
    assert {i: g for i, g in got.items() if g[1]} == want and len(want) > 40
    assert all(g == (i, 0) for i, g in got.items() if i not in want) and set(got) == {i for i, _ in rows}


def test_vector_classes_equal_sql(spark, duck):
    v = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/embeddings.parquet")
    duck.execute(f"create or replace view more as select * from read_parquet('{SF.replace('0.001', '0.01')}/embeddings.parquet')")
    for cosine in (0.35, 0.42):  # the tables have no pair of the query's 0.95
        _, want = sql_rows(duck, covertree.near_classes_sql(cosine).replace("FROM embeddings", "FROM more"))
        assert rows_of(covertree.near_classes(v, cosine, 100)) == want and len({r[0] for r in want}) < len(want)


def clumps(rng, sizes, dim, spread):
    """Vectors round as many centres as there are sizes, in a random order."""
    x = np.concatenate([c + spread * rng.normal(size=(n, dim)) for c, n in zip(rng.normal(size=(len(sizes), dim)), sizes)])
    return [(i, [float(v) for v in r], 0) for i, r in enumerate(rng.permutation(x).astype(np.float32))]


def test_vector_links_are_not_written_as_pairs(spark, monkeypatch):
    """A clump of 300 vectors has 44850 pairs, which no table and no task may hold: what is written grows with the vectors."""
    rows, held = [], clumps(np.random.default_rng(2), [300, 40, *[1] * 60], 64, 0.01)
    write = covertree.written

    def counted(df, name):
        out = write(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(covertree, "written", counted)
    got = covertree.near_classes(vectors(spark, held).repartition(1), 0.95, 100).collect()
    assert sorted((r.links for r in got), reverse=True) == [299] * 300 + [39] * 40 + [0] * 60
    assert len({r.class_id for r in got}) == 62
    assert rows and all(n <= 8 * len(held) for _, n in rows)


@pytest.mark.parametrize("dim,cell", [(3, 30), (16, 7), (64, 1000)])
def test_vector_blocks_equal_brute_force(spark, monkeypatch, dim, cell):
    """Blocks of 50 vectors, so that a cell of 1000 has parts, and visitors in pieces of 40."""
    for name, value in (("BLOCK_BYTES", 200 * dim), ("VISITORS", 40)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(dim)
    held = clumps(rng, [50, 30, 12, 5, 3, *[1] * 60], dim, 0.16)
    held += [(i + 200, v, 0) for i, v, _ in held[:9]] + [(i + 300, [3 * x for x in v], 0) for i, v, _ in held[:4]] + [(1, held[30][1], 0)]
    got = {r.vec_id: (r.class_id, r.links) for r in covertree.near_classes(vectors(spark, held), 0.95, cell).collect()}
    want = cosine_links([(i, v) for i, v, _ in held], 0.95)
    assert {i: g for i, g in got.items() if g[1]} == want and len(want) > 60
    assert all(g == (i, 0) for i, g in got.items() if i not in want) and set(got) == {i for i, *_ in held}


@pytest.mark.parametrize("shared", [False, True])
def test_products_in_small_tiles(monkeypatch, shared):
    for name, value in (("ROWS", 7), ("COLUMNS", 11)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(4)
    x = np.array([v for _, v, _ in clumps(rng, [120, 60, 9, *[1] * 90], 16, 0.1)], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b, p, q = x[:150], x[150:], *x[[3, 200]]
    shares = (a @ p - a @ q, b @ q - b @ p, float(np.sqrt(0.2) * np.linalg.norm(p - q)) + 1e-5) if shared else None
    parts = list(covertree.dual_pairs(covertree.CoverTree(a), covertree.CoverTree(b), float(np.sqrt(0.2)), shares))
    got = [(int(i), int(j)) for m, n, _ in parts for i, j in zip(m, n)]
    want = {(int(i), int(j)) for i, j in np.argwhere(a.astype(float) @ b.T.astype(float) >= 0.9)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    assert all(len(m) <= 7 * 11 and np.allclose(s, (a[m] * b[n]).sum(1), atol=1e-5) for m, n, s in parts)


def test_pairs_united_in_small_steps(monkeypatch):
    monkeypatch.setattr(covertree, "PENDING", 3)
    u, order = covertree._United(50), np.random.default_rng(1).permutation(39)
    for i in order:  # a chain of 40 and ten points alone
        u.add(np.array([i]), np.array([i + 1]))
    assert u.unite().tolist() == [0] * 40 + list(range(40, 50))


def test_blocks_hold_every_cell():
    blocks = covertree._blocks({0: 4, 1: 6, 2: 1, 4: 25, 5: 10, 6: 3}, 10)
    assert blocks == [(0, 1, 1, 0), (2, 2, 1, 0), (4, 4, 3, 0), (4, 4, 3, 1), (4, 4, 3, 2), (5, 5, 1, 0), (6, 6, 1, 0)]
