"""Reply trees, mixing and embeddings against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from brute import DOCS, water

from cuelattice.llm import chat, covertree, mixing

MSG = "tree_id long, node_id long, parent_id long, role string, text string, score long"


def branches(rows, keep):
    nodes = {}
    for t, n, p, role, text, s in rows:
        if t is not None and n is not None:
            x = ((p is not None, p or 0), role or "unknown", text or "", s or 0)
            nodes[t, n] = min(nodes.get((t, n), x), x)
    out = {}
    parents = {(t, x[0][1]) for (t, n), x in nodes.items() if x[0][0]}
    for t, n in nodes:
        if (t, n) in parents:
            continue
        path, at = [], n
        while at is not None and (t, at) in nodes and at not in path:
            path.append(at)
            (has, p), *_ = nodes[t, at]
            at = p if has else None
        if at is None:
            path.reverse()
            score = sum(nodes[t, k][3] for k in path) / len(path)
            said = "".join(f"<|{nodes[t, k][1]}|>\n{nodes[t, k][2].replace('<|', '< |')}<|end|>\n" for k in path)
            out.setdefault(t, []).append((-score, n, ",".join(map(str, path)), said))
    return {(t, i + 1): x for t, xs in out.items() for i, x in enumerate(sorted(xs)[:keep])}


def test_branches_equal_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for t in range(12):
        n = rnd.randint(1, 25)
        for i in range(n):
            p = None if i == 0 or rnd.random() < 0.05 else rnd.choice([rnd.randrange(i), i - 1, 99 if rnd.random() < 0.2 else i - 1, min(n - 1, i + 1) if rnd.random() < 0.1 else i - 1])
            rows.append((t, i, p, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b<|user|>", None, "c"]), rnd.choice([1, 2, 3, None])))
    rows += [(None, 1, None, "user", "x", 1), (3, None, None, "user", "x", 1), rows[0], (0, 0, None, "zz", "other", 5), (50, 1, 2, "u", "circle", 1), (50, 2, 1, "u", "circle", 1), (50, 3, 2, "u", "below", 1), (51, 1, 1, "u", "self", 1)]
    got = {(r.tree_id, r.branch): (-r.score, r.leaf_id, r.path, r.conversation) for r in chat.best_branches(spark.createDataFrame(rows, MSG), 3).collect()}
    assert got == branches(rows, 3)


def test_deep_tree(spark):
    rows = [(1, i, i - 1 if i else None, "u", str(i), 1) for i in range(300)]
    r = chat.best_branches(spark.createDataFrame(rows, MSG)).collect()
    assert len(r) == 1 and r[0].turns == 300 and r[0].path == ",".join(map(str, range(300)))


def test_water_filling_equals_brute_force(spark):
    rnd = random.Random(2)
    for _ in range(6):
        caps = {f"s{i}": rnd.randint(1, 1000) for i in range(8)}
        weights = {k: rnd.randint(1, 9) for k in caps}
        budget = rnd.randint(1, 4500)
        x = spark.createDataFrame([(k, c, budget) for k, c in caps.items()], "name string, cap long, budget long")
        case = mixing.Weights(sources=weights).case("name", weights)
        got = {r.name: r.share for r in mixing.filled(x, [], "name", case).collect()}
        want = water(budget, caps, weights)
        assert all(abs(got[k] - want[k]) <= 1 for k in caps)


def test_mixture_keeps_its_targets(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(1, 60), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "src2", "other", None]), 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    picked = mixing.mixture(docs, share=0.5).collect()
    _, plan = mixing.plan(docs, share=0.5)
    leaves = {(r.domain, r.language, r.origin): r for r in mixing.targets(docs.selectExpr(f"{mixing.DOMAIN} as domain", "coalesce(lang, '') as language", "coalesce(source, '') as origin", "size(split(trim(text), ' ')) as tokens").groupBy("domain", "language", "origin").sum("tokens").withColumnRenamed("sum(tokens)", "tokens"), share=0.5).collect()}
    got = {}
    for r in picked:
        got.setdefault((r.domain, r.lang or "", r.source or ""), []).append((r.tokens, r.copies))
    for k, leaf in leaves.items():
        target, taken = leaf.rounds * leaf.tokens + leaf.rest, sum(t * c for t, c in got.get(k, []))
        assert target - 60 < taken <= target
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert sum(r.rounds * r.tokens + r.rest for r in leaves.values()) <= 0.5 * total
    other = mixing.mixture(docs, share=0.5, seed=8).collect()
    assert {r.doc_id for r in other} != {r.doc_id for r in picked}
    whole = mixing.mixed(docs.withColumn("copies", docs.doc_id), share=0.5)
    assert whole.columns == [*docs.columns, "copies", "copies_"]
    assert {(r.doc_id, r.copies_) for r in whole.collect()} == {(r.doc_id, r.copies) for r in picked}
    with pytest.raises(ValueError):
        mixing.Weights(other=0)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("dim,cell", [(3, 40), (16, 25), (64, 2048)])
def test_vector_pairs_equal_brute_force(spark, dim, cell, monkeypatch):
    monkeypatch.setattr(covertree, "VISITORS", 30)
    rnd = np.random.default_rng(dim)
    base = rnd.normal(size=(60, dim))
    x = np.concatenate([base + s * rnd.normal(size=base.shape) for s in (0, 0.02, 0.1, 0.3)]).astype(np.float32)
    x = np.concatenate([x, x[:5], 3 * x[5:8]])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    got = {(r.vec_a, r.vec_b): r.similarity for r in covertree.near_pairs(vectors(spark, rows), 0.9, cell).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j): round(float(c[i, j]), 4) for i, j in combinations(range(len(x)), 2) if c[i, j] >= 0.9}
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(got[k] - want[k]) <= 1e-4 for k in want)


def test_cover_tree_nests():
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = covertree.CoverTree(x)
    for n, kids in enumerate(t.kids):
        if kids:
            assert t.centre[n] in [t.centre[k] for k in kids]
            assert all(t.radius[k] <= t.radius[n] + 1 for k in kids)
    assert sorted(np.concatenate([p for p in t.points if p is not None])) == list(range(500))


def test_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, -0.0], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [], 0), (7, [float("nan"), 1.0], 0), (None, [1.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [1.0, None], 0), (10, [1.0, 0.0, 0.0], 0)]
    got = sorted((r.vec_a, r.vec_b) for r in covertree.near_pairs(vectors(spark, rows)).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (8, 10)]
    assert covertree.near_pairs(vectors(spark, rows).limit(0)).count() == 0
