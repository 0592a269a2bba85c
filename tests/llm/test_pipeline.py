"""The pipeline's stages against plain Python on a small folder, and its columns."""

import numpy as np
import pyarrow as pa
import pytest
from brute import components, dedup_lines, near_pairs, overlap_words
from conftest import SF, sql_rows

import corpus_pipeline as P
from cuelattice.llm import kernels as K, linededup, mixing, quality
from cuelattice.llm.store import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = table(spark, SF, "documents").where("n_chars < 4000")
    docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(f"{d}/{t}.parquet")
    return d


def test_stages(spark, folder, duck, tmp_path):
    docs, texts = table(spark, folder, "documents"), None
    bench = [r.text for r in table(spark, folder, "benchmark").collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, folder)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        after = spark.read.parquet(path)
        got = {r.doc_id: r.text for r in after.collect()}
        assert len(got) == after.count() > 0
        if k == 0:
            m = quality.train(docs, table(spark, folder, "labels"))
            score = m.score(quality.features(pa.array([t for _, t in before])))
            want = {i: t for (i, t), s in zip(before, score) if s >= quality.THRESHOLD}
        elif k == 1:
            want = dedup_lines(before, linededup.NEAR_CHARS)
        elif k == 2:
            group = components(near_pairs(before))
            want = {i: t for i, t in before if group.get(i, i) == i}
        elif k == 3:
            want = {i: t for i, t in before if not any(_shares(t, x) and overlap_words(t, x) for x in bench)}
        else:
            docs.write.parquet(str(tmp_path / "last"))
            duck.execute(f"create or replace view kept as select * from read_parquet('{tmp_path}/last/*.parquet')")
            _, rows = sql_rows(duck, mixing.mixture_sql().replace("FROM documents", "FROM kept"))
            want = {i: t for i, t in before if str(i) in {r[1] for r in rows}}
            assert sorted((str(r.copies), str(r.doc_id)) for r in after.collect()) == sorted((r[0], r[1]) for r in rows)
        assert got == want, name
        if k < len(P.STAGES) - 1:
            assert after.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs, texts = after, got
    run = P.run(spark, folder)
    assert {r.doc_id: r.text for r in run.collect()} == texts


def _shares(doc, item):
    """Whether five words in a row are common: an overlap of 13 words with two substituted has a run of three at least, so two are enough to look for."""
    a, b = K.words_of(doc), K.words_of(item)
    return not {tuple(a[i : i + 3]) for i in range(len(a))}.isdisjoint(tuple(b[i : i + 3]) for i in range(len(b) - 2))


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    assert P.ORACLE_SQL is None and np.all([callable(f) for _, f in P.STAGES])
