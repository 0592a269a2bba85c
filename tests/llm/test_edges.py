"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and extra columns with clashing names."""

import time

import pytest
from brute import DOCS
from pyspark.sql import functions as F

from cuelattice.llm import chat, covertree, ctw, decontam, licenses, linededup, minhash, mixing, quality, toxicity

LONG = "again and again the same few words stand in this line of a very long text\n" * 3000
A = "the first document has a line that is long enough\nand another line that is quite long too\n"
ROWS = [
    (1, A, "en", "src1", len(A)),
    (1, A, "en", "src1", len(A)),
    (2, A, None, None, None),
    (None, A, "en", "src1", 3),
    (None, None, None, None, None),
    (3, None, "en", "src1", 0),
    (4, "", "en", "src1", 0),
    (5, " \n\n ", "en", "src1", 4),
    (6, LONG, "en", "src2", len(LONG)),
    (1, "another text under the same id as the first one", "en", "src1", 5),
    (7, "漢字 😀 é\nword", "fr", "x", 9),
]
CLASH = ["__h", "__rank", "__gone", "__k", "__at", "__rest", "copies", "domain", "h", "key", "tokens", "score", "o", "v", "d", "k", "w_id", "rounds", "last", "line", "y", "found", "language", "origin", "p_domain", "p_language", "p_origin", "__p_domain", "class_id", "links", "least", "g", "a", "b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (3, 1, 1), (9, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, A), (1, A), (2, None), (None, A), (3, ""), (4, "too short")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda d, l, b: toxicity.offending_sentences(d, l),
    "mixture": lambda d, l, b: mixing.mixture(d),
    "mixed": lambda d, l, b: mixing.mixed(d),
    "near_pairs": lambda d, l, b: minhash.near_pairs(d),
    "near_classes": lambda d, l, b: minhash.near_classes(d),
    "one_of_each_group": lambda d, l, b: minhash.one_of_each_group(d),
    "dedup_lines": lambda d, l, b: linededup.dedup_lines(d),
    "overlaps": lambda d, l, b: decontam.overlaps(d, b),
    "clean_of": lambda d, l, b: decontam.clean_of(d, b),
    "lm": lambda d, l, b: ctw.scored(d),
    "scored": lambda d, l, b: quality.scored(d, l),
    "accepted": lambda d, l, b: quality.accepted(d, l),
    "licenses": lambda d, l, b: licenses.matches(d, licenses.template_table(d.sparkSession)),
}
ROWWISE = ("mixed", "one_of_each_group", "dedup_lines", "clean_of", "accepted")


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(docs, labels, bench, name):
    plain = OPERATORS[name](docs, labels, bench)
    extra = docs.withColumns({c: F.lit(c) for c in CLASH})
    got = OPERATORS[name](extra, labels, bench)
    if name in ROWWISE:
        assert set(extra.columns) <= set(got.columns) and got.where("key != 'key' or copies != 'copies'").count() == 0
        shown = docs.columns
        plain, got = plain.select(*shown), got.select(*shown)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, bench, name):
    none = docs.limit(0)
    assert OPERATORS[name](none, labels, bench).count() == 0
    assert OPERATORS[name](none, labels.limit(0), bench.limit(0)).count() == 0
    OPERATORS[name](docs, labels.limit(0), bench.limit(0)).collect()
    OPERATORS[name](docs.withColumn("text", F.lit(None).cast("string")), labels, bench).collect()


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i))


def test_defined_results(spark, docs, labels, bench):
    assert {(r.doc_a, r.doc_b) for r in minhash.near_pairs(docs).collect()} == {(1, 2)}
    # repeated rows leave one; the two rows of id 1 go or stay together; nulls stay
    assert ids(minhash.one_of_each_group(docs)) == [1, 1, 3, 4, 5, 6, 7, None, None]
    lines = {(r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect()}
    # copies in 2 and null go, 6 keeps its line once, and the null id comes last
    assert (1, A) in lines and (3, None) in lines and (4, "") in lines and (None, None) in lines
    assert [t for i, t in lines if i == 6] == ["again and again the same few words stand in this line of a very long text\n"]
    assert not [1 for i, t in lines if i == 2 or (i is None and t)]
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()} == {(1, 1), (2, 1)}
    assert ids(decontam.clean_of(docs, bench)) == [1, 3, 4, 5, 6, 7, None]
    assert all((r.n_bytes is None) == (r.bits is None) for r in ctw.scored(docs).collect()) and ctw.scored(docs).count() == len(ROWS)
    assert quality.scored(docs, labels).where("score is null").count() == 2
    assert quality.accepted(docs, labels.limit(0)).count() == len(ROWS) - 2
    assert toxicity.offending_sentences(docs, labels.limit(0)).count() == 0
    picked = mixing.mixture(docs, share=2.0, epochs=1).collect()
    assert sorted((r.doc_id, r.copies) for r in picked if r.doc_id is not None) == [(1, 1)] * 3 + [(2, 1), (6, 1), (7, 1)]


def test_templates_and_conversations(spark, docs):
    t = spark.createDataFrame([(None, "a line"), ("x", None), ("y", ""), ("z", "line long enough"), ("z", "line long enough")], "template string, text string")
    got = [(r.doc_id, r.template) for r in licenses.matches(docs.where("doc_id = 2"), t).collect()]
    assert sorted(got, key=str) == [(2, "z"), (2, None)] or sorted(got, key=str) == [(2, None), (2, "z")]
    assert licenses.matches(docs, t.limit(0)).count() == 0
    conv = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, None), (None, 0, "user", "a"), (2, None, "user", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    r = chat.best_branches(chat.messages_of(conv)).collect()
    assert [(x.tree_id, x.path, x.conversation) for x in r] == [(1, "0,1", "<|user|>\na<|end|>\n<|unknown|>\n<|end|>\n")]
    assert chat.best_branches(chat.messages_of(conv.limit(0))).count() == 0
    assert chat.best_branches(chat.messages_of(conv).withColumn("branch", F.lit(1)).withColumn("path", F.lit(2)).withColumn("m", F.lit(3))).count() == 1


def test_vector_extras(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0, 1), (2, [1.0, 0.001], 0, 1)], "vec_id long, embedding array<float>, label int, g int").withColumns({c: F.lit(c) for c in ("cell", "part", "guest", "dim", "ids", "a", "b", "similarity")})
    assert [(r.vec_a, r.vec_b) for r in covertree.near_pairs(v).collect()] == [(1, 2)]
    assert sorted(covertree.near_classes(v).collect()) == [(1, 1, 1), (2, 1, 1)] and covertree.near_classes(v.limit(0)).count() == 0


def test_repetitive_texts(spark):
    """Texts and items of one word: hits are as many as the product of their lengths."""
    docs = spark.createDataFrame([(1, "same " * 20_000), (2, "same other " * 9000), (3, "same " * 12), (4, "same " * 12 + "x same x " + "same " * 12)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same " * 2000), (2, "other same " * 300)], "item_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id): r.words for r in decontam.overlaps(docs, items).collect()}
    assert got == {(1, 1): 2000, (2, 2): 600, (4, 1): 2000} and time.time() - began < 30
    assert [r.doc_id for r in decontam.clean_of(docs, items).collect()] == [3]


def test_clashing_columns_of_the_other_tables(spark, docs, labels, bench):
    more = lambda t, *names: t.withColumns({c: F.lit(c) for c in names})
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(quality.scored(docs, more(labels, "text", "y", "x", "score"))) == rows(quality.scored(docs, labels))
    assert rows(toxicity.offending_sentences(docs, more(labels, "text", "y", "o"))) == rows(toxicity.offending_sentences(docs, labels))
    assert rows(decontam.overlaps(docs, more(bench, "doc_id", "o", "z", "words"))) == rows(decontam.overlaps(docs, bench))
    t = licenses.template_table(spark)
    assert rows(licenses.matches(docs, more(t, "doc_id", "word", "n", "o"))) == rows(licenses.matches(docs, t))
