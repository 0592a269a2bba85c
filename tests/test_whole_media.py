"""Folds over many media in a table, and the steps of postprocess_pass whose work may grow no faster than the cues."""

import math
import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelattice.functions import difftools
from cuelattice.functions import text as tx
from cuelattice.operators import intervals, sequence, shared
from cuelattice.plans import passes

CUE = "media_id long, seq long, start_ms long, end_ms long, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_media_cross_batches():
    ids = [None, None, 1, 1, 1, 1, 1, 2, 3, 3, 4]
    for size in range(1, 12):
        rows = [pa.record_batch({"media_id": pa.array(ids[i : i + size], pa.int64()), "seq": list(range(len(ids)))[i : i + size]}) for i in range(0, len(ids), size)]
        tables = list(shared.whole_media([rows[0].slice(0, 0), *rows]))
        assert [x for t in tables for x in t["seq"].to_pylist()] == list(range(len(ids)))
        assert [hi - lo for t in tables for lo, hi in shared.media_in(t)] == [2, 5, 1, 2, 1]


def test_no_call_for_each_medium(spark):
    x = spark.createDataFrame([(m, q, q * 1000, q * 1000 + 900, f"cue {q} of {m}, and so on") for m in range(3) for q in range(3)], CUE)
    for df in (passes.postprocess(x, x, ["theTh"]), sequence.near_duplicates(x), sequence.terms_kept_whole(x, ["ab"]), sequence.restore_timecodes(x, x), sequence.greedy_chunks(x.withColumn("tokens", F.length("text")))):
        assert "FlatMap" not in plan(df) and "MapInArrow" in plan(df)
    # the corrected cues are made once, and what follows a cue is found without going through the rest of its medium
    assert "Join" not in plan(sequence.restore_timecodes(x, x)) and "1, unboundedfollowing" not in plan(sequence.restore_timecodes(x, x)).lower()


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


def test_folds_across_batches(spark, small_batches):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rng = random.Random(5)
    ref = [(m, q, q * 1000, q * 1000 + 800, " ".join(rng.choices(words, k=8))) for m in range(20) for q in range(1 + m % 7)]
    cor = [(m, q, 0, 0, t.replace("eta", "ata")) for m, q, _, _, t in ref if q != 2]
    got = {(r.media_id, r.seq): (r.matched, r.start_ms, r.end_ms) for r in sequence.restore_timecodes(spark.createDataFrame(cor, CUE), spark.createDataFrame(ref, CUE)).collect()}
    assert len(got) == len(cor)
    for m in range(20):
        own = [c for c in cor if c[0] == m]
        for c, t in zip(own, sequence.restored_times([c[4] for c in own], [r[2:] for r in ref if r[0] == m])):
            assert t is None or got[m, c[1]] == (True, *t)
    cues = [(m, q, q * 100, q * 100 + 50, t) for m in range(9) for q, t in enumerate(["ab cd", "ab cde", "x", "看本益", "比很高"])]
    kept = sorted((r.media_id, r.text) for r in sequence.near_duplicates(spark.createDataFrame(cues, CUE)).collect())
    assert kept == sorted((m, t) for m in range(9) for t in ("ab cde", "x", "看本益", "比很高"))
    whole = sorted((r.media_id, r.text) for r in sequence.terms_kept_whole(spark.createDataFrame(cues, CUE), ["本益比"]).collect())
    assert whole == sorted((m, t) for m in range(9) for t in ("ab cd", "ab cde", "x", "看本益比", "很高"))


def test_rows_without_text_or_medium_stay(spark):
    ref = spark.createDataFrame([(1, 0, 0, 900, "the first one"), (1, 1, 1000, None, None), (1, 2, 2000, 2900, "quite another line")], CUE)
    cor = spark.createDataFrame([(1, 0, 5, 6, "the first one"), (1, 1, 5, 6, None), (1, 2, 5, 6, "quite another line"), (None, 0, 5, 6, "of no medium"), (2, 0, 5, 6, "same key"), (2, 0, 5, 6, "same key")], CUE)
    got = sorted(((r.media_id or 0, r.seq, r.matched, r.start_ms, r.end_ms) for r in sequence.restore_timecodes(cor, ref).collect()))
    assert got == [(0, 0, False, 5, 6), (1, 0, True, 0, 900), (1, 1, False, 900, 1000), (1, 2, True, 1000, 2900), (2, 0, False, 5, 6), (2, 0, False, 5, 6)]


def test_bounded_ratios_are_exact():
    rng = random.Random(3)
    for n in (1, 3, 12, 60, 230, 500):
        for _ in range(40):
            a = "".join(rng.choices("abcdefg 不過", k=n))
            b = "".join(rng.choices("abcdefg 不過", k=rng.randint(0, n))) if rng.random() < 0.3 else "".join(c for c in a if rng.random() < 0.8) + a[: rng.randint(0, n)]
            true = SequenceMatcher(None, a, b).ratio()
            for least in (0.3, 0.6, 0.75, true, 0.9, 1.0):
                assert difftools.ratio_from(a, b, least) == (true if true >= least else 0.0)
                assert difftools.alike(a, b, least) == (true >= least)
    assert difftools.alike("", "", 0.6) and not difftools.alike("", "a", 0.6)


def test_ratios_stop_when_decided(monkeypatch):
    calls, find = [], difftools._longest
    monkeypatch.setattr(difftools, "_longest", lambda *a: calls.append(a) or find(*a))
    a = "".join(random.Random(1).choices("abcdefghij", k=150))
    assert difftools.alike(a + "tion" * 9 + a[::-1], a + "sion" * 9 + a[::-1], 0.4) and len(calls) == 1
    # of frequent characters no place is gone through
    assert len(calls[0][2]) < 40
    calls.clear()
    assert difftools.alike(a * 9, a * 9, 0.6) and not calls


def test_cut_points_of_many_media(spark):
    rng = random.Random(2)
    points = {m: [rng.choice((None, *range(0, 900, 10))) for _ in range(rng.randint(0, 25))] for m in range(40)}
    media = spark.createDataFrame([(m, 100.0 * m % 900) for m in points], "media_id long, total_s double")
    df = intervals.cut_points(media, spark.createDataFrame([(m, None if s is None else float(s)) for m, l in points.items() for s in l], "media_id long, silence_end double"), 60.0)
    want = []
    for m, l in points.items():
        free = {float(s) for s in l if s is not None}
        for no in range(1, math.ceil((100.0 * m % 900) / 60)):
            if free:
                want.append((m, no, min(free, key=lambda s: (abs(s - 60.0 * no), s))))  # noqa: B023
                free.remove(want[-1][2])
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 100
    assert "FlatMap" not in plan(df)


def test_spaces_before_marks(spark):
    rows = [("好" + " " * 200 + "?", "好" + " " * 200 + "？"), ("好 ! ?", "好 ！ ?"), ("好?!", "好？!"), ("a ?", "a ?"), ("1, a,2, b", "1, a,2, b"), ("a, 5 b,,c", "a， 5 b，，c"), (", x", "，x")]
    got = spark.createDataFrame(rows, "t string, want string").select(tx.fullwidth_norm("t").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_parts_do_not_hold_each_other(spark):
    text = "，".join("甲乙丙丁戊己庚辛壬癸子丑" for _ in range(3000))
    df = sequence.split_cues(spark.createDataFrame([(1, 0, 7, 90_007, text)], CUE), forced=True)
    got = df.orderBy("seq").collect()
    assert len(got) == 3000 and [(r.start_ms, r.end_ms) for r in got] == [(7 + 30 * k, 37 + 30 * k) for k in range(3000)]
    assert "sizes" not in plan(df)
