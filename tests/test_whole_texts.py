"""Queries that have to see the whole of a text or vector."""

import re
from collections import Counter

from cuelattice.plans import catalog
from cuelattice.sources import srt


def test_log_scan_meets_every_line(spark, tmp_path, monkeypatch):
    said = "first line\nsecond line\n[not a stamp] third"
    spark.createDataFrame([(1, 0, "user", said), (1, 1, "user", "\nonly a second line"), (1, 2, "user", "last")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    given, scan = [], srt.scan_log
    monkeypatch.setattr(srt, "scan_log", lambda x: given.extend(r.content for r in x.collect()) or scan(x))
    got = [(r.seq, r.text) for r in catalog.queries()["log_reconstruct"](spark, str(tmp_path)).orderBy("seq").collect()]
    assert said in given[0] and "only a second line" in given[0]
    assert got == [(0, "first line"), (1, "last")]


def judged(text):
    t = re.sub(r"[，,。！？、\s]", "", text)
    for n in (1, 2, 3):
        grams = [t[i : i + n] for i in range(max(1, len(t) - n + 1))]
        gram, count = Counter(grams).most_common(1)[0]
        if len(t) >= 10 and count >= 10 and count / len(grams) >= 0.8:
            return n, gram, count, count / len(grams)
    return None, None, None, None


def test_repetition_judges_whole_turns(spark, tmp_path):
    texts = ["the turn begins as any other does", "啊" * 30 + "好", "x" + "哈，" * 40, "aaaaaaaaaaaab" * 9, "aaaa" + "b" * 6, "", "no" * 40, "ab" * 3 + "z" * 90, "你" * 8 + "好" * 3]
    rows = [(1, i, "user", t) for i, t in enumerate([*texts, None])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.n, r.gram, r["count"], r.ratio) for r in catalog.queries()["repeated_grams"](spark, str(tmp_path)).collect()}
    assert got == {i: judged(t) for i, t in enumerate(texts)} | {len(texts): (None,) * 4}
    assert sorted(i for i in got if got[i][0]) == [1, 2, 3, 7]


def test_frames_differ_in_the_last_dimension(spark, tmp_path):
    a = [1.0] * 64
    b = [-1.0] * 7 + [1.0] * 56 + [-1.0]  # 8 signs, the last among them
    spark.createDataFrame([(1, a, 0), (2, b, 0), (3, a, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r.seq for r in catalog.queries()["distinct_frames"](spark, str(tmp_path)).collect()) == [1, 2]
