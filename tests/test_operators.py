"""Sequential operators against plain Python, the gate's behaviour, and edge cases."""

import random
from collections import deque
from difflib import SequenceMatcher

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from cuelattice.functions import difftools, rules, text as tx, timecode as tc
from cuelattice.operators import align, commentary, external, gate, intervals, overlay, quality, sequence, validate
from cuelattice.plans import passes
from cuelattice.sources import sinks, srt

CUE = "media_id string, seq long, start_ms long, end_ms long, text string"
SEG = "media_id string, seg int, seq long, start_ms long, end_ms long, text_lines array<string>"


def B(number, start, end, sep=","):
    """The head of a block: its number and its time line."""
    return f"{number}\n" + " --> ".join(f"00:00:{t:02d}{sep}000" for t in (start, end)) + "\n"


def cues(spark, rows, media="m"):
    return spark.createDataFrame([(media, i, *r) for i, r in enumerate(rows)], CUE)


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


# -- scans and sinks


def test_srt_scan_is_lenient(spark):
    text = "﻿" + B(1, 1, 2).replace("\n", "\r\n") + " a \r\n\r\n b\r\n\r\nbad\r\n\r\n2\r\n00:00:02.5 --> 00:00:03,000\r\n"
    x = srt.scan_srt(spark.createDataFrame([("m", text)], "media_id string, content string"))
    assert [(r.seq, r.idx, r.start_ms, r.text) for r in x.orderBy("seq").collect()] == [(0, 1, 1000, "a"), (1, 2, 2005, "")]


def test_strict_scan_needs_three_lines(spark):
    text = B("x", 1, 2) + "a\nb\n\n" + B(2, 2, 3).rstrip()
    x = srt.scan_srt_strict(spark.createDataFrame([("m", text)], "media_id string, content string")).collect()
    assert [(r.seq, r.text_lines) for r in x] == [(0, ["a", "b"])]


def test_seconds_scan_pads_the_fraction(spark):
    x = srt.scan_srt_seconds(spark.createDataFrame([("m", "+1\n00:00:01,5 --> 00:00:02,000\na")], "media_id string, content string")).first()
    assert (x.start_s, x.end_s) == (1.5, 2.0)


def test_entry_chunks_and_timecode_scan(spark):
    text = "\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},500\nt{i}\n" for i in range(1, 6))
    x = spark.createDataFrame([("m", text)], "media_id string, content string")
    assert [(r.chunk, r.entries) for r in srt.scan_entry_chunks(x, 2).orderBy("chunk").collect()] == [(0, 2), (1, 2), (2, 1)]
    assert [(r.start_ms, r.text) for r in srt.scan_by_timecodes(x).orderBy("seq").collect()] == [(i * 1000, f"t{i}") for i in range(1, 6)]


def test_log_scan(spark):
    log = "[00:01.000 --> 00:02.500] a Traceback (most recent call last) b\nnoise\n[1:00:00.000 --> 1:00:01.000] ♪\n[00:03.000 --> 00:04.000] c\nTraceback (most recent call last):\n[00:05.000 --> 00:06.000] d"
    x = srt.scan_log(spark.createDataFrame([("m", log)], "media_id string, content string")).orderBy("seq").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in x] == [(1000, 2500, "a Traceback (most recent call last) b"), (3000, 4000, "c")]


def test_segment_and_caption_scans(spark):
    make = lambda c: spark.createDataFrame([("m", c)], "media_id string, content string")
    assert srt.scan_segments(make("no json")).count() == 0
    with pytest.raises(Exception, match="no segment list"):
        srt.scan_segments(make("{}"), strict=True).collect()
    r = srt.scan_captions(make('{"captions":[{"time_s":1.5,"caption":"c","terms":["t"]}]}')).first()
    assert (r.time_s, r.caption, r.terms) == (1.5, "c", ["t"])


def test_glossary_scan(spark):
    x = spark.createDataFrame([("g", "# no\n市值（note）\n四指→市值\n\nA")], "media_id string, content string")
    got = {(r.term, r.wrong, r.correct) for r in srt.scan_glossary(x).collect()}
    assert got == {("市值", None, None), ("四指", "四指", "市值"), ("A", None, None)}
    assert {r.term for r in srt.scan_glossary(x, loose=True).collect()} == {"市值", "四指→市值"}


def test_files_round_trip(spark, tmp_path):
    x = cues(spark, [(0, 1000, "a"), (1000, 2000, "b\nc")])
    sinks.write_texts(sinks.render_srt(x), str(tmp_path / "out"))
    back = srt.scan_srt(srt.read_texts(spark, str(tmp_path / "out" / "media_id=m" / "*.txt")))
    assert [(r.start_ms, r.text) for r in back.orderBy("seq").collect()] == [(0, "a"), (1000, "b\nc")]
    assert sinks.render_json(x).first().content.startswith('[{"seq":0')
    assert "| 0 | 1000 |" in sinks.render_table(x.select("start_ms", "end_ms"), "t").first().content
    assert srt.unique_file(["a[1].json", "b.json"], ["a[1]"]) == "a[1].json"
    with pytest.raises(FileNotFoundError):
        srt.unique_file(["a.json", "ab.json"], ["a"])


def test_parts_sort_by_number(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"x_seg_{n}_corrected.srt").write_text(B(1, 1, 2) + "a\n")
    assert [r.seg for r in srt.read_parts(spark, str(tmp_path)).orderBy("seg").collect()] == [2, 10]


# -- difference functions


def test_edits_are_difflibs(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("ab ", k=rnd.randint(0, 30))), "".join(rnd.choices("ab ", k=rnd.randint(0, 30)))) for _ in range(50)] + [("ab" * 150, "b" + "ab" * 150)]
    x = spark.createDataFrame(pairs, "a string, b string").select("a", "b", difftools.edits("a", "b").alias("e"), difftools.ratio("a", "b").alias("r"), difftools.error_rate("a", "b").alias("c"))
    for r in x.collect():
        ops = [o for o in SequenceMatcher(None, r.a, r.b).get_opcodes() if o[0] != "equal"]
        assert [(e.op, e.s0, e.s1, e.a0, e.a1) for e in r.e] == ops
        assert r.r == SequenceMatcher(None, r.a, r.b).ratio()
        assert r.c == ((1.0 if r.a else 0.0) if not r.b else sum(max(j - i, m - k) for _, i, j, k, m in ops) / len(r.b))


def test_grown_replacements(spark):
    x = spark.createDataFrame([("看軍線走", "看均線走"), ("今天事實管理", "今天市值管理")], "a string, b string")
    got = [[tuple(e)[2:] for e in r.r] for r in x.select(difftools.raw_replacements("a", "b").alias("r")).collect()]
    assert got == [[("看軍", "看均")], [("事實管", "市值管")]]


def test_repeated_lines_merge():
    assert difftools.merge_lines(["今天大盤很好", "今天大盤很好啊", "x"]) == ["今天大盤很好啊", "x"]


# -- sequence


def test_duplicate_runs_alternate(spark):
    x = cues(spark, [(0, 10, "A"), (10, 20, "A"), (20, 30, "A"), (9000, 9010, "A")])
    assert [r.deleted for r in sequence.adjacent_duplicates(x).orderBy("seq").collect()] == [False, True, False, False]


def test_splits():
    text = "今天我們先來看一下大盤的走勢，然後再看一下個股的表現因為最近波動比較大"
    parts = sequence.split_long(text)
    assert all(len(p) <= 20 for p in parts) and "".join(parts) == text.replace("，", "", 1) and len(parts) > 1
    assert sequence.split_long("short") == ["short"]
    assert sequence.split_forced("好" * 31) == ["好" * 15, "好" * 16]
    assert sequence.split_forced("a" * 40) == ["a" * 40]
    assert sequence.split_forced("甲" * 28) == ["甲" * 28]


def test_split_cues_share_time(spark):
    text = "今天我們先來看一下大盤的走勢，然後再看一下個股的表現因為最近波動比較大"
    for forced in (False, True):
        x = sequence.split_cues(cues(spark, [(1000, 9000, text), (9000, 9500, None), (9500, 9600, "")]), forced).orderBy("seq").collect()
        assert x[0].start_ms == 1000 and x[-3].end_ms == 9000 and x[-2].text is None and x[-1].text == ""
        assert all(a.end_ms == b.start_ms for a, b in zip(x, x[1:-2])) and [r.seq for r in x] == list(range(len(x)))


def test_greedy_chunks(spark):
    x = spark.createDataFrame([("m", i, 1) for i in range(500)], "media_id string, seq long, tokens int")
    got = [r["count"] for r in sequence.greedy_chunks(x).groupBy("chunk").count().orderBy("chunk").collect()]
    assert got == [200, 200, 100]
    y = spark.createDataFrame([("m", i, t) for i, t in enumerate([10, 10, 10, 10, 10, 99])], "media_id string, seq long, tokens int")
    assert [r.chunk for r in sequence.greedy_chunks(y, 25).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 3]


def test_restored_times():
    ref = [(0, 1000, "今天大盤上漲"), (1000, 2000, "台積電創新高"), (2000, 3000, "我們來看均線"), (3000, 5000, "支撐與壓力都很重要")]
    assert sequence.restored_times([t for _, _, t in ref], ref) == [(s, e) for s, e, _ in ref]
    assert sequence.restored_times(["今天大盤上漲台積電創新高我們來看均線", "支撐與壓力都很重要"], ref) == [(0, 3000), (3000, 5000)]
    assert sequence.restored_times(["支撐與", "壓力都", "很重要"], ref[3:]) == [(3000, 3666), (3666, 4333), (4333, 5000)]
    assert sequence.restored_times(["完全無關的句子呢", "我們來看均線", ""], ref) == [None, (2000, 3000), None]


def test_restore_places_orphans(spark):
    cor = cues(spark, [(0, 0, "今天大盤上漲"), (0, 0, "呼呼嘿嘿哈哈哈哈嗚嗚嗚嗚"), (0, 0, "我們來看均線"), (0, 0, "尾巴啦啦啦")])
    ref = cues(spark, [(0, 1000, "今天大盤上漲"), (3000, 4000, "我們來看均線")])
    got = [(r.start_ms, r.end_ms) for r in sequence.restore_timecodes(cor, ref).orderBy("seq").collect()]
    assert got == [(0, 1000), (1000, 3000), (3000, 4000), (4000, 6000)]


def test_terms_stay_whole(spark):
    x = cues(spark, [(0, 1000, "看本益"), (1000, 2000, "比很高的"), (2000, 3000, "市"), (3000, 4000, "值")])
    got = [(r.start_ms, r.end_ms, r.text) for r in sequence.terms_kept_whole(x, ["本益比", "市值"]).orderBy("start_ms").collect()]
    assert got == [(0, 1250, "看本益比"), (1250, 2000, "很高的"), (2000, 4000, "市值")]


def test_near_duplicates(spark):
    x = cues(spark, [(0, 1000, "今天很好"), (100, 1100, "今天很好啊"), (200, 1200, "完全不同喔"), (5000, 6000, "今天很好")])
    assert [r.text for r in sequence.near_duplicates(x).orderBy("seq").collect()] == ["今天很好啊", "完全不同喔", "今天很好"]
    assert sequence.near_duplicates(x, 500, None).count() == 2


def test_frames(spark):
    x = spark.createDataFrame([("m", 0, 0), ("m", 1, 1), ("m", 2, 0xFFFF), ("m", 3, -1)], "media_id string, seq long, hash long")
    assert [r.seq for r in sequence.distinct_frames(x).orderBy("seq").collect()] == [0, 2, 3]


# -- intervals


def test_cut_points(spark):
    media = spark.createDataFrame([("m", 9000.0), ("short", 10.0)], "media_id string, total_s double")
    sil = spark.createDataFrame([("m", s) for s in (2800.0, 3300.0, 5900.0, 8000.0)], "media_id string, silence_end double")
    assert [r.cut_s for r in intervals.cut_points(media, sil, 3000.0).orderBy("cut_no").collect()] == [2800.0, 5900.0]


def test_interval_edges(spark):
    spans = spark.createDataFrame([("m", 0, 0, 1000), ("m", 1, 5, 5)], "media_id string, span int, start_ms long, end_ms long")
    x = cues(spark, [(200, 400, "a"), (300, 500, "b"), (1000, 2000, "touching")])
    got = {r.span: (r.covered_ms, r.coverage) for r in intervals.coverage(spans, x).collect()}
    assert got == {0: (400, 0.4), 1: (0, 1.0)}
    assert rows_of(intervals.uncovered(spans.where("span = 0"), x), ["start_ms", "end_ms"]) == [("0", "200"), ("500", "1000")]


def test_components_beyond_chains(spark):
    rnd = random.Random(5)
    a = [(s, s + rnd.randint(200, 3000), "t") for s in sorted(rnd.randint(0, 40000) for _ in range(60))]
    b = [(s, s + rnd.randint(200, 3000), "t") for s in sorted(rnd.randint(0, 40000) for _ in range(60))]
    got = {}
    for r in align.groups(cues(spark, a), cues(spark, b)).collect():
        got.setdefault(r.group_id, set()).add((r.side, r.seq))
    nodes = {("s", i) for i in range(60)} | {("a", i) for i in range(60)}
    near = {n: set() for n in nodes}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if min(x[1], y[1]) - max(x[0], y[0]) > 150:
                near["s", i].add(("a", j))
                near["a", j].add(("s", i))
    want = set()
    while nodes:
        todo, seen = deque([nodes.pop()]), set()
        while todo:
            n = todo.popleft()
            if n not in seen:
                seen.add(n)
                todo.extend(near[n])
        nodes -= seen
        want.add(frozenset(seen))
    assert {frozenset(v) for v in got.values()} == want


def test_anomalies(spark):
    x = cues(spark, [(0, 1000, "好" * 12), (1000, 2000, "x"), (20000, 21000, "y")])
    got = [(r.type, r.start_ms, r.end_ms) for r in intervals.anomalies(x).collect()]
    assert got == [("merged", 0, 20000)]


# -- gate


def seg_rows(spark, rows, seg=1):
    return spark.createDataFrame([("m", seg, i, s, e, t if isinstance(t, list) else [t]) for i, (s, e, t) in enumerate(rows)], SEG)


def line(i, e=None):
    return (i * 1000, e if e is not None else i * 1000 + 900, f"line number {i:03d} of text")


def verdict(spark, a, b, **kw):
    r = gate.gate(seg_rows(spark, a), seg_rows(spark, b), **kw).first()
    return r.status, r.reasons


def test_gate(spark):
    base = [line(i) for i in range(30)]
    assert verdict(spark, base, base[:10]) == ("fail", ["ratio"])
    assert verdict(spark, base, base[:21]) == ("warn", [])
    assert verdict(spark, base, [*base[:20], (20000, 41000, "long one here")]) == ("fail", ["ratio"])
    assert verdict(spark, base, [*base[:29], (29000, 29000, "x")]) == ("fail", ["zero_duration"])
    zero = [*base[:29], (29000, 29000, "x")]
    assert verdict(spark, zero, zero) == ("pass", [])
    dup = [*base[:27], (27000, 27900, base[0][2]), base[28], (29000, 29900, base[2][2])]
    assert verdict(spark, base, dup) == ("fail", ["dup_text"])
    assert verdict(spark, base, dup, dup_min_chars=0) == ("pass", [])
    assert verdict(spark, base, [*base[:27], (27000, 27900, base[0][2]), *base[28:]]) == ("warn", [])
    twice = [*base[:27], (27000, 27900, base[0][2]), *base[28:]]
    assert verdict(spark, twice, twice) == ("pass", [])
    assert verdict(spark, base, [*base[:10], (10000, 10000, "z"), *[(11000 + i, 12000, base[0][2]) for i in range(3)]]) == ("fail", ["ratio", "zero_duration", "dup_text"])


def test_merge(spark):
    inputs = seg_rows(spark, [line(i) for i in range(4)])
    out = seg_rows(spark, [(0, 1500, ["今天大盤很好", "今天大盤很好啊"]), line(1), line(2), (30000, 31000, "end of it all")])
    base = spark.createDataFrame([("m", 0, 10000, 11000, ["filled"]), ("m", 1, 1000, 1900, ["there"])], "media_id string, seq long, start_ms long, end_ms long, text_lines array<string>")
    _, merged = gate.merge(inputs, out, base)
    got = [(r.start_ms, r.end_ms, r.text_lines) for r in merged.orderBy("seq").collect()]
    assert got == [(0, 1000, ["今天大盤很好啊"]), (1000, 1900, [line(1)[2]]), (2000, 2900, [line(2)[2]]), (10000, 11000, ["filled"]), (30000, 31000, ["end of it all"])]
    assert gate.merge(inputs, seg_rows(spark, [line(0)]), base)[1].count() == 0


# -- rules, quality, validation, externals


def test_rules(spark):
    r = rules.Rule("ab", "b", contexts=("x",))
    assert rules.apply_in_context("abx  abcdefgh ab", r) == "bx  bcdefgh ab"
    x = spark.createDataFrame([(0, "s", "a", "b", [], []), (1, "s", "b", "c", ["z"], ["no"])], "rule_seq int, ruleset string, wrong string, correct string, contexts array<string>, excludes array<string>")
    got = rules.fold(cues(spark, [(0, 1, "az"), (0, 1, "a no z"), (0, 1, None)]), rules.collected(x)).orderBy("seq").collect()
    assert [t.text for t in got] == ["cz", "b no z", None]
    assert rules.scan_missed(cues(spark, [(0, 1, "aaa")]), [rules.Rule("aa", "b")]).count() == 2


def test_classes(spark):
    x = spark.createDataFrame([("replace", "在", "再", ""), ("delete", "好", "", ""), ("delete", "今天很", "", ""), ("insert", "", " ", ""), ("replace", "甲", "乙", ""), ("replace", "甲", "乙", "看市值"), ("replace", "甲乙", "均線", ""), ("replace", "甲乙", "丙丁", ""), ("replace", "固執", "估值", "")], "op string, old string, new string, a_text string")
    got = x.select(align.categorize_change().alias("c"), align.classify_error().alias("e")).collect()
    assert [r.c for r in got] == ["HOMOPHONE_KNOWN", "FILLER_KNOWN", "FILLER_CANDIDATE", "WHITESPACE", "HOMOPHONE_NEW_CANDIDATE", "HOMOPHONE_NEW_CANDIDATE", "REPLACE_MULTI", "REPLACE_MULTI", "REPLACE_MULTI"]
    assert [r.e and tuple(r.e) for r in got] == [("HOMOPHONE_KNOWN", 2), ("FILLER_KNOWN", 1), ("FILLER_CANDIDATE", 1), None, ("HOMOPHONE_NEW", 2), ("TERM_ERROR", 3), ("TERM_ERROR", 3), ("MISHEAR", 3), ("HOMOPHONE_NEW", 2)]


def test_quality_report(spark):
    a, b = cues(spark, [(0, 1000, "今天軍線"), (1000, 61000, "一樣的話")]), cues(spark, [(0, 1000, "今天均線"), (1000, 61000, "一樣的話")])
    texts = align.group_texts(align.groups(a, b), a, b)
    r = quality.quality_report(a, b, texts).first()
    assert (r.machine_count, r.medium, r.same_ratio, r.quality_score) == (2, 1, 0.5, 50.0)
    assert [tuple(z) for z in r.alerts] == [("RED", "cer"), ("RED", "score")]
    empty = quality.scored(spark.createDataFrame([("m", 0, 0, 0, 0, 0.0)], "media_id string, machine_count long, severe long, medium long, light long, minutes double")).first()
    assert empty.quality_score is None and empty.severe_per_minute == 0


def test_learned_terms(spark):
    a, b = cues(spark, [(0, 1, "看軍線走"), (5, 6, "那軍線呢"), (9, 10, "他來")]), cues(spark, [(0, 1, "看均線走"), (5, 6, "那均線呢"), (9, 10, "她來")])
    got = {(r.wrong, r.correct): r["count"] for r in quality.learned_terms(a, b, 1).collect()}
    assert got == {("看軍", "看均"): 1, ("那軍", "那均"): 1}


def test_validators(spark):
    make = lambda *t: spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "media_id string, content string")
    good = B(1, 1, 2).rstrip() + " tail\na"
    x = make(good, B(1, 1, 2)[2:] + "a", good + "\n\n2\n00:61:01,000 --> 00:62:02,000\nb", B(1, 2, 2) + "a", B(1, 1, 2).rstrip(), "", B(1, 1, 2, ".") + "a")
    got = [(r.valid, r.n) for r in validate.validate_srt(x).orderBy("media_id").collect()]
    assert got == [(True, 1), (True, 1), (False, 1), (False, 0), (False, 0), (False, 0), (False, 0)]
    seg = srt.scan_segments(make('[{"type":"meta","x":1},{"start":0,"end":1,"text":"a"}]', '[{"start":0,"end":1,"text":""}]'))
    assert [(r.valid, r.n) for r in validate.validate_segments(seg).orderBy("media_id").collect()] == [(True, 1), (False, 0)]
    cap = srt.scan_captions(make('[{"time_s":1,"caption":"a"}]', '[{"time_s":-1,"caption":"a"}]'))
    assert [r.valid for r in validate.validate_captions(cap).orderBy("media_id").collect()] == [True, False]


def test_commentary_is_idempotent(spark):
    text = B(1, 1, 2) + "今天\n→ x\n\nloose block\n\n" + B(2, 2, 3) + "走</content>"
    make = lambda t: spark.createDataFrame([("m", t)], "media_id string, content string")
    once = commentary.rendered(commentary.clean(srt.scan_blocks(make(text)))).first().content
    assert once == commentary.rendered(commentary.clean(srt.scan_blocks(make(once)))).first().content
    assert "→" not in once and "loose block" in once and "走\n" in once


def test_external_calls(spark):
    def model(text):
        if text == "bad":
            raise ValueError("no")
        return "1\n" + "00:00:01,000" + " --> " + "00:00:02,000\n" + text

    x = spark.createDataFrame([("m", 0, "a"), ("m", 1, "bad")], "media_id string, seg int, original string")
    got = external.corrected_or_original(external.called(x, model, ["original"], retries=1), "original").orderBy("seg").collect()
    assert [(r.accepted, r.output[-1], r.error) for r in got] == [(True, "a", None), (False, "d", "ValueError: no")]
    raw = spark.createDataFrame([("m", "f", 1.0, "AWS 漲\nAWS 漲\n\nOK"), ("m", "g", 2.0, " ")], "media_id string, frame string, frame_time double, raw string")
    assert [(r.caption, r.terms) for r in external.parse_ocr(raw).collect()] == [("AWS 漲 OK", ["AWS"])]
    assert external.usable_engines("auto", ["vlm", "ocr"]) == ["ocr", "vlm"]
    with pytest.raises(ValueError):
        external.usable_engines("ocr", [])
    gaps = spark.createDataFrame([("m", 0, 5.0, 9.0)], "media_id string, gap int, start_s double, end_s double")
    assert [(r.from_s, r.to_s) for r in external.retry_ladder(gaps).orderBy("attempt").collect()] == [(0.0, 19.0), (0.0, 29.0), (0.0, 39.0)]


def test_postprocess(spark):
    x = cues(spark, [(0, 1000, "今天好?"), (1000, 900, "看本益"), (2000, 3000, "比高。"), (3000, 4000, "</invoke>\n好")])
    got = passes.postprocess(x, terms=["本益比"]).orderBy("seq").collect()
    assert [r.text for r in got] == ["今天好？", "看本益比", "高", "好"]
    with pytest.raises(ValueError, match="residue"):
        passes.postprocess(cues(spark, [(0, 1, "</invoke>")]), strict=True)


def test_empty_tables(spark):
    e = cues(spark, [(0, 1, "x")]).limit(0)
    for df in (intervals.gaps(e), intervals.islands(e, 5), intervals.clamped(e), intervals.align_edges(e, e), align.groups(e, e), align.chained_groups(e, e), sequence.adjacent_duplicates(e), sequence.split_cues(e), sequence.near_duplicates(e), sequence.restore_timecodes(e, e), sequence.terms_kept_whole(e, ["ab"]), overlay.paired_by_start(e, e), quality.character_error_rate(e, e), sinks.render_srt(e)):
        assert df.count() == 0


def test_time_formats(spark):
    assert one(spark, "360000000", tc.format_ms) == "100:00:00,000"
    assert one(spark, "00:00:01,500", tc.parse_ms_strict) == 1500 and one(spark, "00:00:01,5", tc.parse_ms_strict) is None
    assert one(spark, "AWS QQQQQQ 用NVDA OK", lambda c: tx.tickers(c)) == ["AWS"]
    assert one(spark, "0123456789hit0123456789", lambda c: tx.context_snippet(c, F.lit("hit"))) == "23456789hit01234567"
