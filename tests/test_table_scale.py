"""Queries that SQL can't express, over whole tables, against plain Python loops: alignment, edits, errors, splits, restored times."""

from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from conftest import SF

from cuelattice.functions.dictionary import DEFAULT, Dictionary
from cuelattice.operators import align, sequence
from cuelattice.plans import catalog


@pytest.fixture(scope="module")
def media(duck):
    """media_id -> cues (seq, start, end, text), with times counted anew."""
    out = defaultdict(list)
    said = Counter()
    for conv, turn, text in duck.execute("select conv_id, turn, text from conversations order by conv_id, turn").fetchall():
        start = said[conv] * 60 + 12000 * (turn // 3)
        out[conv].append((turn, start, start + len(text) * 50 + (4000 if turn % 3 == 1 else 0), text))
        said[conv] += len(text)
    return dict(out)


def clamped(cues):
    return [(q, s, min(e, cues[i + 1][1]) if i + 1 < len(cues) else e, t) for i, (q, s, e, t) in enumerate(cues)]


def twin_of(cues):
    return [(q, s + 40, e + 40, t.replace("tion", "sion")) for q, s, e, t in cues if q % 7 != 6]


def groups(a, b):
    nodes = sorted([(c[1], "s", c[0]) for c in a] + [(c[1], "a", c[0]) for c in b], key=lambda n: (n[0], n[1] == "a", n[2]))
    root = {n[1:]: n[1:] for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for q, s, e, _ in a:
        for p, u, v, _ in b:
            if min(e, v) - max(s, u) > 150:
                root[find(("s", q))] = find(("a", p))
    own = defaultdict(list)
    for i, n in enumerate(nodes, 1):
        own[find(n[1:])].append((i, *n[1:]))
    return {min(x)[0]: x for x in own.values()}


@pytest.fixture(scope="module")
def texts(media):
    """(media, group) -> (category, machine text, human text, start)."""
    out = {}
    for m, cues in media.items():
        a = clamped(cues)
        b = twin_of(a)
        at = {("s", c[0]): c for c in a} | {("a", c[0]): c for c in b}
        for g, members in groups(a, b).items():
            side = lambda k, members=members, at=at: " ".join(t for _, _, _, t in sorted(at[x[1:]] for x in members if x[1] == k))
            s, h, ns, na = side("s"), side("a"), sum(x[1] == "s" for x in members), sum(x[1] == "a" for x in members)
            if not ns or not na:
                kind = "DEL" if ns else "ADD"
            elif ns == na == 1:
                kind = "SAME" if s == h else "TEXT_MOD"
            elif 1 in (ns, na):
                kind = ("SPLIT" if ns == 1 else "MERGE") + ("" if s == h else "+MOD")
            else:
                kind = "SAME" if s == h else "COMPLEX_MOD"
            out[m, g] = (kind, s, h, min(at[x[1:]][1] for x in members))
    return out


def known(old, new, pairs):
    return pairs.get(old) == new or any(k in old and v in new and len(old) <= len(k) + 2 for k, v in pairs.items())


def category(op, old, new, d=DEFAULT):
    old, new = old.strip(" "), new.strip(" ")
    if op == "delete":
        return "WHITESPACE" if not old else "FILLER_KNOWN" if old in d.fillers else "FILLER_CANDIDATE" if len(old) <= 3 else "DELETE_OTHER"
    if op == "insert":
        return "INSERT" if new else "WHITESPACE"
    if known(old, new, d.homophones):
        return "HOMOPHONE_KNOWN"
    if len(old) == len(new) == 1:
        return "HOMOPHONE_NEW_CANDIDATE"
    return "REPLACE_MULTI" if max(len(old), len(new)) >= 2 else "REPLACE_OTHER"


def error(op, old, new, context, d=DEFAULT):
    old, new = old.strip(" "), new.strip(" ")
    if not old and not new:
        return None
    if known(old, new, {**d.homophones, **d.scored}):
        return "HOMOPHONE_KNOWN", 2
    if op == "delete":
        return None if not old else ("FILLER_KNOWN", 1) if old in d.fillers else ("FILLER_CANDIDATE", 1) if len(old) <= 3 else ("DELETE_OTHER", 2)
    if op == "insert":
        return ("INSERT", 2) if new else None
    if d.sound_alike.get(old) == new:
        return "HOMOPHONE_NEW", 2
    if (old, new) in d.by_context:
        return "CONTEXT_JUDGMENT", 2
    if len(old) == len(new) == 1:
        return ("TERM_ERROR", 3) if any(t in context for t in d.near_terms) else ("HOMOPHONE_NEW", 2)
    if any(t in new for t in d.terms):
        return "TERM_ERROR", 3
    return ("MISHEAR", 3) if len(old) >= 2 and len(new) >= 2 else ("REPLACE_OTHER", 2)


@pytest.fixture(scope="module")
def edits(texts):
    out = []
    for (m, g), (kind, s, h, _) in texts.items():
        if kind not in ("ADD", "DEL") and s != h:
            out += [(m, g, kind, op, s[i:j], h[k:n], h) for op, i, j, k, n in SequenceMatcher(None, s, h).get_opcodes() if op != "equal"]
    return out


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_diff_opcodes(spark, edits):
    got = Counter((r.media_id, r.group_id, r.align_type, r.op, r.old, r.new, r.category) for r in run(spark, "diff_opcodes"))
    assert got == Counter((m, g, kind, op, old, new, category(op, old, new)) for m, g, kind, op, old, new, _ in edits) and len(got) > 50


def test_change_counts(spark, edits):
    want = Counter()
    for _, _, kind, op, old, new, _ in edits:
        c = category(op, old, new)
        if c != "WHITESPACE":
            want.update([(kind, c), (kind, None), (None, None)])
    assert {(r.align_type, r.category): r.n for r in run(spark, "change_counts")} == want


def error_rate(cues):
    a, b = (" ".join(t for *_, t in x) for x in (cues, twin_of(cues)))
    n = sum(max(j - i, m - k) for op, i, j, k, m in SequenceMatcher(None, a, b).get_opcodes() if op != "equal")
    return n / len(b) if b else float(bool(a))


def test_cer(spark, media):
    got = {r.media_id: r.cer for r in run(spark, "cer")}
    assert set(got) == set(media) and all(abs(got[m] - error_rate(c)) < 1e-12 for m, c in media.items())


def test_quality_report(spark, media, texts, edits):
    found = defaultdict(list)
    for m, _, _, op, old, new, h in edits:
        if e := error(op, old, new, h):
            found[m].append(e)
    rows = {r.media_id: r for r in run(spark, "quality_report")}
    assert set(rows) == set(media)
    for m, cues in media.items():
        r, a, own = rows[m], clamped(cues), [x for k, x in texts.items() if k[0] == m]
        n = [sum(s == k for _, s in found[m]) for k in (1, 2, 3)]
        assert (r.machine_count, r.human_count, r.total_changes, r.light, r.medium, r.severe) == (len(a), len(twin_of(a)), sum(n), *n)
        assert r.term_errors == sum(e == "TERM_ERROR" for e, _ in found[m])
        assert abs(r.quality_score - max(0.0, 100 - (3 * n[2] + n[1] + 0.3 * n[0]) / len(a) * 100)) < 1e-9
        assert abs(r.same_ratio - sum(k not in ("ADD", "DEL") and s == h for k, s, h, _ in own) / len(own)) < 1e-12
        assert abs(r.cer - error_rate(a)) < 1e-12


def split_rows(cues, parts_of, forced):
    out = []
    for _, s, e, t in cues:
        parts = parts_of(t) if len(t) > sequence.LIMIT else [t]
        sizes = [1 if forced else max(1, len(p)) for p in parts]
        for k, p in enumerate(parts):
            at = lambda j, sizes=sizes, s=s, e=e: s + (e - s) * sum(sizes[:j]) // sum(sizes)
            out.append((len(out), at(k), at(k + 1), p) if len(parts) > 1 else (len(out), s, e, p))
    return out


@pytest.mark.parametrize("name", ["split_long_cues", "force_split_cues"])
def test_splits(spark, media, name):
    got = defaultdict(list)
    for r in run(spark, name):
        got[r.media_id].append((r.seq, r.start_ms, r.end_ms, r.text))
    forced = name == "force_split_cues"
    longest = 0
    for m, cues in media.items():
        x = cues if forced else [(q, s, e, t.replace(", ", "，")) for q, s, e, t in cues]
        want = split_rows(x, sequence.split_forced if forced else sequence.split_long, forced)
        assert sorted(got[m]) == want
        assert "".join(p for *_, p in want).replace("，", "").replace(" ", "") == "".join(t for *_, t in x).replace("，", "").replace(" ", "").replace(",", ",") or forced
        longest = max(longest, len(want) - len(x))
    assert longest > 0


def test_restore_timecodes(spark, media):
    got = {(r.media_id, r.seq): (r.matched, r.start_ms, r.end_ms) for r in run(spark, "restore_timecodes")}
    n = 0
    for m, cues in media.items():
        cor = twin_of(cues)
        found = sequence.restored_times([t for *_, t in cor], [(s, e, t) for _, s, e, t in cues])
        done = [f is not None for f in found]
        for i, (q, *_) in enumerate(cor):
            if done[i]:
                want = (True, *found[i])
            else:
                before = next((found[j] for j in range(i - 1, -1, -1) if done[j]), None)
                after = next((found[j] for j in range(i + 1, len(cor)) if done[j]), None)
                lo = next((j for j in range(i, -1, -1) if done[j]), -1) + 1
                hi = next((j for j in range(i, len(cor)) if done[j]), len(cor))
                if before is None:
                    want = (False, 0, 0)
                elif after is None:
                    want = (False, before[1], before[1] + 2000)
                else:
                    at = lambda k: before[1] + (after[0] - before[1]) * k // (hi - lo)  # noqa: E731, B023
                    want = (False, at(i - lo), max(at(i - lo + 1), at(i - lo) + (500 if at(i - lo + 1) <= at(i - lo) else 0)))
            assert got[m, q] == want
            # a cue that is found one to one has its own times back
            n += found[i] == next((s, e) for p, s, e, _ in cues if p == q)
    assert n > len(got) / 2


def test_every_pair_of_the_dictionary(spark):
    d = DEFAULT
    words = sorted({*d.homophones, *d.homophones.values(), *d.scored, *d.scored.values(), *d.sound_alike, *d.sound_alike.values(), *d.fillers, *d.terms, "", " ", "甲", "甲乙", "甲乙丙丁"})
    rows = [(op, a + x, b, ctx) for a in words for b in words for op in ("replace", "delete", "insert") for x in ("", "乙") for ctx in ("", "看市值") if op == "replace" or (b == "" if op == "delete" else a == "")]
    x = spark.createDataFrame(rows, "op string, old string, new string, a_text string")
    own = Dictionary.of([("homophone", "甲", "丁"), ("filler", "乙", ""), ("other", "x", "y")])
    got = x.select("*", align.categorize_change().alias("c"), align.classify_error().alias("e"), align.categorize_change(words=own).alias("c2"), align.classify_error(words=own).alias("e2")).collect()
    for r in got:
        args = (r.op, r.old, r.new)
        assert (r.c, r.e and tuple(r.e)) == (category(*args), error(*args, r.a_text)), args
        assert (r.c2, r.e2 and tuple(r.e2)) == (category(*args, own), error(*args, r.a_text, own)), args
    assert len(d.homophones) == 25 and len(d.terms) == 21 and len(got) > 10_000
