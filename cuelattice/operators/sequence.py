"""Order-dependent cue operators: duplicates, neighbours, orphans, splits, chunks, time-code restoration."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.difftools import alike, ratio_from
from .shared import folded, media_in, replaced

CONNECTORS = ("不過", "但是", "可是", "因為", "如果", "或者", "所以", "然後", "甚至", "而且")
LIMIT = 20


def _by_seq() -> Window:
    return Window.partitionBy("media_id").orderBy("seq")


def _seq() -> Column:
    return F.col("seq").asc_nulls_last()


def renumbered(cues: DataFrame) -> DataFrame:
    """seq dense from 0 by (start_ms, seq)."""
    return cues.withColumn("seq", (F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "seq")) - 1).cast("long"))


def adjacent_duplicates(cues: DataFrame, near_ms: int = 2000) -> DataFrame:
    """cues with `deleted`: of a run of equal neighbours less than near_ms apart every second one goes (a deleted cue deletes no other)."""
    w = _by_seq()
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in cues.columns else F.lit(False)
    x = cues.withColumn("gone", gone)
    repeats = (F.col("text") == F.lag("text").over(w)) & (F.abs(F.col("start_ms") - F.lag("end_ms").over(w)) < near_ms) & ~F.lag("gone").over(w)
    x = x.withColumn("repeats", F.coalesce(repeats, F.lit(False))).withColumn("run", F.sum((~F.col("repeats")).cast("int")).over(w))
    at = F.row_number().over(Window.partitionBy("media_id", "run").orderBy("seq")) - 1
    x = x.withColumn("deleted", F.col("gone") | (at % 2 == 1))
    return x.drop("gone", "repeats", "run")


def near_duplicates(cues: DataFrame, near_ms: int = 300, least: float | None = 0.6) -> DataFrame:
    """cues without those that start and end less than near_ms from the last kept one and, unless least is None, are at least so alike; the longer text stays in the earlier one's place.

    A recurrence over what was kept last: each medium in one task.
    """
    clean = re.compile(r"[，。、？！,.\s]")

    def fold(table: pa.Table) -> pa.Table:
        start, end, text = (table[c].to_pylist() for c in ("start_ms", "end_ms", "text"))
        near = lambda x, y: x is not None and y is not None and abs(x - y) < near_ms
        stays = [True] * table.num_rows
        for lo, hi in media_in(table):
            k = lo
            for i in range(lo + 1, hi):
                if near(start[i], start[k]) and near(end[i], end[k]):
                    a, b = text[i] or "", text[k] or ""
                    if least is None:
                        stays[i] = False
                        continue
                    if not least or alike(clean.sub("", a), clean.sub("", b), least):
                        longer = len(a) > len(b)
                        stays[k if longer else i] = False
                        k = i if longer else k
                        continue
                k = i
        return table.filter(pa.array(stays, pa.bool_()))

    return folded(cues, fold, cues.schema, _seq())


def orphans_placed(cues: DataFrame) -> DataFrame:
    """cues of which those not `matched` get times: between matched neighbours in equal shares of the gap (500 ms at least), after the last one two seconds; leading ones keep theirs."""
    w = _by_seq()
    # what follows is looked for from the other end: a frame up to the last row is gone through again for every row
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("media_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    end, start = F.when(F.col("matched"), F.col("end_ms")), F.when(F.col("matched"), F.col("start_ms"))
    x = cues.withColumn("prev_end", F.last(end, ignorenulls=True).over(before)).withColumn("next_start", F.last(start, ignorenulls=True).over(after))
    x = x.withColumn("run", F.sum(F.col("matched").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("media_id", "run")
    x = x.withColumn("i", F.sum((~F.col("matched")).cast("int")).over(run.orderBy("seq"))).withColumn("n", F.sum((~F.col("matched")).cast("int")).over(run))
    gap = F.col("next_start") - F.col("prev_end")
    s = F.col("prev_end") + F.floor(gap * (F.col("i") - 1) / F.col("n")).cast("long")
    e = F.col("prev_end") + F.floor(gap * F.col("i") / F.col("n")).cast("long")
    e = F.when(e <= s, s + 500).otherwise(e)
    between, trailing = ~F.col("matched") & F.col("prev_end").isNotNull() & F.col("next_start").isNotNull(), ~F.col("matched") & F.col("prev_end").isNotNull() & F.col("next_start").isNull()
    x = x.withColumns({"start_ms": F.when(between, s).when(trailing, F.col("prev_end")).otherwise(F.col("start_ms")), "end_ms": F.when(between, e).when(trailing, F.col("prev_end") + 2000).otherwise(F.col("end_ms"))})
    return x.drop("prev_end", "next_start", "run", "i", "n")


# splitting


def _inside_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and all(c.isascii() and c.isalpha() for c in text[at - 1 : at + 1])


def _cuts(text: str, ends: bool) -> list[int]:
    """Places after commas and before connectors; with ends, one after a closing comma too."""
    at = {m.end() for m in re.finditer("，", text)} | {m.start() for c in CONNECTORS for m in re.finditer(c, text)}
    return sorted(p for p in at if p > 0 and (ends or p < len(text)))


def _greedy(text: str, cuts: list[int], least: int) -> list[str]:
    parts, start, end = [], 0, bisect_right(cuts, len(text) - least)
    while len(text) - start > LIMIT:
        inner = bisect_right(cuts, start + LIMIT, 0, end) - 1
        later = bisect_right(cuts, start + least, 0, end)
        if inner >= bisect_left(cuts, start + least, 0, end):
            at = cuts[inner]
        elif later < end:
            at = cuts[later]
        else:
            break
        parts.append(text[start:at].strip())
        start = at
    parts.append(text[start:].strip())
    return [p for p in parts if p]


def _halved(part: str) -> list[str]:
    if len(part) <= LIMIT * 1.5:
        return [part]
    mid, best = len(part) // 2, None
    for p in [m.end() for m in re.finditer("，", part)] + [m.start() for c in CONNECTORS for m in re.finditer(c, part)]:
        if best is None or abs(p - mid) < abs(best - mid):
            best = p
    if best and 3 <= best <= len(part) - 3:
        return [part[:best].strip(), part[best:].strip()]
    return [part]


def _tidy(parts: list[str]) -> list[str]:
    return [p for p in (x.rstrip("，,") for x in parts) if p]


def split_long(text: str) -> list[str]:
    """A text over 20 characters cut after commas and before connectors, parts still over 30 once more near their middle."""
    if len(text) <= LIMIT:
        return [text]
    cuts = [p for p in _cuts(text, False) if not _inside_word(text, p)]
    parts = _greedy(text, cuts, 3) if cuts else [text]
    if len(parts) < 2:
        return [text]
    done = _tidy([q for p in parts for q in _halved(p)])
    return done if len(done) > 1 else [text]


def _middle(text: str, words: Callable[[str], Iterable[str]] | None) -> int:
    mid = len(text) // 2
    at = list(np.cumsum([len(w) for w in words(text)])) if words else []
    at = [int(p) for p in at if 2 < p < len(text) - 2]
    best = min(at, key=lambda p: abs(p - mid)) if at else mid
    letter = lambda c: c.isascii() and c.isalpha()
    if _inside_word(text, best):
        while best > 0 and letter(text[best - 1]):
            best -= 1
        if best == 0:
            best = mid
            while best < len(text) and letter(text[best]):
                best += 1
    return best


def split_forced(text: str, words: Callable[[str], Iterable[str]] | None = None) -> list[str]:
    """As split_long with shorter ends allowed; a text over 30 characters without any place to cut is cut near its middle, at a word of `words`."""
    if len(text) <= LIMIT:
        return [text]
    cuts = _cuts(text, True)
    if not cuts:
        if len(text) <= LIMIT * 1.5:
            return [text]
        cuts = [_middle(text, words)]
    cuts = [p for p in cuts if not _inside_word(text, p)]
    parts = _tidy(_greedy(text, cuts, 2)) if cuts else [text]
    return parts if len(parts) > 1 else [text]


_PARTS = T.ArrayType(T.StructType([T.StructField("part", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("before", "after", "total")]]))


def split_cues(cues: DataFrame, forced: bool = False, words: Callable[[str], Iterable[str]] | None = None) -> DataFrame:
    """cues with the long ones split; times are allotted by length, or in equal shares when forced. Tombstones pass unsplit. seq becomes dense."""

    @F.pandas_udf(_PARTS)
    def parts(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            p = [] if t is None else split_forced(t, words) if forced else split_long(t)
            ends = np.cumsum([0, *(1 if forced else len(x) for x in p)]).tolist()
            out.append([{"part": x, "before": a, "after": b, "total": ends[-1]} for x, a, b in zip(p, ends, ends[1:])])
        return pd.Series(out, dtype=object)

    live = ~F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in cues.columns else F.lit(True)
    whole = F.array(F.struct(F.col("text").alias("part"), F.lit(0).alias("before"), F.lit(1).alias("after"), F.lit(1).alias("total")))
    x = cues.withColumn("parts", F.when(live & (F.length("text") > LIMIT), parts(F.when(live & (F.length("text") > LIMIT), F.col("text")))).otherwise(whole))
    # a part brings its own share along: no row holds the other parts
    x = x.withColumn("many", F.size("parts") > 1).select("*", F.posexplode("parts").alias("part_no", "part"))
    length = F.col("end_ms") - F.col("start_ms")
    share = lambda k: F.col("start_ms") + F.floor(length * F.col(f"part.{k}") / F.col("part.total")).cast("long")
    x = x.withColumns({"new_start": F.when(F.col("many"), share("before")).otherwise(F.col("start_ms")), "new_end": F.when(F.col("many"), share("after")).otherwise(F.col("end_ms"))})
    seq = (F.row_number().over(Window.partitionBy("media_id").orderBy("old", "part_no")) - 1).cast("long")
    x = x.withColumn("old", F.col("seq")).withColumns({"start_ms": F.col("new_start"), "end_ms": F.col("new_end"), "text": F.col("part.part"), "seq": seq})
    return x.select(*cues.columns)


# chunks


def fixed_chunks(cues: DataFrame, size: int = 300) -> DataFrame:
    return cues.withColumn("chunk", F.floor(F.col("seq") / size).cast("int"))


def greedy_chunks(cues: DataFrame, max_tokens: int = 8000, max_entries: int = 200, tokens: str = "tokens") -> DataFrame:
    """cues with `chunk`: a new one starts when the next cue would pass either bound; a cue over the bound by itself is a chunk alone.

    The fold needs ids and token counts only: texts don't go through Python.
    """

    def fold(table: pa.Table) -> pa.Table:
        size, out = table["tokens"].to_pylist(), []
        for lo, hi in media_in(table):
            chunk, used, n = 0, 0, 0
            for t in size[lo:hi]:
                if n and (used + (t or 0) > max_tokens or n + 1 > max_entries):
                    chunk, used, n = chunk + 1, 0, 0
                used, n = used + (t or 0), n + 1
                out.append(chunk)
        return table.select(["media_id", "seq"]).append_column("chunk", pa.chunked_array([pa.array(out, pa.int32())]))

    slim = cues.select("media_id", "seq", F.col(tokens).cast("long").alias("tokens"))
    placed = folded(slim, fold, slim.drop("tokens").withColumn("chunk", F.lit(0)).schema, _seq())
    return cues.join(placed, ["media_id", "seq"])


def chunk_rows(cues: DataFrame, block: str = "text", tokens: str = "tokens") -> DataFrame:
    """(media_id, chunk, blocks, entries, seg_tokens) of chunked cues."""
    x = cues.groupBy("media_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce(F.col(block), F.lit("")).alias("b")))).alias("l"), F.sum(tokens).alias("seg_tokens"))
    return x.select("media_id", "chunk", F.transform("l", lambda z: z["b"]).alias("blocks"), F.size("l").alias("entries"), "seg_tokens")


def chunk_context(chunks: DataFrame, n: int = 5) -> DataFrame:
    """chunks with `ctx`: the text lines (no index and time lines) of the last n blocks of the previous chunk; empty for the first."""
    before = F.lag("blocks").over(Window.partitionBy("media_id").orderBy("chunk"))
    tail = F.slice(before, -F.least(F.lit(n), F.size(before)), F.lit(n))
    lines = F.flatten(F.transform(tail, lambda b: F.filter(F.split(b, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\d+:\d+:\d+") & ~x.rlike(r"^\s*\d+\s*$"))))
    return chunks.withColumn("ctx", F.when(F.size(before) > 0, F.array_join(lines, "\n")).otherwise(F.lit("")))


# time codes from a reference

_CLEAN = re.compile(r"[，。、？！,.\s]")


def _anchor(cor: list[str], ref: list[str], c0: int, r0: int, ratio: Callable[[int, int], float]) -> tuple[int, int] | None:
    nc, nr, best = min(80, len(cor) - c0), min(80, len(ref) - r0), None
    for far in range(1, max(nc, nr)):
        better = False
        for dc in range(min(far + 1, nc)):
            dr = far - dc
            if dr >= nr or not cor[c0 + dc] or not ref[r0 + dr]:
                continue
            r = ratio(c0 + dc, r0 + dr)
            if r and (best is None or r > best[0]):
                best, better = (r, c0 + dc, r0 + dr), True
        if better and best[0] >= 0.85:
            break
    return best and best[1:]


def _best_span(pairs: Iterator[tuple[int, str, str]]) -> tuple[float, int]:
    best = (0.0, 0)
    for span, a, b in pairs:
        r = ratio_from(a, b, max(0.6, best[0]))  # a span under 0.6 is never taken
        if r > best[0]:
            best = (r, span)
    return best


def restored_times(cor: list[str], ref: list[tuple[int, int, str]]) -> list[tuple[int, int] | None]:
    """Times of each corrected text from the reference cues: one to one, one to several, several to one, and on from the next anchor where neither fits."""
    cor, texts = [_CLEAN.sub("", t or "") for t in cor], [_CLEAN.sub("", t or "") for _, _, t in ref]
    out: list[tuple[int, int] | None] = [None] * len(cor)
    # of pairs that the windows of several searches share; kept by place, so that no text is held
    near = functools.lru_cache(maxsize=1 << 14)(lambda i, j: ratio_from(cor[i], texts[j], 0.75))
    c = r = 0
    while c < len(cor) and r < len(ref):
        if not cor[c]:
            c += 1
        elif alike(cor[c], texts[r], 0.6):
            out[c] = ref[r][:2]
            c, r = c + 1, r + 1
        else:
            joined = _best_span((n, cor[c], "".join(texts[r : r + n])) for n in range(2, 8) if r + n <= len(ref))
            parted = _best_span((n, "".join(cor[c : c + n]), texts[r]) for n in range(2, 6) if c + n <= len(cor))
            if joined[0] >= 0.6 and joined[0] >= parted[0]:
                out[c] = (ref[r][0], ref[r + joined[1] - 1][1])
                c, r = c + 1, r + joined[1]
            elif parted[0] >= 0.6:
                start, end, _ = ref[r]
                sizes = [max(1, len(x)) for x in cor[c : c + parted[1]]]
                ends = np.cumsum([0, *sizes])
                for k in range(parted[1]):
                    out[c + k] = tuple(start + (end - start) * int(ends[k + m]) // int(ends[-1]) for m in (0, 1))
                c, r = c + parted[1], r + 1
            else:
                at = _anchor(cor, texts, c, r, near)
                if at is None:
                    break
                c, r = at
    return out


def restore_timecodes(corrected: DataFrame, reference: DataFrame) -> DataFrame:
    """corrected cues with the times of the reference cues whose texts they carry, and `matched`; the rest get times between their neighbours."""
    names = ["media_id", "seq", *[c for c in corrected.columns if c not in ("media_id", "seq", "matched")]]
    times = [F.col(c).cast("long").alias(c) for c in ("start_ms", "end_ms")]

    def fold(table: pa.Table) -> pa.Table:
        is_ref, text, start, end = (table[c].to_pylist() for c in ("is_reference", "text", "start_ms", "end_ms"))
        matched = [False] * table.num_rows
        for lo, hi in media_in(table):
            mid = bisect_left(is_ref, True, lo, hi)
            for i, t in enumerate(restored_times(text[lo:mid], list(zip(start[mid:hi], end[mid:hi], text[mid:hi]))), lo):
                if t:
                    matched[i], start[i], end[i] = t[0] is not None, *(own if found is None else found for own, found in zip((start[i], end[i]), t))
        out = replaced(table, start_ms=start, end_ms=end).append_column("matched", pa.chunked_array([pa.array(matched, pa.bool_())]))
        return out.filter(pa.array([not r for r in is_ref], pa.bool_())).drop_columns(["is_reference"])

    # both sides in one table, once: the corrected cues go through with all they have, and nothing is joined back
    cor = corrected.select(*names).withColumns({"start_ms": times[0], "end_ms": times[1]})
    ref = reference.select("media_id", "seq", *times, "text").withColumn("is_reference", F.lit(True))
    both = cor.withColumn("is_reference", F.lit(False)).unionByName(ref, allowMissingColumns=True)
    schema = both.drop("is_reference").withColumn("matched", F.lit(False)).schema
    return orphans_placed(folded(both, fold, schema, "is_reference", _seq()))


def terms_kept_whole(cues: DataFrame, terms: list[str]) -> DataFrame:
    """Terms cut between two cues are put together in the first one, which borrows time for them; emptied cues vanish. Longer terms first, then by name.

    A recurrence (a cue that took a piece is looked at again): each medium in one task. `terms` is a glossary, small by nature.
    """
    ordered = sorted({t for t in terms if len(t) >= 2}, key=lambda t: (-len(t), t))

    def cut(a: str, b: str) -> str | None:
        for t in ordered:
            for k in range(1, len(t)):
                if a.endswith(t[:k]) and b.startswith(t[k:]):
                    return t[k:]
        return None

    def fold(table: pa.Table) -> pa.Table:
        start, end, text = (table[c].to_pylist() for c in ("start_ms", "end_ms", "text"))
        stays = [True] * table.num_rows
        for lo, hi in media_in(table):
            i, j = lo, lo + 1
            while j < hi:
                moved = cut(text[i] or "", text[j] or "")
                if moved is None:
                    i, j = j, j + 1
                    continue
                text[i] += moved
                text[j] = text[j][len(moved) :].lstrip("，,、 ")
                if text[j]:
                    end[i] = None if None in (end[i], start[j], end[j]) else end[i] + (end[j] - start[j]) * len(moved) // (len(moved) + len(text[j]))
                    start[j] = end[i]
                else:
                    end[i], stays[j] = end[j], False
                    j += 1
        stays = [s and bool((t or "").strip()) for s, t in zip(stays, text)]
        return replaced(table, start_ms=start, end_ms=end, text=text).filter(pa.array(stays, pa.bool_()))

    return folded(cues, fold, cues.schema, _seq())


def distinct_frames(frames: DataFrame, threshold: int = 8) -> DataFrame:
    """frames (media_id, seq, hash LONG) less those within `threshold` bits of an earlier kept one of their medium."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        kept, at = np.zeros(0, np.uint64), []
        for i, h in enumerate(pdf["hash"].to_numpy().astype(np.int64).view(np.uint64)):
            if not len(kept) or np.bitwise_count(kept ^ h).min() >= threshold:
                kept = np.append(kept, h)
                at.append(i)
        return pdf.iloc[at]

    return frames.groupBy("media_id").applyInPandas(fold, frames.schema)
