"""Sequence comparison by matching blocks (the standard library's difflib) as Arrow-batched functions."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("s0", "s1", "a0", "a1")] + [T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))
PAIRS = T.ArrayType(T.StructType([T.StructField("wrong", T.StringType()), T.StructField("correct", T.StringType())]))


def ratio_of(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _longest(a: str, b: str, seeds: list[int], at: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """SequenceMatcher.find_longest_match, going through the seeds alone: the places in a of characters that are looked up in b."""
    besti, bestj, size, ends, last = alo, blo, 0, {}, -1
    for i in seeds[bisect_left(seeds, alo) : bisect_left(seeds, ahi)]:
        before, ends = ends if i == last + 1 else {}, {}
        last = i
        for j in at[a[i]]:
            if j >= bhi:
                break
            if j >= blo:
                k = ends[j] = before.get(j - 1, 0) + 1
                if k > size:
                    besti, bestj, size = i - k + 1, j - k + 1, k
    while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
        besti, bestj, size = besti - 1, bestj - 1, size + 1
    while besti + size < ahi and bestj + size < bhi and a[besti + size] == b[bestj + size]:
        size += 1
    return besti, bestj, size


def _matched_share(a: str, b: str, least: float, enough: bool) -> float:
    """ratio_of two different texts by the same matching blocks, or 0 once they can't reach least; with enough, the share found when it reaches least.

    Two upper bounds, from lengths and from counts of characters, are tried first. As in SequenceMatcher, characters frequent in a b of 200 and more are not looked up.
    """
    n, left = len(a) + len(b), min(len(a), len(b))
    if 2.0 * left / n < least:
        return 0.0
    counts = Counter(b)
    if 2.0 * sum((Counter(a) & counts).values()) / n < least:
        return 0.0
    at: dict[str, list[int]] = {c: [] for c, k in counts.items() if len(b) < 200 or k <= len(b) // 100 + 1}
    for j, c in enumerate(b):
        if c in at:
            at[c].append(j)
    seeds = [i for i, c in enumerate(a) if c in at]
    found, queue = 0, [(0, len(a), 0, len(b))]
    while queue:
        if 2.0 * (found + left) / n < least:
            return 0.0
        alo, ahi, blo, bhi = queue.pop()
        left -= min(ahi - alo, bhi - blo)
        i, j, k = _longest(a, b, seeds, at, alo, ahi, blo, bhi)
        if not k:
            continue
        found += k
        if enough and 2.0 * found / n >= least:
            break
        # the larger part next: it decides sooner
        for size, part in sorted((min(y - x, w - v), (x, y, v, w)) for x, y, v, w in ((alo, i, blo, j), (i + k, ahi, j + k, bhi))):
            if size:
                queue.append(part)
                left += size
    return 2.0 * found / n


def ratio_from(a: str, b: str, least: float) -> float:
    """ratio_of, or 0 if it is under least: blocks are sought only while they can reach it."""
    r = 1.0 if a == b else _matched_share(a, b, least, False)
    return r if r >= least else 0.0


def alike(a: str, b: str, least: float) -> bool:
    """Whether ratio_of is at least so high: no more blocks are sought than it takes to know."""
    return (1.0 if a == b else _matched_share(a, b, least, True)) >= least


def edits_of(a: str, b: str) -> list[tuple]:
    """All operations but the equal ones: (op, s0, s1, a0, a1, old, new)."""
    return [(op, i, j, k, m, a[i:j], b[k:m]) for op, i, j, k, m in SequenceMatcher(None, a, b).get_opcodes() if op != "equal"]


def error_rate_of(machine: str, human: str) -> float:
    if not human:
        return 1.0 if machine else 0.0
    return sum(max(j - i, m - k) for _, i, j, k, m, _, _ in edits_of(machine, human)) / len(human)


def _basic(ch: str) -> bool:
    return "一" <= ch <= "鿿"


def grown(a: str, b: str, i: int, j: int, k: int, m: int, pronouns: frozenset) -> tuple[str, str]:
    """A replacement with the ideograph that both sides share: on the left of a single one, else on the right of a longer one."""
    wrong, correct = a[i:j].strip(), b[k:m].strip()
    if wrong in pronouns and correct in pronouns:
        return wrong, correct
    if len(wrong) == len(correct) == 1 and i and k and a[i - 1] == b[k - 1] and _basic(a[i - 1]):
        return a[i - 1] + wrong, b[k - 1] + correct
    if max(len(wrong), len(correct)) >= 2 and j < len(a) and m < len(b) and a[j] == b[m] and _basic(a[j]):
        return wrong + a[j], correct + b[m]
    return wrong, correct


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts; null if either is."""
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(OPS)
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edits from a to b; none if either is null."""
    return pd.Series([[] if x is None or y is None else edits_of(x, y) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.DoubleType())
def error_rate(machine: pd.Series, human: pd.Series) -> pd.Series:
    """Characters in edits, by the human text's length; of an empty human text 1, or 0 for an empty machine text too."""
    return pd.Series([error_rate_of(x or "", y or "") for x, y in zip(machine, human)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def without_repeated_lines(lines: pd.Series) -> pd.Series:
    """Lines of a cue of which neighbours over 0.7 alike are merged into the longer (of equal ones the later), from the last one back."""
    return pd.Series([None if x is None else merge_lines(list(x)) for x in lines], dtype=object)


def merge_lines(lines: list[str]) -> list[str]:
    for i in range(len(lines) - 1, 0, -1):
        if ratio_of(lines[i - 1], lines[i]) > 0.7:
            lines[i - 1 : i + 1] = [max(lines[i], lines[i - 1], key=len)]
    return lines


def raw_replacements(a: str | Column, b: str | Column) -> Column:
    """(wrong, correct, grown wrong, grown correct) of each replacement: see `operators.learn` for the noise tests around it."""
    return _replacements(a, b)


_REPLACED = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("raw_wrong", "raw_correct", "wrong", "correct")]))


@F.pandas_udf(_REPLACED)
def _replacements(a: pd.Series, b: pd.Series) -> pd.Series:
    from .text import PRONOUNS

    known = frozenset(PRONOUNS)
    out = []
    for x, y in zip(a, b):
        rows = []
        for op, i, j, k, m, old, new in edits_of(x or "", y or ""):
            if op == "replace":
                rows.append((old.strip(), new.strip(), *grown(x, y, i, j, k, m, known)))
        out.append(rows)
    return pd.Series(out, dtype=object)
