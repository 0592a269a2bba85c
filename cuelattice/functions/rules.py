"""Ordered correction rules: each rule sees what the ones before it left, and may need or exclude contexts."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    wrong: str
    correct: str
    contexts: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()


SAMPLE_RULES = (
    Rule("四指", "市值"),
    Rule("城市碼", "程式碼"),
    Rule("軍線", "均線"),
    Rule("排斥", "盤勢", contexts=("今天", "大盤")),
    Rule("機具", "級距", excludes=("農機具",)),
)


def collected(rules: DataFrame) -> list[Rule]:
    """A rule table (rule_seq, wrong, correct, contexts, excludes) in order: it is a dictionary, small by nature."""
    return [Rule(r.wrong, r.correct, tuple(r.contexts or ()), tuple(r.excludes or ())) for r in rules.orderBy("rule_seq").collect()]


def _literal(rules: list[Rule]) -> Column:
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.array(*[F.struct(F.lit(r.wrong).alias("w"), F.lit(r.correct).alias("c"), strings(r.excludes).alias("x")) for r in rules])


def fold_plain(text: str | Column, rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """All rules without contexts, in order, in one JVM-side fold: a rule is skipped for a text that holds one of its excludes anywhere."""
    t = F.col(text) if isinstance(text, str) else text
    if not rules:
        return t
    return F.aggregate(_literal(list(rules)), t, lambda acc, r: F.when(F.exists(r["x"], lambda e: acc.contains(e)), acc).otherwise(F.replace(acc, r["w"], r["c"])))


def apply_in_context(text: str, rule: Rule) -> str:
    """Each occurrence with one of the contexts within five characters is replaced; the window sees what was replaced before."""
    if rule.wrong not in text or any(x in text for x in rule.excludes):
        return text
    at = text.find(rule.wrong)
    while at >= 0:
        around = text[max(0, at - WINDOW) : at + len(rule.wrong) + WINDOW]
        if any(c in around for c in rule.contexts):
            text = text[:at] + rule.correct + text[at + len(rule.wrong) :]
            at = text.find(rule.wrong, at + len(rule.correct))
        else:
            at = text.find(rule.wrong, at + 1)
    return text


def _in_context(text: Column, rule: Rule) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else apply_in_context(t, rule))

    # only texts that hold the wrong word go through Python
    return F.when(text.contains(rule.wrong), run(F.when(text.contains(rule.wrong), text))).otherwise(text)


def fold(cues: DataFrame, rules: list[Rule] | tuple[Rule, ...], prefixes: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """cues with all rules applied in order: prefix replacements first; runs of rules without contexts are one fold, those with contexts one function each."""
    for wrong, right in (prefixes or {}).items():
        cues = cues.withColumn(text, F.replace(F.col(text), F.lit(wrong), F.lit(right)))
    plain: list[Rule] = []
    for r in rules:
        if not r.contexts:
            plain.append(r)
            continue
        cues = cues.withColumn(text, fold_plain(text, plain)).withColumn(text, _in_context(F.col(text), r))
        plain = []
    return cues.withColumn(text, fold_plain(text, plain))


def scan_missed(cues: DataFrame, rules: list[Rule] | tuple[Rule, ...], around: int = 8) -> DataFrame:
    """(media_id, seq, start_ms, wrong, correct, at, snippet) of each place, overlapping ones too, where a rule would still apply.

    Excludes are looked for within five characters of the place, and then contexts.
    """
    if not rules:
        return cues.select("media_id", "seq", "start_ms", F.lit("").alias("wrong"), F.lit("").alias("correct"), F.lit(0).alias("at"), F.lit("").alias("snippet")).limit(0)
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    table = F.array(*[F.struct(F.lit(r.wrong).alias("w"), F.lit(r.correct).alias("c"), strings(r.contexts).alias("k"), strings(r.excludes).alias("x")) for r in rules])
    x = cues.withColumn("r", F.explode(F.filter(table, lambda r: F.col("text").contains(r["w"]))))
    n = F.length("r.w")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: F.substring(F.col("text"), i, n) == F.col("r.w"))
    x = x.withColumn("at", F.explode(places))

    def cut(k: int) -> Column:
        first = F.greatest(F.lit(1), F.col("at") - k)
        return F.substring(F.col("text"), first, F.col("at") + n + k - first)

    x = x.withColumn("window", cut(WINDOW))
    ok = ~F.exists("r.x", lambda e: F.col("window").contains(e)) & ((F.size("r.k") == 0) | F.exists("r.k", lambda c: F.col("window").contains(c)))
    return x.where(ok).select("media_id", "seq", "start_ms", F.col("r.w").alias("wrong"), F.col("r.c").alias("correct"), (F.col("at") - 1).alias("at"), cut(around).alias("snippet"))
