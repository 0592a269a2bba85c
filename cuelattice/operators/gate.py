"""The structural gate between segments and their corrections, the merge behind it, and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import difftools as D
from ..functions import timecode as tc
from ..functions.text import dup_key
from .intervals import clamped, coverage_backfill

KEY = ["media_id", "seg"]


def _text(lines: str = "text_lines") -> Column:
    return F.array_join(lines, "\n")


def _zero(x: DataFrame) -> DataFrame:
    return x.where("end_ms <= start_ms")


def new_zero_durations(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(media_id, seg, start_ms, end_ms, n): intervals that don't last, oftener in the outputs than in the inputs (a multiset difference)."""
    n = lambda x, name: _zero(x).groupBy(*KEY, "start_ms", "end_ms").agg(F.count(F.lit(1)).alias(name))
    x = n(outputs, "o").join(n(inputs, "i"), [*KEY, "start_ms", "end_ms"], "left")
    return x.withColumn("n", F.col("o") - F.coalesce("i", F.lit(0))).where("n > 0").select(*KEY, "start_ms", "end_ms", "n")


def duplicate_keys(cues: DataFrame, min_chars: int = 10) -> DataFrame:
    """(media_id, seg, key, times, first_text): keys of at least min_chars that recur two or more places apart on the timeline."""
    order = Window.partitionBy(*KEY).orderBy("start_ms", "end_ms", "seq")
    x = cues.withColumn("at", F.row_number().over(order)).withColumn("text", _text()).withColumn("key", dup_key("text")).where(F.length("key") >= min_chars)
    x = x.groupBy(*KEY, "key").agg(F.count(F.lit(1)).alias("times"), (F.max("at") - F.min("at")).alias("span"), F.min_by("text", "at").alias("first_text"), F.min("at").alias("first_at"))
    return x.where("times >= 2 and span >= 2").drop("span")


def new_duplicates(inputs: DataFrame, outputs: DataFrame, min_chars: int = 10) -> DataFrame:
    """duplicate_keys of the outputs with `extra`, the copies beyond those of the inputs (of which one is always granted)."""
    before = inputs.withColumn("key", dup_key(_text())).groupBy(*KEY, "key").agg(F.count(F.lit(1)).alias("had"))
    x = duplicate_keys(outputs, min_chars).join(before, [*KEY, "key"], "left")
    return x.withColumn("extra", F.col("times") - F.greatest(F.lit(1), F.coalesce("had", F.lit(0)))).where("extra > 0").drop("had")


def gate(inputs: DataFrame, outputs: DataFrame, ratio_fail: float = 0.55, ratio_warn: float = 0.80, max_dur_s: float = 15.0, dup_min_chars: int = 10, dup_min_texts: int = 2) -> DataFrame:
    """The verdict on each corrected segment: (media_id, seg, ratio, max_dur_sec, input, output, reasons, status, zero_dur_examples, dup_examples).

    inputs and outputs: (media_id, seg, seq, start_ms, end_ms, text_lines). reasons come in the order ratio, zero_duration, dup_text; status is fail, warn or pass.
    dup_min_chars 0 turns the test for duplicates off. A segment without input cues has ratio 1.
    """
    n_in = inputs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("input"))
    n_out = outputs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("output"), (F.max(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))) / 1000.0).alias("max_dur"))
    stamp = F.concat(tc.format_ms("start_ms"), F.lit(" --> "), tc.format_ms("end_ms"))
    zero = new_zero_durations(inputs, outputs).withColumn("example", F.array_repeat(stamp, F.col("n").cast("int")))
    zero = zero.groupBy(*KEY).agg(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "example"))), lambda z: z["example"])), 1, 5).alias("zero_dur_examples"))
    x = n_out.join(n_in, KEY, "left").join(zero, KEY, "left")
    if dup_min_chars:
        dups = new_duplicates(inputs, outputs, dup_min_chars).groupBy(*KEY).agg(F.count(F.lit(1)).alias("dups"), F.max("extra").alias("most"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct("first_at", "first_text"))), lambda z: z["first_text"]), 1, 5).alias("dup_examples"))
        x = x.join(dups, KEY, "left")
    else:
        x = x.withColumns({"dups": F.lit(None).cast("long"), "most": F.lit(None).cast("long"), "dup_examples": F.lit(None).cast("array<string>")})
    x = x.fillna(0, ["input", "dups", "most"]).withColumn("r", F.when(F.col("input") > 0, F.col("output") / F.col("input")).otherwise(1.0))
    ratio = (F.col("r") < ratio_fail) | ((F.col("r") < ratio_warn) & (F.col("max_dur") > max_dur_s))
    dup = (F.col("dups") >= dup_min_texts) | (F.col("most") >= dup_min_texts)
    reasons = F.array_compact(F.array(F.when(ratio, "ratio"), F.when(F.col("zero_dur_examples").isNotNull(), "zero_duration"), F.when(dup, "dup_text")))
    x = x.withColumn("reasons", reasons)
    status = F.when(F.size("reasons") > 0, "fail").when((F.col("r") < ratio_warn) | (F.col("dups") == 1), "warn").otherwise("pass")
    return x.select(*KEY, F.round("r", 6).alias("ratio"), F.round("max_dur", 3).alias("max_dur_sec"), "input", "output", "reasons", status.alias("status"), "zero_dur_examples", "dup_examples")


def cross_duplicate_pairs(cues: DataFrame, min_chars: int = 10) -> DataFrame:
    """(media_id, pairs): pairs of cues of one key; neighbours of one segment don't count, backfilled ones (seg null) do.

    Pairs are counted from the number of each key and not listed: n copies cost n rows.
    """
    order = Window.partitionBy("media_id").orderBy("seq")
    x = cues.withColumn("at", F.row_number().over(order)).withColumn("key", dup_key(_text())).where(F.length("key") >= max(1, min_chars))
    w = Window.partitionBy("media_id", "key").orderBy("at")
    near = (F.col("at") - F.lag("at").over(w) == 1) & (F.col("seg") == F.lag("seg").over(w))
    x = x.withColumn("near", F.coalesce(near, F.lit(False)).cast("long")).groupBy("media_id", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("near"))
    return x.groupBy("media_id").agg(F.sum(F.expr("n * (n - 1) div 2 - near")).alias("pairs"))


def merge(inputs: DataFrame, outputs: DataFrame, base: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(verdicts, merged cues): all segments in order of time, repeated lines repaired, ends clamped, gaps filled from base.

    Media with a failing segment are left out of the merged cues: nothing is written for them.
    """
    verdicts = gate(inputs, outputs, **limits)
    failed = verdicts.where("status = 'fail'").select("media_id").distinct()
    x = outputs.join(failed, "media_id", "left_anti").withColumn("text_lines", F.when(F.size("text_lines") > 1, D.without_repeated_lines("text_lines")).otherwise(F.col("text_lines")))
    x = x.select("media_id", "seg", _place("start_ms", "seg", "seq").alias("seq"), "start_ms", "end_ms", "text_lines")
    x = clamped(x)
    patch = coverage_backfill(x, base.select("media_id", F.lit(None).cast(dict(outputs.dtypes)["seg"]).alias("seg"), "seq", "start_ms", "end_ms", "text_lines"))
    patch = patch.join(x.select("media_id").distinct(), "media_id", "left_semi")
    both = x.withColumn("origin", F.lit(0)).unionByName(patch.withColumn("origin", F.lit(1)))
    return verdicts, clamped(both.withColumn("seq", _place("start_ms", "origin", "seq")).drop("origin"))


def _place(*order: str) -> Column:
    return (F.row_number().over(Window.partitionBy("media_id").orderBy(*order)) - 1).cast("long")


def merge_metrics(cues: DataFrame, long_s: float = 12.0) -> DataFrame:
    """(media_id, entries, max_dur_sec, over_long, zero_dur) of each medium."""
    d = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    return cues.groupBy("media_id").agg(F.count(F.lit(1)).alias("entries"), F.round(F.max(d), 3).alias("max_dur_sec"), F.count_if(d > long_s).alias("over_long"), F.count_if(d <= 0).alias("zero_dur"))
