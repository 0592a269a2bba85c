"""Key joins between versions of a medium: pairing, overlays, audits, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc


def stamp() -> Column:
    return F.concat(tc.format_ms("start_ms"), F.lit(" --> "), tc.format_ms("end_ms"))


def paired_by_start(before: DataFrame, after: DataFrame) -> DataFrame:
    """(media_id, start_ms, before, after) of cues that start at the same time; of several the last counts."""
    last = lambda x, name: x.groupBy("media_id", "start_ms").agg(F.max_by("text", "seq").alias(name))
    return last(before, "before").join(last(after, "after"), ["media_id", "start_ms"])


def review(base: DataFrame, corrected: DataFrame) -> DataFrame:
    """(media_id, stamp, before, after, unchanged) of cues with exactly the same time line."""
    last = lambda x, name: x.groupBy("media_id", "start_ms", "end_ms").agg(F.max_by("text", "seq").alias(name))
    x = last(base, "before").join(last(corrected, "after"), ["media_id", "start_ms", "end_ms"])
    return x.select("media_id", stamp().alias("stamp"), "before", "after", (F.col("before") == F.col("after")).alias("unchanged"))


def change_examples(reviewed: DataFrame, n: int = 10) -> DataFrame:
    """The first n changed cues of each medium."""
    at = F.row_number().over(Window.partitionBy("media_id").orderBy("stamp"))
    return reviewed.where("not unchanged").withColumn("n", at).where(F.col("n") <= n).drop("n")


def fixed(cues: DataFrame, fixes: DataFrame) -> DataFrame:
    """cues with the text of fixes (media_id, stamp, text, file_no) of the same time line; the last file wins, a leading index line is ignored."""
    plain = F.regexp_replace("text", r"^\d+\n", "")
    last = fixes.groupBy("media_id", "stamp").agg(F.max_by(plain, "file_no").alias("new"))
    x = cues.withColumn("stamp", stamp()).join(last, ["media_id", "stamp"], "left")
    return x.withColumn("text", F.coalesce("new", "text")).select(*cues.columns)


def kept_missing(reported: DataFrame, cues: DataFrame) -> DataFrame:
    """reported items (media_id, text) that no cue of the medium holds: a report that says kept, and a file that doesn't."""
    held = cues.select(F.col("media_id").alias("held_media"), F.col("text").alias("held"))
    return reported.join(held, (F.col("media_id") == F.col("held_media")) & F.col("held").contains(F.col("text")), "left_anti")


def segment_ratio(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(media_id, seg, input, output, ratio) of each segment that has an output; 1 without input."""
    n = lambda x, name: x.groupBy("media_id", "seg").agg(F.count(F.lit(1)).alias(name))
    x = n(outputs, "output").join(n(inputs, "input"), ["media_id", "seg"], "left").fillna(0, ["input"])
    return x.withColumn("ratio", F.when(F.col("input") > 0, F.round(F.col("output") / F.col("input"), 6)).otherwise(1.0))


def pending(segments: DataFrame, finished: DataFrame) -> DataFrame:
    """Segments whose output (media_id, seg, content) isn't there yet, or has no time line: what a resumed run still does."""
    done = finished.where(F.col("content").rlike(tc.RANGE.replace("^", "(?m)^"))).select("media_id", "seg").distinct()
    return segments.join(done, ["media_id", "seg"], "left_anti")


def distinct_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, first_at) of each distinct non-blank line of each text, in order of its first occurrence."""
    x = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, "at", F.trim("line").alias("line")).where("line != ''")
    return x.groupBy(key, "line").agg(F.min("at").alias("first_at"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def key_intersection(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def union_segments(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
