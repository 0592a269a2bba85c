"""Validators of artifacts, and the freshness verdict over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timecode as tc

_AT = r"\d{2,}(?::[0-5]\d){2},\d{3}"
_STRICT = rf"^\s*{_AT}\s*-->\s*{_AT}"


def validate_srt(texts: DataFrame) -> DataFrame:
    """(media_id, valid, n, reason) of each text (media_id, content).

    Blocks with a time line count: its stamps need commas, minutes and seconds below 60 and an end after the start, and some text must
    follow; an index line may be missing. The first bad block fails the file, and n is the number of good ones before it. No block at all is
    invalid, too.
    """
    plain = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n?", "\n")
    x = texts.select("media_id", F.posexplode(F.split(plain, r"\n\s*\n")).alias("ord", "raw")).where(F.col("raw").contains("-->"))
    lines = F.split(F.regexp_replace("raw", r"^\s+|\s+$", ""), "\n")
    x = x.withColumn("lines", lines).withColumn("at", F.when(F.col("lines")[0].contains("-->"), 0).otherwise(1))
    line = F.get("lines", F.col("at"))
    start, end = tc.parse_ms(line, tc.RANGE), tc.parse_ms(line, tc.RANGE, 5)
    body = F.exists(F.slice("lines", F.col("at") + 2, F.greatest(F.lit(0), F.size("lines") - F.col("at") - 1)), lambda z: F.trim(z) != "")
    good = F.coalesce(line.rlike(_STRICT), F.lit(False)) & F.coalesce(end > start, F.lit(False)) & body
    x = x.withColumn("good", good)
    first = x.groupBy("media_id").agg(F.min(F.when(~F.col("good"), F.col("ord"))).alias("bad"))
    n = x.join(first, "media_id").groupBy("media_id").agg(F.max("bad").alias("bad"), F.count_if(F.col("bad").isNull() | (F.col("ord") < F.col("bad"))).alias("n"))
    y = texts.select("media_id").distinct().join(n, "media_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    valid = F.col("bad").isNull() & (F.col("n") > 0)
    return y.select("media_id", valid.alias("valid"), "n", F.when(F.col("bad").isNotNull(), "bad block").when(F.col("n") == 0, "no cue").otherwise("").alias("reason"))


def strict_cue_count(texts: DataFrame) -> DataFrame:
    """(media_id, n) of the lines that are strict time lines."""
    hits = F.filter(F.split("content", "\r?\n"), lambda z: z.rlike(r"^\d\d(?::\d\d){2},\d{3} --> \d\d(?::\d\d){2},\d{3}"))
    return texts.select("media_id", F.size(hits).alias("n"))


def validate_segments(segments: DataFrame) -> DataFrame:
    """(media_id, valid, n) of recogniser segments (see `sources.srt.scan_segments`): rows of another kind than speech are tolerated, a speech row without text or with bad times isn't."""
    speech = F.col("kind").isNull() | (F.lower("kind") == "speech")
    usable = F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & (F.col("end_s") > F.col("start_s")) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    declares = F.col("kind").isNotNull() | F.col("start_s").isNotNull() | F.col("end_s").isNotNull() | F.col("text").isNotNull()
    x = segments.groupBy("media_id").agg(F.count_if(speech & usable).alias("n"), F.count_if(speech & declares & ~usable).alias("bad"))
    return x.select("media_id", ((F.col("bad") == 0) & (F.col("n") > 0)).alias("valid"), "n")


def validate_captions(captions: DataFrame) -> DataFrame:
    """(media_id, valid, n) of captions: each needs a time that isn't negative and a text; terms are optional."""
    ok = F.coalesce(F.col("time_s") >= 0, F.lit(False)) & (F.trim(F.coalesce("caption", F.lit(""))) != "")
    x = captions.groupBy("media_id").agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("bad"))
    return x.select("media_id", ((F.col("bad") == 0) & (F.col("n") > 0)).alias("valid"), "n")


def stage_status(expected: DataFrame, found: DataFrame, markers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(media_id, type, status): missing, stale (older than the launch marker), invalid (empty, or by its validator) or ready, in this order.

    expected: (media_id, type); found: with modified and size; markers: (media_id, launched); verdicts: (media_id, type, valid).
    """
    x = expected.join(found, ["media_id", "type"], "left").join(markers, "media_id", "left").join(verdicts, ["media_id", "type"], "left")
    return x.select("media_id", "type", status_of(F.col("modified"), F.col("size"), F.col("launched"), F.col("valid")).alias("status"))


def status_of(modified: Column, size: Column, launched: Column, valid: Column) -> Column:
    return F.when(modified.isNull(), "missing").when(modified <= launched, "stale").when(F.coalesce(size, F.lit(0)) == 0, "invalid").when(F.coalesce(valid, F.lit(False)), "ready").otherwise("invalid")
