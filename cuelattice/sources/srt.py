"""Subtitle, log and segment scans: a DataFrame (media_id, content) of whole files becomes rows of cues.

All scans take text already in a column, so they work on any source; `read_texts` makes such a DataFrame of files. `seq` counts the
valid cues of a file from 0 in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timecode as tc



def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, content, modified, size) of each file: media_id is the file's name without its ending."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("media_id"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))


def read_parts(spark: SparkSession, path: str, pattern: str = r"_seg_(\d+)") -> DataFrame:
    """As read_texts with `seg`, the number in the file's name: parts sort by it and not by their names. Files without one are left out."""
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("media_id"), F.col("value").alias("content"))
    return x.withColumn("seg", F.regexp_extract("media_id", pattern, 1).try_cast("int")).where("seg is not null")


def _plain(content: str | Column) -> Column:
    """Without a byte order mark, line ends as \\n."""
    c = F.col(content) if isinstance(content, str) else content
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n")


def _blocks(texts: DataFrame, split: str) -> DataFrame:
    x = texts.select("media_id", F.posexplode(F.split(_plain("content"), split)).alias("block_seq", "raw"))
    return x.withColumn("lines", F.split(F.regexp_replace("raw", r"^\s+|\s+$", ""), "\n"))


def _numbered(x: DataFrame) -> DataFrame:
    return x.withColumn("seq", (F.row_number().over(Window.partitionBy("media_id").orderBy("block_seq")) - 1).cast("long")).drop("block_seq", "raw", "lines")


def _body(joiner: str | None) -> Column:
    kept = F.filter(F.transform(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    return kept if joiner is None else F.array_join(kept, joiner)


def _cues(blocks: DataFrame, least: int, joiner: str | None, index: str | None) -> DataFrame:
    x = blocks.where((F.size("lines") >= least) & F.col("lines")[1].rlike(tc.RANGE))
    if index:
        x = x.where(F.trim(F.col("lines")[0]).rlike(index))
    line = F.col("lines")[1]
    x = x.select("media_id", "block_seq", "raw", "lines", F.col("lines")[0].try_cast("long").alias("idx"), tc.parse_ms(line, tc.RANGE).alias("start_ms"), tc.parse_ms(line, tc.RANGE, 5).alias("end_ms"), _body(joiner).alias("text" if joiner is not None else "text_lines"))
    return _numbered(x)


def scan_srt(texts: DataFrame) -> DataFrame:
    """Lenient cues (media_id, idx, start_ms, end_ms, text, seq): an index and a time line are enough, an empty text stays, bad blocks are dropped."""
    return _cues(_blocks(texts, r"\n\s*\n"), 2, "\n", r"^\d+$")


def scan_srt_spaced(texts: DataFrame) -> DataFrame:
    """As scan_srt, the lines of a cue joined by spaces."""
    return _cues(_blocks(texts, r"\n\s*\n"), 2, " ", r"^\d+$")


def scan_srt_strict(texts: DataFrame) -> DataFrame:
    """Cues with `text_lines`: three lines at least, split at wholly empty lines only; the first line may be anything."""
    return _cues(_blocks(texts, r"\n\n+"), 3, None, None)


def scan_srt_seconds(texts: DataFrame) -> DataFrame:
    """Cues with start_s and end_s (fractions padded on the right); three lines at least, a sign before the index is allowed."""
    x = _blocks(texts, r"\n\s*\n").where((F.size("lines") >= 3) & F.col("lines")[1].rlike(tc.RANGE) & F.trim(F.col("lines")[0]).rlike(r"^[+-]?\d+$"))
    line = F.col("lines")[1]
    x = x.select("media_id", "block_seq", "raw", "lines", F.col("lines")[0].try_cast("long").alias("idx"), tc.parse_seconds(line, tc.RANGE).alias("start_s"), tc.parse_seconds(line, tc.RANGE, 5).alias("end_s"), _body("\n").alias("text"))
    return _numbered(x)


def scan_blocks(texts: DataFrame) -> DataFrame:
    """(media_id, block_seq, raw, header, text_lines): every block; header is null for one that isn't a cue."""
    x = _blocks(texts, r"\n\n+")
    cue = (F.size("lines") >= 2) & F.col("lines")[1].contains("-->")
    rest = F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))
    return x.select("media_id", "block_seq", "raw", F.when(cue, F.slice("lines", 1, 2)).alias("header"), F.when(cue, rest).otherwise(F.array().cast("array<string>")).alias("text_lines"))


def scan_entry_chunks(texts: DataFrame, size: int = 300) -> DataFrame:
    """(media_id, chunk, entries, content): `size` entries each. An entry starts at an all-digit line after an empty line or at the top."""
    lines = texts.select("media_id", F.posexplode(F.split(_plain("content"), "\n")).alias("at", "line"))
    order = Window.partitionBy("media_id").orderBy("at")
    starts = F.col("line").rlike(r"^\d+\s*$") & (F.coalesce(F.lag("line").over(order), F.lit("")) == "")
    x = lines.withColumn("entry", F.sum(starts.cast("int")).over(order)).where("entry > 0").withColumn("chunk", F.floor((F.col("entry") - 1) / size).cast("int"))
    x = x.groupBy("media_id", "chunk").agg(F.countDistinct("entry").alias("entries"), F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    return x.select("media_id", "chunk", "entries", F.array_join(F.transform("l", lambda z: z["line"]), "\n").alias("content"))


def scan_by_timecodes(texts: DataFrame) -> DataFrame:
    """Cues led by their time lines alone: the text runs to the next index, time line or empty line; entries without text are dropped."""
    lines = texts.select("media_id", F.posexplode(F.split(_plain("content"), "\n")).alias("at", "line"))
    order = Window.partitionBy("media_id").orderBy("at")
    timed = F.col("line").rlike(tc.RANGE)
    x = lines.withColumn("entry", F.sum(timed.cast("int")).over(order)).withColumn("next", F.lead("line").over(order))
    x = x.withColumn("is_time", timed).withColumn("is_index", F.col("line").rlike(r"^\s*\d+\s*$") & F.coalesce(F.col("next").rlike(tc.RANGE), F.lit(False)))
    x = x.where("entry > 0").groupBy("media_id", "entry").agg(F.max(F.when(F.col("is_time"), F.col("line"))).alias("stamp"), F.sort_array(F.collect_list(F.when(~F.col("is_time") & ~F.col("is_index") & (F.trim("line") != ""), F.struct("at", F.trim("line").alias("line"))))).alias("l"))
    x = x.where(F.size("l") > 0)
    seq = (F.row_number().over(Window.partitionBy("media_id").orderBy("entry")) - 1).cast("long")
    return x.select("media_id", tc.parse_ms("stamp", tc.RANGE).alias("start_ms"), tc.parse_ms("stamp", tc.RANGE, 5).alias("end_ms"), F.array_join(F.transform("l", lambda z: z["line"]), "\n").alias("text"), seq.alias("seq"))


_LOG = r"^\s*\[((?:\d+:)?\d{1,2}:\d{2}\.\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}\.\d{1,3})\]\s*(.*?)\s*$"


def _log_ms(stamp: Column) -> Column:
    part = lambda p: F.coalesce(F.regexp_extract(stamp, p, 1).try_cast("long"), F.lit(0))
    return ((part(r"^(\d+):\d+:\d+\.") * 60 + part(r"(\d+):\d+\.")) * 60 + part(r":(\d+)\.")) * 1000 + F.rpad(F.regexp_extract(stamp, r"\.(\d+)$", 1), 3, "0").cast("long")


def scan_log(texts: DataFrame) -> DataFrame:
    """Cues of a recogniser's log: its lines "[MM:SS.mmm --> MM:SS.mmm] text" (or with hours), cut off at a traceback; empty and music-only ones dropped."""
    cut = F.split(_plain("content"), r"Traceback \(most recent call last\)\s*:", 2)[0]
    x = texts.select("media_id", F.posexplode(F.split(cut, "\n")).alias("block_seq", "raw")).where(F.col("raw").rlike(_LOG))
    x = x.select("media_id", "block_seq", "raw", F.array().alias("lines"), _log_ms(F.regexp_extract("raw", _LOG, 1)).alias("start_ms"), _log_ms(F.regexp_extract("raw", _LOG, 2)).alias("end_ms"), F.regexp_extract("raw", _LOG, 3).alias("text"))
    return _numbered(x.where(~F.col("text").rlike(r"^[♪\s]*$")))


def scan_silence(texts: DataFrame) -> DataFrame:
    """(media_id, silence_end) of the silence ends that an audio tool's log reports."""
    ends = F.regexp_extract_all("content", F.lit(r"silence_end:\s*([\d.]+)"), F.lit(1))
    return texts.select("media_id", F.explode(ends).alias("e")).select("media_id", F.col("e").try_cast("double").alias("silence_end")).where("silence_end is not null")


SEGMENTS = "array<map<string,string>>"
_START, _END = ("Start", "start", "start_time"), ("End", "end", "end_time")
_TEXT = tuple("Content content Text text".split())


def _list(content: Column, *wrappers: str) -> Column:
    inner = [F.from_json(F.get_json_object(content, f"$.{w}"), SEGMENTS) for w in wrappers]
    return F.coalesce(F.when(F.ltrim(content).startswith("["), F.from_json(content, SEGMENTS)), *inner)


def scan_segments(texts: DataFrame, strict: bool = False) -> DataFrame:
    """(media_id, seq, start_s, end_s, text, kind) of recogniser segments: a JSON list, or an object with it under segments, results or data.

    Times and text may have any of their usual keys, in either case. An unreadable content has no rows; with strict it is an error.
    """
    content = F.col("content")
    rows = _list(content, "segments", "results", "data")
    if strict:
        rows = F.when(rows.isNull(), F.raise_error(F.concat(F.lit("no segment list in "), F.col("media_id"))).cast(SEGMENTS)).otherwise(rows)
    x = texts.select("media_id", F.posexplode(rows).alias("seq", "m"))
    pick = lambda keys: F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in keys])
    return x.select("media_id", F.col("seq").cast("long").alias("seq"), pick(_START).try_cast("double").alias("start_s"), pick(_END).try_cast("double").alias("end_s"), pick(_TEXT).alias("text"), F.try_element_at("m", F.lit("type")).alias("kind"))


CAPTIONS = T.ArrayType(T.StructType([T.StructField("time_s", T.DoubleType()), T.StructField("caption", T.StringType()), T.StructField("terms", T.ArrayType(T.StringType()))]))


def scan_captions(texts: DataFrame) -> DataFrame:
    """(media_id, seq, time_s, caption, terms) of captions: a JSON list, or an object with it under captions."""
    c = F.col("content")
    rows = F.coalesce(F.when(F.ltrim(c).startswith("["), F.from_json(c, CAPTIONS)), F.from_json(F.get_json_object(c, "$.captions"), CAPTIONS))
    return texts.select("media_id", F.posexplode(rows).alias("seq", "z")).select("media_id", F.col("seq").cast("long").alias("seq"), "z.*")


def scan_glossary(texts: DataFrame, loose: bool = False) -> DataFrame:
    """(media_id, term, wrong, correct) of glossary lines "term（note）" and "wrong→correct"; # starts a remark.

    The loose form, for the protection of terms, splits at brackets only, keeps an arrow as part of the term, and drops terms of one character.
    """
    x = texts.select("media_id", F.explode(F.split(_plain("content"), "\n")).alias("line")).select("media_id", F.trim("line").alias("line")).where("line != '' and not startswith(line, '#')")
    head = lambda c, p: F.trim(F.split(c, p, 2)[0])
    if loose:
        return x.select("media_id", head(F.col("line"), "[（(]").alias("term"), F.lit(None).cast("string").alias("wrong"), F.lit(None).cast("string").alias("correct")).where("length(term) >= 2").distinct()
    arrow = F.col("line").contains("→")
    wrong = F.when(arrow, head(F.split("line", "→", 2)[0], "[（(]"))
    correct = F.when(arrow, head(F.element_at(F.split("line", "→", 2), -1), "[（(]"))
    both = (wrong != "") & (correct != "")
    return x.select("media_id", head(F.col("line"), "[（(→]").alias("term"), F.when(both, wrong).alias("wrong"), F.when(both, correct).alias("correct")).where("term != '' or wrong is not null").distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_seq, ruleset, wrong, correct, contexts, excludes) from JSON lines: rules are data and not code."""
    return spark.read.schema("rule_seq int, ruleset string, wrong string, correct string, contexts array<string>, excludes array<string>").json(path)


def frame_times(frames: DataFrame, interval_s: float) -> DataFrame:
    """frames (media_id, frame_no from 0) with time_s: the first frame stands for the end of the first interval."""
    return frames.withColumn("time_s", (F.col("frame_no") + 1) * F.lit(float(interval_s)))


def unique_file(names: list[str], stems: list[str], suffix: str = ".json") -> str:
    """The only one of names that starts with one of stems (taken literally) and ends with suffix; an error if there is none, or more."""
    hits = sorted({n for n in names for s in stems if n.startswith(s) and n.endswith(suffix)})
    if len(hits) != 1:
        raise FileNotFoundError(f"{len(hits)} files for {stems}: {hits}")
    return hits[0]
