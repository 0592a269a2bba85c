"""Subtitle, JSON and report sinks: rows become file contents, one row for each file, and then files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc


def render_srt(cues: DataFrame, text: str = "text", newline_end: bool = False) -> DataFrame:
    """(media_id, content): live cues, numbered from 1 by (start_ms, seq) as they come; each block ends with an empty line, or the file with one newline only."""
    live = cues.where("not coalesce(deleted, false)") if "deleted" in cues.columns else cues
    body = F.array_join(text, "\n") if dict(cues.dtypes)[text].startswith("array") else F.col(text)
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("seq"))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), tc.format_ms("start_ms"), F.lit(" --> "), tc.format_ms("end_ms"), F.lit("\n"), F.col("body"))
    x = live.select("media_id", number.alias("n"), "start_ms", "end_ms", F.coalesce(body, F.lit("")).alias("body"))
    x = x.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda z: z["b"]), "\n\n")
    return x.select("media_id", F.concat(joined, F.lit("\n" if newline_end else "\n\n")).alias("content"))


def write_texts(contents: DataFrame, path: str) -> None:
    """One folder a media_id with its content as text."""
    # the writer ends each row with a newline itself
    contents.select("media_id", F.regexp_replace("content", "\n$", "").alias("content")).repartition("media_id").write.mode("overwrite").partitionBy("media_id").text(path)


def render_json(rows: DataFrame) -> DataFrame:
    """(media_id, content): the other columns of all rows of a medium as one JSON list, in order of seq if there is one."""
    other = [c for c in rows.columns if c != "media_id"]
    key = F.col("seq") if "seq" in other else F.lit(0)
    x = rows.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.to_json(F.struct(*other)).alias("j")))).alias("l"))
    return x.select("media_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda z: z["j"]), ","), F.lit("]")).alias("content"))


def write_segments(chunks: DataFrame, path: str) -> None:
    """Chunks as folders media_id/seg of JSON; absent references are named by sentinels."""
    filled = {c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(s)).otherwise(F.col(c)) for c, s in (("vv_ref", "NO_VV_REFERENCE"), ("caption_ref", "NO_CAPTIONS")) if c in chunks.columns}
    chunks.withColumns(filled).write.mode("overwrite").partitionBy("media_id", "seg").json(path)


def render_table(rows: DataFrame, title: str) -> DataFrame:
    """(content): a Markdown table of a small result, in the order of its first column."""
    head = f"## {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns)
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
    x = rows.select(F.struct(F.col(rows.columns[0]).alias("k"), line.alias("line")).alias("z")).agg(F.sort_array(F.collect_list("z")).alias("l"))
    return x.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("l", lambda z: z["line"]), "\n")).alias("content"))
