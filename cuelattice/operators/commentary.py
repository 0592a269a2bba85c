"""The cleaner of reviewers' remarks and tool residue in corrected subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_commentary, strip_tag_residue


def clean(blocks: DataFrame) -> DataFrame:
    """Blocks (media_id, block_seq, raw, header, text_lines) with `action` and cleaned text_lines, and their new index.

    Remarks go, and tags in the other lines. A cue that keeps other lines than before is "A", one that keeps none "B" (dropped). A cue without
    a remark between two cues with one, whose 「 and 」 don't balance, is "C" (dropped). Blocks that aren't cues pass as they are.
    """
    w = Window.partitionBy("media_id").orderBy("block_seq")
    cue = F.col("header").isNotNull()
    x = blocks.withColumn("polluted", cue & F.exists("text_lines", is_commentary))
    joined = F.array_join("text_lines", "\n")
    count = lambda ch: F.length(joined) - F.length(F.replace(joined, F.lit(ch), F.lit("")))
    between = F.coalesce(F.lag("polluted").over(w), F.lit(False)) & F.coalesce(F.lead("polluted").over(w), F.lit(False))
    x = x.withColumn("c", cue & ~F.col("polluted") & between & (count("「") != count("」")))
    kept = F.filter(F.transform(F.filter("text_lines", lambda z: ~is_commentary(z)), lambda z: strip_tag_residue(z)), lambda z: z != "")
    x = x.withColumn("kept", F.when(cue, kept).otherwise(F.col("text_lines")))
    action = F.when(~cue, "pass").when(F.col("c"), "C").when(F.size("kept") == 0, "B").when(F.col("kept") != F.col("text_lines"), "A").otherwise("same")
    x = x.withColumn("action", action)
    live = cue & ~F.col("action").isin("B", "C")
    number = F.when(live, F.sum(live.cast("int")).over(w))
    return x.select("media_id", "block_seq", "raw", "header", F.col("kept").alias("text_lines"), "action", number.alias("idx"))


def rendered(cleaned: DataFrame) -> DataFrame:
    """(media_id, content) of the surviving blocks, renumbered."""
    live = cleaned.where("action not in ('B', 'C')")
    block = F.when(F.col("header").isNull(), F.col("raw")).otherwise(F.concat(F.col("idx").cast("string"), F.lit("\n"), F.col("header")[1], F.lit("\n"), F.array_join("text_lines", "\n")))
    x = live.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("block_seq", block.alias("b")))).alias("l"))
    return x.select("media_id", F.concat(F.array_join(F.transform("l", lambda z: z["b"]), "\n\n"), F.lit("\n")).alias("content"))


def counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("media_id").agg(*[F.count_if(F.col("action") == a).alias(f"type_{a.lower()}") for a in "ABC"])
