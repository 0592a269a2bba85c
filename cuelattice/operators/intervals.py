"""Joins and windows over time ranges of cues. `media_id` partitions everything; `seq` orders cues."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc
from .shared import folded, media_in

BUCKET_MS = 60_000


def overlap_join(a: DataFrame, b: DataFrame, least_ms: int = 0, bucket_ms: int = BUCKET_MS, how: str = "inner") -> DataFrame:
    """All pairs of ranges of a and b (with distinct column names but media_id; start_a, end_a, start_b, end_b) that share more than least_ms.

    Both sides are cut into time buckets and joined by (media_id, bucket), so that a long medium is no single task; a pair is kept in the
    bucket of its common start alone, which makes it unique without a distinct.
    """
    spread = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket_ms), F.floor(F.greatest(F.col(e), F.col(s)) / bucket_ms)))
    x = a.withColumn("bucket", spread("start_a", "end_a"))
    y = b.withColumn("bucket", spread("start_b", "end_b"))
    shared = F.least("end_a", "end_b") - F.greatest("start_a", "start_b")
    return x.join(y, ["media_id", "bucket"]).where((shared > least_ms) & (F.col("bucket") == F.floor(F.greatest("start_a", "start_b") / bucket_ms))).drop("bucket").withColumn("shared_ms", shared)


def align_edges(machine: DataFrame, human: DataFrame, least_ms: int = 150) -> DataFrame:
    """(media_id, s_seq, a_seq, shared_ms) of the cues of two versions that overlap by more than least_ms."""
    a = machine.select("media_id", F.col("seq").alias("s_seq"), F.col("start_ms").alias("start_a"), F.col("end_ms").alias("end_a"))
    b = human.select("media_id", F.col("seq").alias("a_seq"), F.col("start_ms").alias("start_b"), F.col("end_ms").alias("end_b"))
    return overlap_join(a, b, least_ms).select("media_id", "s_seq", "a_seq", "shared_ms")


def chunk_bounds(cues: DataFrame, chunk: str = "chunk") -> DataFrame:
    """(media_id, chunk, start_ms, end_ms): the first cue's start and the last cue's end, in order of seq."""
    return cues.groupBy("media_id", chunk).agg(F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"))


def segment_overlay(bounds: DataFrame, segments: DataFrame) -> DataFrame:
    """(media_id, chunk, vv_ref): the texts of the segments that overlap each chunk, in their order, by lines; blanks and [Silence] left out."""
    live = segments.where("trim(coalesce(text, '')) not in ('', '[Silence]')")
    a = bounds.select("media_id", "chunk", F.col("start_ms").alias("start_a"), F.col("end_ms").alias("end_a"))
    b = live.select("media_id", F.col("seq").alias("b_seq"), F.trim("text").alias("b_text"), F.col("start_ms").alias("start_b"), F.col("end_ms").alias("end_b"))
    x = overlap_join(a, b).groupBy("media_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("b_seq", "b_text"))).alias("l"))
    found = x.select("media_id", "chunk", F.array_join(F.transform("l", lambda z: z["b_text"]), "\n").alias("vv_ref"))
    return bounds.select("media_id", "chunk").join(found, ["media_id", "chunk"], "left")


def caption_overlay(bounds: DataFrame, captions: DataFrame, around_s: float = 30.0, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(media_id, chunk, caption_ref): captions (time_s, caption, terms) from around_s before to around_s after each chunk, ends included, as "[MM:SS] caption" lines."""
    lo, hi = F.col("start_ms") - int(around_s * 1000), F.col("end_ms") + int(around_s * 1000)
    a = bounds.select("media_id", "chunk", lo.alias("lo"), hi.alias("hi")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket_ms), F.floor(F.col("hi") / bucket_ms))))
    b = captions.select("media_id", "time_s", "caption", "terms").withColumn("bucket", F.floor(F.col("time_s") * 1000 / bucket_ms))
    line = F.concat(tc.format_short("time_s"), F.lit(" "), F.col("caption"), F.when(F.size(F.coalesce("terms", F.array())) > 0, F.concat(F.lit("\n  "), F.array_join("terms", ", "))).otherwise(""))
    x = a.join(b, ["media_id", "bucket"]).where("time_s * 1000 between lo and hi").groupBy("media_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("time_s", line.alias("line")))).alias("l"))
    found = x.select("media_id", "chunk", F.array_join(F.transform("l", lambda z: z["line"]), "\n").alias("caption_ref"))
    return bounds.select("media_id", "chunk").join(found, ["media_id", "chunk"], "left")


def coverage(spans: DataFrame, cues: DataFrame, least: float = 0.5) -> DataFrame:
    """spans (media_id, span, start_ms, end_ms) with covered_ms, coverage and `gap`: cues that overlap each other count twice, an empty span is covered."""
    a = spans.select("media_id", "span", F.col("start_ms").alias("start_a"), F.col("end_ms").alias("end_a"))
    b = cues.select("media_id", F.col("start_ms").alias("start_b"), F.col("end_ms").alias("end_b"))
    sums = overlap_join(a, b).groupBy("media_id", "span").agg(F.sum("shared_ms").alias("covered_ms"))
    x = spans.join(sums, ["media_id", "span"], "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0)))
    share = F.when(F.col("end_ms") > F.col("start_ms"), F.col("covered_ms") / (F.col("end_ms") - F.col("start_ms"))).otherwise(F.lit(1.0))
    return x.withColumn("coverage", share).withColumn("gap", F.col("coverage") < least)


def uncovered(spans: DataFrame, cues: DataFrame) -> DataFrame:
    """(media_id, span, start_ms, end_ms) of the parts of each span that no cue covers."""
    a = spans.select("media_id", "span", F.col("start_ms").alias("start_a"), F.col("end_ms").alias("end_a"))
    b = cues.select("media_id", F.col("start_ms").alias("start_b"), F.col("end_ms").alias("end_b"))
    cover = overlap_join(a, b).select("media_id", "span", F.greatest("start_a", "start_b").alias("s"), F.least("end_a", "end_b").alias("e"))
    # the span's own ends close the first and the last gap
    ends = spans.select("media_id", "span", F.explode(F.array(F.struct(F.col("start_ms").alias("s"), F.col("start_ms").alias("e")), F.struct(F.col("end_ms").alias("s"), F.col("end_ms").alias("e")))).alias("z")).select("media_id", "span", "z.*")
    order = Window.partitionBy("media_id", "span").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    x = cover.unionByName(ends).withColumn("reached", F.max("e").over(order))
    return x.where("s > reached").select("media_id", "span", F.col("reached").alias("start_ms"), F.col("s").alias("end_ms"))


def islands(ranges: DataFrame, gap_ms: int, inclusive: bool = True, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """(keys, island, start_ms, end_ms, n): ranges that are at most gap_ms (or less than it, if not inclusive) after what came before make one."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reached = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start_ms") - reached
    new = F.coalesce(apart > gap_ms if inclusive else apart >= gap_ms, F.lit(True))
    x = ranges.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))


def long_enough(ranges: DataFrame, least_ms: int) -> DataFrame:
    return ranges.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def _by_seq() -> Window:
    return Window.partitionBy("media_id").orderBy("seq")


def gaps(cues: DataFrame, threshold_s: float = 10.0) -> DataFrame:
    """(media_id, seq, start_ms, end_ms) of the silences of more than threshold_s between a cue and the next."""
    x = cues.select("media_id", "seq", F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(_by_seq()).alias("end_ms"))
    return x.where(F.col("end_ms") - F.col("start_ms") > int(threshold_s * 1000))


def clamped(cues: DataFrame) -> DataFrame:
    """No cue ends after the next one starts; ends that were right stay, and negative lengths may result."""
    return cues.withColumn("end_ms", F.least("end_ms", F.coalesce(F.lead("start_ms").over(_by_seq()), F.col("end_ms"))))


def ends_repaired(cues: DataFrame) -> DataFrame:
    """Cues that end at or before their start get one second, but not beyond the next cue's start."""
    following = F.coalesce(F.lead("start_ms").over(_by_seq()), F.col("start_ms") + 1000)
    return cues.withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.least(F.col("start_ms") + 1000, following)).otherwise(F.col("end_ms")))


def shorts_dropped(cues: DataFrame, least_ms: int = 300) -> DataFrame:
    """Cues shorter than least_ms are dropped before the ends are clamped, and again after."""
    enough = F.col("end_ms") - F.col("start_ms") >= least_ms
    return clamped(cues.where(enough)).where(enough)


def cut_points(media: DataFrame, silences: DataFrame, max_part_s: float) -> DataFrame:
    """(media_id, cut_no, cut_s): near each multiple of max_part_s the closest silence end not yet used and after the last cut; ties go to the earlier.

    media: (media_id, total_s). Candidates are joined first; only the rule that none is used twice is sequential, within one medium.
    """
    ideals = media.where(F.col("total_s") > max_part_s).select("media_id", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total_s") / max_part_s).cast("int") - 1)).alias("cut_no")).withColumn("ideal", F.col("cut_no") * F.lit(float(max_part_s)))

    def pick(table: pa.Table) -> pa.Table:
        cut_no, ideal, silence = (table[c].to_pylist() for c in ("cut_no", "ideal", "silence_end"))
        rows, nos, cuts = [], [], []
        for lo, hi in media_in(table):
            mid = next((i for i in range(lo, hi) if cut_no[i] is None), hi)
            free = sorted({s for s in silence[mid:hi] if s is not None and s == s})
            for i in range(lo, mid):
                if not free:
                    break
                far = lambda k: abs(free[k] - ideal[i])  # noqa: B023, E731
                best = bisect_left(free, ideal[i])
                if best and (best == len(free) or far(best - 1) <= far(best)):
                    best -= 1
                    while best and far(best - 1) == far(best):
                        best -= 1
                rows.append(i)
                nos.append(cut_no[i])
                cuts.append(float(free.pop(best)))
        return pa.table({"media_id": table["media_id"].take(pa.array(rows, pa.int64())), "cut_no": pa.array(nos, pa.int32()), "cut_s": pa.array(cuts, pa.float64())})

    both = ideals.unionByName(silences.select("media_id", F.col("silence_end").cast("double").alias("silence_end")), allowMissingColumns=True)
    return folded(both, pick, both.select("media_id", F.lit(0).alias("cut_no"), F.lit(0.0).alias("cut_s")).schema, F.col("cut_no").asc_nulls_last())


def part_ranges(media: DataFrame, cuts: DataFrame) -> DataFrame:
    """(media_id, part, start_s, end_s, dur_s): the parts between a medium's start, its cuts and its end."""
    points = cuts.select("media_id", F.col("cut_s").alias("at")).unionByName(media.select("media_id", F.lit(0.0).alias("at"))).unionByName(media.select("media_id", F.col("total_s").alias("at"))).distinct()
    order = Window.partitionBy("media_id").orderBy("at")
    x = points.select("media_id", (F.row_number().over(order) - 1).alias("part"), F.col("at").alias("start_s"), F.lead("at").over(order).alias("end_s")).where("end_s is not null")
    return x.withColumn("dur_s", F.col("end_s") - F.col("start_s"))


def merged_parts(parts: DataFrame, segments: DataFrame) -> DataFrame:
    """segments (media_id, part, seq, start_s, end_s, text) moved by their part's start, numbered through."""
    x = segments.join(parts.select("media_id", "part", F.col("start_s").alias("offset")), ["media_id", "part"])
    order = Window.partitionBy("media_id").orderBy("part", "seq")
    return x.select("media_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), (F.col("start_s") + F.col("offset")).alias("start_s"), (F.col("end_s") + F.col("offset")).alias("end_s"), "text")


def coverage_backfill(merged: DataFrame, base: DataFrame, gap_ms: int = 15_000) -> DataFrame:
    """base cues that merged has no cue of the same start for, and that start in a gap of more than gap_ms (ends included) of merged."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "seq")
    holes = merged.select(F.col("media_id").alias("hole_media"), F.col("end_ms").alias("hole_from"), F.lead("start_ms").over(order).alias("hole_to")).where(F.col("hole_to") - F.col("hole_from") > gap_ms)
    missing = base.join(merged.select("media_id", "start_ms").distinct(), ["media_id", "start_ms"], "left_anti")
    inside = (F.col("media_id") == F.col("hole_media")) & F.col("start_ms").between(F.col("hole_from"), F.col("hole_to"))
    first = Window.partitionBy("media_id", "start_ms").orderBy("seq")
    return missing.join(holes, inside, "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").select(*base.columns)


def unique_hits(terms: DataFrame, cues: DataFrame, around_ms: int = 2000) -> DataFrame:
    """terms (media_id, term, at_ms) with hits, and the seq of the one cue near at_ms that holds the term; null with none or several."""
    t = terms.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at_ms") - around_ms) / BUCKET_MS), F.floor((F.col("at_ms") + around_ms) / BUCKET_MS))))
    c = cues.select("media_id", "seq", "start_ms", "text").withColumn("bucket", F.floor(F.col("start_ms") / BUCKET_MS))
    hit = t.join(c, ["media_id", "bucket"]).where((F.abs(F.col("start_ms") - F.col("at_ms")) <= around_ms) & F.col("text").contains(F.col("term")))
    n = hit.groupBy("media_id", "term", "at_ms").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("only"))
    x = terms.join(n, ["media_id", "term", "at_ms"], "left")
    return x.select(*terms.columns, F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("only")).alias("seq"))


def spliced(cues: DataFrame, replacement: DataFrame, anomalies: DataFrame, removal_ms: int = 500, admission_ms: int = 1000) -> DataFrame:
    """cues with those inside an anomaly (media_id, start_ms, end_ms) replaced by the replacement cues that lie in it, in order.

    A cue goes if it lies within the anomaly widened by removal_ms; a replacement comes in if within it widened by admission_ms.
    """

    def inside(ms: int) -> Column:
        return (F.col("media_id") == F.col("y_media")) & (F.col("start_ms") >= F.col("y_start") - ms) & (F.col("end_ms") <= F.col("y_end") + ms)

    bad = anomalies.select(F.col("media_id").alias("y_media"), F.col("start_ms").alias("y_start"), F.col("end_ms").alias("y_end"))
    kept = cues.join(bad, inside(removal_ms), "left_anti").withColumn("origin", F.lit(0))
    new = replacement.join(bad, inside(admission_ms), "left_semi").withColumn("origin", F.lit(1))
    x = kept.select("media_id", "start_ms", "end_ms", "text", "origin", F.col("seq").alias("old")).unionByName(new.select("media_id", "start_ms", "end_ms", "text", "origin", F.col("seq").alias("old")))
    order = Window.partitionBy("media_id").orderBy("start_ms", "origin", "old")
    return x.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).drop("old")


def admitted(cues: DataFrame, windows: DataFrame, share: float = 0.3) -> DataFrame:
    """cues of which at least `share` of their length lies in a window (media_id, start_ms, end_ms)."""
    a = cues.withColumnsRenamed({"start_ms": "start_a", "end_ms": "end_a"})
    b = windows.select("media_id", F.col("start_ms").alias("start_b"), F.col("end_ms").alias("end_b"))
    x = overlap_join(a, b).where(F.col("shared_ms") >= share * (F.col("end_a") - F.col("start_a")))
    return x.drop("start_b", "end_b", "shared_ms").distinct().withColumnsRenamed({"start_a": "start_ms", "end_a": "end_ms"}).select(*cues.columns)


def after_lead(cues: DataFrame, starts: DataFrame, lead_ms: int = 1500) -> DataFrame:
    """cues (with seg) that start no more than lead_ms before their segment (media_id, seg, seg_start)."""
    return cues.join(starts, ["media_id", "seg"]).where(F.col("start_ms") >= F.col("seg_start") - lead_ms).drop("seg_start")


def anomalies(cues: DataFrame, gap_s: float = 10.0, merge_ms: int = 5000) -> DataFrame:
    """(media_id, type, start_ms, end_ms, n) of repetitions and gaps, those less than merge_ms apart merged (type "merged" if of both kinds)."""
    from ..functions.text import repetition

    repeated = cues.where(repetition("text").isNotNull()).select("media_id", "start_ms", "end_ms", F.lit("repetition").alias("type"))
    silent = gaps(cues, gap_s).select("media_id", "start_ms", "end_ms", F.lit("gap").alias("type"))
    both = repeated.unionByName(silent)
    order = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    reached = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = both.withColumn("new", F.coalesce(F.col("start_ms") - reached >= merge_ms, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.when(F.count_distinct("type") > 1, "merged").otherwise(F.min("type"))
    return x.groupBy("media_id", "island").agg(kind.alias("type"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("island")
