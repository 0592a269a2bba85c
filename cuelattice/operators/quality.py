"""Measures and alerts: lengths, error rates, scores, mining, costs, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import difftools as D
from ..functions import text as tx
from . import align

BUCKETS = ((0, 15), (16, 25), (26, 35), (36, 45), (46, 55), (56, None))


def bucket(length: str | Column) -> Column:
    n = F.col(length) if isinstance(length, str) else length
    out = F.lit("56+")
    for lo, hi in reversed(BUCKETS[:-1]):
        out = F.when(n <= hi, f"{lo}-{hi}").otherwise(out)
    return out


def length_histogram(rows: DataFrame, length: str = "char_len") -> DataFrame:
    """(bucket, n) of all six length buckets."""
    every = rows.sparkSession.createDataFrame([(f"{a}-{b}" if b else f"{a}+",) for a, b in BUCKETS], "bucket string")
    n = rows.groupBy(bucket(length).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def index_percentiles(rows: DataFrame, *keys: str, value: str = "char_len") -> DataFrame:
    """(keys, n, mean, max, p50, p90): percentiles are elements of the sorted values, at n // 2 and int(0.9 n), never between two.

    Counts of distinct values are cumulated, so that a group's values needn't fit in one row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    x = counts.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    return x.groupBy(*keys).agg(F.max("n").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"), F.max("v").alias("max"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.9)).alias("p90"))


def delete_tiers(edits: DataFrame, length: str = "n_chars") -> DataFrame:
    """(tier, n) of deletions of up to 3, 4 to 8, and more characters."""
    n = F.col(length)
    return edits.groupBy(F.when(n <= 3, "<=3").when(n <= 8, "4-8").otherwise(">8").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def top_rows(rows: DataFrame, order: list[Column], n: int, *keys: str) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    return rows.withColumn("top", F.row_number().over(w)).where(F.col("top") <= n).drop("top")


def change_counts(edits: DataFrame) -> DataFrame:
    """(align_type, category, n) of edits other than white space; the rollup adds totals (null keys)."""
    x = edits.withColumn("category", align.categorize_change()).where("category != 'WHITESPACE'")
    return x.rollup("align_type", "category").agg(F.count(F.lit(1)).alias("n"))


def mined_pairs(edits: DataFrame, category: str = "HOMOPHONE_NEW_CANDIDATE") -> DataFrame:
    """(old, new, n) of the edits of one category, the commonest first."""
    x = edits.withColumn("category", align.categorize_change()).where(F.col("category") == category)
    return x.groupBy(F.trim("old").alias("old"), F.trim("new").alias("new")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "old", "new")


def missed_grouped(findings: DataFrame, show: int = 5) -> DataFrame:
    """(wrong, correct, n, examples) of scan findings with the first `show` snippets."""
    n = findings.groupBy("wrong", "correct").agg(F.count(F.lit(1)).alias("n"))
    return n.join(_examples(findings, ["wrong", "correct"], ["media_id", "seq", "at", "snippet"], show), ["wrong", "correct"])


def _examples(rows: DataFrame, keys: list[str], order: list[str], show: int) -> DataFrame:
    """(keys, examples): of each key the last of the order columns, of its first `show` rows. Others are left out before they are gathered."""
    first = top_rows(rows, [F.col(c) for c in order], show, *keys)
    x = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("l"))
    return x.select(*keys, F.transform("l", lambda z: z[order[-1]]).alias("examples"))


def transcript(cues: DataFrame) -> DataFrame:
    x = cues.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("l"))
    return x.select("media_id", F.array_join(F.transform("l", lambda z: z["text"]), " ").alias("full"))


def character_error_rate(machine: DataFrame, human: DataFrame) -> DataFrame:
    """(media_id, cer) of whole transcripts."""
    m, h = transcript(machine).withColumnRenamed("full", "m"), transcript(human).withColumnRenamed("full", "h")
    return m.join(h, "media_id", "full").select("media_id", D.error_rate("m", "h").alias("cer"))


def error_rows(texts: DataFrame) -> DataFrame:
    """(media_id, group_id, error_type, severity, op, old, new, start_ms) of each edit that is an error."""
    x = align.group_edits(texts).withColumn("z", align.classify_error()).where("z is not null")
    return x.select("media_id", "group_id", "z.error_type", "z.severity", "op", "old", "new", "start_ms")


def severity_counts(errors: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return errors.groupBy("media_id").agg(F.count(F.lit(1)).alias("total_changes"), n(F.col("severity") == 3).alias("severe"), n(F.col("severity") == 2).alias("medium"), n(F.col("severity") == 1).alias("light"), n(F.col("error_type") == "TERM_ERROR").alias("term_errors"))


def quality_report(machine: DataFrame, human: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each medium: counts, cer, same_ratio, quality_score, severe_per_minute and alerts. Without machine cues the score is null."""
    sums = severity_counts(error_rows(texts))
    same = texts.groupBy("media_id").agg((F.count_if((F.col("ns") > 0) & (F.col("na") > 0) & (F.col("s_text") == F.col("a_text"))) / F.count(F.lit(1))).alias("same_ratio"))
    m = machine.groupBy("media_id").agg(F.count(F.lit(1)).alias("machine_count"))
    h = human.groupBy("media_id").agg(F.count(F.lit(1)).alias("human_count"), ((F.max_by("end_ms", "seq") - F.min_by("start_ms", "seq")) / 60000.0).alias("minutes"))
    x = m.join(h, "media_id", "full").join(sums, "media_id", "left").join(same, "media_id", "left").join(character_error_rate(machine, human), "media_id", "left")
    x = x.fillna(0, ["machine_count", "human_count", "total_changes", "severe", "medium", "light", "term_errors"]).fillna(0.0, ["same_ratio", "minutes"])
    return with_alerts(scored(x))


def scored(x: DataFrame) -> DataFrame:
    """x (machine_count, severe, medium, light, minutes) with quality_score and severe_per_minute."""
    penalty = F.col("severe") * 3.0 + F.col("medium") * 1.0 + F.col("light") * 0.3
    score = F.when(F.col("machine_count") > 0, F.greatest(F.lit(0.0), 100 - penalty / F.col("machine_count") * 100))
    return x.withColumn("quality_score", score).withColumn("severe_per_minute", F.when(F.col("minutes") > 0, F.col("severe") / F.col("minutes")).otherwise(0.0))


def with_alerts(x: DataFrame) -> DataFrame:
    """x with `alerts`, an array of (level, measure): red or yellow for each measure over its bound, or one green."""

    def level(measure: str, red: Column, yellow: Column) -> Column:
        one = lambda name: F.struct(F.lit(name).alias("level"), F.lit(measure).alias("measure"))
        return F.when(red, one("RED")).when(yellow, one("YELLOW"))

    cer, n = F.col("cer"), F.col("machine_count")
    found = F.array_compact(F.array(
        level("cer", cer > 0.10, cer > 0.05),
        level("severe", F.col("severe") > n * 0.02, F.col("severe") > n * 0.01),
        level("score", F.col("quality_score") < 90, F.col("quality_score") < 95),
        level("terms", F.col("term_errors") > 5, F.col("term_errors") > 2),
        level("density", F.col("severe_per_minute") > 1.0, F.col("severe_per_minute") > 0.5),
    ))
    green = F.array(F.struct(F.lit("GREEN").alias("level"), F.lit("all").alias("measure")))
    return x.withColumn("alerts", F.when(F.size(found) > 0, found).otherwise(green))


def learned_terms(before: DataFrame, after: DataFrame, min_count: int = 2) -> DataFrame:
    """(wrong, correct, count, examples, suggestion) of replacements between two versions that recur, the commonest first."""
    from .overlay import paired_by_start
    from ..functions import timecode as tc

    pairs = paired_by_start(before, after).where("before != after")
    x = pairs.select("media_id", "start_ms", "before", "after", F.posexplode(D.raw_replacements("before", "after")).alias("i", "r"))
    x = x.where(~tx.is_noise("r.raw_wrong", "r.raw_correct") & ~tx.is_noise("r.wrong", "r.correct"))
    line = F.concat(tc.format_ms("start_ms"), F.lit(": "), F.col("before"), F.lit(" => "), F.col("after"))
    x = x.select("media_id", "start_ms", "i", line.alias("line"), F.col("r.wrong").alias("wrong"), F.col("r.correct").alias("correct"))
    n = x.groupBy("wrong", "correct").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    x = n.join(_examples(x, ["wrong", "correct"], ["media_id", "start_ms", "i", "line"], 3), ["wrong", "correct"])
    x = x.select("wrong", "correct", "count", "examples", tx.suggest_destination("wrong").alias("suggestion"))
    return x.orderBy(F.desc("count"), "wrong", "correct")


def enriched(candidates: DataFrame, glossary: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates with already_in_terms (the right word is a term, or the pair an arrow) and already_in_preprocess (a rule has the pair)."""
    words = glossary.where("term is not null").select(F.col("term").alias("correct")).distinct().withColumn("is_term", F.lit(True))
    arrows = glossary.where("wrong is not null").select("wrong", "correct").distinct().withColumn("is_arrow", F.lit(True))
    ruled = rules.select("wrong", "correct").distinct().withColumn("is_rule", F.lit(True))
    x = candidates.join(words, "correct", "left").join(arrows, ["wrong", "correct"], "left").join(ruled, ["wrong", "correct"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return x.withColumns({"already_in_terms": flag(F.col("is_term")) | flag(F.col("is_arrow")), "already_in_preprocess": flag(F.col("is_rule"))}).select(*candidates.columns, "already_in_terms", "already_in_preprocess")


def pass_stats(cues: DataFrame, limit: int = 20) -> DataFrame:
    """(media_id, total, alive, deleted, over_limit) after cleaning."""
    live = ~F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in cues.columns else F.lit(True)
    return cues.groupBy("media_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(live).alias("alive"), F.count_if(~live).alias("deleted"), F.count_if(live & (F.length("text") > limit)).alias("over_limit"))


def distinct_terms(captions: DataFrame) -> DataFrame:
    """(media_id, terms): the sorted union of all captions' terms."""
    return captions.groupBy("media_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("terms", F.array().cast("array<string>")))))).alias("terms"))


def run_costs(runs: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, calls, tokens, wall_s, failures, speed): sums over runs (media_id, eval_count, wall_s, error), and media seconds for each second."""
    x = runs.groupBy("media_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("eval_count").alias("tokens"), F.sum("wall_s").alias("wall_s"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    return x.join(media.select("media_id", "total_s"), "media_id", "left").withColumn("speed", F.when(F.col("wall_s") > 0, F.col("total_s") / F.col("wall_s"))).drop("total_s")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy("media_id", status).agg(F.count(F.lit(1)).alias("n"))


def gap_status(found: DataFrame, rest: DataFrame) -> DataFrame:
    """found gaps (media_id, start_ms, end_ms) with status patched, or unresolved where one of rest still overlaps it."""
    left = rest.select(F.col("media_id").alias("l_media"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    hit = (F.col("media_id") == F.col("l_media")) & (F.col("start_ms") < F.col("l_end")) & (F.col("l_start") < F.col("end_ms"))
    bad = found.join(left, hit, "left_semi").withColumn("status", F.lit("unresolved"))
    return bad.unionByName(found.join(left, hit, "left_anti").withColumn("status", F.lit("patched")))
