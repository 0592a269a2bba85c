"""Alignment groups of two versions of a medium, their classes, and the classes of the edits between them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import difftools as D
from ..functions.dictionary import DEFAULT, Dictionary
from .intervals import align_edges
from .shared import checkpointed

CATEGORIES = ("ADD", "DEL", "SAME", "TEXT_MOD", "SPLIT", "SPLIT+MOD", "MERGE", "MERGE+MOD", "COMPLEX_MOD")


def groups(machine: DataFrame, human: DataFrame, least_ms: int = 150) -> DataFrame:
    """(media_id, group_id, side 's' or 'a', seq): connected cues of the two versions; an unmatched cue is a group of its own.

    Least labels spread over the edges until none changes, halving chains in each round; group_id is the least label of the group, ordered by
    (start_ms, side, seq) of its first cue.
    """
    edges = align_edges(machine, human, least_ms)
    nodes = machine.select("media_id", F.lit("s").alias("side"), "seq", "start_ms").unionByName(human.select("media_id", F.lit("a").alias("side"), "seq", "start_ms"))
    order = Window.partitionBy("media_id").orderBy("start_ms", F.col("side").desc(), "seq")
    nodes = nodes.withColumn("id", F.row_number().over(order).cast("long"))
    nodes = checkpointed(nodes)
    s = nodes.where("side = 's'").select("media_id", F.col("seq").alias("s_seq"), F.col("id").alias("u"))
    a = nodes.where("side = 'a'").select("media_id", F.col("seq").alias("a_seq"), F.col("id").alias("v"))
    pairs = edges.join(s, ["media_id", "s_seq"]).join(a, ["media_id", "a_seq"]).select("media_id", "u", "v")
    both = pairs.unionByName(pairs.select("media_id", F.col("v").alias("u"), F.col("u").alias("v")))
    both = checkpointed(both)
    label = nodes.select("media_id", F.col("id").alias("u"), F.col("id").alias("label"))
    while True:
        seen = both.join(label.select("media_id", F.col("u").alias("v"), "label"), ["media_id", "v"]).groupBy("media_id", "u").agg(F.min("label").alias("m"))
        now = label.join(seen, ["media_id", "u"], "left").select("media_id", "u", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        # a label's own label: shortens chains
        jump = now.select("media_id", F.col("u").alias("label"), F.col("label").alias("jump"))
        now = now.join(jump, ["media_id", "label"], "left").select("media_id", "u", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        now = checkpointed(now)
        changed = now.where("label != old").limit(1).count()
        label = now.select("media_id", "u", "label")
        if not changed:
            break
    return nodes.join(label, (nodes["media_id"] == label["media_id"]) & (nodes["id"] == label["u"])).select(nodes["media_id"], F.col("label").alias("group_id"), "side", "seq")


def chained_groups(machine: DataFrame, human: DataFrame, least_ms: int = 150) -> DataFrame:
    """As `groups`, in one pass of windows: right where the cues of either version don't overlap each other (as after clamping)."""
    edges = align_edges(machine, human, least_ms)
    order = Window.partitionBy("media_id").orderBy("s_seq", "a_seq")
    new = (F.lag("s_seq").over(order) != F.col("s_seq")) & (F.lag("a_seq").over(order) != F.col("a_seq"))
    x = edges.withColumn("g", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
    matched = x.select("media_id", "g", F.lit("s").alias("side"), F.col("s_seq").alias("seq")).unionByName(x.select("media_id", "g", F.lit("a").alias("side"), F.col("a_seq").alias("seq"))).distinct()
    all_cues = machine.select("media_id", F.lit("s").alias("side"), "seq", "start_ms").unionByName(human.select("media_id", F.lit("a").alias("side"), "seq", "start_ms"))
    ordered = all_cues.withColumn("id", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", F.col("side").desc(), "seq")).cast("long"))
    y = ordered.join(matched, ["media_id", "side", "seq"], "left")
    first = F.min("id").over(Window.partitionBy("media_id", "g"))
    return y.select("media_id", F.when(F.col("g").isNull(), F.col("id")).otherwise(first).alias("group_id"), "side", "seq")


def group_texts(grouped: DataFrame, machine: DataFrame, human: DataFrame) -> DataFrame:
    """(media_id, group_id, ns, na, s_text, a_text, start_ms, category) of each group: its texts in order, joined by spaces, and its class."""
    cues = machine.select("media_id", F.lit("s").alias("side"), "seq", "start_ms", "text").unionByName(human.select("media_id", F.lit("a").alias("side"), "seq", "start_ms", "text"))
    x = grouped.join(cues, ["media_id", "side", "seq"]).groupBy("media_id", "group_id")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))))
    x = x.agg(side("s").alias("s"), side("a").alias("a"), F.min("start_ms").alias("start_ms"))
    joined = lambda c: F.array_join(F.transform(c, lambda z: z["text"]), " ")
    x = x.select("media_id", "group_id", F.size("s").alias("ns"), F.size("a").alias("na"), joined("s").alias("s_text"), joined("a").alias("a_text"), "start_ms")
    return x.withColumn("category", classify_group(F.col("ns"), F.col("na"), F.col("s_text") == F.col("a_text")))


def classify_group(ns: Column, na: Column, same: Column) -> Column:
    def either(kind: str, modified: str) -> Column:
        return F.when(same, kind).otherwise(modified)

    x = F.when(ns == 0, "ADD").when(na == 0, "DEL").when((ns == 1) & (na == 1), either("SAME", "TEXT_MOD"))
    return x.when(ns == 1, either("SPLIT", "SPLIT+MOD")).when(na == 1, either("MERGE", "MERGE+MOD")).otherwise(either("SAME", "COMPLEX_MOD"))


def category_counts(texts: DataFrame) -> DataFrame:
    """(category, n, pct) of all nine categories, and TOTAL."""
    spark = texts.sparkSession
    n = texts.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string").join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    total = every.agg(F.sum("n").alias("total"))
    rows = every.crossJoin(total).select("category", "n", F.when(F.col("total") > 0, F.round(100.0 * F.col("n") / F.col("total"), 2)).otherwise(0.0).alias("pct"))
    return rows.unionByName(total.select(F.lit("TOTAL").alias("category"), F.col("total").alias("n"), F.when(F.col("total") > 0, 100.0).otherwise(0.0).alias("pct")))


def group_edits(texts: DataFrame) -> DataFrame:
    """One row for each edit of each group with text on both sides: (media_id, group_id, align_type, op, old, new, a_text, start_ms)."""
    both = texts.where("ns > 0 and na > 0 and s_text != a_text")
    x = both.select("media_id", "group_id", F.col("category").alias("align_type"), "a_text", "start_ms", F.explode(D.edits("s_text", "a_text")).alias("e"))
    return x.select("media_id", "group_id", "align_type", F.col("e.op").alias("op"), F.col("e.old").alias("old"), F.col("e.new").alias("new"), "a_text", "start_ms")


def _table(pairs: Iterable[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sorted(pairs)]).cast("array<struct<k:string,v:string>>")


def _is_pair(old: Column, new: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    return F.exists(_table(pairs), lambda p: (p["k"] == old) & (p["v"] == new))


def _known(old: Column, new: Column, pairs: Mapping[str, str]) -> Column:
    """Whether an edit is one of pairs, or holds one with at most two characters more."""
    return F.exists(_table(pairs.items()), lambda p: ((p["k"] == old) & (p["v"] == new)) | (old.contains(p["k"]) & new.contains(p["v"]) & (F.length(old) <= F.length(p["k"]) + 2)))


def categorize_change(op: str | Column = "op", old: str | Column = "old", new: str | Column = "new", words: Dictionary = DEFAULT) -> Column:
    """What kind of change an edit is."""
    op, o, n = (F.col(x) if isinstance(x, str) else x for x in (op, old, new))
    o, n = F.trim(o), F.trim(n)
    deleted = F.when(o == "", "WHITESPACE").when(o.isin(*words.fillers), "FILLER_KNOWN").when(F.length(o) <= 3, "FILLER_CANDIDATE").otherwise("DELETE_OTHER")
    replaced = F.when(_known(o, n, words.homophones), "HOMOPHONE_KNOWN").when((F.length(o) == 1) & (F.length(n) == 1), "HOMOPHONE_NEW_CANDIDATE").when((F.length(o) >= 2) | (F.length(n) >= 2), "REPLACE_MULTI").otherwise("REPLACE_OTHER")
    return F.when(op == "delete", deleted).when(op == "insert", F.when(n == "", "WHITESPACE").otherwise("INSERT")).when(op == "replace", replaced).otherwise("UNKNOWN")


def classify_error(op: str | Column = "op", old: str | Column = "old", new: str | Column = "new", context: str | Column = "a_text", words: Dictionary = DEFAULT) -> Column:
    """Struct (error_type, severity 1 to 3) of an edit towards the human text `context`; null for one of white space alone."""
    op, o, n, ctx = (F.col(x) if isinstance(x, str) else x for x in (op, old, new, context))
    o, n = F.trim(o), F.trim(n)
    verdict = lambda name, s: F.struct(F.lit(name).alias("error_type"), F.lit(s).alias("severity"))
    holds = lambda c, some: F.exists(F.array(*[F.lit(w) for w in some]).cast("array<string>"), lambda w: c.contains(w))
    rep = op == "replace"
    x = F.when((o == "") & (n == ""), F.lit(None)).when(_known(o, n, {**words.homophones, **words.scored}), verdict("HOMOPHONE_KNOWN", 2))
    x = x.when(rep & _is_pair(o, n, words.sound_alike.items()), verdict("HOMOPHONE_NEW", 2)).when(rep & _is_pair(o, n, words.by_context), verdict("CONTEXT_JUDGMENT", 2))
    x = x.when(rep & (F.length(o) == 1) & (F.length(n) == 1), F.when(holds(ctx, words.near_terms), verdict("TERM_ERROR", 3)).otherwise(verdict("HOMOPHONE_NEW", 2)))
    x = x.when((op == "delete") & (o == ""), F.lit(None)).when((op == "delete") & o.isin(*words.fillers), verdict("FILLER_KNOWN", 1)).when((op == "delete") & (F.length(o) <= 3), verdict("FILLER_CANDIDATE", 1)).when(op == "delete", verdict("DELETE_OTHER", 2))
    x = x.when((op == "insert") & (n == ""), F.lit(None)).when(op == "insert", verdict("INSERT", 2))
    return x.when(rep & holds(n, words.terms), verdict("TERM_ERROR", 3)).when(rep & (F.length(o) >= 2) & (F.length(n) >= 2), verdict("MISHEAR", 3)).when(rep, verdict("REPLACE_OTHER", 2)).otherwise(verdict("UNKNOWN", 1))
