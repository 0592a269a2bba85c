"""Whole passes over cues: cleaning before correction, preparing chunks, post-processing after it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as tx
from ..operators import intervals, sequence


def clean(cues: DataFrame, rules: tuple[R.Rule, ...] = R.SAMPLE_RULES, prefixes: Mapping[str, str] | None = None, lexicon: Mapping[str, int] | None = None) -> DataFrame:
    """Rules, filler cues, duplicate cues, inline fillers, commas inside words, and splits. Deleted cues stay as tombstones."""
    x = R.fold(cues, rules, dict(prefixes or {}))
    x = x.withColumn("deleted", tx.is_standalone_filler("text"))
    x = sequence.adjacent_duplicates(x)
    live = ~F.col("deleted")
    x = x.withColumn("text", F.when(live, tx.delete_inline_fillers("text")).otherwise(F.col("text")))
    if lexicon:
        x = x.withColumn("text", F.when(live, tx.cjk_commas_repaired("text", lexicon)).otherwise(F.col("text")))
    return sequence.split_cues(x)


def prepare(cues: DataFrame, segments: DataFrame, captions: DataFrame, max_tokens: int = 8000, max_entries: int = 200) -> DataFrame:
    """(media_id, chunk, blocks, entries, seg_tokens, ctx, vv_ref, caption_ref): chunks with their context and references."""
    x = sequence.greedy_chunks(cues.withColumn("tokens", tx.token_estimate("text")), max_tokens, max_entries)
    bounds = intervals.chunk_bounds(x)
    chunks = sequence.chunk_context(sequence.chunk_rows(x))
    return chunks.join(intervals.segment_overlay(bounds, segments), ["media_id", "chunk"], "left").join(intervals.caption_overlay(bounds, captions), ["media_id", "chunk"], "left")


def postprocess(cues: DataFrame, reference: DataFrame | None = None, terms: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Widths, times from the reference, closing punctuation, terms kept whole, near duplicates, ends, residue, splits, residue.

    With strict it is an error if a cue was residue alone; nothing is returned to be written.
    """
    x = cues.withColumn("text", tx.fullwidth_norm("text"))
    if reference is not None:
        x = sequence.restore_timecodes(x, reference).drop("matched")
    x = x.withColumn("text", tx.strip_trailing_punct("text"))
    if terms:
        x = sequence.terms_kept_whole(x, terms)
    x = sequence.near_duplicates(x.where("trim(text) != ''"))
    x = intervals.clamped(intervals.ends_repaired(x))
    residue = residue_cues(x)
    if strict and residue.limit(1).count():
        raise ValueError("cues of nothing but tool residue: " + ", ".join(str(r.seq) for r in residue.limit(5).collect()))
    x = x.withColumn("text", tx.strip_tag_lines("text"))
    return sequence.split_cues(x, forced=True).withColumn("text", tx.strip_tag_lines("text"))


def residue_cues(cues: DataFrame) -> DataFrame:
    return cues.where((F.trim("text") != "") & (F.trim(tx.strip_tag_lines("text")) == ""))
