"""Cue streams: sessions, duplicates and chunks over Structured Streaming sources. An extension: batch operators have the full semantics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, start, end, n): islands of events no more than gap apart, over a stream or a table; late events up to `late` count."""
    x = events.withWatermark(at, late) if events.isStreaming else events
    x = x.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return x.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes", at: str = "ts", kind: str = "event_type") -> DataFrame:
    x = events.withWatermark(at, late) if events.isStreaming else events
    x = x.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def without_repeats(events: DataFrame, *keys: str, late: str = "30 minutes", at: str = "ts") -> DataFrame:
    """The first of the events of one key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def chunk_stream(cues: DataFrame, max_tokens: int = 8000, max_entries: int = 200) -> DataFrame:
    """(media_id, seq, chunk) of streamed cues (media_id, seq, tokens): the greedy chunker, its place kept in state. Cues of a medium must come in order."""
    kind = dict(cues.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, used, n = state.get if state.exists else (0, 0, 0)
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for t in pdf["tokens"]:
            if n and (used + t > max_tokens or n + 1 > max_entries):
                chunk, used, n = chunk + 1, 0, 0
            used, n = used + int(t), n + 1
            out.append(chunk)
        state.update((chunk, used, n))
        yield pdf[["media_id", "seq"]].assign(chunk=out)

    grouped = cues.groupBy("media_id")
    return grouped.applyInPandasWithState(step, f"media_id {kind['media_id']}, seq {kind['seq']}, chunk int", "chunk int, used long, n int", "append", GroupStateTimeout.NoTimeout)
