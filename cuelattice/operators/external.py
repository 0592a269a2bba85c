"""External models and tools as pluggable functions: one call a row, errors as values, and the parsing of what they return.

A call is any Python function of plain values. It is run by batches in the workers, where `setup` makes a model or a client once in each
task. Nothing here calls a model itself; tests use fakes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timecode as tc

RESULT = "text string, error string, wall_s double"


def called(rows: DataFrame, call: Callable[..., str], inputs: list[str], setup: Callable[[], Any] | None = None, retries: int = 0, single: bool = False) -> DataFrame:
    """rows with text, error and wall_s of call([model,] *inputs) of each row; an exception becomes its error, after `retries` more tries.

    single runs all calls one after the other, for a device that bears one user only.
    """
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = (setup(),) if setup else ()
        for pdf in batches:
            out = []
            for values in zip(*[pdf[c] for c in inputs]):
                began, text, error = time.time(), None, None
                for _ in range(retries + 1):
                    try:
                        text, error = call(*model, *values), None
                        break
                    except Exception as e:  # the caller sees it as a value
                        error = f"{type(e).__name__}: {e}"
                out.append((text, error, time.time() - began))
            yield pdf.assign(**{n: [o[i] for o in out] for i, n in enumerate(("text", "error", "wall_s"))})

    clash = [c for c in rows.columns if c in ("text", "error", "wall_s") and c not in inputs]
    x = rows.drop(*clash)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name not in ("text", "error", "wall_s"))
    keep = [c for c in x.columns if c not in ("text", "error", "wall_s")]
    y = (x.coalesce(1) if single else x).mapInPandas(lambda it: (p[[*keep, "text", "error", "wall_s"]] for p in run(it)), f"{schema}, {RESULT}")
    return y


def corrected_or_original(calls: DataFrame, original: str) -> DataFrame:
    """calls with `accepted` and `output`: an answer counts if it has a time line; else the original stays."""
    ok = F.coalesce(F.col("text").rlike(tc.RANGE.replace("^", "(?m)^")), F.lit(False)) & F.col("error").isNull()
    return calls.withColumns({"accepted": ok, "output": F.when(ok, F.col("text")).otherwise(F.col(original))})


CAPTION_JSON = "caption string, title string, terms array<string>, tickers array<string>"


def parse_vlm(raw: DataFrame) -> DataFrame:
    """raw (media_id, frame, frame_time, raw) as (media_id, frame, time_s, caption, terms, ok) from a fenced or bare JSON object; bad JSON has ok false."""
    fence = F.regexp_extract("raw", r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fence != "", fence).otherwise(F.regexp_extract("raw", r"(?s)\{.*\}", 0)))
    z = F.from_json(body, CAPTION_JSON)
    terms = F.array_sort(F.array_distinct(F.concat(F.coalesce(z["terms"], F.array().cast("array<string>")), F.coalesce(z["tickers"], F.array().cast("array<string>")))))
    caption = F.coalesce(z["caption"], z["title"])
    return raw.select("media_id", "frame", F.col("frame_time").alias("time_s"), caption.alias("caption"), terms.alias("terms"), caption.isNotNull().alias("ok"))


def parse_ocr(raw: DataFrame) -> DataFrame:
    """raw (media_id, frame, frame_time, raw) as (media_id, frame, time_s, caption, terms): distinct lines in order, frames without text left out; terms are the tickers."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("raw", F.lit("")), "\n"), lambda z: F.trim(z)), lambda z: z != ""))
    x = raw.select("media_id", "frame", F.col("frame_time").alias("time_s"), lines.alias("l")).where(F.size("l") > 0)
    caption = F.array_join("l", " ")
    return x.select("media_id", "frame", "time_s", caption.alias("caption"), tx.tickers(caption).alias("terms"))


def ocr_outcome(calls: DataFrame) -> DataFrame:
    """(media_id, frames, failed, outcome): all failed is an error, some a warning."""
    x = calls.groupBy("media_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return x.withColumn("outcome", F.when(F.col("failed") == F.col("frames"), "error").when(F.col("failed") > 0, "warning").otherwise("ok"))


def usable_engines(wanted: str, available: Iterable[str], order: tuple[str, ...] = ("platform", "ocr", "vlm")) -> list[str]:
    """The engines to try: a named one alone, "auto" all that are there in order; an error if none is."""
    have = set(available)
    out = [e for e in order if e in have] if wanted == "auto" else [wanted] if wanted in have else []
    if not out:
        raise ValueError(f"no engine for {wanted}")
    return out


def retry_ladder(gaps: DataFrame, buffers_s: tuple[float, ...] = (10.0, 20.0, 30.0)) -> DataFrame:
    """gaps with one row for each try: (media_id, gap, attempt, from_s, to_s), buffers growing."""
    table = F.array(*[F.struct(F.lit(i + 1).alias("attempt"), F.lit(b).alias("b")) for i, b in enumerate(buffers_s)])
    x = gaps.withColumn("z", F.explode(table))
    return x.select("media_id", "gap", "z.attempt", F.greatest(F.lit(0.0), F.col("start_s") - F.col("z.b")).alias("from_s"), (F.col("end_s") + F.col("z.b")).alias("to_s"))


def first_acceptable(tries: DataFrame) -> DataFrame:
    """The first try of each gap (media_id, gap, attempt, n_cues, anomalous) with more than one cue and no anomaly."""
    ok = tries.where("n_cues > 1 and not anomalous")
    n = F.row_number().over(Window.partitionBy("media_id", "gap").orderBy("attempt"))
    return ok.withColumn("n", n).where("n = 1").drop("n")


def punctuated(cues: DataFrame, call: Callable[[str], str], terms: dict[str, str] | None = None) -> DataFrame:
    """cues with punctuation restored by an external function, then widths and terms set right."""
    x = called(cues.withColumnRenamed("text", "raw_text"), call, ["raw_text"])
    fixed: Column = tx.half_to_full(F.coalesce("text", "raw_text"))
    return x.withColumn("text", tx.terminology(fixed, terms or {})).drop("raw_text", "wall_s")
