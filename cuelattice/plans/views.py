"""Cue views over the driver's tables: conversations as media, their turns as cues with times from the lengths of what was said before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUES_SQL = """cues AS (
  SELECT conv_id AS media_id, turn AS seq,
    CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 60 + 12000 * ((turn - turn % 3) / 3) AS BIGINT) AS start_ms,
    CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 60 + 12000 * ((turn - turn % 3) / 3) + length(text) * 50 + CASE WHEN turn % 3 = 1 THEN 4000 ELSE 0 END AS BIGINT) AS end_ms,
    role, text
  FROM conversations
)"""
TWIN_SQL = "twin AS (SELECT media_id, seq, start_ms + 40 AS start_ms, end_ms + 40 AS end_ms, role, replace(text, 'tion', 'sion') AS text FROM cues WHERE seq % 7 <> 6)"
CLAMPED_SQL = """clamped AS (
  SELECT media_id, seq, start_ms, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq), end_ms)) AS end_ms, role, text FROM cues
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (said * 60 + 12000 * F.expr("turn div 3")).cast("long")
    x = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), start.alias("start_ms"), "role", "text")
    end = (F.col("start_ms") + F.length("text") * 50 + F.when(F.col("seq") % 3 == 1, 4000).otherwise(0)).cast("long")
    return x.select("media_id", "seq", "start_ms", end.alias("end_ms"), "role", "text")


def twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected version: 40 ms later, another spelling, some cues missing."""
    x = cues(spark, sf_dir).where("seq % 7 != 6")
    return x.select("media_id", "seq", (F.col("start_ms") + 40).alias("start_ms"), (F.col("end_ms") + 40).alias("end_ms"), "role", F.replace("text", F.lit("tion"), F.lit("sion")).alias("text"))


def chunked(x: DataFrame) -> DataFrame:
    return x.withColumn("chunk", F.expr("cast(seq div 3 as int)"))
