"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from cuelattice.operators import sequence
from cuelattice.streaming import cues as streams


def _drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_chunk_stream(spark, tmp_path):
    rows = spark.createDataFrame([("m", i, 10) for i in range(12)] + [("n", i, 30) for i in range(4)], "media_id string, seq long, tokens int")
    for k in range(3):
        rows.where(F.col("seq") % 12 >= k * 4).where(F.col("seq") < (k + 1) * 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    x = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _drained(streams.chunk_stream(x, 35, 3), "chunks", "append").groupBy("media_id", "chunk").count()
    want = sequence.greedy_chunks(rows, 35, 3).groupBy("media_id", "chunk").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 300), (1, 5000), (2, 0), (1, 300)], "user_id int, s int").select("user_id", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    x = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert _drained(streams.sessions(x), "sessions", "complete").count() == streams.sessions(rows).count() == 3
    assert _drained(streams.without_repeats(x, "user_id", "ts"), "firsts", "append").count() == 4
