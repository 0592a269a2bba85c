"""The bounded sample of labelled documents that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SAMPLE_BYTES = 48 << 20  # a trainer holds some thirty times as much


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, y, text) of at most per_class documents of each label 0 and 1, the least by a hash of doc_id, of at most sample_bytes together.

    Half of the bytes are each label's; a document that goes beyond them is left out, with all that come after it. Texts are whole.

    Null doc_ids, labels and texts aren't drawn. A doc_id with both labels counts as 1; of several texts of one, the least stays.
    """
    one = labels.where(f"doc_id is not null and `{label}` in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = one.where("y = 0").orderBy(*order).limit(per_class).unionByName(one.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the drawn ids are at most 2 * per_class rows, whatever the size of the tables
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of per_class rows at most
    return found.withColumn("upto", upto).where(F.col("upto") <= sample_bytes // 2).select("doc_id", "y", "text")
