"""Written intermediate tables, row keys and column names shared by the training-data operators."""

from __future__ import annotations

import collections
import inspect
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset: an own temporary folder in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if master not in _OWN:
        _OWN[master] = tempfile.TemporaryDirectory(prefix="cuelattice-")
    return "file://" + _OWN[master].name


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage, and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def text_key(text: str | Column = "text") -> Column:
    """A 64-bit hash of the text; null for a null text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), F.xxhash64(c))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped's one column; of rows with one doc_id and text, only one stays.

    Nulls equal nulls among repeated rows; the row that stays is the least by a hash of all columns.
    """
    h, gone, rank = free(docs, "__h", "__gone", "__rank")
    x = docs.withColumn(h, text_key())
    x = x.join(dropped.toDF(gone), x["doc_id"] == F.col(gone), "left_anti")
    return _one_row_each(x, docs.columns, h, rank)


def _one_row_each(x: DataFrame, columns: list[str], h: str, rank: str, *parted: str) -> DataFrame:
    plain = [F.col(f"`{c}`") for c in columns if not _is_map(x, c)]
    w = Window.partitionBy(*parted, "doc_id", h).orderBy(F.xxhash64(*plain))
    return x.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in columns])


def _is_map(df: DataFrame, c: str) -> bool:
    return "map<" in dict(df.dtypes)[c] or "variant" in dict(df.dtypes)[c]


def arrow_function(fn, returns: T.DataType):
    """A column function from one Arrow function on whole arrays."""
    fn.__annotations__ = {next(iter(inspect.signature(fn).parameters)): pa.Array, "return": pa.Array}
    return F.arrow_udf(fn, returns)


_KEPT: collections.OrderedDict = collections.OrderedDict()


def kept(key: str, most: int, make: Callable):
    """make(), once in each worker process for each key: of the keys used last, `most` are kept (all parts of what a stage lays against its rows)."""
    if key in _KEPT:
        _KEPT.move_to_end(key)
    else:
        while len(_KEPT) >= max(1, most):
            _KEPT.popitem(last=False)
        _KEPT[key] = make()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_BYTES = 32 << 20


def _width(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = kind.elementType
        return F.coalesce(F.size(c), F.lit(0)) * (24 + 8 * len(each) if isinstance(each, T.StructType) else 16) + 24
    return F.lit(16)


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """With a broadcast hint if a sum over all its rows finds at most so many bytes; beyond that, Spark's own choice of join.

    Arrays count by their length, with elements of fixed width: not for arrays of strings.
    """
    size = df.agg(F.sum(sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df
