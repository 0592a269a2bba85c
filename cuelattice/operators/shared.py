"""Reliable checkpoints for iterative operators, and folds over whole media."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

_OWN: list[tempfile.TemporaryDirectory] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """df checkpointed into the folder of spark.checkpoint.dir; where that is unset, into an own temporary one in local mode, and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            _OWN.append(tempfile.TemporaryDirectory(prefix="cuelattice-"))
            named = "file://" + _OWN[-1].name
        sc.setCheckpointDir(named)
    return df.checkpoint()


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def media_in(table: pa.Table) -> Iterator[tuple[int, int]]:
    """First row and end of each medium of a table in which media are contiguous."""
    ids, lo = table["media_id"].to_pylist(), 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or not _same(ids[i], ids[lo]):
            yield lo, i
            lo = i


def whole_media(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole media from batches in which media are contiguous: the last medium of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(b.schema.get_field_index("media_id"))
        last, at = ids[-1].as_py(), b.num_rows - 1
        while at and _same(ids[at - 1].as_py(), last):
            at -= 1
        if held and (at or not _same(held[-1].column(held[-1].schema.get_field_index("media_id"))[-1].as_py(), last)):
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = []
        elif at:
            yield pa.Table.from_batches([b.slice(0, at)])
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def folded(cues: DataFrame, fold: Callable[[pa.Table], pa.Table], schema: T.StructType | str, *order: str | Column) -> DataFrame:
    """fold of tables that hold whole media, many in one, each in the given order: a medium costs its rows, no call and no frame of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_media(batches):
            yield from fold(table).to_batches()

    return cues.repartition("media_id").sortWithinPartitions("media_id", *order).mapInArrow(run, schema)


def replaced(table: pa.Table, **columns: list) -> pa.Table:
    """table with other values in some columns, of the same types."""
    for name, values in columns.items():
        at = table.schema.get_field_index(name)
        table = table.set_column(at, table.schema.field(at).with_nullable(True), pa.chunked_array([pa.array(values, table.schema.field(at).type)]))
    return table
