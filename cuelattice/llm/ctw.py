"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions (which half of the remaining values holds it, from the highest bit on), and each of the 255 decisions has
its own context tree over the `DEPTH` bytes before. A node holds how often the decision went either way after its context in the
whole corpus; its estimate is Krichevsky-Trofimov's, and its weighted probability is the even mixture of that and the
product of its children's. A coding step mixes the estimates of all depths by the weights that follow from these
probabilities.

Everything depends on the counts of byte runs of length DEPTH+1 alone: they are counted over all documents, brought together by their two
bytes nearest to the decision (below depth 2 a tree then lies in one task; the two levels above are at most 257 * 255 rows), and
each run gets its code length. A text's code length is the sum over its runs. The bytes before a text count as zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import text_key, written

DEPTH = 4
UNIT = 1e-6  # code lengths of runs are whole numbers of so many bits, so that sums don't depend on their order
HELD_RUNS = 4_000_000  # most runs whose code lengths are sent to every worker; beyond, texts' runs are joined by a shuffle
MERGE = 3_000_000
U64 = np.uint64
_LN2 = np.log(2.0)


def runs(buf: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """Of each byte: it and the depth bytes before it in its text (zeros before the start), the byte itself lowest."""
    key = np.zeros(len(buf), U64)
    inside = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off)) if len(buf) else np.zeros(0, np.int64)
    early = np.flatnonzero(inside < depth)
    for i in range(depth + 1):
        part = np.zeros(len(buf), U64)
        part[i:] = buf[: len(buf) - i]
        if i:
            part[early[inside[early] < i]] = 0
        key |= part << U64(8 * i)
    return key


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _counted(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, c = _merged(keys, counts)
            near = (k >> U64(8)) & U64(0xFFFF)
            return pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(k.view(np.int64)), pa.array(c)], names=["near", "run", "n"])

        for b in batches:
            for _, _, buf, off in K.pieces(b.column(0)):
                k, c = np.unique(runs(buf, off, depth), return_counts=True)
                keys.append(k)
                counts.append(c.astype(np.int64))
                held += len(k)
                if held > MERGE:
                    k, c = _merged(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > MERGE // 2:  # many different runs: pass on what there is
                        yield out()
                        keys, counts, held = [], [], 0
        if held:
            yield out()

    return run


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5."""
    x = np.asarray(x, float).copy()
    shift = np.zeros(len(x))
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] += np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log probability of a zeros and b ones in any one order."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi)


def log_weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - _LN2


class Levels:
    """The nodes of depths 2..depth of the runs that share their two nearest context bytes with no other task's."""

    def __init__(self, run: np.ndarray, n: np.ndarray, depth: int):
        self.depth = depth
        x = (run & U64(0xFF)).astype(np.int64)
        self.nodes: dict[int, tuple] = {}
        below = None
        # each run takes part in eight decisions
        bits = np.arange(8)
        self.node = ((1 << bits)[None] | (x[:, None] >> (8 - bits)[None])).astype(np.int64)
        self.bit = ((x[:, None] >> (7 - bits)[None]) & 1).astype(bool)
        weight = np.repeat(n, 8).astype(float)
        for d in range(depth, 1, -1):
            context = ((run >> U64(8)) & U64((1 << (8 * d)) - 1))[:, None]
            key = ((context << U64(8)) | self.node.astype(U64)).ravel()
            if below is None:
                u, inverse = np.unique(key, return_inverse=True)
                total = np.bincount(inverse, weight, len(u))
                ones = np.bincount(inverse, weight * self.bit.ravel(), len(u))
                children = None
            else:
                # the farthest byte of the context falls away
                key_above = (below[0] >> U64(8) & U64((1 << (8 * d)) - 1)) << U64(8) | (below[0] & U64(0xFF))
                u, up = np.unique(key_above, return_inverse=True)
                total, ones, children = (np.bincount(up, v, len(u)) for v in below[1:4])
                inverse = up[below[4]]
            own = log_kt(total - ones, ones)
            weighted = own if children is None else log_weighted(own, children)
            stop = np.ones(len(u)) if children is None else np.exp(own - _LN2 - weighted)
            below = (u, total, ones, weighted, inverse)
            self.nodes[d] = (u, total, ones, weighted, stop, inverse)

    def summary(self) -> tuple[np.ndarray, ...]:
        u, total, ones, weighted, _, _ = self.nodes[2]
        return u, total, ones, weighted

    def lengths(self, top: np.ndarray) -> np.ndarray:
        """Bits of each run. top: [257, 256, 3] of total, ones and stopping weight of depth 1 (by its byte) and, last, of depth 0."""
        q = None
        for d in range(self.depth, 1, -1):
            _, total, ones, _, stop, inverse = self.nodes[d]
            one = ((ones + 0.5) / (total + 1.0))[inverse]
            s = stop[inverse]
            q = one if q is None else s * one + (1 - s) * q
        near = (self.nodes[2][0] >> U64(8) & U64(0xFF)).astype(np.int64)[self.nodes[2][5]]
        for row in (near, np.full(len(near), 256)):
            t = top[row, self.node.ravel()]
            q = t[:, 2] * (t[:, 1] + 0.5) / (t[:, 0] + 1.0) + (1 - t[:, 2]) * q
        p = np.where(self.bit.ravel(), q, 1 - q)
        return -np.log2(p).reshape(-1, 8).sum(1)


def _top(spark, summaries: DataFrame) -> np.ndarray:
    """Depths 1 and 0: at most 256 * 255 rows reach the driver, whatever the data."""
    rows = summaries.groupBy("near", "node").agg(F.sum("total").alias("total"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).orderBy("near", "node").toArrow()
    near, node = rows.column("near").to_numpy(), rows.column("node").to_numpy()
    total, ones, children = (rows.column(c).to_numpy() for c in ("total", "ones", "weighted"))
    top = np.zeros((257, 256, 3))
    top[:, :, 2] = 1
    if len(near):
        own = log_kt(total - ones, ones)
        weighted = log_weighted(own, children)
        top[near, node] = np.stack([total, ones, np.exp(own - _LN2 - weighted)], 1)
        t, o, c = (np.bincount(node, v, 256) for v in (total, ones, weighted))
        root = log_kt(t - o, o)
        top[256] = np.stack([t, o, np.exp(root - _LN2 - log_weighted(root, c))], 1)
    return top


def _tables(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(list(batches), pa.schema([("near", pa.int32()), ("run", pa.int64()), ("n", pa.int64())]))
    return t.column("run").to_numpy().view(U64), t.column("n").to_numpy()


def run_lengths(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(run, n, length): each run of depth+1 bytes in docs, how often it occurs, and its code length in units of UNIT bits."""
    if not 2 <= depth <= 5:
        raise ValueError("depth must be 2 to 5")
    spark = docs.sparkSession
    counted = docs.where("text is not null").select("text").mapInArrow(_counted(depth), "near int, run long, n long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = written(counted.groupBy("near", "run").agg(F.sum("n").alias("n")), "ctw-runs")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, n = _tables(batches)
        if len(run):
            u, total, ones, weighted = Levels(run, n, depth).summary()
            near = (u >> U64(8) & U64(0xFF)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array((u & U64(0xFF)).astype(np.int32)), pa.array(total), pa.array(ones), pa.array(weighted)], names=["near", "node", "total", "ones", "weighted"])

    def measured(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run, n = _tables(batches)
            if len(run):
                bits = Levels(run, n, depth).lengths(held.value)
                yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(n), pa.array(np.rint(bits / UNIT).astype(np.int64))], names=["run", "n", "length"])

        return run

    by_near = counted.repartition(parts, "near")  # all runs of a pair of nearest bytes in one task
    top = _top(spark, by_near.mapInArrow(summarise, "near int, node int, total double, ones double, weighted double"))
    held = spark.sparkContext.broadcast(top)  # 1.5 MB, whatever the data
    return written(by_near.mapInArrow(measured(held), "run long, n long, length long"), "ctw-lengths")


class Lookup:
    """Values by 64-bit key in an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = U64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values, self.used = np.zeros(size, U64), np.zeros(size, np.int64), np.zeros(size, bool)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = ~self.used[slot]
            s, one = np.unique(slot[free], return_index=True)
            put = left[free][one]
            self.keys[s], self.values[s], self.used[s] = keys[put], values[put], True
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[one]] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys that are all in the table."""
        slot = self._slot(keys)
        out = self.values[slot]
        wrong = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.mask
            out[wrong] = self.values[slot]
            more = self.keys[slot] != keys[wrong]
            wrong, slot = wrong[more], slot[more]
        return out


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[off[1:]] - run[off[:-1]]


_CACHE: dict = {}
_OUT = "doc_id long, n_bytes long, length long"


def _scored(held, name: str, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _CACHE.get("name") != name:  # one table in each worker process
            _CACHE.update(name=name, table=Lookup(*held.value))
        table = _CACHE["table"]
        for b in batches:
            none = b.column(1).is_null().to_numpy(zero_copy_only=False)
            size, length = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for lo, hi, buf, off in K.pieces(b.column(1)):
                size[lo:hi] = np.diff(off)
                length[lo:hi] = _sums(table.of(runs(buf, off, depth)), off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, mask=none), pa.array(length, mask=none)], names=["doc_id", "n_bytes", "length"])

    return run


def _text_runs(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in K.pieces(b.column(0)):
                for i in range(hi - lo):
                    k, c = np.unique(runs(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), depth), return_counts=True)
                    h = b.column(1).slice(lo + i, 1).take(pa.array(np.zeros(len(k), np.int64)))
                    yield pa.RecordBatch.from_arrays([h, pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "run", "c"])

    return run


def scored(docs: DataFrame, depth: int = DEPTH, held_runs: int = HELD_RUNS) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row of docs, by the model of all of docs.

    bits is the code length of the UTF-8 bytes. An empty text has 0 bits and a null bits_per_byte; all are null for a null
    text. Null and repeated doc_ids are scored like others; repeated rows count in the model each time. Extra columns don't pass. No
    rows for an empty table. Beyond held_runs different runs the result is the same, joined by a shuffle.
    """
    lengths = run_lengths(docs, depth)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    if lengths.count() <= held_runs:
        t = lengths.select("run", "length").toArrow()
        held = docs.sparkSession.sparkContext.broadcast((t.column(0).to_numpy().view(U64).copy(), t.column(1).to_numpy().copy()))
        x = docs.select(ids, "text").mapInArrow(_scored(held, lengths.inputFiles()[0] if t.num_rows else "", depth), _OUT)
    else:
        texts = docs.where("text is not null").select("text", text_key().alias("h")).dropDuplicates(["h"])
        sums = texts.mapInArrow(_text_runs(depth), "h long, run long, c long").join(lengths, "run").groupBy("h").agg(F.sum(F.col("c") * F.col("length")).alias("length"))
        x = docs.select(ids, F.octet_length("text").cast("long").alias("n_bytes"), text_key().alias("h")).join(sums, "h", "left")
        x = x.select("doc_id", "n_bytes", F.when(F.col("n_bytes").isNotNull(), F.coalesce("length", F.lit(0))).alias("length"))
    bits = F.col("length") * F.lit(UNIT)
    return x.select("doc_id", "n_bytes", bits.alias("bits"), F.expr(f"if(n_bytes > 0, length * {UNIT!r}D / n_bytes, null)").alias("bits_per_byte"))
