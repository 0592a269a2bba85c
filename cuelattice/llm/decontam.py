"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some word positions of a short span and ignores the rest. Test items and documents are hashed under each mask at
every position; equal hashes are hits, and around each hit the two texts are laid on one diagonal and compared word by word. An
overlap is a window of `WINDOW` words inside both texts that differs in at most `SUBSTITUTIONS` of them. The masks are chosen
so that every such window holds a fully equal placement of at least one mask: no overlap is missed (a test tries all cases).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import arrow_function, kept

WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 5, 6, 8, 10), (0, 1, 2, 3, 4, 7, 8), (0, 1, 3, 5, 6, 7, 8))
CHUNK_BYTES = 64 << 20  # of benchmark text held by a worker at once; a larger benchmark is laid against the documents in turns
U64 = np.uint64
_MIXERS = tuple(pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) | 1 for i in range(16))
_BITS = 22
CROWD, SLICE = 4096, 1 << 20  # hits of one hash in one row from which they are united as bits; hits listed at once
FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType())]))


def mask_hashes(w: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Of each position of w at which the whole mask fits."""
    n = len(w) - mask[-1]
    if n <= 0:
        return np.zeros(0, U64)
    h = w[mask[0] : mask[0] + n] * U64(_MIXERS[0])
    for k, o in enumerate(mask[1:], 1):
        h += w[o : o + n] * U64(_MIXERS[k])
    return K.mix(h)


class Index:
    """The hashed items of a benchmark: for each mask sorted hashes with the place of each; a bit table screens first."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        hs, firsts, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
        for _, _, buf, off in K.pieces(texts):
            h, _, _, first = K.words(buf, off)
            hs.append(h)
            firsts.append(first[1:] + at)
            at += len(h)
        self.ids, self.words, self.first = ids, np.concatenate(hs), np.concatenate(firsts)
        self.seeds = []
        for m in MASKS:
            h = mask_hashes(self.words, m)
            place = np.arange(len(h))
            item = np.searchsorted(self.first, place, "right") - 1
            fits = place + m[-1] < self.first[item + 1] if len(h) else np.zeros(0, bool)
            h, place, item = h[fits], place[fits], item[fits]
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << _BITS, bool)
            table[h >> U64(64 - _BITS)] = True
            self.seeds.append((m, h[order], place[order], item[order], table))

    def find(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        for lo, _, buf, off in K.pieces(texts):
            h, _, _, first = K.words(buf, off)
            found = [self._diagonals(h, first, *seed) for seed in self.seeds]
            hits = np.unique(np.concatenate(found), axis=0)
            ends = np.flatnonzero(np.any(hits[1:, :2] != hits[:-1, :2], axis=1)) + 1
            for own in np.split(hits, ends) if len(hits) else []:
                row, item = own[0, :2]
                test = self.words[self.first[item] : self.first[item + 1]]
                n = covered_words(h[first[row] : first[row + 1]], test, own[:, 2])
                if n:
                    out[lo + row].append((int(self.ids[item]), n))
        return out

    def _diagonals(self, h: np.ndarray, first: np.ndarray, m: tuple[int, ...], known: np.ndarray, place: np.ndarray, item: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Distinct (row, item, diagonal) of the hits of one mask."""
        x = mask_hashes(h, m)
        p = np.flatnonzero(table[x >> U64(64 - _BITS)])
        a = np.searchsorted(known, x[p], "left")
        many = np.searchsorted(known, x[p], "right") - a
        p, a, many = p[many > 0], a[many > 0], many[many > 0]
        row = np.searchsorted(first, p, "right") - 1
        inside = p + m[-1] < first[row + 1]
        p, a, many, row = p[inside], a[inside], many[inside], row[inside]
        # one hash, often in a row and in the benchmark: its hits are as many as the product, their diagonals only as the sum
        order = np.lexsort((a, row))
        p, a, many, row = p[order], a[order], many[order], row[order]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (a[1:] != a[:-1])]) if len(p) else np.zeros(0, np.int64)
        times = np.diff(np.r_[starts, len(p)])
        crowded = times * many[starts] > CROWD
        out = [np.zeros((0, 3), np.int64)]
        for s, t in zip(starts[crowded], times[crowded]):
            own = slice(a[s], a[s] + many[s])
            out.append(_crowd(row[s], p[s : s + t] - first[row[s]], item[own], place[own] - self.first[item[own]]))
        plain = np.flatnonzero(~np.repeat(crowded, times))
        for some in np.split(plain, np.flatnonzero(np.diff(np.cumsum(many[plain]) // SLICE)) + 1):
            i = np.repeat(some, many[some])
            j = a[i] + np.arange(len(i)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
            out.append(np.unique(np.stack([row[i], item[j], p[i] - first[row[i]] - (place[j] - self.first[item[j]])], 1), axis=0))
        return np.concatenate(out)


def _crowd(row: int, p: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distinct (row, item, p - q): the places p of a row as the bits of one number, shifted by each place q of an item and united."""
    size = int(p.max()) + 1
    flags = np.zeros(size, np.uint8)
    flags[p] = 1
    bits = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    out = []
    for i in np.unique(item):
        places = q[item == i]
        top, united = int(places.max()), 0
        for k in places.tolist():
            united |= bits << (top - k)
        seen = np.unpackbits(np.frombuffer(united.to_bytes((size + top) // 8 + 1, "little"), np.uint8), bitorder="little")
        d = np.flatnonzero(seen) - top
        out.append(np.stack([np.full(len(d), row), np.full(len(d), i), d], 1))
    return np.concatenate(out)


def covered_words(doc: np.ndarray, test: np.ndarray, diagonals: np.ndarray) -> int:
    """How many words of test equal those of doc inside a window of WINDOW words with at most SUBSTITUTIONS unlike ones, on any of the diagonals."""
    covered = np.zeros(len(test), bool)
    if min(len(test), len(doc)) < WINDOW:
        return 0
    q, s = np.arange(len(test)), np.arange(len(test) - WINDOW + 1)
    some = max(1, SLICE // len(test))
    for lo in range(0, len(diagonals), some):
        d = diagonals[lo : lo + some, None]
        at = q + d
        equal = (doc[np.clip(at, 0, len(doc) - 1)] == test) & (at >= 0) & (at < len(doc))
        run = np.zeros((len(d), len(test) + 1), np.int32)
        np.cumsum(equal, axis=1, out=run[:, 1:])
        good = (run[:, WINDOW:] - run[:, :-WINDOW] >= WINDOW - SUBSTITUTIONS) & (s >= -d) & (s + WINDOW <= len(doc) - d)
        edge = np.zeros(run.shape, np.int32)
        edge[:, : len(s)] += good
        edge[:, WINDOW:] -= good
        covered |= (equal & (np.cumsum(edge[:, :-1], axis=1) > 0)).any(0)
        if covered.all():
            break
    return int(covered.sum())


def _finders(benchmark: DataFrame) -> list[Callable]:
    """One text -> overlaps function for each part of the benchmark that a worker can hold."""
    spark = benchmark.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // CHUNK_BYTES)
    out = []
    for k in range(max(1, parts)):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))) == k).distinct().toArrow()
        held = spark.sparkContext.broadcast((part.column(0).to_numpy(), part.column(1).combine_chunks().cast(pa.large_string())))

        out.append(arrow_function(_finder(held, uuid.uuid4().hex, max(1, parts)), FOUND))
    return out


def _finder(held, key: str, parts: int) -> Callable[[pa.Array], pa.Array]:
    def find(texts: pa.Array) -> pa.Array:
        found = kept(key, parts, lambda: Index(*held.value)).find(texts)
        return pa.array([[{"item_id": i, "words": n} for i, n in x] for x in found], pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32())])))

    return find


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, words): the documents and test items that overlap, and how many words of the item the overlaps cover.

    words counts the places of the item that equal the document's inside at least one overlap, on any diagonal. Words are those
    of `kernels`. A document or item of null id or null text, or of fewer than WINDOW words, overlaps nothing. Rows that
    repeat a doc_id (or an item_id) count as one, with the most words. No rows for an empty table on either side.
    """
    found = None
    for udf in _finders(benchmark):
        x = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), udf("text").alias("o"))
        x = x.where(F.size("o") > 0).select("doc_id", F.explode("o").alias("z")).select("doc_id", "z.item_id", "z.words")
        found = x if found is None else found.unionByName(x)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps a test item. Null, empty and short texts stay; repeated rows stay; all columns pass."""
    for udf in _finders(benchmark):
        docs = docs.where(F.size(udf(F.coalesce("text", F.lit("")))) == 0)
    return docs
