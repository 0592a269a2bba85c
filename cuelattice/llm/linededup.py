"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are near when one insertion, deletion or substitution of a code point turns one into the other. Each line emits its
own hash and the hashes of all its one-deletion variants; lines that share a variant are verified by edit distance. A line is
dropped when an equal or near line comes earlier (by doc_id, nulls last, then text hash and line number).

Emitting every variant of every line would be as many rows as there are characters. The same neighbourhood is emitted coarse
to fine instead: first the hashes of a line without its first or its second half, then, where another line shares one of
these, without a sixteenth of that half, and only then without a single code point. Near lines share a key on every level
(that of the part which holds the edit), so nothing is lost, and a line on its own stops at the first level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import _one_row_each, free, small, text_key, written

NEAR_CHARS, PARTS = 10, 16
U64 = np.uint64
_BASE2 = 0xC2B2AE3D27D4EB4F
_LINE_KEY = ["k1", "k2"]


def _points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets in them."""
    u = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(u) == len(buf):
        return u, off
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return u, at[off]


def _running(u: np.ndarray) -> np.ndarray:
    r = np.empty(len(u) + 1, U64)
    r[0] = 0
    np.cumsum((u.astype(U64) + U64(1)) * K.powers(len(u)), out=r[1:])
    return r


def _hash(r: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (r[e] - r[s]) * K.powers(len(r), True)[s]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _line_rows(batch: pa.RecordBatch, min_chars: int, short: bool) -> Iterator[pa.RecordBatch]:
    for lo, hi, buf, off in K.pieces(batch.column(2)):
        u, off = _points(buf, off)
        cut = np.flatnonzero(u == 10)
        starts = np.concatenate([off[:-1], cut + 1])
        ends = np.concatenate([cut, off[1:]])
        starts.sort()
        ends.sort()
        # by counts: an empty text shares its start with the next one
        many = np.searchsorted(cut, off[1:]) - np.searchsorted(cut, off[:-1]) + 1
        row = np.repeat(np.arange(hi - lo), many)
        pos = np.arange(len(starts)) - np.repeat(np.cumsum(many) - many, many)
        ok = ends - starts >= max(2, min_chars)
        if short:
            inked = np.concatenate([[0], np.cumsum((u != 32) & ((u < 9) | (u > 13)))])
            ok = inked[ends] > inked[starts]
        s, e, row, pos = starts[ok], ends[ok], row[ok], pos[ok]
        n = e - s
        r = _running(u)
        cols = [batch.column(0).take(pa.array(row + lo)), batch.column(1).take(pa.array(row + lo)), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))]
        cols += [_signed(K.mix(_hash(r, s, e))), _signed(_content(u, s, e))]
        for extra in (0, 1):
            size = n + extra
            half = size // 2
            for side in (0, 1):  # 0: the edit is in the second half
                h = _hash(r, s, s + half) if side == 0 else _hash(r, e - (size - half), e)
                cols.append(_signed(K.mix(h ^ K.mix((size * 2 + side).astype(U64)))))
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "pos", "n", "k1", "k2", "p0", "p1", "p2", "p3"])


def _content(u: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A second hash of the lines' content, of another base, so that two 64-bit keys must collide at once."""
    base = np.full(len(u) + 1, _BASE2, U64)
    base[0] = 1
    up = np.cumprod(base, dtype=U64)
    base[1:] = U64(pow(_BASE2, -1, 1 << 64))
    down = np.cumprod(base, dtype=U64)
    r = np.empty(len(u) + 1, U64)
    r[0] = 0
    np.cumsum((u.astype(U64) + U64(7)) * up[:-1], out=r[1:])
    return K.mix((r[e] - r[s]) * down[s])


def line_table(docs: DataFrame, min_chars: int, short: bool = False) -> DataFrame:
    """(doc_id, h, pos, n, k1, k2, p0..p3) of each line of at least min_chars code points: keys of the whole and of its halves. With short: of each line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _line_rows(b, min_chars, short)

    schema = "doc_id long, h long, pos int, n int, k1 long, k2 long, p0 long, p1 long, p2 long, p3 long"
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), "text").mapInArrow(run, schema)


def _lines_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, buf, off in K.pieces(batch.column("line")):
        u, off = _points(buf, off)
        yield lo, hi, _running(u), off[:-1], off[1:], off[1:] - off[:-1]


def _parts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, line, side) to (k1, k2, extra, x, y, key): the keys without each part x..y of the half that may hold the edit."""
    for b in batches:
        side = b.column("side").to_numpy()
        for lo, hi, r, s, e, n in _lines_of(b):
            which = side[lo:hi]
            extra, second = which // 2, which % 2 == 0
            size = n + extra
            a = np.where(second, size // 2, 0)
            z = np.where(second, size, size // 2)
            width = np.maximum(1, -(-(z - a) // parts))
            many = -(-(z - a) // width)
            i = np.repeat(np.arange(hi - lo), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            x = a[i] + j * width[i]
            y = np.minimum(x + width[i], z[i])
            key = K.mix(_hash(r, s[i], s[i] + x)) ^ (_hash(r, e[i] - (size[i] - y), e[i]) * U64(0x9FB21C651E98DF25))
            key = K.mix(key ^ K.mix((size[i] << 20).astype(U64) ^ x.astype(U64)))
            at = pa.array(i + lo)
            yield pa.RecordBatch.from_arrays(
                [b.column("k1").take(at), b.column("k2").take(at), pa.array(extra[i].astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), _signed(key)],
                names=["k1", "k2", "extra", "x", "y", "key"],
            )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, line, extra, x, y) to (k1, k2, key): the line without each code point of x..y, or as it is if it is the shorter one."""
    for b in batches:
        extra, x, y = (b.column(c).to_numpy() for c in ("extra", "x", "y"))
        for lo, hi, r, s, e, n in _lines_of(b):
            whole = extra[lo:hi] == 1
            many = np.where(whole, 1, (y - x)[lo:hi])
            i = np.repeat(np.arange(hi - lo), many)
            p = s[i] + x[lo:hi][i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            q = np.minimum(p + 1, e[i])
            p = np.minimum(p, e[i])
            cut = _hash(r, s[i], p) + _hash(r, q, e[i]) * K.powers(len(r))[p - s[i]]
            key = np.where(whole[i], _hash(r, s[i], e[i]), cut)
            at = pa.array(i + lo)
            yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), _signed(K.mix(key))], names=["k1", "k2", "key"])


def _shared(df: DataFrame) -> DataFrame:
    """The rows whose key another row has too. Counts are combined before the shuffle, so that no task holds all rows of a key."""
    return df.join(df.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "key", "left_semi").select(*df.columns)


def _order(prefix: str = "") -> Column:
    return F.struct(F.col(prefix + "doc_id").isNull().alias("none"), F.col(prefix + "doc_id").alias("doc_id"), F.col(prefix + "h").alias("h"), F.col(prefix + "pos").alias("pos"))


def _lines_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, line) of the wanted (k1, k2, f: place)."""
    per_doc = wanted.groupBy(F.col("f.doc_id").alias("w_id"), F.col("f.h").alias("w_h")).agg(F.collect_list(F.struct("f.pos", "k1", "k2")).alias("at"))
    per_doc = small(written(per_doc, "lines-wanted"))
    x = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), "text")
    x = x.join(per_doc, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    x = x.select("at", F.split("text", "\n").alias("parts"))
    x = x.select(F.explode(F.expr("transform(at, a -> struct(a.k1 as k1, a.k2 as k2, parts[a.pos] as line))")).alias("z")).select("z.*")
    return x.dropDuplicates(_LINE_KEY)  # repeated rows of one document


def near_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame, parts: int = PARTS) -> DataFrame:
    """(k1, k2) of the distinct lines to which an earlier distinct line is near."""
    halves = firsts.select(*_LINE_KEY, F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("side", "key"))
    meet = written(_shared(halves).select(*_LINE_KEY, "side"), "lines-meet")
    texts = written(_lines_at(docs, firsts.join(meet.select(*_LINE_KEY).distinct(), _LINE_KEY, "left_semi").select(*_LINE_KEY, "f")), "lines-texts")
    fine = texts.join(meet, _LINE_KEY).mapInArrow(lambda it: _parts(it, parts), "k1 long, k2 long, extra int, x int, y int, key long")
    meet = written(_shared(fine).drop("key"), "lines-meet-fine")
    last = texts.join(meet, _LINE_KEY).mapInArrow(_variants, "k1 long, k2 long, key long").distinct()
    last = written(_shared(last), "lines-variants")
    a, b = last.toDF("a1", "a2", "key"), last.toDF("b1", "b2", "key")
    pairs = a.join(b, "key").where("a1 < b1 or a1 = b1 and a2 < b2").select("a1", "a2", "b1", "b2").distinct()
    text_a, text_b = texts.toDF("a1", "a2", "line_a"), texts.toDF("b1", "b2", "line_b")
    near = pairs.join(text_a, ["a1", "a2"]).join(text_b, ["b1", "b2"]).where("levenshtein(line_a, line_b, 1) >= 0").select("a1", "a2", "b1", "b2")
    place = firsts.select(*_LINE_KEY, "f")
    near = near.join(place.toDF("a1", "a2", "fa"), ["a1", "a2"]).join(place.toDF("b1", "b2", "fb"), ["b1", "b2"])
    later = F.when(F.col("fa") > F.col("fb"), F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2"))).otherwise(F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")))
    return near.select(later.alias("z")).select("z.*").distinct()


def _without(text: str | Column, at: str | Column) -> Column:
    """The text without the lines of the given numbers: one pass over each, inside the JVM."""
    # the lines are a lambda's variable, so that they are split once and not for each number
    kept = lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), at), lambda i: p[i]), "\n")
    return F.transform(F.array(F.split(text, "\n")), kept)[0]


def dropped_lines(docs: DataFrame, near_chars: int = NEAR_CHARS, parts: int = PARTS, short: bool = True) -> DataFrame:
    """(doc_id, h, pos) of each line that an equal or near earlier line makes superfluous; h is the key of the document's text."""
    lines = written(line_table(docs, near_chars, short), "lines")
    firsts = lines.groupBy(*_LINE_KEY).agg(F.min(_order()).alias("f"), F.count(F.lit(1)).alias("times"), *[F.min(c).alias(c) for c in ("n", "p0", "p1", "p2", "p3")])
    firsts = written(firsts, "lines-first")
    late = near_lines(docs, lines, firsts.where(F.col("n") >= near_chars), parts).withColumn("late", F.lit(True))
    verdict = firsts.join(late, _LINE_KEY, "left").where("times > 1 or late").select(*_LINE_KEY, "f", F.coalesce("late", F.lit(False)).alias("late"))
    return lines.join(verdict, _LINE_KEY).where(F.col("late") | (F.col("f") != _order())).select("doc_id", "h", "pos").distinct()


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS, parts: int = PARTS, short: bool = True) -> DataFrame:
    """docs without the lines that repeat, or nearly repeat, an earlier line of any document; n_chars (if there) is counted anew.

    Lines are what "\\n" separates. Lines of near_chars code points and more go if an earlier line is within one edit (in a shorter
    line one edit makes another word), shorter ones if they equal an earlier line; lines of ASCII white space always stay. Without
    short, all lines under near_chars stay. Near is transitive in no way: it doesn't matter whether the earlier line itself stays. A document of which only blank lines would
    stay goes altogether; one without any dropped line passes unchanged, a null or empty text too. Rows that repeat a doc_id and
    text leave one row. A null doc_id comes after all others. Other columns pass through.
    """
    # one key for the join and for the rows that repeat: the texts are shuffled once
    key = F.xxhash64(F.col("doc_id").cast("long"), "h")
    gone = dropped_lines(docs, near_chars, parts, short).groupBy(key.alias("k")).agg(F.collect_set(F.struct("doc_id", "h", "pos")).alias("at"))
    h, k, g_k, at, rank, rest = free(docs, "__h", "__k", "__g_k", "__at", "__rank", "__rest")
    x = docs.withColumn(h, text_key()).withColumn(k, F.xxhash64(F.col("doc_id").cast("long"), h))
    x = x.join(gone.toDF(g_k, at), F.col(k) == F.col(g_k), "left")
    own = F.transform(F.filter(at, lambda z: z["doc_id"].eqNullSafe(F.col("doc_id").cast("long")) & z["h"].eqNullSafe(F.col(h))), lambda z: z["pos"])
    x = _one_row_each(x.withColumn(at, F.when(F.size(own) > 0, own)), [*docs.columns, at], h, rank, k)
    x = x.withColumn(rest, F.when(F.col(at).isNull(), F.col("text")).otherwise(_without("text", at)))
    x = x.where(F.col(at).isNull() | (F.regexp_replace(rest, r"\s+", "") != ""))
    out = {"text": F.col(rest)} | ({"n_chars": F.when(F.col(rest).isNotNull(), F.length(rest)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return x.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
