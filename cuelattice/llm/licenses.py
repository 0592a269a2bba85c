"""License scans by an exact set-similarity join.

A block of text contains a template when it has at least `THRESHOLD` of the template's distinct words. Words are ordered by their
frequency over all blocks, rarest first. A template of n words that needs o of them is posted under its first n-o+1 words only: a block
with none of these can't reach o. Blocks with fewer than o template words are left out (length filter), and so are those that
can't reach o any more after the place where the two first meet (positional filter). What remains is counted exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import arrow_function, kept, written

THRESHOLD = 0.8
CHUNK_BYTES = 16 << 20  # of template text held by a worker at once; more templates are laid against the documents in turns
_BITS = 20
U64 = np.uint64

TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-any", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("permissive-grant", "Permission is hereby granted, free of charge, " "to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("as-is", "The software is provided as is, without warranty of any kind, express or implied"),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "template string, text string")


def needed(n: int, threshold: float) -> int:
    """How many of n words make a share of at least threshold (one at least)."""
    o = max(1, int(np.floor(threshold * n)))
    return o if o / n >= threshold else o + 1


def blocks(buf: np.ndarray, off: np.ndarray, paragraphs: bool) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all blocks and the n+1 boundaries of each row's: lines, or paragraphs (parted by two newlines or more)."""
    cut = np.zeros(len(buf) + 1, bool)
    if paragraphs:
        cut[2:] = (buf[1:] == 10) & (buf[:-1] == 10)
        cut[np.minimum(off[:-1] + 1, len(buf))] = False  # the newline before a row's first byte is another row's
        cut[:-1] &= buf != 10  # a run of newlines parts once
    else:
        cut[1:] = buf == 10
    cut[off[:-1]] = True
    cut[len(buf)] = False
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, off)


class Vocabulary:
    """The distinct words of all templates, by hash."""

    def __init__(self, texts: pa.Array):
        self.of, found = [], []
        for lo, hi, buf, off in K.pieces(texts):
            h, _, _, first = K.words(buf, off)
            self.of += [np.unique(h[first[i] : first[i + 1]]) for i in range(hi - lo)]
            found.append(h)
        self.hashes = np.unique(np.concatenate([np.zeros(0, U64), *found]))
        self.screen = np.zeros(1 << _BITS, bool)
        self.screen[self.hashes >> U64(64 - _BITS)] = True

    def hits(self, buf: np.ndarray, off: np.ndarray, paragraphs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (block, word) that are in the vocabulary, by block; and the rows' boundaries among the blocks."""
        h, s, _, _ = K.words(buf, off)
        starts, first = blocks(buf, off, paragraphs)
        at = np.flatnonzero(self.screen[h >> U64(64 - _BITS)])
        w = np.minimum(np.searchsorted(self.hashes, h[at]), max(0, len(self.hashes) - 1))
        ok = self.hashes[w] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        block = np.searchsorted(starts, s[at[ok]], "right") - 1
        key = np.unique(block * len(self.hashes) + w[ok]) if len(self.hashes) else np.zeros(0, np.int64)
        n = max(1, len(self.hashes))
        return key // n, key % n, first


def _counts(texts: pa.Array, held, paragraphs: bool) -> np.ndarray:
    v = held["vocabulary"]
    total = np.zeros(len(v.hashes), np.int64)
    for _, _, buf, off in K.pieces(texts):
        total += np.bincount(v.hits(buf, off, paragraphs)[1], minlength=len(v.hashes))
    return total


class Join:
    """The templates' prefixes, posted by the word's place in the global order."""

    def __init__(self, v: Vocabulary, names: list[str], frequency: np.ndarray, threshold: float):
        self.v, self.names = v, names
        self.rank = np.empty(len(v.hashes), np.int64)
        self.rank[np.lexsort((v.hashes, frequency))] = np.arange(len(v.hashes))
        self.sets = [np.sort(self.rank[np.searchsorted(v.hashes, h)]) for h in v.of]
        self.need = [needed(len(t), threshold) if len(t) else 0 for t in self.sets]
        self.posted: dict[int, list[tuple[int, int]]] = {}
        self.prefix = np.zeros(len(v.hashes) + 1, bool)
        for i, (t, o) in enumerate(zip(self.sets, self.need)):
            for p, word in enumerate(t[: len(t) - o + 1] if o else []):
                self.posted.setdefault(int(word), []).append((i, p))
                self.prefix[word] = True

    def find(self, texts: pa.Array, paragraphs: bool) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for lo, _, buf, off in K.pieces(texts):
            block, word, first = self.v.hits(buf, off, paragraphs)
            word = self.rank[word]
            order = np.lexsort((word, block))
            block, word = block[order], word[order]
            bounds = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, np.int64)
            some = np.unique(np.searchsorted(bounds, np.flatnonzero(self.prefix[word]), "right") - 1)
            for k in some:
                words = word[bounds[k] : bounds[k + 1]]
                row = int(np.searchsorted(first, block[bounds[k]], "right") - 1)
                for i, n in self.matches(words):
                    t = len(self.sets[i])
                    out[lo + row].append({"block_no": int(block[bounds[k]] - first[row]), "template": self.names[i], "matched": n, "template_words": t, "containment": n / t})
        return out

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        seen = set()
        for j in np.flatnonzero(self.prefix[words]):
            for i, p in self.posted[int(words[j])]:
                o, t = self.need[i], self.sets[i]
                # this is the first common word: what follows it on either side must still reach o
                if i in seen or len(words) < o:
                    continue
                seen.add(i)
                if 1 + min(len(t) - p - 1, len(words) - j - 1) >= o:
                    n = len(np.intersect1d(t, words, assume_unique=True))
                    if n >= o:
                        yield i, n


FOUND = T.ArrayType(T.StructType([T.StructField("block_no", T.IntegerType()), T.StructField("template", T.StringType()), T.StructField("matched", T.IntegerType()), T.StructField("template_words", T.IntegerType()), T.StructField("containment", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("block_no", pa.int32()), ("template", pa.string()), ("matched", pa.int32()), ("template_words", pa.int32()), ("containment", pa.float64())]))


def _finder(held, frequency: np.ndarray, threshold: float, paragraphs: bool, parts: int) -> Callable[[pa.Array], pa.Array]:
    key = uuid.uuid4().hex

    def find(texts: pa.Array) -> pa.Array:
        names, t = held.value
        join = kept(key, parts, lambda: Join(Vocabulary(t), names, frequency, threshold))
        return pa.array(join.find(texts, paragraphs), _ARROW)

    return find


def _counter(held, paragraphs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = Vocabulary(held.value[1]), None
        for b in batches:
            n = _counts(b.column(0), {"vocabulary": v}, paragraphs)
            total = n if total is None else total + n
        if total is not None and total.any():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    return run


def matches(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, unit: str = "line") -> DataFrame:
    """(doc_id, block_no, template, matched, template_words, containment) of each block that has at least `threshold` of a template's distinct words.

    Blocks are the lines of a text, or with unit="paragraph" its paragraphs (parted by two newlines or more); block_no counts from 0. Words are
    those of `kernels`, in lower case for ASCII letters. A null text or template, and one without a word, matches nothing; a null doc_id is
    carried as null; repeated rows of documents are each reported, those of templates once. Templates of one name and several texts are
    each matched. An empty table on either side gives no rows.
    """
    if unit not in ("line", "paragraph"):
        raise ValueError("unit must be line or paragraph")
    paragraphs, spark = unit == "paragraph", docs.sparkSession
    known = templates.where("text is not null").select(F.col("template").cast("string").alias("template"), "text").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, found = max(1, -(-size // CHUNK_BYTES)), None
    texts = docs.where("text is not null")
    for k in range(parts):
        part = known.where(F.pmod(F.xxhash64("template", "text"), F.lit(parts)) == k).orderBy("template", "text").toArrow()
        names, text = part.column(0).to_pylist(), part.column(1).combine_chunks().cast(pa.large_string())
        held = spark.sparkContext.broadcast((names, text))
        frequency = np.zeros(len(Vocabulary(text).hashes), np.int64)
        counts = texts.select("text").mapInArrow(_counter(held, paragraphs), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        for r in counts.collect():  # a row for each word of the templates
            frequency[r.word] = r.n
        x = texts.select("doc_id", arrow_function(_finder(held, frequency, threshold, paragraphs, parts), FOUND)("text").alias("o"))
        x = x.where(F.size("o") > 0).select("doc_id", F.explode("o").alias("z")).select("doc_id", "z.*")
        found = x if found is None else found.unionByName(x)
    return written(found, "license-matches")


def matches_sql(threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL for `matches` by lines, counting the common words of every line and template."""
    rows = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in templates)
    word = "[0-9A-Za-zÀ-῿]+"
    return f"""
WITH t AS (SELECT DISTINCT template, unnest(regexp_extract_all(lower(text), '{word}')) AS word FROM (VALUES {rows}) v(template, text)),
sizes AS (SELECT template, count(*) AS n FROM t GROUP BY template),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS p, row_number() OVER () AS row_no FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, row_no, unnest(p) AS line, unnest(range(len(p))) AS block_no FROM parts),
words AS (SELECT DISTINCT doc_id, row_no, block_no, unnest(regexp_extract_all(lower(line), '{word}')) AS word FROM lines),
common AS (SELECT w.doc_id, w.row_no, w.block_no, t.template, count(*) AS matched FROM words w JOIN t ON t.word = w.word GROUP BY w.doc_id, w.row_no, w.block_no, t.template)
SELECT c.doc_id, CAST(c.block_no AS INTEGER) AS block_no, c.template, CAST(c.matched AS INTEGER) AS matched, CAST(s.n AS INTEGER) AS template_words, CAST(c.matched AS DOUBLE) / s.n AS containment
FROM common c JOIN sizes s ON s.template = c.template WHERE CAST(c.matched AS DOUBLE) / s.n >= {threshold!r}"""
