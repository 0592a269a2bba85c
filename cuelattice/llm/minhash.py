"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's signature has one value per hash function; it is posted under each (coordinate, value). Two documents match
when at least `threshold` of their coordinates agree. Candidates come from a prefix: with the postings of each document
ordered rarest list first, a matching pair must meet within the first m-threshold+1 of its m shared lists; the long lists at
the end are skipped in the merge and only counted for the candidates that remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import text_key, without_rows, written

COORDINATES, SHINGLE, THRESHOLD, SEED = 64, 3, 26, 20240501


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature_rows(texts: pa.Array, coordinates: int, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a word, and their signatures (32-bit values)."""
    a = _multipliers(coordinates, seed)
    has, sigs = np.zeros(len(texts), bool), [np.zeros((0, coordinates), np.int32)]
    for lo, hi, buf, off in K.pieces(texts):
        h, _, _, first = K.words(buf, off)
        sh, bounds = K.shingles(h, first, shingle)
        some = np.diff(bounds) > 0
        has[lo:hi] = some
        at = bounds[:-1][some]
        out = np.empty((len(at), coordinates), np.int32)
        if len(at):
            for i in range(coordinates):
                out[:, i] = (np.minimum.reduceat(sh * a[i], at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        sigs.append(out)
    return has, np.concatenate(sigs)


def signatures(docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, h, sig) of each row that has a doc_id and at least one word; h is the key of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has, sig = signature_rows(b.column(2), coordinates, shingle, seed)
            keep = pa.array(np.flatnonzero(has))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * np.int32(coordinates)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), values], names=["doc_id", "h", "sig"])

    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), text_key().alias("h"), "text")
    return named.mapInArrow(run, "doc_id long, h long, sig array<int>")


def near_classes(docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """(doc_id, class_id, links) of each document that another one matches on at least `threshold` signature coordinates.

    class_id is the least doc_id that chains of matches lead to; links counts the other documents that match this one, copies
    among them, each pair of different signatures being counted. Copies aren't listed in pairs: n of them are n rows. A doc_id of several
    texts has one row: its links are those of each text (its own other texts among them, if they match), and it joins their
    classes. Rows of null id, null text or no word, and documents that match no other, have no row; repeated rows count once.
    Extra columns don't pass. No rows for an empty table.
    """
    sigs = written(signatures(docs, coordinates, shingle, seed), "minhash-signatures")
    keys = [F.xxhash64("sig").alias("g1"), F.xxhash64(F.lit(seed), "sig").alias("g2")]
    ids = written(sigs.select("doc_id", *keys).distinct(), "minhash-members")
    groups = ids.groupBy("g1", "g2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # numbered, as an id of two texts may be the least of two signatures
    of = sigs.select(*keys, "sig").groupBy("g1", "g2").agg(F.min("sig").alias("sig"))
    groups = written(groups.join(of, ["g1", "g2"]).withColumn("g", F.monotonically_increasing_id()), "minhash-groups")
    pairs = written(_rep_pairs(groups.select(F.col("g").alias("doc_id"), "sig"), threshold), "minhash-pairs")
    size = groups.select("g", "least", "n")
    a, b = size.toDF("doc_a", "least_a", "n_a"), size.toDF("doc_b", "least_b", "n_b")
    both = written(pairs.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", "least_a", "least_b", "n_a", "n_b"), "minhash-sized")
    seen = both.select(F.col("doc_a").alias("g"), F.col("n_b").alias("n")).unionByName(both.select(F.col("doc_b").alias("g"), F.col("n_a").alias("n")))
    links = groups.join(seen.groupBy("g").agg(F.sum("n").alias("others")), "g", "left").select("g1", "g2", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    member = written(ids.join(links.where("links > 0"), ["g1", "g2"]).select("doc_id", "least", "links"), "minhash-linked")
    edges = both.select(F.col("least_a").alias("doc_a"), F.col("least_b").alias("doc_b")).unionByName(member.where("doc_id != least").select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b")))
    return classes_of(member.groupBy("doc_id").agg(F.sum("links").alias("links")), components(edges))


def classes_of(links: DataFrame, found: DataFrame, name: str = "doc_id") -> DataFrame:
    """(name, class_id, links) from links (name, links) and the rows of `components`; what is in none of these is its own class."""
    return links.join(found.toDF(name, "class_id"), name, "left").select(name, F.coalesce("class_id", name).alias("class_id"), "links")


def near_pairs(
    docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED
) -> DataFrame:
    """Pairs of class representatives of which at least `threshold` signature coordinates agree, and membership: (doc_a < doc_b, matches).

    Documents of one signature (exact copies among them) are a class, searched for once and represented by their least doc_id; each
    other one is paired with that: n copies give n-1 pairs and not n*n/2. A document of null id, or null text, or no word is in
    no pair; repeated rows of a doc_id and text count once; a doc_id isn't paired with itself, and a pair appears once, with its most
    matches. No pairs of an empty table. Every pair of two signatures that agree on `threshold` coordinates is found, whatever the
    length of its lists.
    """
    reps, copies = _collapsed(docs, coordinates, shingle, seed)
    return _rep_pairs(reps, threshold).unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("matches").alias("matches"))


def _collapsed(docs: DataFrame, coordinates: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    sigs = written(signatures(docs, coordinates, shingle, seed), "minhash-signatures")
    keys = [F.xxhash64("sig").alias("g1"), F.xxhash64(F.lit(seed), "sig").alias("g2")]
    ids = sigs.select("doc_id", *keys)
    least = ids.groupBy("g1", "g2").agg(F.min("doc_id").alias("doc_a"))
    # the least doc_id of each signature, with it; repeated rows of that id have the same signature and count once
    reps = written(sigs.select("doc_id", *keys, "sig").groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select("x.doc_id", "x.sig"), "minhash-representatives")
    copies = (
        ids.join(least, ["g1", "g2"]).where("doc_id > doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(coordinates).alias("matches")).distinct()
    )
    return reps, copies


def _prefixes(reps: DataFrame, threshold: int) -> DataFrame:
    """(d, v, rest): the rarest of the lists that d shares, all but threshold-1 of them, and how many lists of d come after each."""
    # in as many tasks as a shuffle has: each signature becomes many keys, which are counted in memory before their shuffle
    spread = reps.repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    posted = spread.select(F.col("doc_id").alias("d"), F.posexplode("sig").alias("i", "x")).select(
        "d", F.expr("shiftleft(cast(i as bigint), 32) | (cast(x as bigint) & 4294967295L)").alias("v")
    )
    # lists of one document make no pair: only shared ones go on. Counts are combined before the shuffle, however long a list is
    lists = posted.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = posted.join(lists, "v").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("l")).where(F.size("l") >= threshold)
    prefix = ordered.select("d", F.size("l").alias("size"), F.posexplode(F.expr(f"slice(l, 1, size(l) - {threshold - 1})")).alias("at", "e"))
    return prefix.select("d", F.col("e.v").alias("v"), (F.col("size") - 1 - F.col("at")).alias("rest"))


def _counted(found: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of found that agree on at least threshold coordinates, with their number: here the skipped lists are counted."""
    x, y = reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    both = found.select("a", "b").join(x, "a").join(y, "b")
    counted = both.select("a", "b", F.expr("aggregate(zip_with(sa, sb, (p, q) -> if(p = q, 1, 0)), 0, (s, t) -> s + t)").alias("matches"))
    return counted.where(F.col("matches") >= threshold).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "matches")


def _rep_pairs(reps: DataFrame, threshold: int) -> DataFrame:
    """(doc_a, doc_b, matches) of all pairs of reps (doc_id, sig).

    Collisions are counted in the prefixes. Lists have one order for all, so that after the last collision a pair can meet only in
    lists that come later for both: one that can't reach the threshold there any more isn't merged with the skipped lists.
    """
    prefix = _prefixes(reps, threshold)
    a, b = prefix.toDF("a", "v", "rest_a"), prefix.toDF("b", "v", "rest_b")
    met = a.join(b, "v").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.least(F.min("rest_a"), F.min("rest_b")).alias("rest"))
    found = written(met.where(F.col("met") + F.col("rest") >= threshold).select("a", "b"), "minhash-candidates")
    return _counted(found, reps, threshold)


def _linked(reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs of reps that connect whatever `_rep_pairs` connects, without listing all pairs of a group: (doc_a, doc_b).

    Each posting list is first tried as a star round its least member; then only members that this left in different components
    are tried with each other. A group of n near copies costs about n trials for each list.
    """
    prefix = written(_prefixes(reps, threshold).select("d", "v"), "minhash-prefixes")
    least = prefix.groupBy("v").agg(F.min("d").alias("a"))
    star = written(prefix.join(least, "v").where("a < d").select("a", F.col("d").alias("b")).distinct(), "minhash-stars")
    star = written(_counted(star, reps, threshold).select("doc_a", "doc_b"), "minhash-star-pairs")
    label = components(star).toDF("d", "c")
    labelled = written(prefix.join(label, "d", "left").select("v", "d", F.coalesce("c", "d").alias("c")), "minhash-labelled")
    open_lists = labelled.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v")
    rest = labelled.join(open_lists, "v")
    a, b = rest.toDF("v", "a", "ca"), rest.toDF("v", "b", "cb")
    found = a.join(b, "v").where("a < b and ca != cb").select("a", "b").distinct().join(star.toDF("a", "b"), ["a", "b"], "left_anti")
    return star.unionByName(_counted(written(found, "minhash-candidates"), reps, threshold).select("doc_a", "doc_b"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc, least) of each document in a pair: the least doc_id that a chain of pairs leads to.

    Alternates large-star and small-star steps on written edges until nothing changes: the number of rounds grows with the
    logarithm of a chain's length. Empty for no pairs.
    """
    edges = written(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u != v").distinct(), "components")
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.toDF("doc", "least")


def one_of_each_group(
    docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED
) -> DataFrame:
    """docs with one document, that of the least doc_id, of each group that chains of near pairs connect.

    Rows of null id, null text or no word are in no group and stay. Rows that repeat a doc_id and text count as one document
    and leave one row; rows that share a doc_id but not the text stay or go together. All columns pass through as they are.
    """
    reps, copies = _collapsed(docs, coordinates, shingle, seed)
    near = written(_linked(reps, threshold), "minhash-pairs")
    copies = written(copies.select("doc_a", "doc_b"), "minhash-copies")
    groups = components(near.unionByName(copies))
    return without_rows(docs, groups.select("doc").distinct())
