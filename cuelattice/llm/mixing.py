"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' tokens in a tree of domains, their languages and their sources. A token budget goes down from the root by the
weights of siblings. A leaf can give its tokens `EPOCHS` times at most, and a node the sum of its leaves: what a child can't use goes to
its siblings by their weights, and only what all of them can't use is left to the ancestors' siblings. A leaf's share is a prefix
of its epochs, each of which orders its documents by a seeded hash.

Nothing is sorted whole: the tokens of a leaf's last, partial epoch are summed in hash buckets, and only the bucket in which its share
ends is ordered. The choice is then a hash threshold for each leaf.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free, small, written

TOKEN = "[^ \\t\\r\\n]+"
EPOCHS, SHARE, SEED = 2, 0.6, 7
BUCKET_DIGITS = 3  # hexadecimal: 4096 buckets a leaf
DOMAIN = "case when source rlike '[0-9]$' then concat('d', cast(right(source, 1) as int) % 4) else 'other' end"


@dataclass(frozen=True)
class Weights:
    """Of the nodes on each level, relative to their siblings; a name that isn't listed weighs `other`. All must be positive."""

    domains: Mapping[str, int] = field(default_factory=lambda: {"d0": 2, "d1": 5, "d2": 2, "d3": 1})
    languages: Mapping[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: Mapping[str, int] = field(default_factory=dict)
    other: int = 1

    def __post_init__(self):
        if min([self.other, *self.domains.values(), *self.languages.values(), *self.sources.values()]) <= 0:
            raise ValueError("weights must be positive")

    def case(self, name: str, of: Mapping[str, int]) -> str:
        cases = "".join(f" when {name} = '{k.replace(chr(39), chr(39) * 2)}' then {w}" for k, w in of.items())
        return f"case{cases} else {self.other} end" if cases else str(self.other)


WEIGHTS = Weights()


def filled(children: DataFrame, parent: list[str], name: str, weight: str, budget: str = "budget") -> DataFrame:
    """children (parent, name, cap, budget of the parent) with `share`: the budget by weight, none above its cap (water-filling)."""
    level = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = level.orderBy(F.expr("cast(cap as double) / w"), name)
    x = children.withColumn("w", F.expr(weight))
    x = x.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("onwards", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("full", F.expr(f"cast(cap as double) * onwards <= cast({budget} - before as double) * w"))
    x = x.withColumn("used", F.sum(F.expr("if(full, cap, 0)")).over(level)).withColumn("weights", F.sum(F.expr("if(full, 0, w)")).over(level))
    share = f"if(full, cap, least(cap, cast(floor(cast({budget} - used as double) * w / greatest(weights, 1)) as bigint)))"
    return x.withColumn("share", F.expr(share)).drop("w", "before", "onwards", "full", "used", "weights")


def targets(leaves: DataFrame, weights: Weights = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(domain, language, origin, tokens) with the leaf's target: whole epochs `rounds` and the tokens `rest` of one more."""
    leaf = leaves.withColumn("cap", F.col("tokens") * epochs)
    lang = leaf.groupBy("domain", "language").agg(F.sum("cap").alias("cap"))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaf.agg(F.expr(f"least(cast(floor({share!r}D * coalesce(sum(tokens), 0)) as bigint), coalesce(sum(cap), 0))").alias("budget"))
    a = filled(domain.crossJoin(total), [], "domain", weights.case("domain", weights.domains)).select("domain", F.col("share").alias("budget"))
    b = filled(lang.join(a, "domain"), ["domain"], "language", weights.case("language", weights.languages))
    b = b.select("domain", "language", F.col("share").alias("budget"))
    c = filled(leaf.join(b, ["domain", "language"]), ["domain", "language"], "origin", weights.case("origin", weights.sources))
    return c.select("domain", "language", "origin", "tokens", F.expr("share div tokens as rounds"), F.expr("share % tokens as rest"))


def order_key(doc_id: str | Column, epoch: str | Column, seed: int = SEED) -> Column:
    """The place of a document in an epoch's order: 32 hexadecimal digits."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch if isinstance(epoch, Column) else F.col(epoch), F.coalesce(c.cast("string"), F.lit(""))))


def _leaf(domain: str) -> list[Column]:
    return [F.expr(domain).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("language"), F.coalesce(F.col("source"), F.lit("")).alias("origin")]


LEAF = ["domain", "language", "origin"]


def plan(docs: DataFrame, weights: Weights = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain: str = DOMAIN) -> tuple[DataFrame, DataFrame]:
    """The written (doc_id, lang, source, leaf, tokens) of every document with a token; and each leaf's rounds and `last`, the greatest order key of its partial epoch."""
    counted = docs.select("doc_id", "lang", "source", *_leaf(domain), F.regexp_count("text", F.lit(TOKEN)).cast("bigint").alias("tokens")).where("tokens > 0")
    counted = written(counted, "mixing-tokens")
    leaves = counted.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    aim = written(targets(leaves, weights, share, epochs).drop("tokens"), "mixing-targets")
    keyed = counted.join(small(aim.where("rest > 0")), LEAF).withColumn("key", order_key("doc_id", "rounds", seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy(*LEAF).orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("tokens").over(run)).where("upto > rest and upto - tokens <= rest").select(*LEAF, "bucket", (F.col("upto") - F.col("tokens")).alias("before"))
    ends = written(ends, "mixing-ends")
    inside = keyed.join(small(ends), [*LEAF, "bucket"]).groupBy(*LEAF, "rest", "before", "key").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    chosen = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(run)).where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("key"))
    last = ends.join(chosen, LEAF, "left").select(*LEAF, F.coalesce("key", "bucket").alias("last"))
    return counted, written(aim.join(last, LEAF, "left").select(*LEAF, "rounds", F.coalesce("last", F.lit("")).alias("last")), "mixing-plan")


def _copies(x: DataFrame, rounds: str = "rounds", last: str = "last", seed: int = SEED) -> Column:
    return (F.col(rounds) + F.when(order_key("doc_id", rounds, seed) <= F.col(last), 1).otherwise(0)).cast("int")


def mixture(docs: DataFrame, weights: Weights = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain: str = DOMAIN) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies) of each chosen document: in how many epochs the mixture has it.

    The budget is `share` of all tokens (runs of non-space characters), or all that `epochs` epochs give if that is less. No leaf goes above
    its target: the document that would cross it is left out. Null languages and sources are leaves of their own; a null
    or wordless text is never chosen. Documents of one doc_id (all of null id in a leaf, and repeated rows) have one place in the
    order, and are chosen together. No rows for an empty table.
    """
    counted, leaves = plan(docs, weights, share, epochs, seed, domain)
    x = counted.join(small(leaves), LEAF).withColumn("copies", _copies(counted, seed=seed))
    return x.where("copies > 0").select("doc_id", "domain", "lang", "source", "tokens", "copies")


def mixed(docs: DataFrame, weights: Weights = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain: str = DOMAIN) -> DataFrame:
    """The rows of docs that `mixture` chooses, with `copies` (under a free name) beside their own columns."""
    _, leaves = plan(docs, weights, share, epochs, seed, domain)
    names = free(docs, "copies", "__domain", "__language", "__origin", "__rounds", "__last", "__p_domain", "__p_language", "__p_origin")
    x = docs.where(F.col("text").rlike(TOKEN))
    x = x.withColumns({n: c for n, c in zip(names[1:4], _leaf(domain))})
    x = x.join(small(leaves.toDF(*names[6:], *names[4:6])), [F.col(a) == F.col(b) for a, b in zip(names[1:4], names[6:])])
    return x.withColumn(names[0], _copies(x, names[4], names[5], seed)).where(F.col(names[0]) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], names[0])


def mixture_sql(weights: Weights = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL for `mixture` over the table documents, ordering every leaf whole."""

    def fill(children: str, parent: str, name: str, weight: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        order = f"{by} ORDER BY CAST(cap AS DOUBLE) / w, {name}"
        return f"""(SELECT *, CASE WHEN isfull THEN cap ELSE least(cap, CAST(floor(CAST(budget - used AS DOUBLE) * w / greatest(ws, 1)) AS BIGINT)) END AS share FROM (
  SELECT *, sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({by}) AS used, sum(CASE WHEN isfull THEN 0 ELSE w END) OVER ({by}) AS ws FROM (
    SELECT *, CAST(cap AS DOUBLE) * onwards <= CAST(budget - before AS DOUBLE) * w AS isfull FROM (
      SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onwards
      FROM (SELECT *, {weight} AS w FROM {children}) q0) q1) q2) q3)"""

    return f"""
WITH counted AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    CASE WHEN regexp_matches(source, '[0-9]$') THEN 'd' || CAST(CAST(right(source, 1) AS INTEGER) % 4 AS VARCHAR) ELSE 'other' END AS domain,
    CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS BIGINT) AS tokens
  FROM documents WHERE regexp_matches(text, '[^ \\t\\r\\n]')
),
leaf AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap FROM counted GROUP BY domain, language, origin),
lng AS (SELECT domain, language, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY domain, language),
dom AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap FROM lng GROUP BY domain),
total AS (SELECT least(CAST(floor(CAST({share!r} AS DOUBLE) * sum(tokens)) AS BIGINT), CAST(sum(cap) AS BIGINT)) AS budget FROM leaf),
a0 AS (SELECT d.domain, d.cap, t.budget FROM dom d, total t),
a AS (SELECT domain, CAST(share AS BIGINT) AS budget FROM {fill("a0", "", "domain", weights.case("domain", weights.domains))} x),
b0 AS (SELECT l.domain, l.language, l.cap, a.budget FROM lng l JOIN a ON a.domain = l.domain),
b AS (SELECT domain, language, CAST(share AS BIGINT) AS budget FROM {fill("b0", "domain", "language", weights.case("language", weights.languages))} x),
c0 AS (SELECT l.domain, l.language, l.origin, l.tokens, l.cap, b.budget FROM leaf l JOIN b ON b.domain = l.domain AND b.language = l.language),
c AS (SELECT domain, language, origin, CAST(share AS BIGINT) // tokens AS rounds, CAST(share AS BIGINT) % tokens AS rest
  FROM {fill("c0", "domain, language", "origin", weights.case("origin", weights.sources))} x),
keyed AS (
  SELECT k.*, c.rounds, c.rest, md5('{seed}:' || CAST(c.rounds AS VARCHAR) || ':' || coalesce(CAST(k.doc_id AS VARCHAR), '')) AS key
  FROM counted k JOIN c ON c.domain = k.domain AND c.language = k.language AND c.origin = k.origin
),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY key) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, tokens, CAST(rounds + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM run WHERE rounds + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""
