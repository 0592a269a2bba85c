"""The queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, covertree, ctw, decontam, licenses, linededup, minhash, mixing, quality, sql_lines, toxicity
from .store import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offending sentences of toxic documents: see `toxicity.offending_sentences`."""
    return toxicity.offending_sentences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best branches of the reply trees that the turns of conversations make: see `chat.messages_of` and `chat.best_branches`."""
    return chat.best_branches(chat.messages_of(table(spark, sf_dir, "conversations")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents to target weights: see `mixing.mixture`."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents and each one's links: see `minhash.near_classes`."""
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines: see `linededup.dedup_lines`."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items: see `decontam.overlaps`."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors and each one's links: see `covertree.near_classes`."""
    return covertree.near_classes(table(spark, sf_dir, "embeddings"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents: see `ctw.scored`."""
    return ctw.scored(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with scores: see `quality.accepted_scores`."""
    return quality.accepted_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that contain a license template: see `licenses.matches`."""
    return licenses.matches(table(spark, sf_dir, "documents"), licenses.template_table(spark))


def queries() -> dict[str, Query]:
    ops = (op1_toxicity, op2_reply_trees, op3_mixing, op4_minhash, op5_line_dedup, op6_decontamination, op7_embedding_dedup, op8_lm_scoring, op9_quality, op10_licenses)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_reply_trees": chat.best_branches_sql(),
        "op3_mixing": mixing.mixture_sql(),
        "op5_line_dedup": sql_lines.dedup_lines_sql(linededup.NEAR_CHARS),
        "op7_embedding_dedup": covertree.near_classes_sql(),
        "op10_licenses": licenses.matches_sql(),
    }
