"""Queries of the training-data operators, over the tables below a folder; `__spark_entry__.py` adds them if this can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmesh.llm import abuse, answers, noise, quality
from leafmesh.llm.chunks import repeated_lines, texts_without_repeats
from leafmesh.llm.forms import canonical_blocks, look_alike_pairs
from leafmesh.llm.leaks import leaked, without_leaks
from leafmesh.llm.mixing import copies, shares
from leafmesh.pages import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, block_id_a, block_id_b): blocks that look the same though their characters differ."""
    return look_alike_pairs(table(spark, sf_dir, "source_pages"))


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, page, block_id, text, changed): the canonical text of each block."""
    return canonical_blocks(table(spark, sf_dir, "source_pages"))


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, page, block_id, text, cut): each block's text without the lines that its source repeats."""
    return texts_without_repeats(table(spark, sf_dir, "source_pages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, block_id, line_no): lines that a source puts into many of its documents."""
    return repeated_lines(table(spark, sf_dir, "source_pages")).select("document", "block_id", "line_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, block_id, defect): entries of translations whose answer is defective."""
    return answers.defects(table(spark, sf_dir, "source_pages"), table(spark, sf_dir, "translations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, block_id, noise): cut words, misread words, running headers and printed page numbers."""
    return noise.found(table(spark, sf_dir, "source_pages"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, paragraph, page, y_min, text): the repaired text of each document."""
    return noise.paragraphs(table(spark, sf_dir, "source_pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document): documents that are lists, tables or junk rather than prose."""
    return quality.found(table(spark, sf_dir, "source_pages"))


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every document, and the probability that it is no prose."""
    return quality.judged(table(spark, sf_dir, "source_pages"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of a held-out item."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of a held-out item."""
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, documents): how many documents leak each item."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("item_id").agg(F.count("*").alias("documents"))


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each record of the mixed sources is used."""
    return copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source: target_share, max_repeats, records, used, tokens and actual_share."""
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents with a passage that is abusive, hateful or sexual."""
    return abuse.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, score, windows, hits): a score of every document."""
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, documents, flagged, rate)."""
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_texts, p2_found, p2_texts, p3_found, p4_found, p4_paragraphs, p5_found, p5_statistics, p6_found, p6_items, p6_clean, p7_copies, p7_shares, p8_found, p8_scores, p8_rates)}

#: SQL is given only where it is as fast on whole tables; the operators here are tested against brute force instead.
ORACLES: dict[str, str] = {}
