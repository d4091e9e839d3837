"""Review of answers against their blocks: kinds of text, likeness, and back translations."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmesh.operators import text as T
from leafmesh.operators.boxes import PAGE


def kind(t: Column) -> Column:
    """empty, short (one line of at most 80 characters), section_header or body."""
    return F.when(T.flat(t) == "", "empty").when((F.length(t) <= 80) & ~t.contains("\n"), "short").when(T.is_heading(t), "section_header").otherwise("body")


def similarities(pairs: DataFrame, left: str = "text", right: str = "answer") -> DataFrame:
    """(document, page, block_id, similarity): the ratio of matching blocks of two texts in normal form, at four decimals.

    Built-in functions have no such ratio, so texts go through Python in Arrow batches; equal texts are told beforehand.
    """
    a, b = T.normalized_english(F.col(left)), T.normalized_english(F.col(right))
    schema = pa.schema([("document", pa.string()), ("page", pa.int32()), ("block_id", pa.string()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {f.name: batch.column(k).to_pylist() for k, f in enumerate(batch.schema)}
            ratio = [1.0 if x == y else round(SequenceMatcher(None, x or "", y or "").ratio(), 4) for x, y in zip(cols["a"], cols["b"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols["document"], pa.string()), pa.array(cols["page"], pa.int32()), pa.array(cols["block_id"], pa.string()), pa.array(ratio, pa.float64())], schema=schema)

    return pairs.select(*PAGE, "block_id", a.alias("a"), b.alias("b")).mapInArrow(run, "document string, page int, block_id string, similarity double")


def back_translations(originals: DataFrame, answers: DataFrame, back: DataFrame) -> DataFrame:
    """(document, page, block_id, similarity): how alike originals and the back translations of their answers are, worst first.

    `back` is (document, page, block_id, back); an answer without one counts as an empty text.
    """
    joined = originals.where(T.flat(F.col("text")) != "").select(*PAGE, "block_id", "text").join(answers.select(*PAGE, "block_id"), [*PAGE, "block_id"])
    joined = joined.join(back, [*PAGE, "block_id"], "left").withColumn("back", F.coalesce("back", F.lit("")))
    return similarities(joined, "text", "back").orderBy("similarity", *PAGE, "block_id")
