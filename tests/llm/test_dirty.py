"""Every operator over tables with nulls in any column, empty and very long texts, repeated rows, no rows and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from leafmesh.llm import abuse, answers, chunks, forms, leaks, mixing, noise, quality
from tests.llm.test_found import PAGES, block

LONG = "the parser reads the sequence of the operator and writes it to the cache in every run " * 4000
LINE = "This copy was served by the archive of the society of quiet readers"


def pages(spark):
    odd = (None, None, None, None, None, None, None, None, None)
    rows = [
        ("d1", 1, "s", [block("b1", "efficient code"), block("b2", "eﬃcient code"), block(None, "x"), block("b3", None), block("b4", ""), block("b5", LONG), odd, None], 1),
        ("d2", 1, None, [block("b1", LINE), block("b1", LINE)], None), ("d3", None, "s", [block("b1", LINE)], 1), (None, 1, "s", [block("b1", LINE)], 1), ("d4", 1, "s", None, 1), ("d5", 1, "s", [], 1), (None, None, None, None, None),
        *[(f"e{k}", 1, "s", [block("b1", f"{LINE}\nown words of number {k}"), block("b2", "- 3 -", y=760.0)], 1) for k in range(6)],
    ]
    # names of the operators' own columns
    return spark.createDataFrame(rows + rows, PAGES + ", loaded_at int").withColumns({c: F.lit(1) for c in ("form", "plain", "text", "pos", "n", "anchor", "wording", "block_id", "y", "lines", "probability", "words", "what", "next")})


def translations(spark):
    rows = [("d1", 1, {"b1": "高效代码", "b5": None, "zz": "无"}, 1), ("d1", 1, {"b1": "高效代码", "b5": None, "zz": "无"}, 1), ("d2", None, {"b1": ""}, 1), (None, 1, {"b1": ""}, 1), ("d2", 1, None, None), ("e1", 1, {}, None)]
    return spark.createDataFrame(rows, "document string, page int, translations map<string,string>, returned_at int").withColumns({c: F.lit(1) for c in ("answer", "block_id", "text", "margin", "defect")})


def documents(spark):
    rows = [(1, LONG, "a"), (1, LONG, "a"), (2, None, "a"), (3, "", None), (None, "x", "b"), (4, "你这个白痴。" * 3, "b"), (5, "word", "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in ("tokens", "copies", "score", "windows", "item_id", "label", "_share", "need", "whole", "chance")})


PAGE_OPERATORS = {
    "pairs": forms.look_alike_pairs, "classes": forms.look_alike_classes, "canonical": forms.canonical_blocks, "repeated": chunks.repeated_lines, "without": chunks.texts_without_repeats, "wordings": chunks.repeated_wordings,
    "noise": noise.found, "paragraphs": noise.paragraphs, "quality": quality.judged,
}


@pytest.mark.parametrize("name", PAGE_OPERATORS)
def test_operators_on_pages(spark, name):
    rows = PAGE_OPERATORS[name](pages(spark)).collect()
    assert not any(r.document is None for r in rows if "document" in r.__fields__)
    assert PAGE_OPERATORS[name](pages(spark).where("false")).count() == 0


def test_values_on_dirty_pages(spark):
    p = pages(spark)
    assert {tuple(r) for r in forms.look_alike_pairs(p).collect()} == {("d1", "b1", "b2")}
    found = {(r.document, r.block_id, r.line_no) for r in chunks.repeated_lines(p).collect()}
    assert found == {(f"e{k}", "b1", 1) for k in range(6)} | {("d3", "b1", 1)}
    assert {tuple(r) for r in noise.found(p).where("noise = 'page_number'").collect()} == {(f"e{k}", "b2", "page_number") for k in range(6)}
    assert {r.document for r in quality.judged(p).collect()} == {"d1", "d2", "d4", "d5", *(f"e{k}" for k in range(6))}


def test_answers_on_dirty_tables(spark):
    got = {tuple(r) for r in answers.defects(pages(spark), translations(spark)).collect()}
    assert ("d1", "b5", "empty") in got and all(d == "d1" for d, _, _ in got)
    assert answers.defects(pages(spark).where("false"), translations(spark)).count() == 0
    assert answers.defects(pages(spark), translations(spark).where("false")).count() == 0


def test_leaks_on_dirty_tables(spark):
    item = "the parser reads the sequence of the operator and writes it to the cache in every run"
    items = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "")], "item_id bigint, text string").withColumn("doc_id", F.lit(9))
    d = documents(spark)
    assert {tuple(r) for r in leaks.leaked(d, items).collect()} == {(1, 1)}
    assert leaks.without_leaks(d, items).count() == d.count() - 2
    assert leaks.leaked(d.where("false"), items).count() == 0 and leaks.leaked(d, items.where("false")).count() == 0


def test_mixing_on_dirty_tables(spark):
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2), ("none", 0.0, None), (None, 0.1, 1), ("zero", None, 1)], "source string, target_share double, max_repeats int").withColumn("tokens", F.lit(1))
    d = documents(spark)
    rows = mixing.copies(d, targets).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2, 4] and {r.copies for r in rows if r.tokens == 0} == {0}
    out = {r.source: r for r in mixing.shares(d, targets).collect()}
    assert set(out) == {"a", "b", "none", "zero"} and out["none"].used == 0
    assert mixing.copies(d.where("false"), targets).count() == 0 and mixing.copies(d, targets.where("false")).count() == 0


def test_scores_on_dirty_tables(spark):
    labels = spark.createDataFrame([(4, "abusive"), (5, "clean"), (None, "clean"), (1, None)], "doc_id bigint, label string").withColumn("text", F.lit("x"))
    d = documents(spark)
    rows = abuse.scored(d, labels).collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == d.count() and score[4] >= abuse.THRESHOLD and score[2] == score[3] == 0
    assert max(r.windows for r in rows) > 8000


def test_hot_source_and_ties(spark):
    draw = random.Random(1)
    rows = [(f"d{k}", 1, "hot" if k % 3 else f"s{k % 5}", [block("b1", f"{LINE}\n{''.join(draw.choices('abcdefgh ', k=60))}")], 1) for k in range(90)]
    p = spark.createDataFrame(rows, PAGES + ", loaded_at int").repartition(7)
    assert chunks.repeated_lines(p).where("line_no = 1").count() == 90


def test_joins_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    rows = [(f"d{k}", 1, "hot" if k % 3 else f"s{k % 5}", [block("b1", f"{LINE}\n{LINE} {chr(97 + k % 4) * 9}\nown {k}")], 1) for k in range(60)]
    p = spark.createDataFrame(rows, PAGES + ", loaded_at int")
    few = {tuple(r) for r in chunks.repeated_lines(p).collect()}
    by_set = {r.document: r for r in quality.judged(p).collect()}
    monkeypatch.setattr(chunks, "MOST_WORDINGS", 0)
    assert {tuple(r) for r in chunks.repeated_lines(p).collect()} == few and len(few) > 60
    assert {r.document: r for r in quality.judged(p).collect()} == by_set
