import numpy as np

from leafmesh.llm import quality
from leafmesh.llm.trees import Boosted
from tests.llm.test_found import PAGES, block

PROSE = "The parser reads the sequence of the operator and then writes it to the cache. However, this is not the case in every run.\nIn most cases, the result is bounded by the vector."
LISTS = "- parser\n- cache\n* vector graph\n- operator\n* bounded query\n- index"
TABLE = "parser\t12\t3.4%\ncache\t15\t7.1%\nvector\t99\t0.2%\nquery\t7\t1.5%"


def test_trees_learn_and_calibrate():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    model = Boosted(trees=40, depth=3).fit(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    p = model.calibrate(x[2000:2500], y[2000:2500]).probability(x[2500:])
    assert ((p > 0.5) == y[2500:]).mean() > 0.97
    assert len(Boosted().fit(np.zeros((0, 5)), np.zeros(0)).probability(np.zeros((0, 5)))) == 0
    assert (Boosted().fit(x, np.ones(len(x))).probability(x) > 0.9).all()


def test_sums_leave_headings_and_captions_aside():
    assert quality.block_sums("3.1 The Replica of the Paragraph") is None and quality.block_sums("Fig. 3. The parser reads it.") is None and quality.block_sums(" \n") is None
    s = dict(zip(quality.SUMS, quality.block_sums("The cat sat.\nIt was fat."), strict=True))
    assert (s["lines"], s["words"], s["chars"], s["letters"], s["ended_lines"], s["sentences"], s["symbols"]) == (2, 6, 19, 17, 2, 2, 2)


def test_found(spark):
    rows = [(f"prose{k}", p, None, [block("b1", PROSE * (1 + k % 5)), block("b2", LISTS[: 9 * (k % 4)]), block("b3", PROSE), block("b4", "x" * 500, y=20.0)], p) for k in range(60) for p in range(1, 2 + k % 3)]
    rows += [(f"list{k}", p, None, [block("b1", LISTS * 3), block("b2", TABLE * (1 + k // 2 % 5)), block("b3", PROSE[: 60 + k // 2]), block("b4", None)], 1) for k in range(40) for p in range(1, 2 + k // 2 % 3)]
    # the last delivery of a page counts, once
    rows += [("list0", 1, None, [block("b1", LISTS * 3), block("b2", TABLE), block("b3", PROSE[:60]), block("b4", None)], None)]
    rows += [("empty", 1, "s", [], 1), ("none", 1, "s", None, 1), (None, 1, "s", [block("b1", LISTS)], 1), ("odd", None, "s", [block("b1", LISTS)], 1)]
    pages = spark.createDataFrame(rows, PAGES + ", loaded_at int")
    got = {r.document: r for r in quality.judged(pages.withColumn("words", pages.page)).collect()}
    assert set(got) == {f"prose{k}" for k in range(60)} | {f"list{k}" for k in range(40)} | {"empty", "none"}
    assert got["list0"].asDict() | {"document": ""} == got["list1"].asDict() | {"document": ""}
    assert {r.document for r in quality.found(pages).collect()} == {f"list{k}" for k in range(40)}
    assert got["empty"].words == 0 and got["empty"].probability == 0
    assert quality.found(pages.where("false")).count() == 0


def test_kind_takes_time_in_proportion():
    import time

    from leafmesh.llm.structure import kind

    began = time.time()
    for part in ("A", "1", ".", "A.", "A ", "a-", "- ", "a,1", "a, ", "1 2", "|", "\t", "[1] ", "…"):
        kind(part * 20_000), kind(part * 20_000 + "x"), kind("a, " + part * 20_000 + "!")
    assert time.time() - began < 5


def test_kind_of_long_capital_lines():
    from leafmesh.llm.structure import kind

    assert kind("ALL RIGHTS TO THIS COPY STAY WITH PINECREST FORUM, 1997.") == "prose"
    assert kind("Halund Nirosk\nYelode Zavrin") == "names" and kind("Related Work", frozenset(["work"])) == "heading"


def test_running_words_are_counted_over_all_pages(spark):
    from leafmesh.llm.forms import few

    def pages(with_word):
        rows = [(f"d{k}", 1, None, [block("b1", "The parser reads it." + (" An ambit." if f"d{k}" in with_word else "")), block("b2", None)]) for k in range(600)]
        return spark.createDataFrame([*rows, ("none", 1, None, None), (None, 1, None, [block("b1", "none none none")])], PAGES)

    sampled = {r.document for r in few(pages(()), ["document", "page"], 300).select("document").collect()}
    others = sorted({f"d{k}" for k in range(600)} - sampled)
    assert quality.running_words(pages(others[:7])) == {"parser", "reads", "it", "ambit"}
    # as rare in proportion as twice in 300 pages
    assert quality.running_words(pages(others[:4])) == {"parser", "reads", "it"}
    assert quality.running_words(pages(()).where("false")) == frozenset()
