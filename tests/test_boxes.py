import pytest
from pyspark.sql import functions as F

from leafmesh.operators import boxes, clusters, layout

SIDES = "document string, page int, pos int, block_id string, x_min double, y_min double, x_max double, y_max double"


def frame(spark, *rows):
    return spark.createDataFrame([("d", 1, k, f"b{k}", *map(float, r)) if r else ("d", 1, k, f"b{k}", None, None, None, None) for k, r in enumerate(rows)], SIDES)


def both(spark, a, b):
    """One row with the sides a and b."""
    return frame(spark, a).alias("a").crossJoin(frame(spark, b).alias("b"))


@pytest.mark.parametrize(
    ("a", "b", "shared", "ratio"),
    [((0, 0, 10, 10), (5, 5, 15, 15), 25, 0.25), ((0, 0, 10, 10), (10, 0, 20, 10), 0, 0), ((0, 0, 10, 10), (2, 2, 4, 4), 4, 1), ((5, 5, 5, 5), (0, 0, 10, 10), 0, 0), ((10, 10, 0, 0), (0, 0, 10, 10), 0, 0)],
)
def test_overlap(spark, a, b, shared, ratio):
    r = both(spark, a, b).select(boxes.overlap_area("a", "b").alias("s"), boxes.overlap_ratio("a", "b").alias("r"), boxes.intersects("a", "b").alias("i"), boxes.intersection("a", "b").alias("x")).first()
    assert (r.s, r.r, r.i) == (shared, ratio, shared > 0)
    assert (r.x is None) == (shared == 0)


def test_touching_boxes_do_not_overlap_but_hold_the_point(spark):
    r = both(spark, (0, 0, 10, 10), (10, 10, 20, 20)).select(boxes.intersects("a", "b").alias("i"), boxes.contains_point("a", F.lit(10.0), F.lit(10.0)).alias("p"), boxes.contains("a", "b").alias("c"), boxes.contains("a", "b", 10).alias("s")).first()
    assert tuple(r) == (False, True, False, True)


def test_subtract_leaves_the_area_that_is_not_shared(spark):
    r = both(spark, (0, 0, 10, 10), (2, 3, 5, 12)).select(boxes.subtract(boxes.box("a"), boxes.box("b")).alias("rest")).first()
    assert {tuple(x) for x in r.rest} == {(0, 0, 10, 3), (0, 3, 2, 10), (5, 3, 10, 10)}
    whole = both(spark, (0, 0, 10, 10), (20, 20, 30, 30)).select(boxes.subtract(boxes.box("a"), boxes.box("b")).alias("rest")).first()
    assert [tuple(x) for x in whole.rest] == [(0, 0, 10, 10)]


def test_free_parts_and_uncovered_area(spark):
    whole, covers = frame(spark, (0, 0, 10, 10)), frame(spark, (50, 50, 51, 51), (0, 0, 5, 10), (4, 0, 10, 4))
    got = layout.free_parts(whole, covers).collect()
    assert {tuple(r)[4:] for r in got} == {(5.0, 4.0, 10.0, 10.0)}
    assert layout.uncovered_area(whole, covers).first().area == 30
    assert layout.uncovered_area(whole, frame(spark, (50, 50, 51, 51), (0, 0, 10, 10))).count() == 0


def test_clamp_and_shift(spark):
    r = frame(spark, (-5, 790, 20, 820)).select(boxes.clamped(boxes.box()).alias("c"), boxes.shifted_inside().alias("s")).first()
    assert tuple(r.c) == (0, 790, 20, 801) and tuple(r.s) == (0, 771, 25, 801)
    assert frame(spark, (0, 0, 700, 10)).select(boxes.shifted_inside().alias("s")).first().s is None


def test_semi_anti_and_best(spark):
    b = frame(spark, (0, 0, 10, 10), (5, 5, 15, 15), (6, 6, 9, 9), (100, 100, 110, 110), None)
    hit = (F.col("a.pos") != F.col("b.pos")) & boxes.intersects("a", "b")
    assert {r.block_id for r in boxes.with_neighbour(b, b, hit).collect()} == {"b0", "b1", "b2"}
    assert {r.block_id for r in boxes.without_neighbour(b, b, hit).collect()} == {"b3", "b4"}
    best = boxes.best_partner(b, b, hit, [boxes.overlap_area("a", "b").desc()]).select(F.col("a.block_id").alias("x"), F.col("b.block_id").alias("y")).collect()
    assert {tuple(r) for r in best} == {("b0", "b1"), ("b1", "b0"), ("b2", "b0")}


def test_vertical_limits(spark):
    b = frame(spark, (0, 0, 100, 10), (0, 50, 100, 60), (200, 20, 300, 30))
    got = {r.pos: (r.above, r.below) for r in boxes.vertical_limits(b).collect()}
    assert got == {0: (0.0, 48.0), 1: (12.0, 801.0), 2: (0.0, 801.0)}


def test_clusters(spark):
    lines = frame(spark, (0, 0, 10, 10), (20, 1, 30, 11), (0, 20, 10, 30), (300, 2, 400, 12))
    rows = {r.block_id: r.cluster for r in clusters.rows_of_lines(lines).collect()}
    assert rows["b0"] == rows["b1"] == rows["b3"] != rows["b2"]
    lanes = {r.block_id: r.cluster for r in clusters.lanes(frame(spark, (0, 0, 100, 10), (200, 0, 300, 10), (10, 20, 90, 30), (150, 40, 320, 50))).collect()}
    assert lanes["b0"] == lanes["b2"] and lanes["b1"] == lanes["b3"] != lanes["b0"]
    merged = {r.block_id: r.cluster for r in clusters.merged_regions(frame(spark, (0, 0, 100, 10), (0, 15, 100, 30), (0, 100, 100, 120))).collect()}
    assert merged["b0"] == merged["b1"] != merged["b2"]
    taken = {r.block_id: r.cluster for r in clusters.absorbed_labels(frame(spark, (0, 0, 50, 10), (0, 20, 50, 30), (0, 40, 50, 90), (0, 300, 50, 310)), "pos = 2").collect()}
    assert taken == {"b0": 1, "b1": 1, "b2": 1, "b3": 0}
    assert clusters.lanes(frame(spark).where("false")).count() == 0


def test_wrap_and_fit(spark):
    r = spark.createDataFrame([("aa bbb cc\ndd", "汉字汉字汉", "")], "a string, b string, c string")
    out = r.select(layout.wrapped(F.col("a"), F.lit(6)).alias("a"), layout.wrapped(F.col("b"), F.lit(4)).alias("b"), layout.wrapped(F.col("c"), F.lit(4)).alias("c"), layout.units(F.col("b")).alias("u")).first()
    assert out.a == ["aa bbb", "cc", "dd"] and out.b == ["汉字", "汉字", "汉"] and out.c == [""] and out.u == 10
    size = r.select(layout.fitted_size(F.col("a"), F.lit(100.0), F.lit(30.0)).alias("s"), layout.fitted_size(F.col("a"), F.lit(5.0), F.lit(5.0)).alias("n")).first()
    assert size.s == 11.0 and size.n is None
    assert layout.style_order_errors() == []


def test_restacked(spark):
    items = spark.createDataFrame([("d", 1, 1, 0, 10.0, 5.0), ("d", 1, 1, 1, 99.0, 7.0), ("d", 1, 2, 0, 3.0, 1.0)], "document string, page int, `group` int, pos int, y_min double, height double")
    assert {(r.group, r.pos): (r.y_min, r.y_max) for r in layout.restacked(items).collect()} == {(1, 0): (10.0, 15.0), (1, 1): (19.0, 26.0), (2, 0): (3.0, 4.0)}
