from pyspark.sql import functions as F

from leafmesh.operators import text as T
from leafmesh.operators import windows
from tests.test_plans import LONG, ROWS, frame


def placed(spark, *rows):
    """Rows (x0, y0, x1, y1, text) of one page."""
    return spark.createDataFrame([("d", 1, k, f"b{k}", *map(float, r[:4]), r[4], None) for k, r in enumerate(rows)], ROWS)


def test_captions_take_what_stands_above_them(spark):
    b = placed(spark, (0, 0, 100, 10, "x1"), (0, 100, 100, 120, "label"), (50, 130, 150, 150, LONG), (0, 160, 100, 170, "Fig. 1. It is"), (300, 100, 400, 120, "far"))
    r = windows.caption_windows(b).collect()
    assert [(x.caption_id, x.blocks, x.y_min, x.y_max) for x in r] == [("b3", 1, 100.0, 120.0)]


def test_cells_in_a_row(spark):
    b = placed(spark, (0, 0, 50, 10, "name"), (100, 1, 150, 11, "75.3%"), (0, 50, 50, 60, "other"), (0, 0, 50, 10, LONG))
    assert {r.block_id for r in windows.row_aligned(b, T.is_metric_cell(F.col("text"))).collect()} == {"b0"}


def test_fragments_go_to_the_nearest_text(spark):
    b = placed(spark, (0, 0, 100, 50, LONG), (0, 60, 100, 70, "one two"), (0, 90, 100, 140, LONG), (0, 400, 100, 410, "alone"), (0, 75, 100, 80, None))
    assert [(r.fragment_id, r.target_id, r.distance) for r in windows.fragment_targets(b).collect()] == [("b1", "b0", 10.0)]


def test_bands_and_holders(spark):
    b = placed(spark, (0, 100, 100, 150, LONG), (0, 85, 100, 95, "a"), (0, 300, 100, 310, "b"), (10, 110, 20, 120, "in"), (10, 105, 20, 108, "up"))
    r = windows.in_band(b).first()
    assert (r.rows, r.first_id, r.last_id) == (4, "b1", "b3")
    assert {(x.fragment_id, x.holder_id, x.place) for x in windows.contained_fragments(b).collect()} == {("b4", "b0", 1), ("b3", "b0", 2)}


def test_boxes_grow_down_and_then_up(spark):
    b = placed(spark, (0, 100, 100, 110, "a"), (0, 115, 100, 125, "b"), (0, 700, 100, 710, "c")).withColumn("need", F.lit(30.0))
    got = {r.pos: (r.y_min, r.y_max, r.fits) for r in windows.grown(b).collect()}
    assert got == {0: (83.0, 113.0, True), 1: (115.0, 145.0, True), 2: (700.0, 730.0, True)}


def test_numbered_items(spark):
    b = placed(spark, (0, 10, 9, 20, "(2) b"), (0, 30, 9, 40, "(1) a"), (0, 50, 9, 60, "(3) c"), (0, 70, 9, 80, "none"))
    assert {r.block_id: r.y_min for r in windows.numbered_in_order(b).collect()} == {"b0": 30.0, "b1": 10.0, "b2": 50.0}
    gap = placed(spark, (0, 10, 9, 20, "(5) b"), (0, 30, 9, 40, "(1) a"))
    assert {r.block_id: r.y_min for r in windows.numbered_in_order(gap).collect()} == {"b0": 10.0, "b1": 30.0}


def test_first_page_and_places(spark):
    b = frame(spark, (3, 100, "Dense Cache Lattice"), (3, 120, "Ann Bee"), (3, 140, LONG), (3, 160, "Cee Dee"), (4, 100, "Dense Cache"), (5, 100, "x"))
    assert {r.block_id: r.role for r in windows.first_page_roles(b).collect()} == {"b0": "title", "b1": "authors"}
    assert {(r.block_id, r.pages) for r in windows.across_pages(b).collect()} == {("b0", 3), ("b4", 3), ("b5", 3)}


def test_worst_scores(spark):
    s = spark.createDataFrame([("d", 1, f"b{k}", k / 10) for k in range(8)], "document string, page int, block_id string, similarity double")
    r = windows.worst_by_document(s, 3).first()
    assert (r.blocks, r.worst, r.ids) == (8, 0.0, "b0,b1,b2")
