"""Boxes of positioned blocks: their areas, overlaps and distances, and joins of the boxes of a page.

A box is four columns, or a struct of them. Joins are on (document, page), so a page's boxes meet in one hash bucket, and
the condition on the coordinates is a residual of that join; nothing is compared across pages. Overlap means a common
area above 0, so boxes that only touch don't overlap; a point on the edge of a box is in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("document", "page")
BOX = ("x_min", "y_min", "x_max", "y_max")
#: Size of a page in points.
PAGE_WIDTH, PAGE_HEIGHT = 623.0, 801.0


def _of(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}" if side else name)


def box(side: str = "", prefix: str = "") -> Column:
    """The four columns of a side as a struct; missing coordinates are 0."""
    return F.struct(*(F.coalesce(_of(side, prefix + c).cast("double"), F.lit(0.0)).alias(c) for c in BOX))


def make_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x_min"), y0.alias("y_min"), x1.alias("x_max"), y1.alias("y_max"))


def width(side: str = "") -> Column:
    """Width of a box, 0 at least."""
    return F.greatest(F.lit(0.0), _of(side, "x_max") - _of(side, "x_min"))


def height(side: str = "") -> Column:
    """Height of a box, 0 at least."""
    return F.greatest(F.lit(0.0), _of(side, "y_max") - _of(side, "y_min"))


def area(side: str = "") -> Column:
    """Area of a box; an inverted box has none."""
    return width(side) * height(side)


def center(side: str = "") -> tuple[Column, Column]:
    """The point in the middle of a box."""
    return (_of(side, "x_min") + _of(side, "x_max")) / 2, (_of(side, "y_min") + _of(side, "y_max")) / 2


def _shared(a: str, b: str, low: str, high: str) -> Column:
    """Length that two intervals share; a missing end shares nothing, though greatest and least pass over it."""
    ends = [_of(a, low), _of(a, high), _of(b, low), _of(b, high)]
    there = reduce(lambda x, y: x & y, (e.isNotNull() for e in ends))
    return F.when(there, F.greatest(F.lit(0.0), F.least(ends[1], ends[3]) - F.greatest(ends[0], ends[2]))).otherwise(F.lit(0.0))


def x_overlap(a: str, b: str) -> Column:
    """Length that two boxes share across the page, 0 at least."""
    return _shared(a, b, "x_min", "x_max")


def y_overlap(a: str, b: str) -> Column:
    """Length that two boxes share down the page, 0 at least."""
    return _shared(a, b, "y_min", "y_max")


def _part(shared: Column, whole: Column) -> Column:
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def x_ratio(a: str, b: str) -> Column:
    """Length shared across the page as a part of the narrower box."""
    return _part(x_overlap(a, b), F.least(width(a), width(b)))


def y_ratio(a: str, b: str) -> Column:
    """Length shared down the page as a part of the lower box."""
    return _part(y_overlap(a, b), F.least(height(a), height(b)))


def overlap_area(a: str, b: str) -> Column:
    """Area that two boxes share."""
    return x_overlap(a, b) * y_overlap(a, b)


def overlap_ratio(a: str, b: str) -> Column:
    """Shared area as a part of the smaller box; 0 where that has no area."""
    return _part(overlap_area(a, b), F.least(area(a), area(b)))


def intersects(a: str, b: str) -> Column:
    """Whether two boxes share an area."""
    return (x_overlap(a, b) > 0) & (y_overlap(a, b) > 0)


def intersection(a: str, b: str) -> Column:
    """The box that two boxes share, null if there is none."""
    inner = make_box(
        F.greatest(_of(a, "x_min"), _of(b, "x_min")), F.greatest(_of(a, "y_min"), _of(b, "y_min")), F.least(_of(a, "x_max"), _of(b, "x_max")), F.least(_of(a, "y_max"), _of(b, "y_max"))
    )
    return F.when(intersects(a, b), inner)


def contains(a: str, b: str, slack: float = 0.0) -> Column:
    """Whether box a holds box b, give or take slack points."""
    return (
        (_of(a, "x_min") <= _of(b, "x_min") + slack) & (_of(a, "y_min") <= _of(b, "y_min") + slack)
        & (_of(a, "x_max") >= _of(b, "x_max") - slack) & (_of(a, "y_max") >= _of(b, "y_max") - slack)
    )


def contains_point(a: str, x: Column, y: Column) -> Column:
    """Whether a point lies in box a or on its edge."""
    return x.between(_of(a, "x_min"), _of(a, "x_max")) & y.between(_of(a, "y_min"), _of(a, "y_max"))


def significant_overlap(a: str, b: str, least_ratio: float, least_height: float) -> Column:
    """Whether two boxes share more height, and more of the smaller one's area, than given."""
    return (y_overlap(a, b) > least_height) & (overlap_ratio(a, b) > least_ratio)


def same_cluster(a: str, b: str, least_ratio: float = 0.45, gap: float = 10.0) -> Column:
    """Whether two boxes stand above each other in one column, with a common height or a small gap."""
    between = F.greatest(_of(a, "y_min"), _of(b, "y_min")) - F.least(_of(a, "y_max"), _of(b, "y_max"))
    return (x_ratio(a, b) >= least_ratio) & (between <= gap)


def conflicts_across(a: str, b: str, least_ratio: float = 0.15, least_length: float = 12.0) -> Column:
    """Whether two boxes get in each other's way if they are moved up or down."""
    return (x_ratio(a, b) >= least_ratio) | (x_overlap(a, b) >= least_length)


def expanded(side: str, pad_x: float, pad_y: float) -> Column:
    """A box with a margin around it."""
    return make_box(_of(side, "x_min") - pad_x, _of(side, "y_min") - pad_y, _of(side, "x_max") + pad_x, _of(side, "y_max") + pad_y)


def clamped(b: Column, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> Column:
    """A box struct cut to the page; what lies outside shrinks to the edge."""

    def cut(v: Column, most: float) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(most))

    return make_box(cut(b.x_min, page_width), cut(b.y_min, page_height), cut(b.x_max, page_width), cut(b.y_max, page_height))


def shifted_inside(side: str = "", page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> Column:
    """A box moved onto the page at its size, null if it is larger than the page."""
    w, h = width(side), height(side)
    x = F.least(F.greatest(_of(side, "x_min"), F.lit(0.0)), F.lit(page_width) - w)
    y = F.least(F.greatest(_of(side, "y_min"), F.lit(0.0)), F.lit(page_height) - h)
    return F.when((w <= page_width) & (h <= page_height), make_box(x, y, x + w, y + h))


def pixels(side: str = "", dpi: float = 200.0, pad: int = 0) -> Column:
    """The pixels that a box in points covers, whole ones, within the page's image."""
    scale = dpi / 72.0
    w, h = int(PAGE_WIDTH * scale), int(PAGE_HEIGHT * scale)

    def low(v: Column) -> Column:
        return F.greatest(F.floor(v * scale).cast("int") - pad, F.lit(0))

    def high(v: Column, most: int) -> Column:
        return F.least(F.ceil(v * scale).cast("int") + pad, F.lit(most))

    return make_box(low(_of(side, "x_min")), low(_of(side, "y_min")), high(_of(side, "x_max"), w), high(_of(side, "y_max"), h))


def line_slice(side: str, index: Column, count: Column) -> Column:
    """The box of one of `count` lines of equal height in a box, from 0."""
    step = height(side) / count
    return make_box(_of(side, "x_min"), _of(side, "y_min") + step * index, _of(side, "x_max"), _of(side, "y_min") + step * (index + 1))


def subtract(rest: Column, cut: Column) -> Column:
    """What is left of a box struct without another one: up to four boxes, above, below, left and right of it."""
    x0, x1 = F.greatest(rest.x_min, cut.x_min), F.least(rest.x_max, cut.x_max)
    y0, y1 = F.greatest(rest.y_min, cut.y_min), F.least(rest.y_max, cut.y_max)
    parts = F.array(
        make_box(rest.x_min, rest.y_min, rest.x_max, y0), make_box(rest.x_min, y1, rest.x_max, rest.y_max), make_box(rest.x_min, y0, x0, y1), make_box(x1, y0, rest.x_max, y1)
    )
    kept = F.filter(parts, lambda b: (b.x_max > b.x_min) & (b.y_max > b.y_min))
    return F.when((x1 > x0) & (y1 > y0), kept).otherwise(F.array(rest))


def subtract_all(whole: Column, cuts: Column) -> Column:
    """What is left of a box struct without an array of others, taken away one after the other."""
    return F.aggregate(cuts, F.array(whole), lambda rest, cut: F.flatten(F.transform(rest, lambda r: subtract(r, cut))))


def total_area(boxes: Column) -> Column:
    """The sum of the areas of an array of boxes."""
    return F.aggregate(boxes, F.lit(0.0), lambda s, b: s + (b.x_max - b.x_min) * (b.y_max - b.y_min))


def union(side: str = "") -> list[Column]:
    """Aggregates for the box around all boxes of a group."""
    return [F.min(_of(side, "x_min")).alias("x_min"), F.min(_of(side, "y_min")).alias("y_min"), F.max(_of(side, "x_max")).alias("x_max"), F.max(_of(side, "y_max")).alias("y_max")]


def union_of(left: Column, right: Column) -> Column:
    """The box around two box structs."""
    return make_box(F.least(left.x_min, right.x_min), F.least(left.y_min, right.y_min), F.greatest(left.x_max, right.x_max), F.greatest(left.y_max, right.y_max))


# ---------------------------------------------------------------------------------------------- joins


def on_page(condition: Column) -> Column:
    """The condition for the sides a and b, within one page."""
    return reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in PAGE)) & condition


def pairs(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Boxes a of `left` and b of `right` on one page for which the condition holds; `how` is a join type."""
    return left.alias("a").join(right.alias("b"), on_page(condition), how)


def with_neighbour(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """The boxes of `left` that have at least one partner in `right`."""
    return pairs(left, right, condition, "left_semi")


def without_neighbour(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """The boxes of `left` that have no partner in `right`."""
    return pairs(left, right, condition, "left_anti")


def best_partner(left: DataFrame, right: DataFrame, condition: Column, order: list[Column], key: str = "pos") -> DataFrame:
    """Each box of `left` with the first of its partners by `order`; ties go to the partner that comes first on the page."""
    w = Window.partitionBy(*(F.col(f"a.{c}") for c in (*PAGE, key))).orderBy(*order, F.col(f"b.{key}"))
    return pairs(left, right, condition).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def vertical_limits(boxes: DataFrame, top: float = 0.0, bottom: float = PAGE_HEIGHT, gap: float = 2.0) -> DataFrame:
    """(document, page, pos, above, below): how far each box may grow up and down until it meets one in its way."""
    thin = boxes.select(*PAGE, "pos", *BOX)
    met = pairs(thin, thin, (F.col("a.pos") != F.col("b.pos")) & conflicts_across("a", "b"), "left")
    above = F.max(F.when(F.col("b.y_max") <= F.col("a.y_min"), F.col("b.y_max") + gap))
    below = F.min(F.when(F.col("b.y_min") >= F.col("a.y_max"), F.col("b.y_min") - gap))
    return met.groupBy("a.document", "a.page", "a.pos").agg(F.coalesce(above, F.lit(top)).alias("above"), F.coalesce(below, F.lit(bottom)).alias("below"))


def dedupe(regions: DataFrame, digits: int = 3) -> DataFrame:
    """One row per box at `digits` decimals and page, with the sorted ids of the blocks that have it."""
    rounded = regions.select(*PAGE, "block_id", *((F.floor(F.col(c) * 10**digits + 0.5) / 10**digits).alias(c) for c in BOX))
    return rounded.groupBy(*PAGE, *BOX).agg(F.array_sort(F.collect_set("block_id")).alias("block_ids"))
