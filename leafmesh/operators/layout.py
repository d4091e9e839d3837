"""Fitting text into boxes: widths, wrapping, stacking, and what is left of a box around others.

The width of a character comes from a rule: an ideograph or full-width sign is as wide as the font is high, anything else
half of that. A renderer with real fonts passes its own function of text to width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmesh.operators import boxes
from leafmesh.operators import text as T
from leafmesh.operators.boxes import PAGE

WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}]"
Width = Callable[[Column], Column]


def units(t: Column) -> Column:
    """Width of a text in halves of the font size."""
    return F.length(t) + F.regexp_count(t, F.lit(WIDE))


def wrap_units(t: Column) -> Column:
    """The pieces between which a line may be broken: words with the space after them, and single wide characters."""
    return F.regexp_extract_all(t, F.lit(f"{WIDE}|[^ \\n\\x{{1100}}-\\x{{115F}}\\x{{2E80}}-\\x{{A4CF}}\\x{{AC00}}-\\x{{D7A3}}\\x{{F900}}-\\x{{FAFF}}\\x{{FE30}}-\\x{{FE4F}}\\x{{FF00}}-\\x{{FF60}}]+ ?| "), 0)


def wrapped(t: Column, most: Column, width: Width = units) -> Column:
    """The lines of a text, each filled with as many pieces as fit in `most`; a piece that is wider stands alone.

    A line feed ends a line. The fold holds one text.
    """
    state = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(s: Column, piece: Column) -> Column:
        fits = (s.now == "") | (width(F.rtrim(F.concat(s.now, piece))) <= most)
        return F.when(fits, F.struct(s.done.alias("done"), F.concat(s.now, piece).alias("now"))).otherwise(F.struct(F.concat(s.done, F.array(F.rtrim(s.now))).alias("done"), piece.alias("now")))

    def lines(p: Column) -> Column:
        return F.aggregate(wrap_units(p), state, step, lambda s: F.concat(s.done, F.array(F.rtrim(s.now))))

    return F.flatten(F.transform(F.split(t, "\n"), lines))


def fitted_size(t: Column, box_width: Column, box_height: Column, sizes: tuple[float, ...] = (14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0, 6.0, 5.0), leading: float = 1.3) -> Column:
    """The largest of the sizes at which a text fits its box, null if none does."""
    out = F.lit(None).cast("double")
    for size in sorted(sizes):
        need = F.size(wrapped(t, F.floor(box_width * 2 / size))) * size * leading
        out = F.when(need <= box_height, size).otherwise(out)
    return out


def required_height(t: Column, box_width: Column, size: float, leading: float = 1.3) -> Column:
    """The height of a text that is wrapped in a box."""
    return F.size(wrapped(t, F.floor(box_width * 2 / F.lit(size)))) * size * leading


def restacked(items: DataFrame, gap: float = 4.0) -> DataFrame:
    """(document, page, group, pos, y_min, y_max): the items of a group set one below the other from the top of the first.

    `items` has document, page, group, pos, y_min and height; an item's place is the sum of what stands above it.
    """
    w = Window.partitionBy(*PAGE, "group").orderBy("pos")
    above = F.coalesce(F.sum(F.col("height") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    top = F.first("y_min").over(w) + above
    return items.select(*PAGE, "group", "pos", top.alias("y_min"), (top + F.col("height")).alias("y_max"))


def free_parts(whole: DataFrame, obstacles: DataFrame, least_width: float = 2.0, least_height: float = 2.0) -> DataFrame:
    """(document, page, block_id, part, x_min, y_min, x_max, y_max): what is left of each box without the obstacles of its page that overlap it.

    Obstacles are taken away in the order of their places; parts below the least size are dropped.
    """
    hit = boxes.pairs(whole.select(*PAGE, "pos", "block_id", *boxes.BOX), obstacles.select(*PAGE, "pos", *boxes.BOX), (F.col("a.pos") != F.col("b.pos")) & boxes.intersects("a", "b"), "left")
    cut = F.struct(F.col("b.pos").alias("pos"), boxes.box("b").alias("box"))
    g = hit.groupBy("a.document", "a.page", "a.block_id", boxes.box("a").alias("whole")).agg(F.array_sort(F.collect_list(F.when(F.col("b.pos").isNotNull(), cut))).alias("cuts"))
    rest = F.filter(boxes.subtract_all(F.col("whole"), F.col("cuts.box")), lambda b: (b.x_max - b.x_min >= least_width) & (b.y_max - b.y_min >= least_height))
    return g.select("document", "page", "block_id", F.posexplode(rest).alias("part", "r")).select("document", "page", "block_id", "part", "r.*")


def uncovered_area(whole: DataFrame, covers: DataFrame) -> DataFrame:
    """(document, page, block_id, area): the area of each box that no cover of its page lies over, if there is any."""
    parts = free_parts(whole, covers, 0.0, 0.0)
    return parts.groupBy("document", "page", "block_id").agg(F.sum((F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))).alias("area")).where("area > 0.01")


def heading_pairs(blocks: DataFrame, gap: float = 90.0) -> DataFrame:
    """(document, page, number_id, title_id): section numbers that stand alone with the title to the right of them on their line.

    A number takes the nearest title; of several numbers that would take a title the nearest one keeps it.
    """
    b = blocks.select(*PAGE, "pos", "block_id", *boxes.BOX, "text")
    numbers = b.where(T.heading_number(F.col("text")) != "")
    titles = b.where(T.is_heading(F.col("text")) & (T.heading_number(F.col("text")) == ""))
    right = (F.col("b.x_min") - F.col("a.x_max")).between(0, gap) & (boxes.y_ratio("a", "b") >= 0.45)
    near = boxes.best_partner(numbers, titles, right, [F.col("b.x_min") - F.col("a.x_max")])
    rows = near.select(F.col("a.document").alias("document"), F.col("a.page").alias("page"), F.col("a.block_id").alias("number_id"), F.col("b.block_id").alias("title_id"), (F.col("b.x_min") - F.col("a.x_max")).alias("gap"), F.col("a.pos").alias("pos"))
    w = Window.partitionBy(*PAGE, "title_id").orderBy("gap", "pos")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select(*PAGE, "number_id", "title_id")


def style_of(t: Column, cls: Column) -> Column:
    """The style of a block by its class; subheadings are headings with a number of two parts or more."""
    return (
        F.when((cls == "heading") & t.rlike(r"^[0-9]+\.[0-9]"), "subheading").when(cls == "heading", "heading").when(cls == "caption", "caption").when(cls.isin("reference", "reference_heading"), "reference")
        .when(cls.isin("page_number", "furniture"), "footer").otherwise("body")
    )


#: Sizes of the styles in points, and how far a block's own may be from them.
STYLE_SIZES = {"heading": 13.0, "subheading": 11.5, "body": 10.0, "caption": 9.0, "reference": 8.5, "footer": 8.0}


def style_size(style: Column) -> Column:
    out = F.lit(STYLE_SIZES["body"])
    for name, size in STYLE_SIZES.items():
        out = F.when(style == name, size).otherwise(out)
    return out


def style_order_errors() -> list[str]:
    """Styles whose size isn't below that of the style before them."""
    sizes = list(STYLE_SIZES.items())
    return [f"{a} must be larger than {b}" for (a, x), (b, y) in zip(sizes, sizes[1:], strict=False) if x <= y]
