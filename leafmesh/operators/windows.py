"""What stands near a block: captions and what they belong to, cells in a row, fragments and where they go, lines in a band.

All are joins of the blocks of one page with a condition on their boxes, and a rank where one partner is to be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmesh.operators import boxes
from leafmesh.operators import text as T
from leafmesh.operators.boxes import BOX, PAGE


def caption_windows(blocks: DataFrame, above: float = 140.0, slack: float = 8.0) -> DataFrame:
    """(document, page, caption_id, blocks, x_min, y_min, x_max, y_max): each caption with the blocks in a band above it that lie across it."""
    b = blocks.select(*PAGE, "pos", "block_id", *BOX, "text")
    captions = b.where(T.is_caption(F.col("text")))
    band = (F.col("b.y_max") <= F.col("a.y_min") + slack) & (F.col("b.y_min") >= F.col("a.y_min") - above) & (boxes.x_overlap("a", "b") > 0) & ~T.is_prose(F.col("b.text")) & ~T.is_caption(F.col("b.text"))
    hit = boxes.pairs(captions, b, (F.col("a.pos") != F.col("b.pos")) & band)
    return hit.groupBy("a.document", "a.page", F.col("a.block_id").alias("caption_id")).agg(F.count("*").alias("blocks"), *boxes.union("b"))


def row_aligned(blocks: DataFrame, seeds: Column, gap: float = 130.0, share: float = 0.45, widest: float = 360.0) -> DataFrame:
    """(document, page, block_id): blocks without prose that stand in one row with a block for which `seeds` holds."""
    b = blocks.select(*PAGE, "pos", "block_id", *BOX, "text", T.yes(seeds).alias("seed"))
    apart = F.greatest(F.col("a.x_min"), F.col("b.x_min")) - F.least(F.col("a.x_max"), F.col("b.x_max"))
    near = (F.col("a.pos") != F.col("b.pos")) & (boxes.y_ratio("a", "b") >= share) & (apart <= gap) & (boxes.width("a") <= widest)
    return boxes.with_neighbour(b.where(~T.is_prose(F.col("text"))), b.where("seed"), near).select(*PAGE, "block_id")


def fragment_targets(blocks: DataFrame, longest: int = 30, reach: float = 96.0, share: float = 0.35) -> DataFrame:
    """(document, page, fragment_id, target_id, distance): the nearest text above or below each short fragment, in its column.

    Distance is white space down the page; of equals the block that comes first is taken. Fragments are texts of one or two
    words that need no translation of their own.
    """
    b = blocks.select(*PAGE, "pos", "block_id", *BOX, "text")
    words = F.size(T.tokens(F.col("text")))
    short = b.where(T.yes((F.length(T.flat(F.col("text"))) <= longest) & words.between(1, 2) & ~T.needs_translation(F.col("text"))))
    distance = F.greatest(F.lit(0.0), F.greatest(F.col("a.y_min"), F.col("b.y_min")) - F.least(F.col("a.y_max"), F.col("b.y_max")))
    near = (F.col("a.pos") != F.col("b.pos")) & (boxes.x_ratio("a", "b") >= share) & (distance <= reach)
    best = boxes.best_partner(short, b.where(T.is_prose(F.col("text"))), near, [distance])
    return best.select(F.col("a.document").alias("document"), F.col("a.page").alias("page"), F.col("a.block_id").alias("fragment_id"), F.col("b.block_id").alias("target_id"), distance.alias("distance"))


def in_band(blocks: DataFrame, above: float = 20.0, below: float = 20.0) -> DataFrame:
    """(document, page, block_id, rows, first_id, last_id): the blocks whose middle lies in a band around each prose block."""
    b = blocks.select(*PAGE, "pos", "block_id", *BOX, "text")
    middle = boxes.center("b")[1]
    hit = boxes.pairs(b.where(T.is_prose(F.col("text"))), b, middle.between(F.col("a.y_min") - above, F.col("a.y_max") + below))
    at = F.struct(F.col("b.y_min"), F.col("b.x_min"), F.col("b.pos"))
    return hit.groupBy("a.document", "a.page", "a.block_id").agg(F.count("*").alias("rows"), F.min_by("b.block_id", at).alias("first_id"), F.max_by("b.block_id", at).alias("last_id"))


def contained_fragments(blocks: DataFrame, part: float = 6.0) -> DataFrame:
    """(document, page, fragment_id, holder_id, place): small blocks that lie in a block at least `part` times as large, by how far down they stand.

    A fragment goes to the smallest block that holds it; place counts the fragments of a holder from the top.
    """
    b = blocks.select(*PAGE, "pos", "block_id", *BOX)
    inside = (F.col("a.pos") != F.col("b.pos")) & boxes.contains("b", "a", 1.5) & (boxes.area("b") >= boxes.area("a") * part)
    best = boxes.best_partner(b, b, inside, [boxes.area("b")])
    rows = best.select(F.col("a.document").alias("document"), F.col("a.page").alias("page"), F.col("a.block_id").alias("fragment_id"), F.col("b.block_id").alias("holder_id"), F.col("a.y_min").alias("y"), F.col("a.pos").alias("pos"))
    w = Window.partitionBy(*PAGE, "holder_id").orderBy("y", "pos")
    return rows.withColumn("place", F.row_number().over(w)).drop("y", "pos")


def grown(items: DataFrame, gap: float = 2.0) -> DataFrame:
    """(document, page, pos, y_min, y_max, fits): boxes grown to the height that they need, down first and then up.

    `items` has the box and the column `need`. A box grows until it meets another in its way; neighbours are taken where
    they stood before anything grew.
    """
    limits = boxes.vertical_limits(items, gap=gap)
    joined = items.select(*PAGE, "pos", "y_min", "y_max", "need").join(limits, [*PAGE, "pos"])
    bottom = F.greatest(F.col("y_max"), F.least(F.col("below"), F.col("y_min") + F.col("need")))
    top = F.least(F.col("y_min"), F.greatest(F.col("above"), bottom - F.col("need")))
    return joined.select(*PAGE, "pos", top.alias("y_min"), bottom.alias("y_max"), (bottom - top >= F.col("need") - 1e-6).alias("fits"))


def numbered_in_order(blocks: DataFrame) -> DataFrame:
    """(document, page, block_id, number, y_min): numbered items of a page set in the order of their numbers.

    Where the numbers follow each other without a gap, the k-th number takes the k-th place from the top; else nothing moves.
    """
    n = T.enumeration_start(F.col("text"))
    b = blocks.select(*PAGE, "pos", "block_id", "y_min", n.alias("number")).where("number is not null")
    page = Window.partitionBy(*PAGE)
    ranked = b.withColumn("by_number", F.row_number().over(page.orderBy("number", "pos"))).withColumn("by_place", F.row_number().over(page.orderBy("y_min", "pos")))
    ranked = ranked.withColumn("whole", F.max("number").over(page) - F.min("number").over(page) + 1 == F.count("*").over(page))
    places = ranked.select(*PAGE, F.col("by_place").alias("by_number"), F.col("y_min").alias("slot"))
    joined = ranked.join(places, [*PAGE, "by_number"])
    return joined.select(*PAGE, "block_id", "number", F.when(F.col("whole"), F.col("slot")).otherwise(F.col("y_min")).alias("y_min"))


def first_page_roles(blocks: DataFrame) -> DataFrame:
    """(document, page, block_id, role): what the blocks above the first prose of a document's first page are: title, authors or other."""
    first = blocks.groupBy("document").agg(F.min("page").alias("page"))
    b = blocks.join(first, ["document", "page"], "left_semi").where(~T.yes((F.col("y_min") < 62) | (F.col("y_min") > 745)))
    w = Window.partitionBy("document").orderBy("pos")
    marked = b.select(*PAGE, "pos", "block_id", "text", F.sum(T.is_prose(F.col("text")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("prose"), F.row_number().over(w).alias("k"))
    names = T.yes(T.flat(F.col("text")).rlike(r"^[A-Z][A-Za-z.-]*( [A-Z][A-Za-z.-]*){1,3}$")) & (F.col("k") > 1)
    role = F.when((F.col("k") == 1) & T.is_heading(F.col("text")), "title").when(names, "authors").otherwise("other")
    return marked.where("prose = 0").select(*PAGE, "block_id", role.alias("role"))


def across_pages(blocks: DataFrame, least_pages: int = 3, digits: int = 0) -> DataFrame:
    """(document, block_id, page, pages): blocks that stand at the same place, to the point, on several pages of a document."""
    at = [F.floor(F.col(c) * 10**digits + 0.5).alias(f"_{c}") for c in ("x_min", "y_min")]
    b = blocks.select(*PAGE, "block_id", *at)
    often = b.groupBy("document", "_x_min", "_y_min").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    return b.join(often, ["document", "_x_min", "_y_min"]).select("document", "block_id", "page", "pages")


def worst_by_document(scores: DataFrame, most: int = 5) -> DataFrame:
    """(document, blocks, worst, ids): the count and least of the scores of each document, and the blocks with the least ones."""
    rank = F.row_number().over(Window.partitionBy("document").orderBy("similarity", "page", "block_id"))
    ranked = scores.withColumn("rank", rank)
    return ranked.groupBy("document").agg(F.count("*").alias("blocks"), F.min("similarity").alias("worst"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "block_id")))).alias("top")).select("document", "blocks", "worst", F.array_join("top.block_id", ",").alias("ids"))
