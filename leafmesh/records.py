"""The records that plans are made of, and their JSON: items, spans, components, issues, ledgers and whole pages.

JSON objects have their keys in alphabetical order and no missing values, so equal records give equal strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmesh.operators.boxes import BOX, PAGE

SPAN = "struct<block_id: string, start: int, end: int>"
ITEM = "struct<kind: string, block_ids: array<string>, bbox: array<double>, text: string, style: string, size: double>"
COMPONENT = "struct<component_id: string, kind: string, block_ids: array<string>, bbox: array<double>, confidence: string, reasons: array<string>>"
COVERAGE = "struct<block_id: string, class: string, kind: string, rendered: boolean, reason: string>"
PLAN = f"struct<coverage: array<{COVERAGE}>, items: array<{ITEM}>, page: int>"
KINDS = ("text", "image", "skip")
CONFIDENCES = ("high", "medium", "low")


def slice_spans(spans: Column, start: Column, end: Column) -> Column:
    """The part of a list of ranges that lies between two offsets into the text that the ranges make when put together."""
    state = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = x["end"] - x["start"]
        low, high = F.greatest(start - s["at"], F.lit(0)), F.least(end - s["at"], size)
        piece = F.struct(x["block_id"].alias("block_id"), (x["start"] + low).cast("int").alias("start"), (x["start"] + high).cast("int").alias("end"))
        return F.struct((s["at"] + size).cast("int").alias("at"), F.when(low < high, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    return F.aggregate(spans, state, step, lambda s: s["out"])


def bbox(digits: int | None = 3) -> Column:
    """The four columns of a box as an array."""
    return F.array(*(F.col(c) if digits is None else F.round(c, digits) for c in BOX))


def issue_json() -> Column:
    """A row of issues as JSON, with its blocks in order."""
    return F.to_json(F.struct(F.array_sort("block_ids").alias("block_ids"), F.col("check"), F.col("message"), F.col("page"), F.col("severity")))


def sorted_json(pairs: Column) -> Column:
    """A map of strings as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def page_plans(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """(document, page, json): each page's items and coverage as one JSON object.

    `items` is (document, page, pos, kind, block_id, x_min.., text, style, size), `ledger` (document, page, block_id, class, status).
    A page's rows are gathered; pages are small and are spread by their key.
    """
    item = F.struct(F.col("kind"), F.array("block_id").alias("block_ids"), bbox().alias("bbox"), F.col("text"), F.col("style"), F.col("size").cast("double").alias("size"))
    listed = items.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), item.alias("item")))).alias("i"))
    entry = F.struct(F.col("block_id"), F.col("class"), F.when(F.col("status") == "kept", "skip").otherwise("text").alias("kind"), (F.col("status") == "translated").alias("rendered"), F.col("status").alias("reason"))
    covered = ledger.groupBy(*PAGE).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    joined = listed.join(covered, [*PAGE], "full_outer")
    empty_items, empty_coverage = F.expr(f"cast(array() as array<{ITEM}>)"), F.expr(f"cast(array() as array<{COVERAGE}>)")
    plan = F.struct(F.coalesce("c", empty_coverage).alias("coverage"), F.coalesce(F.col("i.item").cast(f"array<{ITEM}>"), empty_items).alias("items"), F.col("page").cast("int").alias("page"))
    return joined.select(*PAGE, F.to_json(plan).alias("json"))


def plan_problems(plans: DataFrame) -> DataFrame:
    """(document, page, place, problem): what is wrong with plans given as JSON (document, page, json).

    unreadable, wrong_page, unknown_kind, bad_box (not four numbers in order), no_blocks, and uncovered for items whose block
    has no entry of coverage. `place` is the number of the item, -1 for the plan itself.
    """
    parsed = plans.select(*PAGE, F.from_json("json", PLAN).alias("p"))
    whole = F.array_compact(F.array(F.when(F.col("p").isNull() | F.col("p.items").isNull(), "unreadable"), F.when(F.col("p.page") != F.col("page"), "wrong_page")))
    top = parsed.select(*PAGE, F.lit(-1).alias("place"), F.explode(whole).alias("problem"))
    items = parsed.select(*PAGE, F.col("p.coverage.block_id").alias("covered"), F.posexplode("p.items").alias("place", "i"))
    b = F.col("i.bbox")
    good = (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e9)) & (b[0] <= b[2]) & (b[1] <= b[3])
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("i.kind").isin(*KINDS), F.lit(False)), "unknown_kind"), F.when(~F.coalesce(good, F.lit(False)), "bad_box"), F.when(F.coalesce(F.size("i.block_ids"), F.lit(0)) <= 0, "no_blocks"),
            F.when(F.size(F.array_except(F.col("i.block_ids"), F.coalesce("covered", F.array().cast("array<string>")))) > 0, "uncovered"),
        )
    )
    return items.select(*PAGE, "place", F.explode(problems).alias("problem")).unionByName(top)
