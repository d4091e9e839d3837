"""From pages to translated, checked plans: the stages put together, each a table that can be written and taken up again.

The model that translates is a function of rows that runs on the executors; what it gave is kept by request key, and a later
run sends only what isn't there. Nothing is gathered by the driver but the answer to whether there are errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmesh import records
from leafmesh.operators import boxes, clusters, layout, plans
from leafmesh.operators import text as T
from leafmesh.operators.boxes import BOX, PAGE
from leafmesh.session import written

Executor = Callable[[list[dict]], list[str]]


@dataclass(frozen=True)
class Options:
    """What a run can be told: characters of a batch, model and effort for the request keys, and attempts per request."""

    batch_characters: int = 10_000
    model: str = "default"
    effort: str = "medium"
    attempts: int = 3


def components(blocks: DataFrame) -> DataFrame:
    """(document, page, component_id, kind, block_ids, x_min, y_min, x_max, y_max): each block in one component.

    Blocks kept as images are put together by the region they grow into; every other block is a component of its class.
    """
    image = F.coalesce("preserve_image", F.lit(False))
    regions = clusters.merged_regions(blocks.where(image)).withColumnRenamed("cluster", "region")
    b = blocks.select(*PAGE, "pos", "block_id", *BOX, F.when(image, "image").otherwise(plans.class_of()).alias("kind")).join(regions, [*PAGE, "block_id"], "left")
    group = F.when(F.col("region").isNotNull(), F.concat(F.lit("r"), "region")).otherwise(F.concat(F.lit("b"), "pos"))
    g = b.groupBy(*PAGE, group.alias("g")).agg(F.min("kind").alias("kind"), F.array_sort(F.collect_set("block_id")).alias("block_ids"), F.min("pos").alias("first"), *boxes.union())
    return g.select(*PAGE, T.component_id(F.col("page"), F.col("first")).alias("component_id"), "kind", "block_ids", *BOX)


def owners(component_rows: DataFrame) -> DataFrame:
    """(document, page, component_id, block_id): the ledger of who owns what."""
    return component_rows.select(*PAGE, "component_id", F.explode(F.array_distinct("block_ids")).alias("block_id"))


def items(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(document, page, pos, block_id, kind, x_min.., text, style, size): how each block is to be drawn.

    Images, formulas and cells stay as they are, furniture is skipped, and text is the answer, or the source where there is
    none that can be used.
    """
    cls = plans.class_of()
    b = blocks.select(*PAGE, "pos", "block_id", *BOX, "text", "preserve_image", cls.alias("class")).join(answers, [*PAGE, "block_id"], "left")
    kind = F.when(F.coalesce("preserve_image", F.lit(False)) | F.col("class").isin("formula", "cell"), "image").when(F.col("class").isin("empty", "page_number", "furniture"), "skip").otherwise("text")
    usable = F.col("answer").isNotNull() & ~T.is_blank(F.col("answer")) & ~T.is_untranslated(F.col("text"), F.col("answer"))
    text = F.when(kind == "text", F.when(usable, T.with_terminal_marks(T.normalized_translation(F.col("answer")))).otherwise(F.col("text")))
    style = layout.style_of(F.col("text"), F.col("class"))
    return b.select(*PAGE, "pos", "block_id", kind.alias("kind"), *BOX, text.alias("text"), style.alias("style"), layout.style_size(style).alias("size"))


def checks(blocks: DataFrame, plan_items: DataFrame, component_rows: DataFrame) -> DataFrame:
    """The issues of all validators over blocks, items and components."""
    out = plans.ownership_issues(owners(component_rows), blocks)
    texts = plan_items.where("kind = 'text'").withColumn("preserve_image", F.lit(False))
    for part in (plans.bounds_issues(plan_items), plans.overlap_issues(texts), plans.noise_issues(texts), plans.headings_in_body(texts), fit_issues(plan_items)):
        out = out.unionByName(part)
    return out


def fit_issues(plan_items: DataFrame) -> DataFrame:
    """Texts that fit their box at no size."""
    t = plan_items.where("kind = 'text' and text is not null and text <> ''")
    size = layout.fitted_size(F.col("text"), boxes.width(), boxes.height())
    return t.where(size.isNull()).select(*PAGE, *plans.issue("text_fit", "warning", F.col("block_id"), F.array("block_id")))


def requests(blocks: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(document, page, batch, blocks, request_key, items): the batches to be translated, with their texts in order."""
    packed = plans.pack(blocks, options.batch_characters)
    keys = plans.request_keys(blocks, packed, options.model, options.effort)
    texts = packed.join(blocks.select(*PAGE, "block_id", "text"), [*PAGE, "block_id"]).groupBy(*PAGE, "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "text"))).alias("items"))
    return keys.join(texts, [*PAGE, "batch"])


def with_attempts(execute: Callable[[dict], dict[str, str]], attempts: int) -> Executor:
    """A function of rows that asks once more, up to `attempts` times, where an answer is missing or blank or asking fails.

    Each answer is JSON of block id to text; what could not be had is left out of it.
    """
    import json

    def run(rows: list[dict]) -> list[str]:
        out = []
        for row in rows:
            wanted = {i["block_id"] for i in row["items"]}
            best: dict[str, str] = {}
            for _ in range(max(1, attempts)):
                try:
                    got = {k: v for k, v in execute(row).items() if k in wanted and v and v.strip()}
                except Exception:  # noqa: BLE001  a failed request is asked again
                    got = {}
                best |= got
                if set(best) == wanted:
                    break
            out.append(json.dumps(best, ensure_ascii=False, sort_keys=True))
        return out

    return run


def answered(request_rows: DataFrame) -> DataFrame:
    """(document, page, block_id, answer) of requests with their answers as JSON."""
    parsed = request_rows.select(*PAGE, F.from_json("answer", "map<string,string>").alias("m"))
    return parsed.select(*PAGE, F.explode("m").alias("block_id", "answer"))


def translate(blocks: DataFrame, execute: Callable[[dict], dict[str, str]], cache: DataFrame | None = None, options: Options = Options()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(answers, cache): the answers to all blocks that need one, and the cache (request_key, answer) with what was new.

    What the model gave is written before it is used, so it is not asked again if a task is lost later.
    """
    due = requests(blocks, options)
    if cache is not None:
        hit, miss = plans.resume(due, cache.select("request_key", "answer").dropDuplicates(["request_key"]))
    else:
        hit, miss = None, due
    fresh = written(plans.run_batches(miss, with_attempts(execute, options.attempts)), "answers")
    everything = fresh if hit is None else hit.select(fresh.columns).unionByName(fresh)
    kept = fresh.select("request_key", "answer")
    return answered(everything), kept if cache is None else cache.select("request_key", "answer").unionByName(kept)


def run(blocks: DataFrame, execute: Callable[[dict], dict[str, str]], cache: DataFrame | None = None, options: Options = Options()) -> dict[str, DataFrame]:  # noqa: B008
    """The tables of a run: answers, cache, components, items, ledger, coverage, issues and plans."""
    answers, kept = translate(blocks, execute, cache, options)
    component_rows = components(blocks)
    plan_items = items(blocks, answers)
    ledger = plans.ledger(blocks, answers)
    return {
        "answers": answers, "cache": kept, "components": component_rows, "items": plan_items, "ledger": ledger, "coverage": plans.coverage(ledger),
        "issues": checks(blocks, plan_items, component_rows), "plans": records.page_plans(plan_items, ledger),
    }


def has_errors(issues: DataFrame) -> bool:
    """Whether any issue is an error; the gate before anything is published."""
    return not issues.where("severity = 'error'").isEmpty()
