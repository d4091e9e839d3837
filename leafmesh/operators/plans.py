"""Order, neighbourhood and duty of the blocks of pages: running headers, flows, batches, ledgers, validators and reports.

Inputs are blocks as `leafmesh.pages.blocks` gives them. Windows are partitioned by page or by document and ordered by
columns that make the order total, so results don't depend on how the input is split. Validators give rows of
(document, page, check, severity, message, block_ids); no row means that nothing is wrong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmesh.operators import boxes
from leafmesh.operators import text as T
from leafmesh.operators.boxes import BOX, PAGE

ISSUES = ("document", "page", "check", "severity", "message", "block_ids")
SEVERITIES = {"info": 0, "warning": 1, "error": 2}


def issue(check: str, severity: str, message: Column, ids: Column) -> list[Column]:
    """The columns of a row of issues, beside document and page."""
    return [F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"), F.array_sort(ids).alias("block_ids")]


def severity_rank(severity: Column) -> Column:
    """0, 1 and 2 for info, warning and error; -1 for anything else."""
    out = F.lit(-1)
    for name, rank in SEVERITIES.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


# ---------------------------------------------------------------------------------------------- classes of blocks


def class_of(t: Column = None, y: Column = None) -> Column:  # noqa: RUF013
    """The class of a block by the first rule that holds."""
    t = F.col("text") if t is None else t
    y = F.col("y_min") if y is None else y
    margin = T.yes((y < 62) | (y > 745))
    return (
        F.when(t.isNull() | T.is_blank(t), "empty")
        .when(margin & T.is_decorated_page_number(t), "page_number")
        .when(margin, "furniture")
        .when(T.is_caption(t), "caption")
        .when(T.is_reference_heading(t), "reference_heading")
        .when(T.is_reference_item(t), "reference")
        .when(T.is_formula(t) | T.is_equation_label(t), "formula")
        .when(T.is_numeric_column(t) | T.is_metric_cell(t), "cell")
        .when(T.is_statement(t), "statement")
        .when(T.is_heading(t), "heading")
        .when(T.is_prose(t), "prose")
        .otherwise("other")
    )


def references_from(blocks: DataFrame) -> DataFrame:
    """(document, first_page, first_y): where the list of references of a document begins, by its first heading or entry."""
    marked = blocks.where(T.is_reference_heading(F.col("text")) | T.is_reference_item(F.col("text")))
    first = marked.groupBy("document").agg(F.min(F.struct("page", "y_min")).alias("f"))
    return first.select("document", F.col("f.page").alias("first_page"), F.col("f.y_min").alias("first_y"))


def reference_state(blocks: DataFrame) -> DataFrame:
    """(document, page, in_references): whether the list of references has begun on an earlier page and not ended.

    A page whose first heading outside the margins is another one than that of the references ends it. One row per page is
    folded, by two running maxima, so a document of any length is never gathered.
    """
    body = blocks.where(~T.yes((F.col("y_min") < 62) | (F.col("y_min") > 745)))
    opens = F.max((T.is_reference_heading(F.col("text")) | T.is_reference_item(F.col("text"))).cast("int"))
    ends = F.max((T.is_heading(F.col("text")) & ~T.is_reference_heading(F.col("text")) & F.col("text").rlike(r"^[0-9]")).cast("int"))
    per_page = body.groupBy(*PAGE).agg(opens.alias("opens"), ends.alias("ends"))
    w = Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.max(F.when(F.col("opens") == 1, F.col("page"))).over(w)
    ended = F.max(F.when((F.col("ends") == 1) & (F.col("opens") == 0), F.col("page"))).over(w)
    return per_page.select(*PAGE, F.coalesce((opened >= ended) | (opened.isNotNull() & ended.isNull()), F.lit(False)).alias("in_references"))


def running_headers(blocks: DataFrame, least_pages: int = 2) -> DataFrame:
    """(document, page, block_id, header): blocks in margins whose first line, in letters, stands on several pages."""
    lines = blocks.where(T.yes((F.col("y_min") < 62) | (F.col("y_min") > 745))).select(*PAGE, "block_id", F.regexp_replace(F.lower(T.first_line(F.col("text"))), "[^a-z]+", "").alias("header")).where("header <> ''")
    often = lines.groupBy("document", "header").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= least_pages).select("document", "header")
    return lines.join(often, ["document", "header"], "left_semi").select(*PAGE, "block_id", "header")


def nested_duplicates(blocks: DataFrame, least_share: float = 0.85, larger: float = 2.5, least_text: int = 8) -> DataFrame:
    """(document, page, block_id): blocks that lie in a much larger block whose text holds theirs."""
    b = blocks.select(*PAGE, "block_id", *BOX, T.compact_with_cjk(F.col("text")).alias("plain"))
    inside = (
        (F.col("a.block_id") != F.col("b.block_id")) & (boxes.area("b") > boxes.area("a") * larger) & (boxes.overlap_area("a", "b") >= boxes.area("a") * least_share)
        & (F.length("a.plain") >= least_text) & F.col("b.plain").contains(F.col("a.plain"))
    )
    return boxes.with_neighbour(b, b, inside).select(*PAGE, "block_id").distinct()


def repeated_texts(blocks: DataFrame, least_text: int = 8) -> DataFrame:
    """(document, page, block_id, first_id): blocks whose text stands earlier on the page, with the first block that has it."""
    b = blocks.select(*PAGE, "pos", "block_id", T.compact_with_cjk(F.col("text")).alias("plain")).where(F.length("plain") >= least_text)
    first = F.first("block_id").over(Window.partitionBy(*PAGE, "plain").orderBy("pos"))
    return b.withColumn("first_id", first).where("first_id <> block_id").select(*PAGE, "block_id", "first_id")


# ---------------------------------------------------------------------------------------------- order and flow


def neighbours(blocks: DataFrame) -> DataFrame:
    """(document, page, block_id, previous_id, next_id) in the order of extraction."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    return blocks.select(*PAGE, "block_id", F.lag("block_id").over(w).alias("previous_id"), F.lead("block_id").over(w).alias("next_id"))


def flows(blocks: DataFrame, gap: float = 16.0, share: float = 0.55) -> DataFrame:
    """(document, page, flow, blocks, x_min, y_min, x_max, y_max, first_id): runs of blocks that go on down one column.

    In the order of extraction a block belongs to the flow of the one before it if it begins at most `gap` below its end and
    shares at least `share` of the narrower width.
    """
    w = Window.partitionBy(*PAGE).orderBy("pos")
    b = blocks.select(*PAGE, "pos", "block_id", *BOX).withColumn("p", F.lag(F.struct(*BOX)).over(w))
    shared = F.greatest(F.lit(0.0), F.least("x_max", "p.x_max") - F.greatest("x_min", "p.x_min"))
    narrow = F.least(F.col("x_max") - F.col("x_min"), F.col("p.x_max") - F.col("p.x_min"))
    same = F.coalesce((F.col("y_min") - F.col("p.y_max") <= gap) & (F.col("y_min") >= F.col("p.y_min")) & (narrow > 0) & (shared >= narrow * share), F.lit(False))
    numbered = b.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("flow", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*PAGE, "flow").agg(F.count("*").alias("blocks"), *boxes.union(), F.min_by("block_id", "pos").alias("first_id"))


def wide_gaps(blocks: DataFrame, least: float = 32.0) -> DataFrame:
    """(document, page, block_id, next_id, gap): white space down a page between a block and the next one below it in its column.

    Gaps in which another block stands in the way aren't reported.
    """
    b = blocks.select(*PAGE, "pos", "block_id", *BOX)
    below = (F.col("b.y_min") >= F.col("a.y_max")) & (boxes.x_ratio("a", "b") >= 0.55)
    nearest = boxes.best_partner(b, b, below & (F.col("a.pos") != F.col("b.pos")), [F.col("b.y_min")])
    gaps = nearest.select(F.col("a.document").alias("document"), F.col("a.page").alias("page"), F.col("a.block_id").alias("block_id"), F.col("b.block_id").alias("next_id"), (F.col("b.y_min") - F.col("a.y_max")).alias("gap"),
                          F.greatest("a.x_min", "b.x_min").alias("x_min"), F.col("a.y_max").alias("y_min"), F.least("a.x_max", "b.x_max").alias("x_max"), F.col("b.y_min").alias("y_max")).where(F.col("gap") > least)
    return boxes.without_neighbour(gaps, b, boxes.intersects("a", "b")).select(*PAGE, "block_id", "next_id", "gap")


def page_splits(blocks: DataFrame) -> DataFrame:
    """(document, page, block_id, next_page, next_id): the last prose of a page and the first of the next, if a sentence goes on."""
    prose = blocks.where(~T.yes((F.col("y_min") < 62) | (F.col("y_min") > 745)) & T.is_prose(F.col("text"))).select(*PAGE, "pos", "block_id", "text")
    ends = prose.groupBy(*PAGE).agg(F.max_by(F.struct("block_id", "text"), "pos").alias("last"), F.min_by(F.struct("block_id", "text"), "pos").alias("first"))
    w = Window.partitionBy("document").orderBy("page")
    ahead = ends.withColumn("next_page", F.lead("page").over(w)).withColumn("next", F.lead("first").over(w)).where("next_page = page + 1")
    open_ = ahead.where(T.goes_on(F.col("last.text")) & T.starts_inside(F.col("next.text")))
    return open_.select(*PAGE, F.col("last.block_id").alias("block_id"), "next_page", F.col("next.block_id").alias("next_id"))


def outline(blocks: DataFrame) -> DataFrame:
    """(document, number, page, block_id, level, title): the headings of a document, each at most one level below the one before.

    The level that a heading gets depends on the level that the one before it got. Written out, it is the least of its own
    depth plus nothing and of any earlier depth plus the headings since: a running minimum of depth minus place.
    """
    heads = blocks.where(~T.yes((F.col("y_min") < 62) | (F.col("y_min") > 745)) & T.is_heading(F.col("text")))
    heads = heads.select(*PAGE, "pos", "block_id", T.flat(F.col("text")).alias("title"), T.heading_level(F.col("text")).alias("depth"))
    heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("document", "page", "title", "depth").orderBy("pos"))).where("k = 1").drop("k")
    w = Window.partitionBy("document").orderBy("page", "pos")
    placed = heads.withColumn("number", F.row_number().over(w))
    least = F.min(F.col("depth") - F.col("number")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("number")
    return placed.select("document", "number", "page", "block_id", F.least(F.col("depth"), least, F.col("number")).cast("int").alias("level"), "title")


def title_maps(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(document, title, first_answer, last_answer): the first and last translation of each title of a document."""
    heads = blocks.where(T.is_heading(F.col("text"))).select(*PAGE, "pos", "block_id", F.lower(T.flat(F.col("text"))).alias("title"))
    joined = heads.join(answers.where("answer is not null"), [*PAGE, "block_id"])
    at = F.struct("page", "pos")
    return joined.groupBy("document", "title").agg(F.min_by("answer", at).alias("first_answer"), F.max_by("answer", at).alias("last_answer"))


# ---------------------------------------------------------------------------------------------- batches


def pack(blocks: DataFrame, most: int = 2000) -> DataFrame:
    """(document, page, pos, block_id, batch): blocks that need a translation, packed in order into batches of at most `most` characters.

    A batch holds one block at least. Batches stay within a page, so the fold runs over the lengths of one page's blocks.
    """
    asked = blocks.where(T.needs_translation(F.col("text"))).select(*PAGE, "pos", "block_id", F.length("text").alias("size"))
    listed = asked.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "size"))).alias("items"))
    state = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = (s.batch > 0) & (s.used + x["size"] <= most)
        batch = F.when(fits, s.batch).otherwise(s.batch + 1)
        return F.struct(batch.alias("batch"), F.when(fits, s.used + x["size"]).otherwise(x["size"]).alias("used"), F.concat(s.out, F.array(batch)).alias("out"))

    packed = listed.withColumn("batches", F.aggregate("items", state, step, lambda s: s.out))
    rows = packed.select(*PAGE, F.explode(F.arrays_zip("items", "batches")).alias("z"))
    return rows.select(*PAGE, F.col("z.items.pos").alias("pos"), F.col("z.items.block_id").alias("block_id"), F.col("z.batches").alias("batch"))


def request_keys(blocks: DataFrame, batches: DataFrame, model: str = "default", effort: str = "medium") -> DataFrame:
    """(document, page, batch, blocks, request_key): the hash by which the answer to a batch is kept and found again."""
    joined = batches.join(blocks.select(*PAGE, "block_id", "text"), [*PAGE, "block_id"])
    items = F.array_sort(F.collect_list(F.struct("pos", "block_id", "text")))
    body = F.array_join(F.transform(items, lambda x: F.concat(x.block_id, F.lit("\x1f"), x.text)), "\x1e")
    keyed = joined.groupBy(*PAGE, "batch").agg(F.count("*").alias("blocks"), body.alias("body"))
    return keyed.select(*PAGE, "batch", "blocks", F.sha2(F.concat(F.lit(f"{model}\x1e{effort}\x1e"), "body"), 256).alias("request_key"))


def resume(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache answers, with the answer, and those that are still to be sent."""
    return requests.join(cache, "request_key"), requests.join(cache, "request_key", "left_anti")


def run_batches(requests: DataFrame, execute: Callable[[list[dict]], list[str]], answer: str = "answer") -> DataFrame:
    """The requests with what `execute` gives back for them; it gets the rows of an Arrow batch and is called on the executors.

    The result is to be written before it is used twice, since a lost task calls it again.
    """
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = batch.to_pylist()
            yield batch.append_column(answer, pa.array(execute(rows) if rows else [], pa.string()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInArrow(run, f"{ddl}, `{answer}` string")


def payload_issues(expected: DataFrame, payload: DataFrame) -> DataFrame:
    """Issues of a response (document, page, block_id, answer) against the blocks that were sent: missing, unknown, doubled, blank."""
    sent, got = expected.select(*PAGE, "block_id").distinct(), payload.select(*PAGE, "block_id", "answer")
    ids = F.array("block_id")
    missing = sent.join(got, [*PAGE, "block_id"], "left_anti").select(*PAGE, *issue("missing", "error", F.col("block_id"), ids))
    unknown = got.join(sent, [*PAGE, "block_id"], "left_anti").select(*PAGE, *issue("unknown", "error", F.col("block_id"), ids)).distinct()
    doubled = got.groupBy(*PAGE, "block_id").agg(F.count("*").alias("n")).where("n > 1").select(*PAGE, *issue("doubled", "error", F.col("block_id"), ids))
    blank = got.where(F.coalesce(T.is_blank(F.col("answer")), F.lit(True)) | F.col("answer").isNull()).select(*PAGE, *issue("blank", "error", F.col("block_id"), ids)).distinct()
    return missing.unionByName(unknown).unionByName(doubled).unionByName(blank)


# ---------------------------------------------------------------------------------------------- ledgers and validators


def ledger(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(document, page, block_id, class, status): what became of each block: kept, translated, untranslated or missing."""
    joined = blocks.select(*PAGE, "pos", "block_id", "text", class_of().alias("class")).join(answers.withColumn("sent", F.lit(True)), [*PAGE, "block_id"], "left")
    status = (
        F.when(~T.needs_translation(F.col("text")) | F.col("class").isin("page_number", "furniture", "empty"), "kept")
        .when(F.col("sent").isNull(), "missing")
        .when(F.col("answer").isNull() | T.is_blank(F.col("answer")), "blank")
        .when(T.is_untranslated(F.col("text"), F.col("answer")), "untranslated")
        .otherwise("translated")
    )
    return joined.select(*PAGE, "block_id", "class", status.alias("status"))


def coverage(ledger_rows: DataFrame) -> DataFrame:
    """(document, page, blocks, due, done, share): how many of a page's blocks that need a translation have one."""
    due = F.col("status") != "kept"
    g = ledger_rows.groupBy(*PAGE).agg(F.count("*").alias("blocks"), F.count_if(due).alias("due"), F.count_if(F.col("status") == "translated").alias("done"))
    return g.withColumn("share", F.when(F.col("due") > 0, F.round(F.col("done") / F.col("due"), 6)).otherwise(1.0))


def bounds_issues(blocks: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """Blocks that stand out of the page, or whose box is inverted."""
    out = (F.col("x_min") < -tolerance) | (F.col("y_min") < -tolerance) | (F.col("x_max") > boxes.PAGE_WIDTH + tolerance) | (F.col("y_max") > boxes.PAGE_HEIGHT + tolerance)
    inverted = (F.col("x_min") > F.col("x_max")) | (F.col("y_min") > F.col("y_max"))
    ids = F.array("block_id")
    return blocks.where(T.yes(out)).select(*PAGE, *issue("page_bounds", "error", F.col("block_id"), ids)).unionByName(blocks.where(T.yes(inverted)).select(*PAGE, *issue("inverted_box", "error", F.col("block_id"), ids)))


def overlap_issues(blocks: DataFrame, least_ratio: float = 0.12, least_height: float = 3.0) -> DataFrame:
    """Pairs of blocks of a page that overlap by more than given."""
    thin = blocks.select(*PAGE, "pos", "block_id", *BOX)
    hit = boxes.pairs(thin, thin, (F.col("a.pos") < F.col("b.pos")) & boxes.significant_overlap("a", "b", least_ratio, least_height))
    return hit.select("a.document", "a.page", *issue("text_overlap", "error", F.round(boxes.overlap_area("a", "b"), 3).cast("string"), F.array("a.block_id", "b.block_id")))


def layer_issues(blocks: DataFrame, least_height: float = 4.0, least_ratio: float = 0.05) -> DataFrame:
    """Text that lies over an image: blocks kept as images and other blocks of a page that overlap."""
    thin = blocks.select(*PAGE, "pos", "block_id", "preserve_image", *BOX)
    hit = boxes.pairs(thin.where("not coalesce(preserve_image, false)"), thin.where("preserve_image"), boxes.significant_overlap("a", "b", least_ratio, least_height))
    return hit.select("a.document", "a.page", *issue("text_over_image", "warning", F.col("a.block_id"), F.array("a.block_id", "b.block_id")))


def ownership_issues(owned: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that no component owns, and blocks that several own; `owned` is (document, page, component_id, block_id)."""
    owners = owned.groupBy(*PAGE, "block_id").agg(F.countDistinct("component_id").alias("n"))
    counted = blocks.select(*PAGE, "block_id").join(owners, [*PAGE, "block_id"], "left").where("n is null or n > 1")
    check = F.when(F.col("n").isNull(), "missing_owner").otherwise("duplicate_owner")
    return counted.select(*PAGE, check.alias("check"), F.lit("error").alias("severity"), F.coalesce("n", F.lit(0)).cast("string").alias("message"), F.array("block_id").alias("block_ids"))


def span_issues(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """Spans (document, page, block_id, start, end, text) must cover each source text exactly once and in order, without white space.

    A row for each span that does not start where the one before it ends or whose text differs, and for each source that is
    not covered to its end.
    """
    plain = sources.select(*PAGE, "block_id", T.without_space(F.col("text")).alias("plain"))
    w = Window.partitionBy(*PAGE, "block_id").orderBy("start", "end")
    joined = spans.withColumn("due", F.coalesce(F.lag("end").over(w), F.lit(0))).join(plain, [*PAGE, "block_id"], "left")
    bad = joined.where(T.yes(F.col("start") != F.col("due")) | F.col("plain").isNull() | T.yes(F.expr("substring(plain, start + 1, end - start)") != F.col("text")))
    ids = F.array("block_id")
    ends = plain.join(spans.groupBy(*PAGE, "block_id").agg(F.max("end").alias("last")), [*PAGE, "block_id"], "left").where(F.coalesce("last", F.lit(0)) != F.length("plain"))
    return bad.select(*PAGE, *issue("span_order", "error", F.col("start").cast("string"), ids)).unionByName(ends.select(*PAGE, *issue("span_end", "error", F.coalesce("last", F.lit(0)).cast("string"), ids)))


def footer_issues(blocks: DataFrame) -> DataFrame:
    """Footers whose height differs from that of the first footer of their document by more than a point."""
    foot = blocks.where("y_min > 745").select(*PAGE, "pos", "block_id", F.round(F.col("y_max") - F.col("y_min"), 3).alias("size"))
    w = Window.partitionBy("document").orderBy("page", "pos")
    return foot.withColumn("first", F.first("size").over(w)).where("abs(size - first) > 1").select(*PAGE, *issue("footer_style", "warning", F.col("size").cast("string"), F.array("block_id")))


def headings_in_body(blocks: DataFrame) -> DataFrame:
    """Prose blocks in which a later line is a numbered heading."""
    later = F.slice(F.split("text", "\n"), 2, 1000)
    inside = F.exists(later, lambda x: x.rlike(r"^[0-9]+(\.[0-9]+)+\.? [A-Z][a-z]"))
    return blocks.where(T.yes((T.line_count(F.col("text")) > 1) & inside & T.is_prose(F.col("text")))).select(*PAGE, *issue("embedded_heading", "warning", F.col("block_id"), F.array("block_id")))


def noise_issues(blocks: DataFrame) -> DataFrame:
    """Blocks with a garbled line."""
    return blocks.where(T.yes(F.exists(F.split("text", "\n"), T.is_garbled))).select(*PAGE, *issue("garbled_line", "warning", F.col("block_id"), F.array("block_id")))


# ---------------------------------------------------------------------------------------------- reports


def needs_ocr(blocks: DataFrame) -> DataFrame:
    """(document, pages, blocks, chars, needs_ocr, garbled): whether a document's text layer is too thin or garbled to use."""
    t = F.col("text")
    words, solid = F.regexp_count(t, F.lit("[A-Za-z]{2,}")), F.length(T.without_space(t))
    letters = F.regexp_count(t, F.lit(r"[A-Za-z\x{00C0}-\x{024F}\x{4E00}-\x{9FFF}]"))
    g = blocks.groupBy("document").agg(
        F.countDistinct("page").alias("pages"), F.count_if(~T.is_trivial(t)).alias("blocks"), F.coalesce(F.sum(F.length(t)), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(letters), F.lit(0)).alias("_letters"), F.coalesce(F.sum(solid), F.lit(0)).alias("_solid"), F.count_if(T.is_garbled(t)).alias("_bad"), F.count("*").alias("_all"), F.coalesce(F.sum(words), F.lit(0)).alias("_words"),
    )
    thin = (F.col("blocks") <= F.greatest(F.lit(10), F.col("pages") * 2)) & (F.col("chars") <= F.greatest(F.lit(600), F.col("pages") * 80))
    garbled = (F.col("_solid") >= 400) & ((F.col("_letters") < F.col("_solid") * 0.45) | (F.col("_bad") > F.col("_all") * 0.3))
    return g.select("document", "pages", "blocks", "chars", thin.alias("needs_ocr"), garbled.alias("garbled"))


def severity_counts(issues: DataFrame) -> DataFrame:
    """(document, info, warning, error, highest, pages): the issues of a document by severity, and its pages that have any."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    highest = F.coalesce(F.max_by("severity", severity_rank(F.col("severity"))), F.lit("none"))
    return issues.groupBy("document").agg(*counts, highest.alias("highest"), F.array_sort(F.collect_set("page")).alias("pages"))


def top_issues(issues: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` issues of each document: errors first, then by page, check, message and blocks."""
    w = Window.partitionBy("document").orderBy(severity_rank(F.col("severity")).desc(), "page", "check", "message", F.array_join("block_ids", ","))
    return issues.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("document", "rank", "page", "check", "severity", "message", F.array_join("block_ids", ",").alias("ids"))


def sampled(blocks: DataFrame, most: int = 100) -> DataFrame:
    """(document, page, block_id, rank): a fixed sample of `most` blocks of prose for review.

    The longest half is taken from the head of the order; the rest are taken from the remainder at even steps. The order is
    total, and ranks are given by counting in ranges first, so no task sorts all blocks.
    """
    prose = blocks.where(T.is_prose(F.col("text"))).select(*PAGE, "block_id", F.length("text").alias("size"))
    order = [F.desc("size"), F.asc("document"), F.asc("page"), F.asc("block_id")]
    head = prose.orderBy(*order).limit(most // 2)
    rest = prose.join(F.broadcast(head), [*PAGE, "block_id"], "left_anti")
    # of the remainder, the blocks whose hashes come first in equal parts of the hash range
    part = F.pmod(F.xxhash64(*PAGE, "block_id"), F.lit(most - most // 2))
    spread = rest.withColumn("part", part).groupBy("part").agg(F.min(F.struct(*PAGE, "block_id")).alias("b")).select("b.document", "b.page", "b.block_id")
    return head.select(*PAGE, "block_id").withColumn("kind", F.lit("head")).unionByName(spread.withColumn("kind", F.lit("spread")))


def assertion_rows(expected: DataFrame) -> DataFrame:
    """(document, page, place, expect, category, source_ids): the assertions of a table of expectations, one per row."""
    ids = F.array_distinct(F.concat(F.coalesce("a.source_ids", F.array().cast("array<string>")), F.filter(F.array("a.source_id"), lambda x: x.isNotNull())))
    return expected.select(*PAGE, F.posexplode("assertions").alias("place", "a")).select(*PAGE, "place", "a.expect", "a.category", ids.alias("source_ids"))


def assertion_results(assertions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document, page, place, expect, sources, found): how many of an assertion's blocks there are on its page."""
    one = assertions.select(*PAGE, "place", "expect", F.explode_outer("source_ids").alias("block_id"))
    hit = one.join(blocks.select(*PAGE, "block_id").distinct().withColumn("there", F.lit(1)), [*PAGE, "block_id"], "left")
    return hit.groupBy(*PAGE, "place", "expect").agg(F.count("block_id").alias("sources"), F.count("there").alias("found"))
