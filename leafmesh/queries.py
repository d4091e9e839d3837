"""Queries of the operators on positioned text, over the tables below a folder, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmesh import pipeline, records, sources
from leafmesh import sql as S
from leafmesh.operators import boxes, clusters, layout, plans, review, windows
from leafmesh.operators import text as T
from leafmesh.operators.boxes import BOX, PAGE
from leafmesh.pages import blocks, latest_pages, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each page, of its last delivery."""
    return blocks(latest_pages(table(spark, sf_dir, "source_pages")))


def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, page, block_id, answer) of the last delivery of each page's answers."""
    t = latest_pages(table(spark, sf_dir, "translations"), "returned_at")
    return t.select("document", "page", F.explode("translations").alias("block_id", "answer"))


#: The same in SQL.
BLOCKS = """blocks as (
  select document, page, source, (i - 1)::int as pos, b.id as block_id, b.block_index as block_index, b.xMin as x_min, b.yMin as y_min, b.xMax as x_max, b.yMax as y_max, b.text as text, b.preserve_image as preserve_image
  from (select document, page, source, unnest(blocks) as b, unnest(range(1, len(blocks) + 1)) as i from (
    select *, row_number() over (partition by document, page order by loaded_at desc nulls last) as rn from source_pages where document is not null and page is not null) where rn = 1))"""
ANSWERS = """answers as (
  select document, page, unnest(map_keys(translations)) as block_id, unnest(map_values(translations)) as answer from (
    select *, row_number() over (partition by document, page order by returned_at desc nulls last) as rn from translations where document is not null and page is not null) where rn = 1)"""


@query(f"""with {BLOCKS}, {ANSWERS}
select a.document, a.page, 'overlap' as "check", a.block_id as block_a, b.block_id as block_b
from blocks a join blocks b using (document, page)
where a.pos < b.pos and least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min) > 0 and least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min) > 3
union all
select document, page, 'missing', block_id, null from blocks
where text is not null and length(trim(text)) > 0 and not exists (select 1 from answers where answers.document = blocks.document and answers.page = blocks.page and answers.block_id = blocks.block_id)""")
def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, page, check, block_a, block_b): blocks of a page that collide, and blocks with text but without an answer."""
    b = page_blocks(spark, sf_dir).select("document", "page", "pos", "block_id", *BOX, "text")
    thin = b.drop("text")
    hit = boxes.pairs(thin, thin, (F.col("a.pos") < F.col("b.pos")) & (boxes.x_overlap("a", "b") > 0) & (boxes.y_overlap("a", "b") > 3))
    hit = hit.select("a.document", "a.page", F.lit("overlap").alias("check"), F.col("a.block_id").alias("block_a"), F.col("b.block_id").alias("block_b"))
    asked = b.where("text is not null and length(trim(text)) > 0").select("document", "page", "block_id")
    missing = asked.join(latest_answers(spark, sf_dir).drop("answer"), ["document", "page", "block_id"], "left_anti")
    return hit.unionByName(missing.select("document", "page", F.lit("missing").alias("check"), F.col("block_id").alias("block_a"), F.lit(None).cast("string").alias("block_b")))


# ---------------------------------------------------------------------------------------------- geometry


@query(f"""with {BLOCKS}
select document, page, block_id, {S.width('blocks')} as width, {S.height('blocks')} as height, {S.area('blocks')} as area, (x_min + x_max) / 2 as cx, (y_min + y_max) / 2 as cy,
  least(greatest(x_min - 8, 0.0), 623.0) as ex0, least(greatest(y_max + 4, 0.0), 801.0) as ey1,
  greatest(floor(x_min * (200.0::double / 72.0::double))::int - 2, 0) as px0, least(ceil(y_max * (200.0::double / 72.0::double))::int + 2, 2225) as py1,
  y_min as line0_top, y_min + {S.height('blocks')} / {S.line_count('text')} * 1 as line0_bottom
from blocks where text is not null""")
def geom_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each block's box: size, centre, the box with a margin cut to the page, its pixels, its first line."""
    b = page_blocks(spark, sf_dir).where("text is not null")
    cx, cy = boxes.center()
    padded, px = boxes.clamped(boxes.expanded("", 8.0, 4.0)), boxes.pixels("", 200.0, 2)
    first = boxes.line_slice("", F.lit(0), T.line_count(F.col("text")))
    return b.select(
        "document", "page", "block_id", boxes.width().alias("width"), boxes.height().alias("height"), boxes.area().alias("area"), cx.alias("cx"), cy.alias("cy"),
        padded.x_min.alias("ex0"), padded.y_max.alias("ey1"), px.x_min.alias("px0"), px.y_max.alias("py1"), first.y_min.alias("line0_top"), first.y_max.alias("line0_bottom"),
    )


@query(f"""with {BLOCKS}
select a.document, a.page, a.block_id as block_a, b.block_id as block_b, round({S.overlap_area()}, 4) as shared, round({S.y_overlap()}, 6) as height, round({S.x_ratio()}, 6) as x_ratio, round({S.overlap_ratio()}, 6) as ratio,
  round(greatest(a.x_min, b.x_min), 6) as x0, round(least(a.y_max, b.y_max), 6) as y1
from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos < b.pos and {S.x_overlap()} > 0 and {S.y_overlap()} > 0""")
def geom_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of blocks of a page that share an area, with the measures of what they share."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "pos", "block_id", *BOX)
    inner = boxes.intersection("a", "b")
    hit = boxes.pairs(b, b, (F.col("a.pos") < F.col("b.pos")) & boxes.intersects("a", "b"))
    return hit.select(
        "a.document", "a.page", F.col("a.block_id").alias("block_a"), F.col("b.block_id").alias("block_b"), F.round(boxes.overlap_area("a", "b"), 4).alias("shared"), F.round(boxes.y_overlap("a", "b"), 6).alias("height"),
        F.round(boxes.x_ratio("a", "b"), 6).alias("x_ratio"), F.round(boxes.overlap_ratio("a", "b"), 6).alias("ratio"), F.round(inner.x_min, 6).alias("x0"), F.round(inner.y_max, 6).alias("y1"),
    )


@query(f"""with {BLOCKS}
select document, page, count(*) as blocks, min(x_min) as x_min, min(y_min) as y_min, max(x_max) as x_max, max(y_max) as y_max from blocks group by document, page""")
def geom_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all blocks of each page."""
    return page_blocks(spark, sf_dir).groupBy(*PAGE).agg(F.count("*").alias("blocks"), *boxes.union())


@query(f"""with {BLOCKS},
cut as (select a.document, a.page, a.block_id as block_a, b.block_id as block_b, a.x_min as ax0, a.y_min as ay0, a.x_max as ax1, a.y_max as ay1,
  greatest(a.x_min, b.x_min) as x0, greatest(a.y_min, b.y_min) as y0, least(a.x_max, b.x_max) as x1, least(a.y_max, b.y_max) as y1
  from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and {S.x_overlap()} > 0 and {S.y_overlap()} > 0),
parts as (select *, unnest([{{'k': 0, 'x0': ax0, 'y0': ay0, 'x1': ax1, 'y1': y0}}, {{'k': 1, 'x0': ax0, 'y0': y1, 'x1': ax1, 'y1': ay1}}, {{'k': 2, 'x0': ax0, 'y0': y0, 'x1': x0, 'y1': y1}}, {{'k': 3, 'x0': x1, 'y0': y0, 'x1': ax1, 'y1': y1}}]) as p from cut)
select document, page, block_a, block_b, round(p.x0, 6) as x_min, round(p.y0, 6) as y_min, round(p.x1, 6) as x_max, round(p.y1, 6) as y_max from parts where p.x1 > p.x0 and p.y1 > p.y0""")
def geom_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each block's box without each box that overlaps it, as rectangles."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "pos", "block_id", *BOX)
    hit = boxes.pairs(b, b, (F.col("a.pos") != F.col("b.pos")) & boxes.intersects("a", "b"))
    rest = hit.select("a.document", "a.page", F.col("a.block_id").alias("block_a"), F.col("b.block_id").alias("block_b"), F.explode(boxes.subtract(boxes.box("a"), boxes.box("b"))).alias("r"))
    return rest.select("document", "page", "block_a", "block_b", *(F.round(f"r.{c}", 6).alias(c) for c in BOX))


@query(f"""with {BLOCKS}
select document, page, block_id, round(least(greatest(x_min + 200, 0), 623 - {S.width('blocks')}), 6) as x_min, round(least(greatest(y_min - 120, 0), 801 - {S.height('blocks')}), 6) as y_min
from (select document, page, block_id, x_min, y_min, x_max, y_max from blocks) blocks where {S.width('blocks')} <= 623 and {S.height('blocks')} <= 801""")
def geom_shift_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's box, moved by a vector, and back onto the page at its size."""
    b = page_blocks(spark, sf_dir)
    moved = b.select(*PAGE, "block_id", (F.col("x_min") + 200).alias("x_min"), (F.col("y_min") - 120).alias("y_min"), (F.col("x_max") + 200).alias("x_max"), (F.col("y_max") - 120).alias("y_max"))
    s = boxes.shifted_inside()
    return moved.where(s.isNotNull()).select(*PAGE, "block_id", F.round(s.x_min, 6).alias("x_min"), F.round(s.y_min, 6).alias("y_min"))


@query(f"""with {BLOCKS}
select document, page, floor(x_min * 1000 + 0.5) / 1000 as x_min, floor(y_min * 1000 + 0.5) / 1000 as y_min, floor(x_max * 1000 + 0.5) / 1000 as x_max, floor(y_max * 1000 + 0.5) / 1000 as y_max, string_agg(distinct block_id, ',' order by block_id) as ids
from blocks group by all""")
def dedupe_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per box of a page, with the ids of its blocks."""
    return boxes.dedupe(page_blocks(spark, sf_dir)).select(*PAGE, *BOX, F.array_join("block_ids", ",").alias("ids"))


@query(f"""with {BLOCKS}, images as (select * from blocks where preserve_image), t as (select * from blocks where not coalesce(preserve_image, false))
select document, page, pos, block_id, round(x_max - x_min, 6) as left_over from (select document, page, pos, block_id, x_min, x_max from t
where not exists (select 1 from blocks b where b.document = t.document and b.page = t.page and b.pos <> t.pos and {S.x_overlap('t', 'b')} > 0 and {S.y_overlap('t', 'b')} > 0))""")
def anti_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks that overlap no other block of their page."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "pos", "block_id", "preserve_image", *BOX)
    free = boxes.without_neighbour(b.where("not coalesce(preserve_image, false)"), b, (F.col("a.pos") != F.col("b.pos")) & boxes.intersects("a", "b"))
    return free.select(*PAGE, "pos", "block_id", F.round(F.col("x_max") - F.col("x_min"), 6).alias("left_over"))


@query(f"""with {BLOCKS}
select distinct a.document, a.page, a.block_id from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos
and {S.part(S.y_overlap(), f"least({S.height('a')}, {S.height('b')})")} >= 0.45 and b.x_min - a.x_max between 0 and 130""")
def semi_neighbour_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with another one to the right of them at the same height."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "pos", "block_id", *BOX)
    right = (F.col("a.pos") != F.col("b.pos")) & (boxes.y_ratio("a", "b") >= 0.45) & (F.col("b.x_min") - F.col("a.x_max")).between(0, 130)
    return boxes.with_neighbour(b, b, right).select(*PAGE, "block_id")


@query(f"""with {BLOCKS}
select a.document, a.page, a.block_id, b.block_id as holder from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos
and (a.x_min + a.x_max) / 2 between b.x_min and b.x_max and (a.y_min + a.y_max) / 2 between b.y_min and b.y_max""")
def join_contains_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose centre lies in another block."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "pos", "block_id", *BOX)
    hit = boxes.pairs(b, b, (F.col("a.pos") != F.col("b.pos")) & boxes.contains_point("b", *boxes.center("a")))
    return hit.select("a.document", "a.page", F.col("a.block_id").alias("block_id"), F.col("b.block_id").alias("holder"))


@query(f"""with {BLOCKS}
select document, page, block_id, partner, round(shared, 4) as shared from (
  select a.document, a.page, a.block_id, b.block_id as partner, {S.overlap_area()} as shared, row_number() over (partition by a.document, a.page, a.pos order by {S.overlap_area()} desc, b.pos) as rn
  from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and {S.x_overlap()} > 0 and {S.y_overlap()} > 0) where rn = 1""")
def join_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the block that overlaps it most."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "pos", "block_id", *BOX)
    best = boxes.best_partner(b, b, (F.col("a.pos") != F.col("b.pos")) & boxes.intersects("a", "b"), [boxes.overlap_area("a", "b").desc()])
    return best.select("a.document", "a.page", F.col("a.block_id").alias("block_id"), F.col("b.block_id").alias("partner"), F.round(boxes.overlap_area("a", "b"), 4).alias("shared"))


@query(f"""with {BLOCKS}
select a.document, a.page, a.pos, coalesce(max(case when b.y_max <= a.y_min then b.y_max + 2 end), 0.0) as above, coalesce(min(case when b.y_min >= a.y_max then b.y_min - 2 end), 801.0) as below
from blocks a left join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and ({S.x_ratio()} >= 0.15 or {S.x_overlap()} >= 12)
group by a.document, a.page, a.pos""")
def join_nearest_above_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each block may grow up and down."""
    return boxes.vertical_limits(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}
select a.document, a.page, a.block_id as block_a, b.block_id as block_b from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos < b.pos
and {S.x_ratio()} >= 0.45 and greatest(a.y_min, b.y_min) - least(a.y_max, b.y_max) <= 10""")
def join_same_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of blocks that stand close above each other in one column."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "pos", "block_id", *BOX)
    hit = boxes.pairs(b, b, (F.col("a.pos") < F.col("b.pos")) & boxes.same_cluster("a", "b"))
    return hit.select("a.document", "a.page", F.col("a.block_id").alias("block_a"), F.col("b.block_id").alias("block_b"))


@query(f"""with {BLOCKS}, b as (select document, page, block_id, x_min, y_min, x_max, y_max, {S.compact_with_cjk('text')} as plain from blocks)
select distinct x.document, x.page, x.block_id from b x join b y on x.document = y.document and x.page = y.page and x.block_id <> y.block_id and {S.area('y')} > {S.area('x')} * 2.5
and {S.overlap_area('x', 'y')} >= {S.area('x')} * 0.85 and length(x.plain) >= 8 and contains(y.plain, x.plain)""")
def dup_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that lie in a much larger block that holds their text."""
    return plans.nested_duplicates(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, b as (select document, page, pos, block_id, {S.compact_with_cjk('text')} as plain from blocks)
select document, page, block_id, first_id from (select *, first_value(block_id) over (partition by document, page, plain order by pos) as first_id from b where length(plain) >= 8) where first_id <> block_id""")
def dup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose text stands earlier on the page."""
    return plans.repeated_texts(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, b as (select document, page, pos, block_id, {S.compact('text')} as plain from blocks)
select x.document, x.page, x.block_id as part_id, y.block_id as whole_id from b x join b y on x.document = y.document and x.page = y.page and x.pos <> y.pos and length(x.plain) between 8 and length(y.plain) and contains(y.plain, x.plain)""")
def substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of blocks of a page of which one's text holds the other's."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "pos", "block_id", T.compact(F.col("text")).alias("plain"))
    hit = boxes.pairs(b, b, (F.col("a.pos") != F.col("b.pos")) & (F.length("a.plain") >= 8) & (F.length("a.plain") <= F.length("b.plain")) & F.col("b.plain").contains(F.col("a.plain")))
    return hit.select("a.document", "a.page", F.col("a.block_id").alias("part_id"), F.col("b.block_id").alias("whole_id"))


# ---------------------------------------------------------------------------------------------- texts


@query(f"""with {BLOCKS}
select document, page, block_id, {S.normalized('text')} as normalized, {S.flat('text')} as flat, {S.compact('text')} as compact, {S.gone(S.flat("translate(lower(text), '‘’“”', '''''\"\"')"), ' ([,.;:!?)])', chr(92) + '1')} as english,
  {S.gone(S.stripped('text'), chr(92) + 'n{3,}', chr(10) * 2)} as answer, {S.flat(S.gone('text', '([a-z])-' + chr(92) + 'n([a-z])', chr(92) + '1' + chr(92) + '2'))} as joined
from blocks where text is not null""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal forms of each block's text."""
    t = F.col("text")
    return page_blocks(spark, sf_dir).where(t.isNotNull()).select(
        "document", "page", "block_id", T.normalized(t).alias("normalized"), T.flat(t).alias("flat"), T.compact(t).alias("compact"), T.normalized_english(t).alias("english"), T.normalized_translation(t).alias("answer"), T.joined_hyphens(t).alias("joined"))


@query(f"""with {BLOCKS}
select document, page, block_id, {S.cjk_count('text')}::int as cjk, len({S.latin_words('text')})::int as words, {S.stop_words('text')}::int as stop_words, {S.line_count('text')}::int as lines, len({S.lines('text')})::int as full_lines, length({S.without_space('text')})::int as solid
from blocks where text is not null""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of ideographs, words, stop words, lines and visible characters of each block."""
    t = F.col("text")
    return page_blocks(spark, sf_dir).where(t.isNotNull()).select(
        "document", "page", "block_id", T.cjk_count(t).cast("int").alias("cjk"), F.size(T.latin_words(t)).alias("words"), T.stop_word_count(t).alias("stop_words"), T.line_count(t).cast("int").alias("lines"),
        F.size(T.lines(t)).alias("full_lines"), F.length(T.without_space(t)).alias("solid"))


@query(f"""with {BLOCKS}
select document, page, block_id, coalesce(nullif({S.gone(S.gone('lower(text)', '[^a-z0-9]+', '-'), '^-+|-+$')}, ''), 'document') as slug, 'page-' || lpad(page::varchar, 3, '0') || '.png' as file,
  'p' || lpad(page::varchar, 3, '0') || 'c' || lpad(pos::varchar, 4, '0') as component, case when regexp_extract(text, '^([^.!?。！？]*[.!?。！？])', 1) = '' then text else regexp_extract(text, '^([^.!?。！？]*[.!?。！？])', 1) end as sentence,
  nullif(regexp_extract(text, '^[ \\t\\n]*\\(([0-9]{{1,3}})\\)', 1), '')::int as enumeration, regexp_extract({S.stripped('text')}, '^([1-9][0-9]?(\\.[1-9][0-9]?)*)\\.?$', 1) as heading_number
from blocks where text is not null""")
def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, first sentences and leading numbers made of each block."""
    t = F.col("text")
    return page_blocks(spark, sf_dir).where(t.isNotNull()).select(
        "document", "page", "block_id", T.slug(t).alias("slug"), T.page_file(F.col("page")).alias("file"), T.component_id(F.col("page"), F.col("pos")).alias("component"), T.first_sentence(t).alias("sentence"),
        T.enumeration_start(t).alias("enumeration"), T.heading_number(t).alias("heading_number"))


@query(f"""with {BLOCKS}
select document, page, block_id, {S.is_trivial('text')} as trivial, {S.is_page_number('text')} as page_number, {S.is_decorated('text')} as decorated, {S.is_caption('text')} as caption, {S.is_equation_label('text')} as equation_label,
  {S.is_formula('text')} as formula, {S.is_metric('text')} as metric, {S.is_numeric_column('text')} as numeric_column, {S.is_reference_heading('text')} as reference_heading, {S.is_reference_item('text')} as reference_item
from blocks""")
def class_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which predicates on text hold for each block: furniture, captions, formulas, cells, references."""
    t = F.col("text")
    return page_blocks(spark, sf_dir).select(
        "document", "page", "block_id", T.is_trivial(t).alias("trivial"), T.is_page_number(t).alias("page_number"), T.is_decorated_page_number(t).alias("decorated"), T.is_caption(t).alias("caption"), T.is_equation_label(t).alias("equation_label"),
        T.is_formula(t).alias("formula"), T.is_metric_cell(t).alias("metric"), T.is_numeric_column(t).alias("numeric_column"), T.is_reference_heading(t).alias("reference_heading"), T.is_reference_item(t).alias("reference_item"))


@query(f"""with {BLOCKS}
select document, page, block_id, {S.is_heading('text')} as heading, {S.is_prose('text')} as prose, {S.is_statement('text')} as statement, {S.is_code('text')} as code, {S.is_identifier('text')} as identifier, {S.needs_translation('text')} as needs_translation,
  {S.goes_on('text')} as goes_on, {S.starts_inside('text')} as starts_inside, {S.is_garbled('text')} as garbled, {S.yes("len(" + S.lines('text') + ") between 2 and 20 and " + S.every('text', S.like('x', '^[0-9]{1,3}$')))} as line_numbers
from blocks where text is not null""")
def prose_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which predicates on text hold for each block: headings, prose, code, breaks."""
    t = F.col("text")
    return page_blocks(spark, sf_dir).where(t.isNotNull()).select(
        "document", "page", "block_id", T.is_heading(t).alias("heading"), T.is_prose(t).alias("prose"), T.is_statement(t).alias("statement"), T.is_code(t).alias("code"), T.is_identifier(t).alias("identifier"), T.needs_translation(t).alias("needs_translation"),
        T.goes_on(t).alias("goes_on"), T.starts_inside(t).alias("starts_inside"), T.is_garbled(t).alias("garbled"), T.is_line_numbers(t).alias("line_numbers"))


@query(f"""with {BLOCKS}, r as (select document, page, block_id, {S.flat(S.gone('text', '([a-z])-' + chr(92) + 'n([a-z])', chr(92) + '1' + chr(92) + '2'))} as s from blocks where {S.is_reference_item('text')}),
b as (select *, regexp_replace(s, '^\\[?[0-9]{{1,3}}[\\].][ ]', '') as body from r)
select document, page, block_id, regexp_extract(s, '^\\[?([0-9]{{1,3}})[\\].][ ]', 1) as marker, regexp_extract(body, '^((?:[A-Z]\\. [^.,]+(?:, )?)+)\\. ', 1) as authors, regexp_extract(body, '^(?:[A-Z]\\. [^.,]+(?:, )?)+\\. ([^.]+)\\. ', 1) as title,
  regexp_extract(body, '\\. ([A-Z][A-Za-z ]+) [0-9]+\\([0-9]+\\), [0-9]{{4}}', 1) as venue, regexp_extract(body, '\\), ([0-9]{{4}})', 1) as year, regexp_extract(body, ' ([0-9]+)\\([0-9]+\\), [0-9]{{4}}', 1) as volume,
  regexp_extract(body, ' [0-9]+\\(([0-9]+)\\), [0-9]{{4}}', 1) as issue, regexp_extract(body, 'pp\\. ([0-9]+-[0-9]+)', 1) as pages from b""")
def reference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the first bibliography entry of each block of references."""
    t = F.col("text")
    return page_blocks(spark, sf_dir).where(T.is_reference_item(t)).select("document", "page", "block_id", T.reference_parts(t).alias("r")).select("document", "page", "block_id", "r.*")


@query()
def text_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of translations with their soft line breaks removed and end marks set."""
    a = latest_answers(spark, sf_dir).where("answer is not null")
    return a.select("document", "page", "block_id", T.with_terminal_marks(T.reflowed(F.col("answer"))).alias("text"))


@query(f"""with {BLOCKS} select document, page, block_id, {S.class_of()} as class from blocks""")
def class_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each block by the first rule that holds."""
    return page_blocks(spark, sf_dir).select("document", "page", "block_id", plans.class_of().alias("class"))


@query(f"""with {BLOCKS} select document, first_page, first_y from (select document, page as first_page, y_min as first_y, row_number() over (partition by document order by page, y_min) as rn from blocks
where {S.is_reference_heading('text')} or {S.is_reference_item('text')}) where rn = 1""")
def class_references_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the list of references of each document begins."""
    return plans.references_from(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, p as (select document, page, max(({S.is_reference_heading('text')} or {S.is_reference_item('text')})::int) as opens,
  max(({S.is_heading('text')} and not {S.is_reference_heading('text')} and {S.like('text', '^[0-9]')})::int) as ends from blocks where not {S.MARGIN} group by document, page),
w as (select document, page, max(case when opens = 1 then page end) over prev as opened, max(case when ends = 1 and opens = 0 then page end) over prev as ended from p
  window prev as (partition by document order by page rows between unbounded preceding and 1 preceding))
select document, page, coalesce(opened >= ended or (opened is not null and ended is null), false) as in_references from w""")
def class_reference_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page goes on with a list of references that began before."""
    return plans.reference_state(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, l as (select document, page, block_id, {S.gone(f"lower({S.first_line('text')})", '[^a-z]+')} as header from blocks where {S.MARGIN}),
o as (select document, header from l where header <> '' group by document, header having count(distinct page) >= 2)
select document, page, block_id, header from l where exists (select 1 from o where o.document = l.document and o.header = l.header)""")
def headers_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in margins whose first line stands on several pages of the document."""
    return plans.running_headers(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, g as (select document, count(distinct page) as pages, count_if(not {S.is_trivial('text')}) as blocks, coalesce(sum(length(text)), 0)::bigint as chars,
  coalesce(sum({S.count('text', '[A-Za-z' + chr(92) + 'x{00C0}-' + chr(92) + 'x{024F}' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}]')}), 0) as letters, coalesce(sum(length({S.without_space('text')})), 0) as solid, count_if({S.is_garbled('text')}) as bad, count(*) as n from blocks group by document)
select document, pages, blocks, chars, blocks <= greatest(10, pages * 2) and chars <= greatest(600, pages * 80) as needs_ocr, solid >= 400 and (letters < solid * 0.45 or bad > n * 0.3) as garbled from g""")
def doc_ocr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the text of each document is too thin or too garbled to use."""
    return plans.needs_ocr(page_blocks(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- order and flow


@query(f"""with {BLOCKS} select document, page, block_id, lag(block_id) over w as previous_id, lead(block_id) over w as next_id from blocks window w as (partition by document, page order by pos)""")
def neighbour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks before and after each block of a page."""
    return plans.neighbours(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, p as (select *, lag(x_min) over w as px0, lag(y_min) over w as py0, lag(x_max) over w as px1, lag(y_max) over w as py1 from blocks window w as (partition by document, page order by pos)),
f as (select *, sum(case when coalesce(y_min - py1 <= 16 and y_min >= py0 and least(x_max - x_min, px1 - px0) > 0 and greatest(0.0, least(x_max, px1) - greatest(x_min, px0)) >= least(x_max - x_min, px1 - px0) * 0.55, false) then 0 else 1 end)
  over (partition by document, page order by pos rows unbounded preceding)::int as flow from p)
select document, page, flow, count(*) as blocks, min(x_min) as x_min, min(y_min) as y_min, max(x_max) as x_max, max(y_max) as y_max, arg_min(block_id, pos) as first_id from f group by document, page, flow""")
def islands_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blocks that go on down one column."""
    return plans.flows(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, n as (select a.document, a.page, a.block_id, b.block_id as next_id, b.y_min - a.y_max as gap, greatest(a.x_min, b.x_min) as x_min, a.y_max as y_min, least(a.x_max, b.x_max) as x_max, b.y_min as y_max,
  row_number() over (partition by a.document, a.page, a.pos order by b.y_min, b.pos) as rn from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and b.y_min >= a.y_max and {S.x_ratio()} >= 0.55)
select document, page, block_id, next_id, gap from n where rn = 1 and gap > 32 and not exists (select 1 from blocks c where c.document = n.document and c.page = n.page and {S.x_overlap('n', 'c')} > 0 and {S.y_overlap('n', 'c')} > 0)""")
def gap_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space down a page between a block and the next one below it."""
    return plans.wide_gaps(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, p as (select document, page, pos, block_id, text from blocks where not {S.MARGIN} and {S.is_prose('text')}),
e as (select document, page, arg_max(block_id, pos) as last_id, arg_max(text, pos) as last_text, arg_min(block_id, pos) as first_id, arg_min(text, pos) as first_text from p group by document, page),
n as (select *, lead(page) over w as next_page, lead(first_id) over w as next_id, lead(first_text) over w as next_text from e window w as (partition by document order by page))
select document, page, last_id as block_id, next_page, next_id from n where next_page = page + 1 and {S.goes_on('last_text')} and {S.starts_inside('next_text')}""")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that go on over a page break."""
    return plans.page_splits(page_blocks(spark, sf_dir))


@query(f"""with recursive {BLOCKS}, h as (select document, page, pos, block_id, {S.flat('text')} as title,
  case when regexp_extract({S.stripped('text')}, '^([0-9]+(\\.[0-9]+)*)\\.?[ \\t]', 1) = '' then 1 else least(len(regexp_extract({S.stripped('text')}, '^([0-9]+(\\.[0-9]+)*)\\.?[ \\t]', 1)) - len(replace(regexp_extract({S.stripped('text')}, '^([0-9]+(\\.[0-9]+)*)\\.?[ \\t]', 1), '.', '')) + 1, 4) end as depth
  from blocks where not {S.MARGIN} and {S.is_heading('text')}),
d as (select *, row_number() over (partition by document, page, title, depth order by pos) as k from h),
n as (select document, page, pos, block_id, title, depth, row_number() over (partition by document order by page, pos) as number from d where k = 1),
c as (select document, number, page, block_id, 1 as level, title from n where number = 1
  union all select n.document, n.number, n.page, n.block_id, least(n.depth, c.level + 1)::int, n.title from c join n on n.document = c.document and n.number = c.number + 1)
select document, number::int as number, page, block_id, level, title from c""")
def outline_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of each document, no heading more than one level below the one before."""
    return plans.outline(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, {ANSWERS}, h as (select document, page, pos, block_id, lower({S.flat('text')}) as title from blocks where {S.is_heading('text')})
select h.document, h.title, arg_min(answer, h.page * 100000 + pos) as first_answer, arg_max(answer, h.page * 100000 + pos) as last_answer from h join answers a on a.document = h.document and a.page = h.page and a.block_id = h.block_id where answer is not null group by h.document, h.title""")
def outline_title_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last translation of each title of a document."""
    return plans.title_maps(page_blocks(spark, sf_dir), latest_answers(spark, sf_dir))


@query(f"""with recursive {BLOCKS}, i as (select document, page, pos, block_id, length(text) as size, row_number() over (partition by document, page order by pos) as k from blocks where {S.needs_translation('text')}),
r as (select document, page, pos, block_id, k, 1 as batch, size as used from i where k = 1
  union all select i.document, i.page, i.pos, i.block_id, i.k, case when r.used + i.size <= 2000 then r.batch else r.batch + 1 end, case when r.used + i.size <= 2000 then r.used + i.size else i.size end
  from r join i on i.document = r.document and i.page = r.page and i.k = r.k + 1)
select document, page, pos, block_id, batch from r""")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that need a translation, packed in order into batches of bounded length."""
    return plans.pack(page_blocks(spark, sf_dir))


_PACKED = ORACLES["pack_batches"].replace("select document, page, pos, block_id, batch from r", "")


@query(f"""{_PACKED}, k as (select r.document, r.page, r.batch, count(*) as blocks, string_agg(r.block_id || chr(31) || b.text, chr(30) order by r.pos) as body from r join blocks b on b.document = r.document and b.page = r.page and b.block_id = r.block_id group by all)
select document, page, batch, blocks, sha256('default' || chr(30) || 'medium' || chr(30) || body) as request_key from k""")
def request_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys by which answers to batches are kept."""
    b = page_blocks(spark, sf_dir)
    return plans.request_keys(b, plans.pack(b))


@query(f"""{_PACKED}, {ANSWERS}, k as (select r.document, r.page, r.batch, count(*) as blocks, count(a.block_id) as answered from r left join answers a on a.document = r.document and a.page = r.page and a.block_id = r.block_id group by all)
select document, page, count(*) as batches, count_if(answered = blocks) as cached, count_if(answered < blocks) as due from k group by document, page""")
def cache_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many batches of each page are answered already, and how many are still to be sent."""
    packed = plans.pack(page_blocks(spark, sf_dir))
    known = latest_answers(spark, sf_dir).select(*PAGE, "block_id").withColumn("there", F.lit(1))
    state = packed.join(known, [*PAGE, "block_id"], "left").groupBy(*PAGE, "batch").agg(F.count("*").alias("blocks"), F.count("there").alias("answered"))
    return state.groupBy(*PAGE).agg(F.count("*").alias("batches"), F.count_if(F.col("answered") == F.col("blocks")).alias("cached"), F.count_if(F.col("answered") < F.col("blocks")).alias("due"))


@query(f"""with {BLOCKS}, {ANSWERS}, sent as (select distinct document, page, block_id from blocks where {S.needs_translation('text')})
select document, page, 'missing' as "check", block_id from sent where not exists (select 1 from answers a where a.document = sent.document and a.page = sent.page and a.block_id = sent.block_id)
union all select document, page, 'unknown', block_id from answers where not exists (select 1 from sent a where a.document = answers.document and a.page = answers.page and a.block_id = answers.block_id)
union all select document, page, 'blank', block_id from answers where answer is null or {S.is_blank('answer')}""")
def payload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the answers of each page, against the blocks that need one."""
    sent = page_blocks(spark, sf_dir).where(T.needs_translation(F.col("text")))
    return plans.payload_issues(sent, latest_answers(spark, sf_dir)).select("document", "page", "check", F.col("block_ids")[0].alias("block_id"))


# ---------------------------------------------------------------------------------------------- ledgers and validators

_STATUS = f"""case when not {S.needs_translation('b.text')} or {S.class_of('b.text', 'b.y_min')} in ('page_number', 'furniture', 'empty') then 'kept' when a.block_id is null then 'missing'
  when a.answer is null or {S.is_blank('a.answer')} then 'blank' when {S.is_untranslated('b.text', 'a.answer')} then 'untranslated' else 'translated' end"""
_LEDGER = f"""with {BLOCKS}, {ANSWERS}, ledger as (select b.document, b.page, b.block_id, {S.class_of('b.text', 'b.y_min')} as class, {_STATUS} as status
  from blocks b left join answers a on a.document = b.document and a.page = b.page and a.block_id = b.block_id)"""


@query(f"{_LEDGER} select document, page, block_id, class, status from ledger")
def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each block."""
    return plans.ledger(page_blocks(spark, sf_dir), latest_answers(spark, sf_dir))


@query(f"""{_LEDGER}, g as (select document, page, count(*) as blocks, count_if(status <> 'kept') as due, count_if(status = 'translated') as done from ledger group by document, page)
select *, case when due > 0 then round(done / due, 6) else 1.0 end as share from g""")
def coverage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each page is translated."""
    return plans.coverage(plans.ledger(page_blocks(spark, sf_dir), latest_answers(spark, sf_dir)))


@query(f"""{_LEDGER} select document, page, block_id, status from ledger where status not in ('kept', 'translated')""")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that need a translation and have none that can be used."""
    return plans.ledger(page_blocks(spark, sf_dir), latest_answers(spark, sf_dir)).where("status not in ('kept', 'translated')").select(*PAGE, "block_id", "status")


_OVERLAPS = f"""select a.document, a.page, 'text_overlap' as "check", 'error' as severity, least(a.block_id, b.block_id) || ',' || greatest(a.block_id, b.block_id) as ids from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos < b.pos
  and {S.y_overlap()} > 3 and {S.overlap_ratio()} > 0.12"""


@query(f"with {BLOCKS} {_OVERLAPS}")
def text_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page that overlap too much."""
    return plans.overlap_issues(page_blocks(spark, sf_dir)).select("document", "page", "check", "severity", F.array_join("block_ids", ",").alias("ids"))


_BOUNDS = """select document, page, 'page_bounds' as "check", 'error' as severity, block_id as ids from blocks where x_min < -6 or y_min < -6 or x_max > 543 or y_max > 760
union all select document, page, 'inverted_box', 'error', block_id from blocks where x_min > x_max or y_min > y_max"""


@query(f"with {BLOCKS} {_BOUNDS.replace('543', '629').replace('760', '807')}")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that stand out of the page."""
    return plans.bounds_issues(page_blocks(spark, sf_dir)).select("document", "page", "check", "severity", F.array_join("block_ids", ",").alias("ids"))


@query(f"""with {BLOCKS} select a.document, a.page, 'text_over_image' as "check", 'warning' as severity, least(a.block_id, b.block_id) || ',' || greatest(a.block_id, b.block_id) as ids from blocks a join blocks b on a.document = b.document and a.page = b.page
and not coalesce(a.preserve_image, false) and b.preserve_image and {S.y_overlap()} > 4 and {S.overlap_ratio()} > 0.05""")
def layer_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that lies over an image."""
    return plans.layer_issues(page_blocks(spark, sf_dir)).select("document", "page", "check", "severity", F.array_join("block_ids", ",").alias("ids"))


@query(f"""with {BLOCKS}, owned as (select document, page, {S.class_of()} as component, block_id from blocks where {S.class_of()} <> 'other' union all select document, page, 'image', block_id from blocks where preserve_image),
n as (select document, page, block_id, count(distinct component) as n from owned group by all)
select document, page, 'missing_owner' as "check", block_id as ids from blocks where not exists (select 1 from n where n.document = blocks.document and n.page = blocks.page and n.block_id = blocks.block_id)
union all select document, page, 'duplicate_owner', block_id from n where n > 1""")
def ownership_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that no component owns or that several own; components are the classes and the images of a page."""
    b = page_blocks(spark, sf_dir)
    names = F.array_compact(F.array(F.nullif(plans.class_of(), F.lit("other")), F.when(F.col("preserve_image"), "image")))
    owned = b.select(*PAGE, "block_id", F.explode(names).alias("component_id"))
    return plans.ownership_issues(owned, b).select("document", "page", "check", F.array_join("block_ids", ",").alias("ids"))


_SPANS = f"""spans as (select document, page, block_id, k::int * 400 as s, least((k::int + 1) * 400, length(plain))::int as e, substring(plain, k::int * 400 + 1, 400) as t from (
  select document, page, block_id, plain, unnest(range(0, greatest(1, ceil(length(plain) / 400.0)::int))) as k from (select document, page, block_id, {S.without_space('text')} as plain from blocks where text is not null and page % 7 <> 3)))"""


@query(f"""with {BLOCKS}, sources as (select document, page, block_id, {S.without_space('text')} as plain from blocks where text is not null), {_SPANS},
c as (select document, page, block_id, max(e) as last from spans group by all)
select s.document, s.page, 'span_end' as "check", coalesce(last, 0)::varchar as message, s.block_id as ids from sources s left join c on c.document = s.document and c.page = s.page and c.block_id = s.block_id where coalesce(last, 0) <> length(plain)""")
def span_exact_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether spans cover each text exactly once; the spans here are runs of 400 characters, and every seventh page lacks its own."""
    b = page_blocks(spark, sf_dir).where("text is not null").select(*PAGE, "block_id", "text")
    plain = T.without_space(F.col("text"))
    cut = b.where("page % 7 <> 3").select(*PAGE, "block_id", plain.alias("plain")).withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("plain") / 400).cast("int") - 1))))
    spans = cut.select(*PAGE, "block_id", (F.col("k") * 400).alias("start"), F.least((F.col("k") + 1) * 400, F.length("plain")).alias("end"), F.expr("substring(plain, k * 400 + 1, 400)").alias("text"))
    return plans.span_issues(spans, b).select("document", "page", "check", "message", F.array_join("block_ids", ",").alias("ids"))


@query(f"""with {BLOCKS}, f as (select document, page, pos, block_id, round(y_max - y_min, 3) as size from blocks where y_min > 745)
select document, page, block_id as ids, size from (select *, first_value(size) over (partition by document order by page, pos) as first from f) where abs(size - first) > 1""")
def footer_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers that differ from the first of their document."""
    return plans.footer_issues(page_blocks(spark, sf_dir)).select("document", "page", F.array_join("block_ids", ",").alias("ids"), F.col("message").cast("double").alias("size"))


@query(f"""with {BLOCKS} select document, page, block_id as ids from blocks where {S.line_count('text')} > 1 and {S.is_prose('text')}
and len(list_filter((string_split(text, chr(10)))[2:], lambda x: {S.like('x', '^[0-9]+(' + chr(92) + '.[0-9]+)+' + chr(92) + '.? [A-Z][a-z]')})) > 0""")
def headings_in_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose in which a later line is a heading."""
    return plans.headings_in_body(page_blocks(spark, sf_dir)).select("document", "page", F.array_join("block_ids", ",").alias("ids"))


@query(f"""with {BLOCKS} select document, page, block_id as ids from blocks where len(list_filter(string_split(text, chr(10)), lambda x: {S.is_garbled('x')})) > 0""")
def garbled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a garbled line."""
    return plans.noise_issues(page_blocks(spark, sf_dir)).select("document", "page", F.array_join("block_ids", ",").alias("ids"))


def all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of all validators on blocks."""
    b = page_blocks(spark, sf_dir)
    out = plans.overlap_issues(b)
    for f in (plans.bounds_issues, plans.layer_issues, plans.headings_in_body, plans.noise_issues, plans.footer_issues):
        out = out.unionByName(f(b))
    return out


_ALL = f"""{_OVERLAPS} union all {_BOUNDS.replace('543', '629').replace('760', '807')} union all {ORACLES['layer_exclusive'].split(BLOCKS)[1]}
union all select document, page, 'embedded_heading', 'warning', ids from ({ORACLES['headings_in_body'].split(BLOCKS)[1]}) union all select document, page, 'garbled_line', 'warning', ids from ({ORACLES['garbled_lines'].split(BLOCKS)[1]})
union all select document, page, 'footer_style', 'warning', ids from (with f as (select document, page, pos, block_id, round(y_max - y_min, 3) as size from blocks where y_min > 745) select document, page, block_id as ids from (select *, first_value(size) over (partition by document order by page, pos) as first from f) where abs(size - first) > 1)"""
_RANK = "case severity when 'error' then 2 when 'warning' then 1 when 'info' then 0 else -1 end"


@query(f"""with {BLOCKS}, issues as ({_ALL}) select document, count_if(severity = 'info') as info, count_if(severity = 'warning') as warning, count_if(severity = 'error') as error, arg_max(severity, {_RANK}) as highest,
string_agg(distinct lpad(page::varchar, 6, '0'), ',' order by lpad(page::varchar, 6, '0')) as pages from issues group by document""")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of each document by severity."""
    r = plans.severity_counts(all_issues(spark, sf_dir))
    return r.withColumn("pages", F.array_join(F.transform("pages", lambda p: F.lpad(p.cast("string"), 6, "0")), ","))


@query(f"""with {BLOCKS}, issues as ({_ALL}) select document, rank::int as rank, page, "check", severity, ids from (select *, row_number() over (partition by document order by {_RANK} desc, page, "check", ids) as rank from issues) where rank <= 5""")
def issues_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five issues of each document."""
    plain = all_issues(spark, sf_dir).withColumn("message", F.lit(""))
    return plans.top_issues(plain).drop("message")


@query()
def qa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed sample of a hundred blocks of prose for review."""
    return plans.sampled(page_blocks(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- expectations

_IDS = "list_distinct(list_concat(coalesce(a.source_ids, []), list_filter([a.source_id], lambda x: x is not null)))"


@query(f"""with {BLOCKS}, e as (select document, page, unnest(assertions) as a, unnest(range(0, len(assertions)))::int as place from expected_plans),
o as (select document, page, place, a.expect as expect, {_IDS} as ids from e),
u as (select document, page, place, expect, unnest(case when len(ids) = 0 then [null] else ids end) as block_id from o),
t as (select distinct document, page, block_id from blocks)
select u.document, u.page, u.place, u.expect, count(u.block_id) as sources, count(t.block_id) as found from u left join t on t.document = u.document and t.page = u.page and t.block_id = u.block_id group by all""")
def expected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each assertion about a plan there are on its page."""
    return plans.assertion_results(plans.assertion_rows(table(spark, sf_dir, "expected_plans")), page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, e as (select document, page, unnest(assertions) as a, unnest(range(0, len(assertions)))::int as place from expected_qa),
u as (select document, page, place, a.expect as expect, unnest(case when len(coalesce(a.source_ids, [])) = 0 then [null] else list_distinct(a.source_ids) end) as block_id from e),
t as (select distinct document, page, block_id from blocks)
select u.document, u.page, u.place, u.expect, count(u.block_id) as sources, count(t.block_id) as found from u left join t on t.document = u.document and t.page = u.page and t.block_id = u.block_id group by all""")
def expected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each assertion about findings there are on its page."""
    e = table(spark, sf_dir, "expected_qa").select(*PAGE, F.posexplode("assertions").alias("place", "a"))
    rows = e.select(*PAGE, "place", "a.expect", F.array_distinct(F.coalesce("a.source_ids", F.array().cast("array<string>"))).alias("source_ids"))
    return plans.assertion_results(rows, page_blocks(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- clusters and layout


@query()
def rows_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each page put together into rows."""
    return clusters.rows_of_lines(page_blocks(spark, sf_dir))


@query()
def lanes_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of each page."""
    return clusters.lanes(page_blocks(spark, sf_dir))


@query()
def regions_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions that the blocks of each page grow into."""
    return clusters.merged_regions(page_blocks(spark, sf_dir))


@query()
def labels_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks kept as images with the blocks close above them."""
    return clusters.absorbed_labels(page_blocks(spark, sf_dir), "preserve_image")


@query()
def free_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each block's box without the others that overlap it."""
    b = page_blocks(spark, sf_dir)
    return layout.free_parts(b, b)


_WIDE = "[" + "\\x{1100}-\\x{115F}\\x{2E80}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FF60}" + "]"


@query(f"""with {ANSWERS} select document, page, block_id, (length(answer) + {S.count('answer', _WIDE)})::int as units, len(string_split(answer, chr(10)))::int as lines from answers where answer is not null""")
def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of each answer in halves of the font size."""
    a = latest_answers(spark, sf_dir).where("answer is not null")
    return a.select("document", "page", "block_id", layout.units(F.col("answer")).cast("int").alias("units"), F.size(F.split("answer", "\n")).alias("lines"))


@query()
def text_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer wrapped in the box of its block: its lines at ten points, the height they need, and the largest size that fits."""
    b = page_blocks(spark, sf_dir).select(*PAGE, "block_id", boxes.width().alias("w"), boxes.height().alias("h"))
    a = b.join(latest_answers(spark, sf_dir).where("answer is not null"), [*PAGE, "block_id"])
    lines = layout.wrapped(F.col("answer"), F.floor(F.col("w") / 5))
    return a.select("document", "page", "block_id", F.size(lines).alias("lines"), layout.required_height(F.col("answer"), F.col("w"), 10.0).alias("height"), layout.fitted_size(F.col("answer"), F.col("w"), F.col("h")).alias("size"))


@query(f"""with {BLOCKS}, h as (select document, page, pos, 1 as grp, y_min, {S.height('blocks')} as height from blocks)
select document, page, grp as "group", pos, first_value(y_min) over w + coalesce(sum(height + 4.0) over (partition by document, page order by pos rows between unbounded preceding and 1 preceding), 0.0) as y_min from h window w as (partition by document, page order by pos)""")
def body_restacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each page set one below the other."""
    b = page_blocks(spark, sf_dir).select(*PAGE, F.lit(1).alias("group"), "pos", "y_min", boxes.height().alias("height"))
    return layout.restacked(b).drop("y_max")


@query(f"""with {BLOCKS}, n as (select *, regexp_extract({S.stripped('text')}, '^([1-9][0-9]?(\\.[1-9][0-9]?)*)\\.?$', 1) as num, {S.is_heading('text')} as heading from blocks),
c as (select a.document, a.page, a.block_id as number_id, a.pos, b.block_id as title_id, b.x_min - a.x_max as gap, row_number() over (partition by a.document, a.page, a.pos order by b.x_min - a.x_max, b.pos) as rn
  from n a join n b on a.document = b.document and a.page = b.page and a.num <> '' and b.heading and b.num = '' and b.x_min - a.x_max between 0 and 90 and {S.part(S.y_overlap(), f"least({S.height('a')}, {S.height('b')})")} >= 0.45),
k as (select *, row_number() over (partition by document, page, title_id order by gap, pos) as kn from c where rn = 1)
select document, page, number_id, title_id from k where kn = 1""")
def heading_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers that stand alone, with their titles."""
    return layout.heading_pairs(page_blocks(spark, sf_dir))


_STYLE = "case when class = 'heading' and regexp_matches(text, '^[0-9]+\\.[0-9]') then 'subheading' when class = 'heading' then 'heading' when class = 'caption' then 'caption' when class in ('reference', 'reference_heading') then 'reference' when class in ('page_number', 'furniture') then 'footer' else 'body' end"


@query(f"""with {BLOCKS}, c as (select document, page, block_id, text, y_max - y_min as h, {S.class_of()} as class from blocks), s as (select *, {_STYLE} as style from c)
select document, page, block_id, style, case style when 'heading' then 13.0 when 'subheading' then 11.5 when 'caption' then 9.0 when 'reference' then 8.5 when 'footer' then 8.0 else 10.0 end::double as size from s""")
def block_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of each block and its size."""
    b = page_blocks(spark, sf_dir).select("document", "page", "block_id", "text", plans.class_of().alias("class"))
    style = layout.style_of(F.col("text"), F.col("class"))
    return b.select("document", "page", "block_id", style.alias("style"), layout.style_size(style).alias("size"))


# ---------------------------------------------------------------------------------------------- sources and reports


@query(f"""with {BLOCKS} select document, page, row_number() over (partition by document, page order by pos)::int - 1 as pos, round(x_min, 6) as x_min, round(y_max, 6) as y_max, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') as text from blocks
where text is not null and not {S.is_blank('text')}""")
def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each document written as XML and read back."""
    b = page_blocks(spark, sf_dir).where("text is not null").where(~T.is_blank(F.col("text")))
    back = sources.from_xml(sources.to_xml(b))
    return back.select("document", "page", "pos", F.round("x_min", 6).alias("x_min"), F.round("y_max", 6).alias("y_max"), "text")


@query(f"""with {BLOCKS} select document, page, pos, block_id, text from blocks where text is not null""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each page written as JSON and read back."""
    back = sources.from_pages_json(sources.pages_json(page_blocks(spark, sf_dir)))
    return back.where("text is not null").select("document", "page", "pos", "block_id", "text")


@query()
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first issues of each document as lines of text."""
    return sources.report_lines(all_issues(spark, sf_dir))


@query()
def qa_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the plain text of each block and its answer are, from 0 to 1; what was given back unchanged has 1."""
    joined = page_blocks(spark, sf_dir).select(*PAGE, "block_id", "text").join(latest_answers(spark, sf_dir).where("answer is not null"), [*PAGE, "block_id"])
    return review.similarities(joined.where("text is not null"))


@query(f"""with {BLOCKS}, {ANSWERS} select b.document, b.page, b.block_id, case when trim({S.flat('text')}) = '' then 'empty' when length(text) <= 80 and not contains(text, chr(10)) then 'short' when {S.is_heading('text')} then 'section_header' else 'body' end as kind,
  {S.is_untranslated('text', 'answer')} as untranslated, {S.cjk_count('answer')}::int as cjk
from blocks b join answers a on a.document = b.document and a.page = b.page and a.block_id = b.block_id where text is not null and answer is not null""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each answer looks like beside its block."""
    joined = page_blocks(spark, sf_dir).select(*PAGE, "block_id", "text").join(latest_answers(spark, sf_dir), [*PAGE, "block_id"]).where("text is not null and answer is not null")
    t, a = F.col("text"), F.col("answer")
    return joined.select("document", "page", "block_id", review.kind(t).alias("kind"), T.is_untranslated(t, a).alias("untranslated"), T.cjk_count(a).cast("int").alias("cjk"))


@query("""with p as (select *, row_number() over (partition by document, page order by loaded_at desc nulls last) as rn, count(*) over (partition by document, page) as n from source_pages where document is not null and page is not null)
select document, page, n::int as deliveries, len(blocks)::int as blocks from p where rn = 1 and n > 1""")
def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were delivered more than once."""
    p = table(spark, sf_dir, "source_pages").where("document is not null and page is not null").select("document", "page", F.size("blocks").alias("blocks"), "loaded_at")
    g = p.groupBy("document", "page").agg(F.count("*").cast("int").alias("deliveries"), F.max_by("blocks", "loaded_at").alias("blocks"))
    return g.where("deliveries > 1")


@query("""select l_returnflag, l_linestatus, count(*) as lines, sum(l_quantity)::double as quantity from lineitem group by all""")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of the line items by flag, as a reader of any table gives it."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("double").alias("quantity"))


# ---------------------------------------------------------------------------------------------- the whole run


@query()
def page_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each page."""
    c = pipeline.components(page_blocks(spark, sf_dir))
    return c.withColumn("block_ids", F.array_join("block_ids", ","))


_USABLE = f"a.answer is not null and not {S.is_blank('a.answer')} and not {S.is_untranslated('b.text', 'a.answer')}"


@query(f"""with {BLOCKS}, {ANSWERS} select b.document, b.page, b.pos, b.block_id,
  case when coalesce(b.preserve_image, false) or {S.class_of('b.text', 'b.y_min')} in ('formula', 'cell') then 'image' when {S.class_of('b.text', 'b.y_min')} in ('empty', 'page_number', 'furniture') then 'skip' else 'text' end as kind, ({_USABLE}) as translated
from blocks b left join answers a on a.document = b.document and a.page = b.page and a.block_id = b.block_id""")
def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each block is to be drawn, and whether with its answer."""
    b, a = page_blocks(spark, sf_dir), latest_answers(spark, sf_dir)
    usable = F.col("answer").isNotNull() & ~T.is_blank(F.col("answer")) & ~T.is_untranslated(F.col("text"), F.col("answer"))
    flags = b.select(*PAGE, "block_id", "text").join(a, [*PAGE, "block_id"], "left").select(*PAGE, "block_id", usable.alias("translated"))
    return pipeline.items(b, a).select(*PAGE, "pos", "block_id", "kind").join(flags, [*PAGE, "block_id"]).select("document", "page", "pos", "block_id", "kind", "translated")


@query()
def plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's plan as JSON."""
    b, a = page_blocks(spark, sf_dir), latest_answers(spark, sf_dir)
    return records.page_plans(pipeline.items(b, a), plans.ledger(b, a))


@query()
def plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the plans of all pages, read back from JSON; no row means nothing."""
    return records.plan_problems(plan_json(spark, sf_dir))


@query(f"""{_PACKED}, {ANSWERS}, k as (select r.document, r.page, r.batch, count(*) as blocks, count(case when a.answer is not null and trim(a.answer) <> '' then 1 end) as got from r left join answers a on a.document = r.document and a.page = r.page and a.block_id = r.block_id group by all)
select document, count(*) as batches, count_if(got = blocks) as complete, sum(blocks)::bigint as blocks from k group by document""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many batches of each document are answered in full."""
    packed = plans.pack(page_blocks(spark, sf_dir))
    a = latest_answers(spark, sf_dir).where("answer is not null and trim(answer) <> ''").select(*PAGE, "block_id").withColumn("there", F.lit(1))
    g = packed.join(a, [*PAGE, "block_id"], "left").groupBy(*PAGE, "batch").agg(F.count("*").alias("blocks"), F.count("there").alias("got"))
    return g.groupBy("document").agg(F.count("*").alias("batches"), F.count_if(F.col("got") == F.col("blocks")).alias("complete"), F.sum("blocks").alias("blocks"))


# ---------------------------------------------------------------------------------------------- what stands near


@query(f"""with {BLOCKS} select a.document, a.page, a.block_id as caption_id, count(*) as blocks, min(b.x_min) as x_min, min(b.y_min) as y_min, max(b.x_max) as x_max, max(b.y_max) as y_max
from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and {S.is_caption('a.text')} and b.y_max <= a.y_min + 8 and b.y_min >= a.y_min - 140 and {S.x_overlap()} > 0 and not {S.is_prose('b.text')} and not {S.is_caption('b.text')}
group by a.document, a.page, a.block_id""")
def caption_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each caption with the blocks in a band above it."""
    return windows.caption_windows(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS} select distinct a.document, a.page, a.block_id from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and not {S.is_prose('a.text')} and {S.is_metric('b.text')}
and {S.part(S.y_overlap(), f"least({S.height('a')}, {S.height('b')})")} >= 0.45 and greatest(a.x_min, b.x_min) - least(a.x_max, b.x_max) <= 130 and {S.width('a')} <= 360""")
def row_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that stand in one row with a cell of figures."""
    return windows.row_aligned(page_blocks(spark, sf_dir), T.is_metric_cell(F.col("text")))


_DISTANCE = "greatest(0.0, greatest(a.y_min, b.y_min) - least(a.y_max, b.y_max))"


@query(f"""with {BLOCKS}, s as (select * from blocks where {S.yes(f"length({S.flat('text')}) <= 30 and len({S.tokens('text')}) between 1 and 2")} and not {S.needs_translation('text')}),
c as (select a.document, a.page, a.block_id as fragment_id, b.block_id as target_id, {_DISTANCE} as distance, row_number() over (partition by a.document, a.page, a.pos order by {_DISTANCE}, b.pos) as rn
  from s a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and {S.is_prose('b.text')} and {S.x_ratio()} >= 0.35 and {_DISTANCE} <= 96)
select document, page, fragment_id, target_id, distance from c where rn = 1""")
def fragment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each short fragment belongs to."""
    return windows.fragment_targets(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, h as (select a.document, a.page, a.block_id, b.block_id as other, row_number() over (partition by a.document, a.page, a.pos order by b.y_min, b.x_min, b.pos) as k, count(*) over (partition by a.document, a.page, a.pos) as n
  from blocks a join blocks b on a.document = b.document and a.page = b.page and {S.is_prose('a.text')} and (b.y_min + b.y_max) / 2 between a.y_min - 20 and a.y_max + 20)
select document, page, block_id, count(*) as "rows", max(case when k = 1 then other end) as first_id, max(case when k = n then other end) as last_id from h group by document, page, block_id""")
def band_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks in a band around each prose block."""
    return windows.in_band(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, c as (select a.document, a.page, a.block_id as fragment_id, b.block_id as holder_id, a.y_min, a.pos, row_number() over (partition by a.document, a.page, a.pos order by {S.area('b')}, b.pos) as rn
  from blocks a join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and b.x_min <= a.x_min + 1.5 and b.y_min <= a.y_min + 1.5 and b.x_max >= a.x_max - 1.5 and b.y_max >= a.y_max - 1.5 and {S.area('b')} >= {S.area('a')} * 6)
select document, page, fragment_id, holder_id, row_number() over (partition by document, page, holder_id order by y_min, pos)::int as place from c where rn = 1""")
def contained_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small blocks that lie in much larger ones."""
    return windows.contained_fragments(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, l as (select a.document, a.page, a.pos, coalesce(max(case when b.y_max <= a.y_min then b.y_max + 2 end), 0.0) as above, coalesce(min(case when b.y_min >= a.y_max then b.y_min - 2 end), 801.0) as below
  from blocks a left join blocks b on a.document = b.document and a.page = b.page and a.pos <> b.pos and ({S.x_ratio()} >= 0.15 or {S.x_overlap()} >= 12) group by a.document, a.page, a.pos),
g as (select b.document, b.page, b.pos, b.y_min, {S.height('b')} + 6.0 as need, above, greatest(b.y_max, least(below, b.y_min + {S.height('b')} + 6.0)) as bottom from blocks b join l on l.document = b.document and l.page = b.page and l.pos = b.pos)
select document, page, pos, least(y_min, greatest(above, bottom - need)) as y_min, bottom as y_max, bottom - least(y_min, greatest(above, bottom - need)) >= need - 1e-6 as fits from g""")
def boxes_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's box grown by six points where there is room."""
    return windows.grown(page_blocks(spark, sf_dir).withColumn("need", boxes.height() + 6.0))


@query(f"""with {BLOCKS}, f as (select document, min(page) as page from blocks group by document), b as (select blocks.* from blocks join f on f.document = blocks.document and f.page = blocks.page where not {S.MARGIN}),
m as (select *, sum({S.is_prose('text')}::int) over (partition by document order by pos rows unbounded preceding) as prose, row_number() over (partition by document order by pos) as k from b)
select document, page, block_id, case when k = 1 and {S.is_heading('text')} then 'title' when {S.like(S.flat('text'), '^[A-Z][A-Za-z.-]*( [A-Z][A-Za-z.-]*){1,3}$')} and k > 1 then 'authors' else 'other' end as role from m where prose = 0""")
def first_page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the blocks above the first prose of each document are."""
    return windows.first_page_roles(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, b as (select document, page, block_id, floor(x_min + 0.5) as x, floor(y_min + 0.5) as y from blocks), o as (select document, x, y, count(distinct page) as pages from b group by all having count(distinct page) >= 3)
select b.document, b.block_id, b.page, o.pages from b join o on o.document = b.document and o.x = b.x and o.y = b.y""")
def places_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that stand at the same place on several pages."""
    return windows.across_pages(page_blocks(spark, sf_dir))


@query(f"""with {BLOCKS}, n as (select document, page, pos, block_id, y_min, nullif(regexp_extract(text, '^[ \\t\\n]*\\(([0-9]{{1,3}})\\)', 1), '')::int as number from blocks),
r as (select *, row_number() over (partition by document, page order by number, pos) as by_number, row_number() over (partition by document, page order by y_min, pos) as by_place, max(number) over w - min(number) over w + 1 = count(*) over w as whole from n where number is not null window w as (partition by document, page))
select a.document, a.page, a.block_id, a.number, case when a.whole then b.y_min else a.y_min end as y_min from r a join r b on a.document = b.document and a.page = b.page and a.by_number = b.by_place""")
def numbered_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered items of each page in the order of their numbers."""
    return windows.numbered_in_order(page_blocks(spark, sf_dir))


@query()
def qa_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least likeness of the answers of each document, and the blocks that have it."""
    return windows.worst_by_document(qa_similarity(spark, sf_dir))
