"""Readers and writers of pages as files: text geometry in XML, pages and plans in JSON, and the listing of documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmesh.operators import plans
from leafmesh.operators import text as T
from leafmesh.operators.boxes import BOX, PAGE

#: Pages of words in lines in blocks, as text extractors write them.
XML_SCHEMA = (
    "page ARRAY<STRUCT<_number: INT, _width: DOUBLE, _height: DOUBLE, "
    "block: ARRAY<STRUCT<_xMin: DOUBLE, _yMin: DOUBLE, _xMax: DOUBLE, _yMax: DOUBLE, line: ARRAY<STRUCT<_text: STRING>>>>>>"
)


def escaped(t: Column) -> Column:
    """A text as the value of an XML attribute."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def number_text(v: Column) -> Column:
    """A number with six decimals."""
    return F.format_string("%.6f", v)


def to_xml(blocks: DataFrame) -> DataFrame:
    """(document, xml): the blocks of each document as XML, a page after the other.

    The pages of a document are put together one by one from the blocks of a page, so what a task holds is a document.
    """
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit('<line text="'), escaped(x), F.lit('"/>'))), "")
    box = F.concat(*(x for c, n in zip(BOX, ("xMin", "yMin", "xMax", "yMax"), strict=True) for x in (F.lit(f' {n}="'), number_text(F.col(c)), F.lit('"'))))
    block = F.concat(F.lit("<block"), box, F.lit(">"), lines, F.lit("</block>"))
    pages = blocks.where("text is not null").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("xml")))).alias("b"))
    page = F.concat(F.lit('<page number="'), F.col("page").cast("string"), F.lit('">'), F.array_join("b.xml", ""), F.lit("</page>"))
    docs = pages.select(*PAGE, page.alias("xml")).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "xml"))).alias("p"))
    return docs.select("document", F.concat(F.lit("<doc>"), F.array_join("p.xml", ""), F.lit("</doc>")).alias("xml"))


def from_xml(documents: DataFrame) -> DataFrame:
    """(document, page, pos, x_min, y_min, x_max, y_max, text): the blocks of documents given as XML; blank blocks leave a gap."""
    parsed = documents.select("document", F.from_xml("xml", XML_SCHEMA, {"attributePrefix": "_", "ignoreSurroundingSpaces": "false"}).alias("d"))
    pages = parsed.select("document", F.explode("d.page").alias("p"))
    b = pages.select("document", F.col("p._number").alias("page"), F.posexplode("p.block").alias("pos", "b"))
    text = F.array_join(F.transform("b.line", lambda x: F.coalesce(x["_text"], F.lit(""))), "\n")
    rows = b.select(*PAGE, "pos", *(F.col(f"b._{n}").alias(c) for c, n in zip(BOX, ("xMin", "yMin", "xMax", "yMax"), strict=True)), F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "").alias("text"))
    return rows.where(~T.is_blank(F.col("text")))


def read_xml(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """The blocks of the XML files below a folder; the document is the name of the file without its ending."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1)
    return from_xml(files.select(name.alias("document"), F.col("value").alias("xml")))


def list_documents(spark: SparkSession, path: str, glob: str = "*.pdf", include: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(document, path, size): the files below a folder by name, all of them, those named or the first of them. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("document"), "path", F.col("length").alias("size"))
    if include:
        named = named.where(F.col("document").isin(*include) | F.regexp_extract("path", r"([^/]+)$", 1).isin(*include))
    return named.orderBy("document").limit(most) if most else named


def block_json(keep_null: bool = False) -> Column:
    """A block as JSON with its keys in order; missing values are left out."""
    box = F.array(*(F.round(c, 3) for c in BOX)).alias("bbox")
    return F.to_json(F.struct(box, "block_id", "page", F.col("preserve_image"), "text"), {"ignoreNullFields": str(not keep_null).lower()})


def pages_json(blocks: DataFrame) -> DataFrame:
    """(document, page, json): each page's blocks as one JSON array in order."""
    rows = blocks.select(*PAGE, "pos", block_json().alias("j"))
    g = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pos", "j"))).alias("b"))
    return g.select(*PAGE, F.concat(F.lit("["), F.array_join("b.j", ","), F.lit("]")).alias("json"))


def from_pages_json(pages: DataFrame) -> DataFrame:
    """(document, page, pos, block_id, x_min, y_min, x_max, y_max, text): the blocks of pages given as JSON; bad JSON gives none."""
    schema = "array<struct<bbox: array<double>, block_id: string, page: int, preserve_image: boolean, text: string>>"
    b = pages.select(*PAGE, F.posexplode(F.from_json("json", schema)).alias("pos", "b")).where("size(b.bbox) = 4 and b.block_id is not null")
    return b.select(*PAGE, "pos", "b.block_id", *(F.col("b.bbox")[k].alias(c) for k, c in enumerate(BOX)), "b.text")


def write_pages(blocks: DataFrame, path: str) -> None:
    """Pages as JSON lines, in folders by the first letter of the document, for exchange; the table format is Parquet."""
    pages_json(blocks).withColumn("part", F.lower(F.substring("document", 1, 1))).write.mode("errorifexists").partitionBy("part").json(path)


def report_lines(issues: DataFrame, most: int = 20) -> DataFrame:
    """(document, report): the first issues of each document as lines of text."""
    rank = F.row_number().over(Window.partitionBy("document").orderBy(F.desc("severity"), "page", "check", F.array_join("block_ids", ",")))
    line = F.concat(F.lit("- page "), F.col("page").cast("string"), F.lit(": "), "check", F.lit(" ("), F.array_join("block_ids", ", "), F.lit(")"))
    top = issues.withColumn("rank", rank).where(F.col("rank") <= most).select("document", "rank", line.alias("line"))
    return top.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l")).select("document", F.array_join("l.line", "\n").alias("report"))


# ---------------------------------------------------------------------------------------------- images, keys, reports


def page_images(spark: SparkSession, path: str, glob: str = "page-*.png") -> DataFrame:
    """(document, page, content): the page images below a folder; a page's document is the folder that it lies in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("document"), F.regexp_extract("path", r"page-0*([0-9]+)\.", 1).cast("int").alias("page"), "content")


def missing_pages(expected: DataFrame, there: DataFrame) -> DataFrame:
    """(document, page): the pages that are expected and not there."""
    return expected.select(*PAGE).distinct().join(there.select(*PAGE), [*PAGE], "left_anti")


def recognised(images: DataFrame, engine: Callable[[bytes], list[tuple[float, float, float, float, str, float]]], least_score: float = 0.45) -> DataFrame:
    """(document, page, pos, block_id, x_min, y_min, x_max, y_max, text, score): lines that `engine` reads in page images.

    The engine gets an image and gives (x_min, y_min, x_max, y_max, text, score) of each line. Lines below the least score are
    dropped; the rest are numbered from the top, and from the left where they begin at one height.
    """
    schema = pa.schema([("document", pa.string()), ("page", pa.int32()), ("pos", pa.int32()), ("block_id", pa.string()), *((c, pa.float64()) for c in BOX), ("text", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = sorted((x for x in engine(row["content"]) if x[5] >= least_score and x[4].strip()), key=lambda x: (x[1], x[0]))
                out = [(row["document"], row["page"], k, f"p{row['page']:03d}b{k + 1:04d}", *map(float, x[:4]), x[4], float(x[5])) for k, x in enumerate(lines)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ddl = "document string, page int, pos int, block_id string, " + ", ".join(f"{c} double" for c in BOX) + ", text string, score double"
    return images.select(*PAGE, "content").mapInArrow(run, ddl)


def source_keys(files: DataFrame, **settings: object) -> DataFrame:
    """(document, key): the hash by which what was extracted from a file (document, content) with these settings is kept."""
    told = json.dumps(settings, sort_keys=True)
    return files.select("document", F.sha2(F.concat("content", F.encode(F.lit(told), "UTF-8")), 256).alias("key"))


def prompts(requests: DataFrame, instruction: str, glossary: dict[str, str] | None = None) -> DataFrame:
    """Requests with what is sent to the model: the instruction, the glossary, and the batch's texts as JSON."""
    head = instruction + "".join(f"\n{a} = {b}" for a, b in sorted((glossary or {}).items())) + "\n"
    listed = F.to_json(F.transform("items", lambda x: F.struct(x.block_id.alias("id"), x.text.alias("text"))))
    return requests.withColumn("prompt", F.concat(F.lit(head), listed))


def report_json(summary: DataFrame, issues: DataFrame, most: int = 100) -> DataFrame:
    """(document, json): each document's counts by severity and its first issues as JSON with keys in order."""
    rank = F.row_number().over(Window.partitionBy("document").orderBy(plans.severity_rank(F.col("severity")).desc(), "page", "check", F.array_join("block_ids", ",")))
    one = F.struct(F.col("rank"), F.struct(F.array_sort("block_ids").alias("block_ids"), F.col("check"), F.col("message"), F.col("page"), F.col("severity")).alias("issue"))
    listed = issues.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("document").agg(F.array_sort(F.collect_list(one)).alias("l"))
    joined = summary.join(listed, "document", "left")
    return joined.select("document", F.to_json(F.struct("error", "highest", "info", F.coalesce(F.col("l.issue"), F.array()).alias("issues"), "pages", "warning")).alias("json"))


def published(df: DataFrame, path: str) -> None:
    """Writes a table beside its place and moves it there, so that a reader sees all of it or none; what was there stays as path.old."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ending) for ending in (".new", ".old"))
    df.write.mode("overwrite").parquet(staged.toString())
    if files.exists(target):
        files.delete(old, True)
        if not files.rename(target, old):
            raise OSError(f"{path} can't be set aside")
    if not files.rename(staged, target):
        raise OSError(f"{path} can't be published")
