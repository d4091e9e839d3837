from pyspark.sql import functions as F

from leafmesh import sources
from leafmesh.operators import plans, review
from leafmesh.pages import blocks, latest_pages

ROWS = "document string, page int, pos int, block_id string, x_min double, y_min double, x_max double, y_max double, text string, preserve_image boolean"
ANSWERS = "document string, page int, block_id string, answer string"
LONG = "We see that the cache of the parser is bounded by the vector in most cases"


def frame(spark, *rows):
    """Rows (page, y, text), each a line lower than the one before on its page."""
    return spark.createDataFrame([("d", p, k, f"b{k}", 60.0, float(y), 500.0, float(y) + 10, t, None) for k, (p, y, t) in enumerate(rows)], ROWS)


def test_latest_pages_and_blocks(spark):
    block = "array<struct<id string, page int, block_index int, xMin double, yMin double, xMax double, yMax double, text string, preserve_image boolean>>"
    one, two = [("a", 1, 0, 0.0, 0.0, 1.0, 1.0, "old", None)], [("a", 1, 0, 0.0, 0.0, 1.0, 1.0, "new", None), ("b", 1, 2, 0.0, 0.0, 1.0, 1.0, None, True)]
    p = spark.createDataFrame([("d", 1, "s", one, 1), ("d", 1, "s", two, 2), ("d", 2, "s", None, 1), (None, 1, "s", one, 1)], f"document string, page int, source string, blocks {block}, loaded_at int")
    assert [(r.block_id, r.pos, r.text) for r in blocks(latest_pages(p)).collect()] == [("a", 0, "new"), ("b", 1, None)]
    assert latest_pages(p).count() == 2


def test_headers_references_and_outline(spark):
    b = frame(spark, (1, 40, "Dense Cache"), (1, 100, "1 Related Work"), (1, 130, "1.1.1 The Deep Part"), (1, 200, LONG), (2, 40, "DENSE CACHE"), (2, 100, "References"), (2, 200, "[1] S. Ammira, H. Wildane. X."), (3, 40, "Other"), (3, 100, "[2] A. Bcd. Y."), (4, 100, "2 Next Part"), (5, 100, LONG))
    assert {r.block_id for r in plans.running_headers(b).collect()} == {"b0", "b4"}
    first = plans.references_from(b).first()
    assert (first.first_page, first.first_y) == (2, 100)
    assert {r.page: r.in_references for r in plans.reference_state(b).collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}
    assert [(r.title, r.level) for r in plans.outline(b).orderBy("number").collect()] == [("1 Related Work", 1), ("1.1.1 The Deep Part", 2), ("References", 1), ("2 Next Part", 1)]


def test_duplicates_flows_and_gaps(spark):
    rows = [("d", 1, 0, "big", 0.0, 100.0, 400.0, 300.0, LONG + " " + LONG, None), ("d", 1, 1, "small", 10.0, 110.0, 200.0, 130.0, "the cache of the parser", None), ("d", 1, 2, "low", 0.0, 400.0, 400.0, 420.0, LONG + " " + LONG, None)]
    b = spark.createDataFrame(rows, ROWS)
    assert [r.block_id for r in plans.nested_duplicates(b).collect()] == ["small"]
    assert [tuple(r)[2:] for r in plans.repeated_texts(b).collect()] == [("low", "big")]
    assert [(r.block_id, r.next_id, r.gap) for r in plans.wide_gaps(b).where("block_id = 'big'").collect()] == [("big", "low", 100.0)]
    flow = plans.flows(frame(spark, (1, 100, "a"), (1, 115, "b"), (1, 200, "c"))).orderBy("flow").collect()
    assert [(r.blocks, r.first_id) for r in flow] == [(2, "b0"), (1, "b2")]
    ids = {r.block_id: (r.previous_id, r.next_id) for r in plans.neighbours(b).collect()}
    assert ids == {"big": (None, "small"), "small": ("big", "low"), "low": ("small", None)}


def test_splits(spark):
    b = frame(spark, (1, 100, LONG + " and"), (1, 760, "- 1 -"), (2, 40, "Head"), (2, 100, "goes on in the cache of the parser."), (4, 100, "and so it is in the cache of the parser."))
    assert [(r.block_id, r.next_id) for r in plans.page_splits(b).collect()] == [("b0", "b3")]


def test_batches_and_payload(spark):
    b = frame(spark, *[(1, 100 + 20 * k, LONG) for k in range(5)], (1, 300, "x8"), (2, 100, LONG * 40))
    packed = plans.pack(b, 2 * len(LONG))
    assert {r.block_id: r.batch for r in packed.collect()} == {"b0": 1, "b1": 1, "b2": 2, "b3": 2, "b4": 3, "b6": 1}
    keys = plans.request_keys(b, packed)
    again = plans.request_keys(b.repartition(7), plans.pack(b.repartition(3), 2 * len(LONG)))
    assert {tuple(r) for r in keys.collect()} == {tuple(r) for r in again.collect()} and keys.select("request_key").distinct().count() == 4
    cache = keys.where("page = 2").select("request_key", F.lit("done").alias("answer"))
    hit, miss = plans.resume(keys, cache)
    assert hit.count() == 1 and miss.count() == 3
    out = plans.run_batches(miss, lambda rows: [f"{r['page']}:{r['batch']}" for r in rows])
    assert {r.answer for r in out.collect()} == {"1:1", "1:2", "1:3"}
    answers = spark.createDataFrame([("d", 1, "b0", "好"), ("d", 1, "b0", "好"), ("d", 1, "b1", " "), ("d", 1, "zz", "好"), ("d", 2, "b6", None)], ANSWERS)
    got = {(r.check, r.block_ids[0]) for r in plans.payload_issues(packed, answers).collect()}
    assert got == {("missing", "b2"), ("missing", "b3"), ("missing", "b4"), ("unknown", "zz"), ("doubled", "b0"), ("blank", "b1"), ("blank", "b6")}


def test_ledger_and_coverage(spark):
    b = frame(spark, (1, 100, LONG), (1, 120, LONG + " two"), (1, 140, LONG + " three"), (1, 160, LONG + " four"), (1, 760, "- 1 -"), (1, 180, None))
    a = spark.createDataFrame([("d", 1, "b0", "译文在这里"), ("d", 1, "b1", LONG + " two"), ("d", 1, "b2", " ")], ANSWERS)
    rows = plans.ledger(b, a)
    assert {r.block_id: r.status for r in rows.collect()} == {"b0": "translated", "b1": "untranslated", "b2": "blank", "b3": "missing", "b4": "kept", "b5": "kept"}
    c = plans.coverage(rows).first()
    assert (c.blocks, c.due, c.done, c.share) == (6, 4, 1, 0.25)


def test_validators(spark):
    rows = [("d", 1, 0, "a", 0.0, 0.0, 100.0, 100.0, LONG, False), ("d", 1, 1, "b", 10.0, 10.0, 90.0, 90.0, LONG, True), ("d", 1, 2, "c", 600.0, 10.0, 700.0, 20.0, "x\n2.1 Heading\n" + LONG, None), ("d", 1, 3, "e", 9.0, 9.0, 5.0, 5.0, "xkcdqrtzbnm", None)]
    b = spark.createDataFrame(rows, ROWS)
    assert {tuple(r.block_ids) for r in plans.overlap_issues(b).collect()} == {("a", "b")}
    assert {(r.check, r.block_ids[0]) for r in plans.bounds_issues(b).collect()} == {("page_bounds", "c"), ("inverted_box", "e")}
    assert {tuple(r.block_ids) for r in plans.layer_issues(b).collect()} == {("a", "b")}
    assert {r.block_ids[0] for r in plans.headings_in_body(b).collect()} == {"c"} and {r.block_ids[0] for r in plans.noise_issues(b).collect()} == {"e"}
    owned = spark.createDataFrame([("d", 1, "k1", "a"), ("d", 1, "k2", "a"), ("d", 1, "k2", "b")], "document string, page int, component_id string, block_id string")
    assert {(r.check, r.block_ids[0]) for r in plans.ownership_issues(owned, b).collect()} == {("duplicate_owner", "a"), ("missing_owner", "c"), ("missing_owner", "e")}
    assert plans.overlap_issues(b.where("false")).count() == 0


def test_spans(spark):
    b = frame(spark, (1, 100, "ab cd"), (1, 120, "xyz"), (1, 140, "ok"))
    spans = spark.createDataFrame([("d", 1, "b0", 0, 2, "ab"), ("d", 1, "b0", 3, 4, "d"), ("d", 1, "b1", 0, 2, "xy"), ("d", 1, "b2", 0, 2, "ok")], "document string, page int, block_id string, start int, end int, text string")
    assert {(r.check, r.block_ids[0]) for r in plans.span_issues(spans, b).collect()} == {("span_order", "b0"), ("span_end", "b1")}


def test_reports(spark):
    rows = [("d", p, c, s, "m", [f"b{p}"]) for p, c, s in ((2, "x", "warning"), (1, "y", "error"), (1, "x", "error"), (3, "z", "odd"))]
    i = spark.createDataFrame(rows, "document string, page int, `check` string, severity string, message string, block_ids array<string>")
    r = plans.severity_counts(i).first()
    assert (r.info, r.warning, r.error, r.highest, r.pages) == (0, 1, 2, "error", [1, 2, 3])
    assert [(t.rank, t.page, t.check) for t in plans.top_issues(i, 2).orderBy("rank").collect()] == [(1, 1, "x"), (2, 1, "y")]
    assert sources.report_lines(i, 2).first().report.count("\n") == 1


def test_xml_and_json_go_round(spark, tmp_path):
    b = frame(spark, (1, 100, 'a <b> & "c"\n d'), (1, 120, "x"), (2, 40, "汉字"), (2, 60, None))
    xml = sources.to_xml(b)
    back = {(r.page, r.y_min): r.text for r in sources.from_xml(xml).collect()}
    assert back == {(1, 100.0): 'a <b> & "c"\n d', (1, 120.0): "x", (2, 40.0): "汉字"}
    assert {(r.page, r.pos, r.block_id): r.text for r in sources.from_pages_json(sources.pages_json(b)).collect()} == {(1, 0, "b0"): 'a <b> & "c"\n d', (1, 1, "b1"): "x", (2, 0, "b2"): "汉字", (2, 1, "b3"): None}
    bad = spark.createDataFrame([("d", 1, "not json"), ("d", 2, '[{"bbox": [1, 2], "block_id": "a"}]')], "document string, page int, json string")
    assert sources.from_pages_json(bad).count() == 0
    (tmp_path / "one.xml").write_text(xml.first().xml)
    (tmp_path / "two.pdf").write_bytes(b"x")
    assert {r.document for r in sources.read_xml(spark, str(tmp_path)).collect()} == {"one"}
    assert [(r.document, r.size) for r in sources.list_documents(spark, str(tmp_path)).collect()] == [("two", 1)]


def test_similarity(spark):
    p = spark.createDataFrame([("d", 1, "a", "Same text", "same  text"), ("d", 1, "b", "abcd", "bcde"), ("d", 1, "c", None, "x")], "document string, page int, block_id string, text string, answer string")
    assert {r.block_id: r.similarity for r in review.similarities(p).collect()} == {"a": 1.0, "b": 0.75, "c": 0.0}
