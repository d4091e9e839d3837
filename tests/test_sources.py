import json

from pyspark.sql import functions as F

from leafmesh import pipeline, sources
from leafmesh.operators import plans
from tests.test_plans import LONG, frame


def test_images_and_recognition(spark, tmp_path):
    for d, p in (("one", 1), ("one", 12), ("two", 1)):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / f"page-{p:03d}.png").write_bytes(f"{d}{p}".encode())
    images = sources.page_images(spark, str(tmp_path))
    assert {(r.document, r.page) for r in images.select("document", "page").collect()} == {("one", 1), ("one", 12), ("two", 1)}
    expected = spark.createDataFrame([("one", 1), ("one", 2), ("two", 1)], "document string, page int")
    assert [tuple(r) for r in sources.missing_pages(expected, images).collect()] == [("one", 2)]
    lines = sources.recognised(images, lambda data: [(9, 50, 20, 60, "low", 0.9), (0, 10, 5, 20, data.decode(), 0.8), (0, 1, 2, 3, "bad", 0.1), (0, 5, 2, 6, " ", 0.9)])
    assert [(r.block_id, r.text) for r in lines.where("document = 'one' and page = 12").orderBy("pos").collect()] == [("p012b0001", "one12"), ("p012b0002", "low")]
    one, same, other = (sources.source_keys(images, **s).orderBy("document", "key").collect() for s in ({"dpi": 200, "force": True}, {"force": True, "dpi": 200}, {"dpi": 100, "force": True}))
    assert one == same != other


def test_prompts(spark):
    r = sources.prompts(pipeline.requests(frame(spark, (1, 100, LONG))), "Translate.", {"cache": "缓存"}).first()
    assert r.prompt.startswith("Translate.\ncache = 缓存\n") and json.loads(r.prompt.split("\n", 2)[2]) == [{"id": "b0", "text": LONG}]


def test_report_and_publication(spark, tmp_path):
    rows = [("d", p, "x", s, "m", [f"b{p}"]) for p, s in ((1, "warning"), (2, "error"))]
    issues = spark.createDataFrame(rows, "document string, page int, `check` string, severity string, message string, block_ids array<string>")
    got = json.loads(sources.report_json(plans.severity_counts(issues), issues).first().json)
    assert (got["error"], got["warning"], got["highest"], [i["page"] for i in got["issues"]]) == (1, 1, "error", [2, 1])
    path = f"file://{tmp_path}/out"
    sources.published(spark.range(3), path)
    sources.published(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(path + ".old").count() == 3
    sources.write_pages(frame(spark, (1, 100, LONG)), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").select(F.col("document"), "page").first().page == 1
