import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmesh import pipeline, records
from leafmesh.operators import pixels
from tests.test_plans import LONG, frame


def test_run_takes_up_where_it_stopped(spark):
    b = frame(spark, (1, 100, LONG), (1, 120, LONG + " too"), (1, 760, "- 1 -"), (2, 100, "2 Related Work"), (2, 130, "f(x) = x² + 1"), (2, 150, None))
    out = pipeline.run(b, lambda row: {i["block_id"]: "译文" + i["block_id"] for i in row["items"]}, options=pipeline.Options(batch_characters=100))
    assert {r.block_id: r.answer for r in out["answers"].collect()} == {k: "译文" + k for k in ("b0", "b1", "b3")}
    assert {r.block_id: (r.kind, r.text) for r in out["items"].collect()} == {"b0": ("text", "译文b0"), "b1": ("text", "译文b1"), "b2": ("skip", None), "b3": ("text", "译文b3"), "b4": ("image", None), "b5": ("skip", None)}
    assert [r.share for r in out["coverage"].orderBy("page").collect()] == [1.0, 1.0]
    assert not pipeline.has_errors(out["issues"]) and records.plan_problems(out["plans"]).count() == 0

    def refuse(row):
        raise AssertionError("must not be asked again")

    again, kept = pipeline.translate(b, refuse, out["cache"], pipeline.Options(batch_characters=100))
    assert {r.block_id for r in again.collect()} == {"b0", "b1", "b3"} and kept.count() == out["cache"].count()


def test_failed_requests_are_asked_again_and_missing_answers_stay_missing():
    calls = []

    def model(row):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError
        return {"a": "好", "b": " ", "zz": "x"}

    assert pipeline.with_attempts(model, 3)([{"items": [{"block_id": "a"}, {"block_id": "b"}]}]) == ['{"a": "好"}'] and len(calls) == 3


def test_each_block_has_one_owner(spark):
    b = frame(spark, (1, 100, LONG), (1, 115, "x"), (1, 125, "y"), (1, 300, "z")).withColumn("preserve_image", F.col("pos") > 0)
    c = pipeline.components(b)
    assert {tuple(r.block_ids) for r in c.collect()} == {("b0",), ("b1", "b2"), ("b3",)}
    assert pipeline.plans.ownership_issues(pipeline.owners(c), b).count() == 0


def test_slices_of_spans(spark):
    d = spark.sql(f"select cast(array(named_struct('block_id', 'a', 'start', 5, 'end', 10), named_struct('block_id', 'b', 'start', 0, 'end', 3)) as array<{records.SPAN}>) as s")
    for lo, hi, want in ((0, 8, [("a", 5, 10), ("b", 0, 3)]), (2, 6, [("a", 7, 10), ("b", 0, 1)]), (5, 6, [("b", 0, 1)]), (3, 3, [])):
        assert [tuple(x) for x in d.select(records.slice_spans(F.col("s"), F.lit(lo), F.lit(hi)).alias("x")).first().x] == want


def test_bad_plans_are_found(spark):
    rows = [("d", 1, "{"), ("d", 2, '{"page": 3, "items": [], "coverage": []}'), ("d", 4, '{"page": 4, "coverage": [], "items": [{"kind": "odd", "bbox": [1, 2, 0], "block_ids": []}, {"kind": "text", "bbox": [0, 0, 1, 1], "block_ids": ["a"]}]}')]
    got = {(r.page, r.place, r.problem) for r in records.plan_problems(spark.createDataFrame(rows, "document string, page int, json string")).collect()}
    assert got == {(1, -1, "unreadable"), (2, -1, "wrong_page"), (4, 0, "unknown_kind"), (4, 0, "bad_box"), (4, 0, "no_blocks"), (4, 1, "uncovered")}


def png(grey, filters=None):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = grey.shape
    lines = []
    for y in range(h):
        f = filters[y % len(filters)] if filters else 0
        row, above = grey[y].astype(int), grey[y - 1].astype(int) if y else np.zeros(w, int)
        left, corner = np.append(0, row[:-1]), np.append(0, above[:-1])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines.append(bytes([f]) + ((row - {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: paeth}[f]) % 256).astype(np.uint8).tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_png_filters(filters):
    grey = np.random.default_rng(1).integers(0, 256, (11, 7))
    assert (pixels.grey_png(png(grey, filters)) == grey).all()


def test_dark_pixels(spark):
    image = np.full((801, 623), 255)
    image[105:110, 70:90] = 0
    images = spark.createDataFrame([("d", 1, bytearray(png(image)))], "document string, page int, content binary")
    got = {r.block_id: r for r in pixels.dark_pixels(frame(spark, (1, 100, "a"), (1, 300, "b"), (2, 100, "c")), images).collect()}
    assert set(got) == {"b0", "b1"} and got["b0"].dark == 100 and got["b1"].dark == 0 and got["b1"].x_min is None
    assert (got["b0"].x_min, got["b0"].y_min, got["b0"].x_max, got["b0"].y_max) == (70.0, 105.0, 90.0, 110.0)
    with pytest.raises(ValueError, match="PNG"):
        pixels.grey_png(b"x")
