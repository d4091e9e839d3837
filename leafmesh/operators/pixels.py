"""Pixels of page images: how many are dark in a box, and the box that they fill.

Images come as bytes in a table, one row per page, and are read where they lie. PNG files of eight bits per channel without
interlacing are read here; another reader is passed as a function of bytes to an array of grey values.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmesh.operators.boxes import BOX, PAGE, PAGE_HEIGHT, PAGE_WIDTH

DARK = 245
Reader = Callable[[bytes], np.ndarray]


def grey_png(data: bytes) -> np.ndarray:
    """The grey values of a PNG of 8 bits per channel: grey, grey with alpha, RGB or RGBA."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, packed, head = 8, b"", None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("this kind of PNG is not read here")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), dtype=np.uint8)
    above = np.zeros(width * channels, dtype=np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 2:
            above = line + above
        elif kind == 0:
            above = line.copy()
        elif kind == 1:
            above = np.cumsum(line.reshape(width, channels), axis=0, dtype=np.uint8).ravel()
        else:
            row = bytearray(line.tobytes())
            for x in range(len(row)):
                a, b, c = row[x - channels] if x >= channels else 0, int(above[x]), int(above[x - channels]) if x >= channels else 0
                if kind == 3:
                    row[x] = (row[x] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    row[x] = (row[x] + best) & 255
            above = np.frombuffer(bytes(row), dtype=np.uint8)
        out[y] = above
    pixels = out.reshape(height, width, channels).astype(float)
    if channels in (2, 4):
        alpha = pixels[:, :, -1:] / 255
        pixels = pixels[:, :, :-1] * alpha + 255 * (1 - alpha)
    return pixels.mean(axis=2)


def crop(pixels: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, int, int]:
    """The pixels that a box in points covers, and where they begin."""
    h, w = pixels.shape
    x0, y0 = max(0, int(np.floor(box[0] * w / PAGE_WIDTH))), max(0, int(np.floor(box[1] * h / PAGE_HEIGHT)))
    x1, y1 = min(w, int(np.ceil(box[2] * w / PAGE_WIDTH))), min(h, int(np.ceil(box[3] * h / PAGE_HEIGHT)))
    return pixels[y0 : max(y0, y1), x0 : max(x0, x1)], x0, y0


def dark_pixels(boxes: DataFrame, images: DataFrame, reader: Reader = grey_png, threshold: int = DARK) -> DataFrame:
    """(document, page, block_id, total, dark, x_min, y_min, x_max, y_max): the pixels of each box, and the box of the dark ones in points.

    `images` is (document, page, content). A box without dark pixels has null coordinates; boxes of pages without an image
    give no row. Boxes are gathered by page, so that an image is sent and read once.
    """
    schema = pa.schema([("document", pa.string()), ("page", pa.int32()), ("block_id", pa.string()), ("total", pa.int64()), ("dark", pa.int64()), *((c, pa.float64()) for c in BOX)])
    from pyspark.sql import functions as F

    listed = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("block_id", *BOX)).alias("boxes"))
    joined = images.select(*PAGE, "content").join(listed, [*PAGE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pixels = reader(row["content"])
                h, w = pixels.shape
                for b in row["boxes"]:
                    if any(b[c] is None for c in BOX):
                        continue
                    part, x, y = crop(pixels, tuple(b[c] for c in BOX))
                    ys, xs = np.nonzero(part < threshold)
                    span = [None] * 4 if not len(xs) else [(x + xs.min()) * PAGE_WIDTH / w, (y + ys.min()) * PAGE_HEIGHT / h, (x + xs.max() + 1) * PAGE_WIDTH / w, (y + ys.max() + 1) * PAGE_HEIGHT / h]
                    out.append((row["document"], row["page"], b["block_id"], part.size, len(xs), *span))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, "document string, page int, block_id string, total bigint, dark bigint, " + ", ".join(f"{c} double" for c in BOX))
