"""Greedy groupings of a page's boxes, where a box joins a group by what the group has become so far.

The result depends on the order of the boxes, so these run as one function over the boxes of each page. A page's boxes are
few by nature; pages are spread over the tasks, and documents are never gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

from leafmesh.operators.boxes import BOX, PAGE

_KEYS = "document string, page int"


def _by_page(boxes: DataFrame, columns: list[str], group: Callable[[pd.DataFrame], list[int]], order: list[str]) -> DataFrame:
    """The rows of each page in `order`, with the number that `group` gives each as column `cluster`."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        rows["cluster"] = pd.Series(group(rows), dtype="int32")
        return rows[[*PAGE, *columns, "cluster"]]

    thin = boxes.select(*PAGE, *dict.fromkeys([*columns, *order]))
    kinds = {f.name: f.dataType.simpleString() for f in thin.schema}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in (*PAGE, *columns)) + ", cluster int"
    return thin.groupBy(*PAGE).applyInPandas(run, ddl)


def rows_of_lines(lines: DataFrame, tolerance: float = 2.2, back: int = 4) -> DataFrame:
    """(document, page, block_id, cluster): fragments of lines put together into rows.

    In the order of their middles a fragment joins the nearest of the last `back` rows whose median middle is within
    `tolerance`; else it begins a row. Ties go to the later row.
    """

    def group(rows: pd.DataFrame) -> list[int]:
        out, middles = [], []
        for top, bottom in zip(rows["y_min"], rows["y_max"], strict=True):
            y = (top + bottom) / 2
            best, least = -1, tolerance
            for k in range(max(0, len(middles) - back), len(middles)):
                distance = abs(median(middles[k]) - y)
                if distance <= least:
                    best, least = k, distance
            if best < 0:
                middles.append([])
                best = len(middles) - 1
            middles[best].append(y)
            out.append(best + 1)
        return out

    return _by_page(lines, ["block_id"], group, ["y_min", "x_min", "pos", "y_max"]).select(*PAGE, "block_id", "cluster")


def lanes(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """(document, page, block_id, cluster): columns of a page.

    From top to bottom a box joins the first lane that shares at least `share` of the narrower width; the lane then
    grows around it.
    """

    def group(rows: pd.DataFrame) -> list[int]:
        out: list[int] = []
        found: list[list[float]] = []
        for left, right in zip(rows["x_min"], rows["x_max"], strict=True):
            for k, lane in enumerate(found):
                shared = min(right, lane[1]) - max(left, lane[0])
                narrow = min(right - left, lane[1] - lane[0])
                if narrow > 0 and shared >= share * narrow:
                    lane[0], lane[1] = min(lane[0], left), max(lane[1], right)
                    out.append(k + 1)
                    break
            else:
                found.append([left, right])
                out.append(len(found))
        return out

    return _by_page(boxes, ["block_id"], group, ["y_min", "x_min", "pos", "x_max"]).select(*PAGE, "block_id", "cluster")


def merged_regions(boxes: DataFrame, share: float = 0.45, gap: float = 10.0) -> DataFrame:
    """(document, page, block_id, cluster): regions that boxes grow into, each joining the first region it is close to."""

    def group(rows: pd.DataFrame) -> list[int]:
        out: list[int] = []
        regions: list[list[float]] = []
        for x0, y0, x1, y1 in rows[list(BOX)].itertuples(index=False):
            for k, r in enumerate(regions):
                narrow = min(x1 - x0, r[2] - r[0])
                shared = min(x1, r[2]) - max(x0, r[0])
                if narrow > 0 and shared >= share * narrow and max(y0, r[1]) - min(y1, r[3]) <= gap:
                    regions[k] = [min(x0, r[0]), min(y0, r[1]), max(x1, r[2]), max(y1, r[3])]
                    out.append(k + 1)
                    break
            else:
                regions.append([x0, y0, x1, y1])
                out.append(len(regions))
        return out

    return _by_page(boxes, ["block_id"], group, ["y_min", "x_min", "pos", "x_max", "y_max"]).select(*PAGE, "block_id", "cluster")


def absorbed_labels(boxes: DataFrame, seeds: str, gap: float = 24.0) -> DataFrame:
    """(document, page, block_id, cluster): each seed with the boxes above it that join it one after the other.

    A box joins the region of a seed if it ends at most `gap` above it and lies across it; the region then grows, until no
    box joins any more. A box belongs to the first seed that takes it; boxes that none takes have cluster 0.
    """

    def group(rows: pd.DataFrame) -> list[int]:
        spans = rows[list(BOX)].to_numpy()
        taken = [0] * len(rows)
        number = 0
        for i in [k for k, s in enumerate(rows["_seed"]) if s]:
            if taken[i]:
                continue
            number += 1
            taken[i] = number
            region = list(spans[i])
            grown = True
            while grown:
                grown = False
                for k, (x0, y0, x1, y1) in enumerate(spans):
                    if not taken[k] and not rows["_seed"][k] and 0 <= region[1] - y1 <= gap and min(x1, region[2]) > max(x0, region[0]):
                        taken[k] = number
                        region = [min(x0, region[0]), min(y0, region[1]), max(x1, region[2]), max(y1, region[3])]
                        grown = True
        return taken

    from pyspark.sql import functions as F

    marked = boxes.withColumn("_seed", F.coalesce(F.expr(seeds), F.lit(False)))
    return _by_page(marked, ["block_id", "_seed"], group, ["y_min", "x_min", "pos", *BOX]).select(*PAGE, "block_id", "cluster")
