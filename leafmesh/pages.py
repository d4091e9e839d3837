"""Readers and reshapers for pages of positioned blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Page margins in points: a block's margin is yMin < TOP_MARGIN or yMin > BOTTOM_MARGIN.
TOP_MARGIN, BOTTOM_MARGIN = 62.0, 745.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_pages(pages: DataFrame, order: str = "loaded_at", keys: tuple[str, ...] = ("document", "page")) -> DataFrame:
    """One row per page: of several deliveries the last one; rows without a key are left out.

    Ties in the order column go to an arbitrary delivery, which matters only where deliveries differ.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    kept = pages.where(" and ".join(f"`{k}` is not null" for k in keys))
    return kept.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def blocks(pages: DataFrame, *extra: str) -> DataFrame:
    """One row per block with its position in extraction order; pages without blocks give no row.

    Nothing is dropped here: a page that was delivered twice gives its blocks twice.
    """
    return pages.select("document", "page", "source", *extra, F.posexplode("blocks").alias("pos", "b")).select(
        "document", "page", "source", *extra, "pos", F.col("b.id").alias("block_id"), F.col("b.xMin").alias("x_min"),
        F.col("b.yMin").alias("y_min"), F.col("b.xMax").alias("x_max"), F.col("b.yMax").alias("y_max"),
        F.col("b.text").alias("text"), F.col("b.preserve_image").alias("preserve_image"),
    )


def in_margin(y: str = "y_min") -> Column:
    """Whether a block stands in a margin; null coordinates are no margin."""
    return F.coalesce((F.col(y) < TOP_MARGIN) | (F.col(y) > BOTTOM_MARGIN), F.lit(False))
