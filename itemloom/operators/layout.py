"""Regions of blocks on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-3


def boxes(blocks: DataFrame, group: list[str], page: str = "page", bbox: str = "bbox") -> DataFrame:
    """Per group and page, the smallest box around its blocks, as (group, page, bbox)."""
    b = lambda f, i: f(F.col(bbox)[i])
    return blocks.groupBy(*group, page).agg(F.array(b(F.min, 0), b(F.min, 1), b(F.max, 2), b(F.max, 3)).alias("bbox"))


def regions(blocks: DataFrame, group: list[str], page: str = "page", bbox: str = "bbox") -> DataFrame:
    """Per group the boxes of its pages, in the pages' order."""
    each = boxes(blocks, group, page, bbox)
    return each.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), "bbox"))).alias("regions"))


def blocks_in(blocks: DataFrame, wanted: DataFrame, on: list[str], region: str = "region", bbox: str = "bbox") -> DataFrame:
    """Blocks that lie in a wanted region of the same document and page, with a tolerance of ``EPS``."""
    b, r = blocks.withColumnRenamed(bbox, "__b"), wanted.withColumnRenamed(region, "__r")
    (x0, y0, x1, y1), (left, top, right, bottom) = ([F.col(c)[i] for i in range(4)] for c in ("__b", "__r"))
    inside = (x0 >= left - EPS) & (y0 >= top - EPS) & (x1 <= right + EPS) & (y1 <= bottom + EPS)
    return b.join(r, on).where(inside).withColumnRenamed("__b", bbox).withColumnRenamed("__r", region)


def remap_regions(regions_: DataFrame, old: DataFrame, new: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, question, page, bbox): regions moved to where the blocks that they held stand now; one that held none stays.

    ``regions_`` has doc, question, page and region; ``old`` and ``new`` have doc, block, page and bbox.
    """
    held = blocks_in(old.select(doc, "block", "page", "bbox"), regions_, [doc, "page"])
    moved = held.select(doc, "question", F.col("page").alias("was"), "block").join(new.select(doc, "block", "page", "bbox"), [doc, "block"])
    boxed = boxes(moved, [doc, "question", "was"]).withColumn("bbox", F.transform("bbox", lambda v: F.round(v, 4)))
    stay = regions_.select(doc, "question", F.col("page").alias("was"), F.col("region")).join(boxed, [doc, "question", "was"], "left")
    return stay.select(doc, "question", F.coalesce("page", "was").alias("page"), F.coalesce("bbox", "region").alias("bbox"))


def paginate(heights: DataFrame, group: list[str], order: str, height: str, limit: float) -> DataFrame:
    """Pages filled in order: a row that would overflow starts the next page; the fold runs in the JVM."""
    seq = heights.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, height))).alias("__s"))  # bounded by a document
    start = F.struct(F.lit(0.0).alias("used"), F.lit(1).alias("page"), F.array().cast("array<int>").alias("pages"))

    def step(s, x):
        over = (s["used"] > 0) & (s["used"] + x[height] > limit)
        page = s["page"] + over.cast("int")
        return F.struct(F.when(over, x[height].cast("double")).otherwise(s["used"] + x[height]).alias("used"), page.alias("page"), F.concat(s["pages"], F.array(page)).alias("pages"))

    folded = seq.withColumn("__p", F.aggregate("__s", start, step, lambda s: s["pages"]))
    return folded.select(*group, F.explode(F.arrays_zip("__s", "__p")).alias("z")).select(*group, F.col(f"z.__s.{order}").alias(order), F.col("z.__p").alias("page"))
