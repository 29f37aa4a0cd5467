"""Operators on layout boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The detector's labels by what is done with them.
ROUTES = {
    "doc_title": ["doc_title"],
    "title": ["paragraph_title", "figure_title", "table_title", "chart_title", "formula_caption"],
    "figure": ["image", "figure", "chart", "seal"],
    "table": ["table"],
    "formula": ["formula", "formula_number"],
}
IOU_LIMIT = 0.6
#: The least side of a region that is read.
SMALLEST = 4


def route(label: Column) -> Column:
    out = F.lit("text")
    for name, labels in ROUTES.items():
        out = F.when(label.isin(labels), name).otherwise(out)
    return out


def heading(label: Column, text: Column) -> Column:
    return F.when(route(label) == "doc_title", F.concat(F.lit("# "), text)).when(route(label) == "title", F.concat(F.lit("## "), text)).otherwise(text)


def in_reading_order(boxes: DataFrame, page: str, *content: str) -> DataFrame:
    """boxes with `place` from 1: by bands of half the mean height (8 at least), then x, then ord; what is alike in these by its other corners and `content`."""
    of = Window.partitionBy(page)
    band = F.greatest(F.lit(8.0), 0.5 * F.avg(F.col("y2") - F.col("y1")).over(of))
    return boxes.withColumn("band", F.rint(F.col("y1") / band)).withColumn("place", F.row_number().over(of.orderBy("band", "x1", "ord", "y1", "x2", "y2", *content)))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def without_overlaps(boxes: DataFrame, page: str) -> DataFrame:
    """page, kept: of boxes that overlap by more than the limit the one of higher score, earlier of equals."""
    box = F.struct((-F.coalesce(F.col("score"), F.lit(0.0))).alias("rank"), "ord", "label", "x1", "y1", "x2", "y2")
    whole = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    ranked = boxes.where(whole).groupBy(page).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    keep = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > IOU_LIMIT), acc).otherwise(F.array_append(acc, b)))
    return ranked.select(page, F.explode(keep).alias("b")).select(page, "b.ord", "b.label")


def clamped(x1, y1, x2, y2, width, height):
    """Corners rounded half to even, then kept within the page."""
    inside = lambda v, most: F.greatest(F.lit(0), F.least(most, F.rint(v))).cast("int")
    return F.struct(inside(x1, width).alias("x1"), inside(y1, height).alias("y1"), inside(x2, width).alias("x2"), inside(y2, height).alias("y2"))


def page_markdown(boxes: DataFrame, page: str) -> DataFrame:
    """page, md, table_count, image_count, formula_count of a page put together from its regions.

    boxes: page, ord, label, x1, y1, x2, y2, what was read there as text, table and grid (Markdown of a table by its lines, else
    by the places of its words, or null), and the page's width and height. Regions of under 4 pixels a side after clamping are
    left out; figures are links to crops, numbered in reading order; a table without a grid is its text; a counter rises only for
    what is put out. Boxes of one band, x1 and ord are told apart by all that can be seen of them, so rows in any order give the same page.
    """
    placed = in_reading_order(boxes, page, "label", "text", "table", "grid").withColumn("crop", clamped("x1", "y1", "x2", "y2", F.col("width"), F.col("height")))
    kept = placed.where((F.col("crop.x2") - F.col("crop.x1") >= SMALLEST) & (F.col("crop.y2") - F.col("crop.y1") >= SMALLEST)).withColumn("kind", route(F.col("label")))
    nth = F.count_if(F.col("kind") == "figure").over(Window.partitionBy(page).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    text = F.nullif(F.trim("text"), F.lit(""))
    grid = F.coalesce("table", "grid")
    figure = F.format_string("![](images/page_%04d_fig_%d.png)", F.col(page).cast("bigint"), nth)
    part = F.when(F.col("kind") == "table", F.coalesce(grid, text)).when(F.col("kind") == "figure", figure).otherwise(heading(F.col("label"), text))
    parts = kept.withColumn("part", part)
    made = parts.groupBy(page).agg(
        F.expr("coalesce(listagg(part, '\\n\\n') WITHIN GROUP (ORDER BY place), '')").alias("md"),
        F.count_if((F.col("kind") == "table") & grid.isNotNull()).alias("table_count"), F.count_if(F.col("kind") == "figure").alias("image_count"),
        F.count_if((F.col("kind") == "formula") & F.col("part").isNotNull()).alias("formula_count"),
    )
    return made
