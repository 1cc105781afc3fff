"""Boxes found on page pictures: overlap, acceptance, suppression, budgets; and the ranking of readings. rect: struct(x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without an overlap."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, w * 0) * F.greatest(h, h * 0)
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def accept(measured: DataFrame, least_area: int = 120) -> DataFrame:
    """Boxes among measured contours: source (color, border), area, rect, page_area, corners, fill_ratio, colored_ratio, border_density, dark_ratio.

    Keeps those of plausible size and shape, with type and confidence.
    """
    w, h, size = F.col("rect.w"), F.col("rect.h"), F.col("rect.w") * F.col("rect.h")
    shape = (F.col("area") >= max(least_area, 120)) & (w >= 24) & (h >= 10) & (size <= F.col("page_area") * 0.18) & ~((w <= 26) & (h <= 26) & (F.col("area") < 320)) & (F.greatest(w, h) / F.least(w, h) <= 35) & (F.col("corners") <= 10)
    fill, colored, border, dark = (F.col(c) for c in ("fill_ratio", "colored_ratio", "border_density", "dark_ratio"))
    by_color = 0.50 * colored + 0.35 * fill + 0.15 * F.least(border * 8.0, F.lit(1.0))
    by_border = 0.65 * F.least(border * 6.0, F.lit(1.0)) + 0.20 * F.least(fill * 1.8, F.lit(1.0)) + 0.15 * F.least(dark * 10.0, F.lit(1.0))
    color = F.col("source") == "color"
    good = F.when(color, (fill >= 0.35) & (colored >= 0.40) & (by_color >= 0.42)).otherwise((border >= 0.08) & (fill >= 0.08) & (dark >= 0.015) & (by_border >= 0.34))
    kind = F.when(color, F.when(border >= 0.12, "solid_border").when(border >= 0.05, "dashed_border").otherwise("colored_bg")).otherwise(F.when(border >= 0.12, "border_only").otherwise("dashed_border"))
    rounded = lambda c, n: F.round(c, 3).alias(n)
    out = measured.where(shape & good).withColumn("type", kind).withColumn("confidence", F.least(F.lit(1.0), F.round(F.when(color, by_color).otherwise(by_border), 3)))
    return out.select(*[rounded(F.col(c), c) if c in ("fill_ratio", "colored_ratio", "border_density") else F.col(c) for c in out.columns])


def suppress(boxes: DataFrame, page: list[str], most_overlap: float = 0.45, most: int = 38) -> DataFrame:
    """Per page the boxes, best confidence first, that overlap no better kept one by more than `most_overlap`; at most `most`. Order decides, so a page is one fold; a page's boxes are few.

    boxes: page columns, box_seq, rect, confidence. The result has kept_seq (from 1) in that order.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), F.col("box_seq").alias("box_seq"), F.col("rect").alias("rect"), F.col("confidence").alias("confidence"))))
    rows = boxes.groupBy(*page).agg(ordered.alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda have, x: F.when((F.size(have) >= most) | F.exists(have, lambda y: iou(x["rect"], y["rect"]) > most_overlap), have).otherwise(F.array_append(have, x)))
    return rows.select(*page, F.posexplode(kept).alias("i", "x")).select(*page, (F.col("i") + 1).alias("kept_seq"), "x.box_seq", "x.rect", "x.confidence")


def first_of(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group: budgets of costly readers per page, or the largest contours."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def per_page(rows: DataFrame, page: list[str]) -> DataFrame:
    """Boxes of each page, by type: what a run has found."""
    return rows.groupBy(*page).agg(F.count("*").alias("boxes"), *(F.count_if(F.col("type") == t).alias(t) for t in ("solid_border", "dashed_border", "colored_bg", "border_only")))


#: How many boxes of a page the costly readers may take, and how many outlines are tried where few coloured boxes are found.
EASYOCR_BUDGET, TROCR_BUDGET, EDGE_CONTOURS, FEW_COLORED = 8, 4, 180, 22


def readable(boxes: DataFrame) -> DataFrame:
    """Without long thin boxes that have hardly a border: rules, not annotations."""
    thin = (F.col("rect.h") <= 14) & (F.col("rect.w") >= 180) & (F.col("rect.w") / F.greatest(F.lit(1), F.col("rect.h")) >= 9.5) & (F.col("border_density") < 0.30)
    return boxes.where(~thin)


def rank_quick(readings: DataFrame, box: list[str]) -> DataFrame:
    """readings(box, cand_seq, text, score) with rank and gap to the next; 99 without one. Best score first, then shorter text, then order."""
    w = Window.partitionBy(*box).orderBy(F.desc("score"), F.length("text"), "cand_seq")
    return readings.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(99.0)))


def choose_reading(ranked: DataFrame, box: list[str]) -> DataFrame:
    """The reading of each box by score, confidence and quality (columns conf, adj), among the best and a runner-up within 1.0.

    Totals that agree to nine decimals are equal, as sums of the same value can differ in the last bits; then score, confidence and the shorter text decide.
    """
    best = Window.partitionBy(*box)
    near = ranked.where("rank <= 2").withColumn("_best", F.max("score").over(best)).where("rank = 1 or _best - score <= 1.0")
    near = near.withColumn("total", F.col("score") * 10.0 + F.col("conf") + F.col("adj"))
    w = best.orderBy(F.round("total", 9).desc(), F.desc("score"), F.desc("conf"), F.length("text"), "rank")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_best", "rank", "gap")


def mean_confidence(words: DataFrame, box: list[str]) -> DataFrame:
    """Mean confidence of the words whose confidence is valid (0 or more)."""
    return words.groupBy(*box).agg(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("mean_conf"))
