"""Labelled regions of pages, as CSV: page, x, y, w, h, expected_text. Appended part by part; each part has the header once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "page int, x int, y int, w int, h int, expected_text string"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("header", True).csv(path)


def append_gold(rows: DataFrame, path: str) -> None:
    rows.select("page", "x", "y", "w", "h", "expected_text").write.mode("append").option("header", True).csv(path)


def page_spec(spec: Column, total: Column) -> Column:
    """Sorted distinct pages of a specification such as '11-30,35', those from 1 to total; parts that are no page or range go."""
    parts = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda t: F.regexp_replace(t, r"\s", "")), lambda t: t.rlike(r"^\d{1,9}(-\d{1,9})?$"))
    ends = lambda t: F.transform(F.split(t, "-"), lambda e: e.cast("int"))
    # a range is clipped before it is laid out
    clipped = F.transform(parts, lambda t: F.struct(F.greatest(F.array_min(ends(t)), F.lit(1)).alias("low"), F.least(F.array_max(ends(t)), total).alias("high")))
    pages = F.transform(F.filter(clipped, lambda r: r["low"] <= r["high"]), lambda r: F.sequence(r["low"], r["high"]))
    return F.array_sort(F.array_distinct(F.flatten(pages)))
