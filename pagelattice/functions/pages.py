"""Page sets as sorted distinct arrays of integers: parsing, formatting, and how two of them relate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relations of the contract's pages to the document's, best last.
RELATIONS = ["disjoint", "overlap", "pdf_subset", "pdf_superset", "exact"]


def normalize_text(c: Column) -> Column:
    """Upper case without outer white space and with inner runs of it as one space; null gives ''."""
    trimmed = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.upper(F.regexp_replace(trimmed, r"(?U)\s+", " "))


def page_tokens(c: Column) -> Column:
    """Tokens between commas and white space of a string; of an array join its elements by a comma first. Null gives none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[,\s]+"), lambda t: t != "")


def parse_pages(tokens: Column) -> Column:
    """Sorted distinct pages of tokens: numbers, and ranges with either end first; other tokens are dropped."""

    def pages(t: Column) -> Column:
        ends = F.transform(F.split(t, "-"), lambda e: e.try_cast("int"))
        low, high = F.array_min(ends), F.array_max(ends)
        whole = F.forall(ends, lambda e: e.isNotNull())
        return F.when(t.rlike(r"^\d+(-\d+)?$") & whole, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, pages))))


def int_list(c: Column) -> Column:
    """Numbers of a comma-separated string, in order and with duplicates; other tokens are dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t).try_cast("int")), lambda p: p.isNotNull())


def format_pages(c: Column, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(c).cast("array<string>"), separator)


def distinct_texts(c: Column) -> Column:
    """Stripped non-empty strings of an array, each once, in order of first sight."""
    return F.array_distinct(F.filter(F.transform(c, lambda t: F.trim(t)), lambda t: t != ""))


def diff_detail(xml: Column, pdf: Column) -> Column:
    """'xml_only=...; pdf_only=...', without a part that is empty."""
    parts = [F.when(F.size(only) > 0, F.concat(F.lit(f"{name}="), format_pages(only))) for name, only in (("xml_only", F.array_except(xml, pdf)), ("pdf_only", F.array_except(pdf, xml)))]
    return F.concat_ws("; ", *parts)


def relation(xml: Column, pdf: Column) -> Column:
    """How two sets relate; equal sets are exact, two empty ones too."""
    inside = (F.size(xml) > 0) & (F.size(F.array_except(xml, pdf)) == 0)
    around = (F.size(pdf) > 0) & (F.size(F.array_except(pdf, xml)) == 0)
    return F.when(xml == pdf, "exact").when(inside, "pdf_superset").when(around, "pdf_subset").when(F.arrays_overlap(xml, pdf), "overlap").otherwise("disjoint")


def relation_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RELATIONS)), c).cast("int") - 1
