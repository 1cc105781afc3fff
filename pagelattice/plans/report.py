"""Reports over indexes: classification, order, filters, display columns and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.operators.reconcile import DATASET_CATEGORIES

#: Order of the classes in a report.
CLASS_ORDER = ["Domain", "Variable", "NOT SUBMITTED"]
#: Rows that a table on a screen shows, and pages of a listing of single steps.
TABLE_ROWS, LISTED_PAGES = 800, 50
RESULT_COLUMNS = ["Classification", "Name", "Pages", "PageCount", "Category", "RawTexts"]
SUMMARY_COLUMNS = ["Dataset", "XML_Variable_Count", "MATCH", "VLM_RESOLVED", "PAGE_MISMATCH", "MISSING_IN_PDF", "LOW_CONFIDENCE"]
DETAIL_COLUMNS = ["XML_Dataset", "XML_Variable", "XML_Pages", "XML_PageCount", "PDF_Matched_Name", "PDF_Pages", "PDF_PageCount", "diff_type", "page_subset", "match_path", "page_diff_detail", "note"]
EXTRA_COLUMNS = ["diff_type", "PDF_Name", "PDF_Pages", "PDF_PageCount", "Category", "subtype", "RawTexts"]
EXTRA_DOMAIN_COLUMNS = ["diff_type", "PDF_Domain", "PDF_Pages", "PDF_PageCount", "subtype"]


def classification(category: Column) -> Column:
    return F.when(category == "not_submitted", "NOT SUBMITTED").when(category.isin(DATASET_CATEGORIES), "Domain").otherwise("Variable")


def class_rank(c: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, CLASS_ORDER)), c)
    return F.when(at > 0, at - 1).otherwise(99).cast("int")


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def wrap(c: Column, n: int | None = None) -> Column:
    """A cell with a line break after each comma, semicolon and bar."""
    out = F.replace(F.replace(F.replace(c, F.lit(","), F.lit(",\n")), F.lit("; "), F.lit(";\n")), F.lit(" | "), F.lit("\n"))
    return out if n is None else preview(out, n)


def result(index: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Index rows (variable, page_string, page_count, category, raw_texts) and the domains (domain, page_string, page_count) that are not among them as data sets, in report columns."""
    rows = index.select(classification(F.col("category")).alias("Classification"), F.col("variable").alias("Name"), F.col("page_string").alias("Pages"), F.col("page_count").alias("PageCount"), F.col("category").alias("Category"), F.array_join("raw_texts", " | ").alias("RawTexts"))
    if domains is None:
        return rows
    known = rows.where("Classification = 'Domain'").select("Name")
    more = domains.select(F.lit("Domain").alias("Classification"), F.col("domain").alias("Name"), F.col("page_string").alias("Pages"), F.col("page_count").alias("PageCount"), F.lit("dataset_name").alias("Category"), F.lit("").alias("RawTexts"))
    return rows.unionByName(more.join(known, "Name", "left_anti"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(class_rank(F.col("Classification")), "Name")


def first_rows(rows: DataFrame, limit: int = TABLE_ROWS) -> DataFrame:
    """What a screen shows of a report: its first rows in order."""
    return in_order(rows).limit(limit)


def unmatched(rows: DataFrame) -> DataFrame:
    return rows.where("Category = 'unknown'")


def search(rows: DataFrame, column: str, query: str) -> DataFrame:
    return rows.where(F.lower(column).contains(query.lower())) if query else rows


def result_metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("Category") == "not_submitted").alias("not_submitted"), F.count_if(F.col("Category") == "unknown").alias("unknown"))


def detail_display(detail: DataFrame) -> DataFrame:
    """Fewer, wider columns for a screen."""
    pages = lambda p: F.concat(F.col(f"{p}_Pages"), F.lit(" ("), F.col(f"{p}_PageCount").cast("string"), F.lit(")"))
    return detail.select(F.concat_ws(" / ", "XML_Dataset", "XML_Variable").alias("item"), wrap(pages("XML")).alias("xml_pages"), F.col("PDF_Matched_Name").alias("matched"), wrap(pages("PDF")).alias("pdf_pages"), F.concat_ws(" / ", "diff_type", "page_subset", "match_path").alias("verdict"), wrap(F.col("page_diff_detail")).alias("difference"))


def write_csv(rows: DataFrame, fields: list[str], path: str) -> None:
    """One CSV file with a header and just `fields`: other columns are left out, missing ones are blank. For reports, which are small."""
    cells = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in fields]
    rows.select(cells).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_result(index: DataFrame, path: str, domains: DataFrame | None = None) -> None:
    write_csv(in_order(result(index, domains)), RESULT_COLUMNS, path)


def write_unmatched(index: DataFrame, path: str) -> None:
    write_csv(in_order(unmatched(result(index))), RESULT_COLUMNS, path)


def write_cross_validation(found, path: str) -> None:
    """The four files of a cross-validation, each in a folder of its own under `path`."""
    write_csv(found.summary_by_dataset.orderBy("Dataset"), SUMMARY_COLUMNS, f"{path}/summary")
    write_csv(found.detail.orderBy("XML_Dataset", "XML_Variable"), DETAIL_COLUMNS, f"{path}/detail")
    write_csv(found.extra_variables.orderBy("PDF_Name"), EXTRA_COLUMNS, f"{path}/extra_variables")
    write_csv(found.extra_domains.orderBy("PDF_Domain"), EXTRA_DOMAIN_COLUMNS, f"{path}/extra_domains")
