"""Define-XML as a contract table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions.text import oid_dataset
from pagelattice.operators.reconcile import first_per_name

#: An ItemDef at any depth below the root is brought to one list before parsing, so that a fixed schema reads all of them in document order.
_ITEM = r"""(?s)<(?:[\w.-]+:)?ItemDef\b(?:(?:[^>"'/]++|"[^"]*"|'[^']*'|/(?!>))*+/>|.*?</(?:[\w.-]+:)?ItemDef\s*>)"""
_REFS = r"""(?s)<(?:[\w.-]+:)?PDFPageRef\b[^>]*?\bPageRefs\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def page_list(refs: Column) -> Column:
    """Tokens between white space, with duplicates."""
    return F.filter(F.split(F.coalesce(refs, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def item_definitions(documents: DataFrame, text: str = "value") -> DataFrame:
    """doc_id, pos, name, oid, page_refs of each ItemDef of each document (doc_id, text), in document order; page_refs are those of the first page reference.

    Documents with a document type are refused: external entities are never read. Text that is no XML raises when it is read.
    """
    body = F.when(F.col(text).rlike(r"(?i)<!DOCTYPE|<!ENTITY"), F.raise_error(F.lit("a document type is not allowed"))).otherwise(F.col(text))
    # without comments, and checked as a whole: from_xml fails on text that is not well formed
    plain = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    checked = F.from_xml(plain, "_corrupt string", {"mode": "FAILFAST", "columnNameOfCorruptRecord": "_corrupt"})
    rows = documents.select("doc_id", plain.alias("body"), checked.alias("checked"))
    items = rows.select("doc_id", F.posexplode(F.regexp_extract_all("body", F.lit(_ITEM), F.lit(0))).alias("pos", "item"))
    # an attribute's value may hold >
    opening = F.regexp_extract("item", r"""(?s)^<(?:[^>"']++|"[^"]*"|'[^']*')*+>""", 0)
    parsed = F.from_xml(F.concat(F.regexp_replace(opening, r"/?>$", ""), F.lit("/>")), "_Name string, _OID string", {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    refs = F.coalesce(F.nullif(F.regexp_extract("item", _REFS, 1), F.lit("")), F.regexp_extract("item", _REFS, 2))
    return items.select("doc_id", "pos", parsed.alias("p"), refs.alias("page_refs")).select("doc_id", "pos", F.col("p._Name").alias("name"), F.coalesce("p._OID", F.lit("")).alias("oid"), "page_refs")


def contract(items: DataFrame) -> DataFrame:
    """pos, dataset, variable, oid, page_tokens, page_string, page_count: the first item of each name in its document, if that one has pages. items: pos, name, oid, page_refs, and doc_id if there are several documents."""
    if "doc_id" in items.columns:
        keyed = items.withColumn("_key", F.when(F.col("name") != "", F.to_json(F.struct("doc_id", "name"))))
        items = first_per_name(keyed.withColumnRenamed("name", "_name").withColumnRenamed("_key", "name")).drop("name").withColumnRenamed("_name", "name")
    else:
        items = first_per_name(items)
    rows = items.withColumn("page_tokens", page_list(F.col("page_refs"))).where(F.size("page_tokens") > 0)
    keep = [c for c in ("doc_id",) if c in items.columns]
    return rows.select(*keep, "pos", oid_dataset(F.col("oid")).alias("dataset"), F.col("name").alias("variable"), "oid", "page_tokens", F.array_join("page_tokens", " ").alias("page_string"), F.size("page_tokens").alias("page_count"))


def contract_summary(rows: DataFrame) -> DataFrame:
    """Variables, page references, and data sets with a name."""
    return rows.agg(F.count("*").alias("variables"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("page_refs"), F.count_distinct(F.when(F.col("dataset") != "", F.col("dataset"))).alias("datasets"))


def document_name(path: Column) -> Column:
    """A file's name without its folder and its last extension: what tells documents apart where nothing else is given."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_define_xml(spark: SparkSession, path: str, doc_id: Column | None = None) -> DataFrame:
    """The contract of each Define-XML file under `path`. doc_id: made from the file's path, which input_file_name() gives; by default the name of the file."""
    files = spark.read.text(path, wholetext=True).withColumn("doc_id", document_name(F.input_file_name()) if doc_id is None else doc_id)
    return contract(item_definitions(files))
