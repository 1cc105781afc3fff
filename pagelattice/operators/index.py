"""Term, domain and not-submitted indexes of annotated documents, and profiles of documents.

annotations: doc_id, page, seq, content; seq orders all annotations of a document. page_text: doc_id, page, text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions import pages as P
from pagelattice.functions import text as X
from pagelattice.operators import classify as C


def clean_annotations(annotations: DataFrame) -> DataFrame:
    """Cleaned, non-empty contents, each once per page, at its first place."""
    rows = annotations.withColumn("content", X.clean(F.col("content"))).where("content <> ''")
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "content").orderBy("seq"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def need_ocr(annotations: DataFrame) -> DataFrame:
    """Annotations without content, which only their picture can tell."""
    return annotations.where(F.coalesce(X.strip(F.col("content")), F.lit("")) == "")


def _snapped(rows: DataFrame, variables: list[str]) -> DataFrame:
    """rows with lhs and term: names that are no variable but within one edit of just one become that one."""
    known = rows.sparkSession.createDataFrame([(v,) for v in variables], "term string")
    near = C.nearest_unique(rows.where(~F.col("lhs").isin(*variables)).select(F.col("lhs").alias("token")).distinct(), known)
    term = F.when(F.col("is_pair"), F.concat("nearest", F.expr("substring(term, length(lhs) + 1)"))).otherwise(F.col("nearest"))
    joined = rows.join(near, rows["lhs"] == near["token"], "left")
    return joined.withColumn("term", F.coalesce(term, "term")).withColumn("lhs", F.coalesce("nearest", "lhs")).drop("token", "nearest")


def occurrences(texts: DataFrame, vocabulary: C.Vocabulary, profile: str = "structural") -> DataFrame:
    """doc_id, page, seq, ord, term, raw, category, match_level, domain: each pair and candidate of each text (content), classified; blacklisted ones left out."""
    ocr, c = profile == "ocr", F.col("content")
    supp = (X.ocr_supp_pairs if ocr else X.supp_pairs)(c)
    names = F.array_distinct(F.concat(X.candidates(c, vocabulary.blacklist), F.flatten(F.transform(supp, lambda p: F.array(p["variable"], p["dataset"])))))
    names = F.filter(names, lambda n: F.length(n).between(2, 8))
    terms = F.concat(
        F.transform(X.value_pairs(c), lambda p: F.struct(p["variable"].alias("lhs"), p["pair"].alias("term"), (F.lit(ocr) & (F.length(p["pair"]) > 0)).alias("whole"), F.lit(True).alias("is_pair"))),
        F.transform(names, lambda n: F.struct(n.alias("lhs"), n.alias("term"), (F.length(n) > 0).alias("whole"), F.lit(False).alias("is_pair"))),
    )
    rows = texts.select("doc_id", "page", "seq", "content", X.paren_labels(c).alias("labels"), F.posexplode(terms).alias("ord", "t")).select("doc_id", "page", "seq", "ord", "content", "labels", "t.*")
    if ocr and vocabulary.exact_variable:
        rows = _snapped(rows, vocabulary.exact_variable)
    found = C.dataset_override(C.classify(F.col("lhs"), F.col("content"), vocabulary, profile, F.col("labels")), F.col("lhs"), vocabulary)
    if ocr:
        found = F.when(F.col("is_pair"), found).otherwise(C.ocr_demotion(found, F.col("lhs"), F.col("content"), vocabulary))
    rows = rows.withColumn("found", found).where("found.category <> 'blacklist'")
    if ocr:
        rows = rows.where(F.col("is_pair") | C.ocr_keep(F.col("found"), F.col("lhs"), F.col("content"), vocabulary))
    raw = F.when(F.col("whole"), X.strip(F.col("content"))).otherwise(F.col("term"))
    domain = F.when(~F.col("is_pair") & (F.upper("lhs").isin(*vocabulary.exact_dataset) if vocabulary.exact_dataset else F.lit(False)), F.upper("lhs"))
    return rows.select("doc_id", "page", "seq", "ord", F.upper("term").alias("term"), raw.alias("raw"), "found.category", "found.match_level", domain.alias("domain"))


def term_index(found: DataFrame) -> DataFrame:
    """Per document and term: sorted pages, raw texts in order of first sight, folded category and level."""
    at = F.struct("seq", "ord")
    best = F.max(F.struct(C.fold_order(F.col("category"), F.col("match_level"), at).alias("order"), "category", "match_level"))
    # a text counts once, at its first place, before the texts of a term are gathered
    rows = found.groupBy("doc_id", "term", "raw").agg(F.min(at).alias("first"), F.collect_set("page").alias("pages"), best.alias("best"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("first", "raw"))), lambda r: r["raw"])
    rows = rows.groupBy("doc_id", "term").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.max("best").alias("best"), texts.alias("raw_texts"))
    rows = rows.select("doc_id", "term", "pages", "best.category", "best.match_level", "raw_texts")
    return rows.withColumn("page_string", P.format_pages(F.col("pages"))).withColumn("page_count", F.size("pages"))


def domain_index(texts: DataFrame, found: DataFrame, datasets: list[str]) -> DataFrame:
    """Per document and known data set that a text has as a short token or a term: sorted pages."""
    tokens = texts.select("doc_id", "page", F.explode(X.domain_tokens(F.col("content"))).alias("domain")).where(F.col("domain").isin(*datasets) if datasets else F.lit(False))
    rows = tokens.union(found.where("domain is not null").select("doc_id", "page", "domain"))
    return rows.groupBy("doc_id", "domain").agg(F.array_sort(F.collect_set("page")).alias("pages")).withColumn("page_string", P.format_pages(F.col("pages"))).withColumn("page_count", F.size("pages"))


def not_submitted_bag(texts: DataFrame, content: str = "text") -> DataFrame:
    """Per document with any: the pages that say not submitted, as often as they say so."""
    rows = texts.select("doc_id", "page", X.not_submitted_count(F.col(content)).alias("n")).where("n > 0").groupBy("doc_id", "page").agg(F.sum("n").cast("int").alias("n"))
    bag = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "n"))), lambda r: F.array_repeat(r["page"], r["n"])))
    return rows.groupBy("doc_id").agg(bag.alias("pages"), F.sum("n").alias("occurrences")).withColumn("page_string", P.format_pages(F.col("pages"))).withColumn("page_count", F.size(F.array_distinct("pages")))


@dataclass
class DocumentIndex:
    """variables: doc_id, seq, variable, pages, page_string, page_count, category, match_level, raw_texts, in the order of seq, with what says not submitted as the last row of a document;
    domains: doc_id, domain, pages, page_string, page_count. Both are what `reconcile.cross_validate` and the reports take."""

    variables: DataFrame
    domains: DataFrame

    def in_order(self) -> DataFrame:
        return self.variables.orderBy("doc_id", "seq")


def document_index(texts: DataFrame, not_submitted: DataFrame, vocabulary: C.Vocabulary, profile: str = "structural") -> DocumentIndex:
    """The indexes of cleaned texts (doc_id, page, seq, content); not_submitted: the bags of not_submitted_bag()."""
    found = occurrences(texts, vocabulary, profile)
    at = lambda last, name: F.struct(F.lit(last).alias("last"), name.alias("name")).alias("seq")
    columns = ["doc_id", "seq", "variable", "pages", "page_string", "page_count", "category", "match_level", "raw_texts"]
    terms = term_index(found).select("*", at(False, F.col("term")), F.col("term").alias("variable"))
    name = F.lit("NOT SUBMITTED")
    bags = not_submitted.select("doc_id", at(True, name), name.alias("variable"), "pages", "page_string", F.col("occurrences").cast("int").alias("page_count"), F.lit("not_submitted").alias("category"), F.lit("").alias("match_level"), F.array().cast("array<string>").alias("raw_texts"))
    return DocumentIndex(terms.select(columns).union(bags.select(columns)), domain_index(texts, found, vocabulary.exact_dataset))


def structural_index(annotations: DataFrame, page_text: DataFrame, vocabulary: C.Vocabulary) -> DocumentIndex:
    """From annotations with contents; what says not submitted is looked for in the whole text of the pages."""
    return document_index(clean_annotations(annotations), not_submitted_bag(page_text), vocabulary)


def ocr_index(readings: DataFrame, vocabulary: C.Vocabulary) -> DocumentIndex:
    """From recognised texts (doc_id, page, seq, content), which tell what is not submitted as well."""
    return document_index(clean_annotations(readings), not_submitted_bag(readings, "content"), vocabulary, "ocr")


def text_layer(page_text: DataFrame) -> DataFrame:
    """Per document: averages of characters and words a page, share of pages with over 50 characters, whether the text layer is too weak to read, and why."""
    t = X.strip(F.coalesce("text", F.lit("")))
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    rows = page_text.groupBy("doc_id").agg(F.avg(F.length(t)).alias("avg_chars"), F.avg(words).alias("avg_words"), F.avg(F.when(F.length(t) > 50, 1.0).otherwise(0.0)).alias("text_share"))
    flat = (F.col("avg_chars") < 180) | (F.col("avg_words") < 25) | (F.col("text_share") < 0.3)
    reason = F.when(~flat, "").when(F.col("avg_chars") < 50, "Very few text layers detected (highly likely flattened PDF)").otherwise("Weak text layer detected, likely flattened PDF")
    return rows.select("*", flat.alias("is_flattened"), reason.alias("reason"))


def annotation_profile(annotations: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per document: counts of annotations and readable ones, ratios, and the type that decides which parser to use. pages: doc_id, page of all pages, if known."""
    c = X.clean(F.col("content"))
    readable = c != ""
    rows = annotations.groupBy("doc_id").agg(
        F.count("*").alias("total_annots"), F.count_if(readable).alias("readable_annots"), F.count_if(readable & ~F.upper(c).contains("NOT SUBMITTED")).alias("non_special_readable"), F.count_distinct(F.when(readable, F.col("page"))).alias("pages_with_readable")
    )
    if pages is not None:
        rows = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("total_pages")).join(rows, "doc_id", "left").na.fill(0)
        rows = rows.withColumn("readable_page_ratio", F.col("pages_with_readable") / F.col("total_pages"))
    ratio = F.when(F.col("total_annots") > 0, F.col("readable_annots") / F.col("total_annots")).otherwise(0.0)
    kind = F.when(F.col("readable_annots") == 0, "annotation_flattened").when((ratio >= 0.8) & (F.col("non_special_readable") >= 5), "msg2_readable").otherwise("partial_weak_annotation")
    return rows.select("*", ratio.alias("readable_ratio"), kind.alias("type_key"))


#: The parsers to run for a type of document.
PARSERS = {"annotation_flattened": ["ocr"], "msg2_readable": ["structural"], "partial_weak_annotation": ["structural", "ocr"]}


def recommended_parsers(type_key: Column) -> Column:
    out = F.array().cast("array<string>")
    for k, v in PARSERS.items():
        out = F.when(type_key == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def annotation_coverage(annotations: DataFrame, first_pages: int = 10) -> DataFrame:
    """Per document, over its first pages: annotations with content, all, and their ratio."""
    has = F.coalesce(X.strip(F.col("content")), F.lit("")) != ""
    return annotations.where(F.col("page") <= first_pages).groupBy("doc_id").agg(F.count_if(has).alias("with_content"), F.count("*").alias("annotations")).withColumn("coverage", F.col("with_content") / F.col("annotations"))
