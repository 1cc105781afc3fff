"""Reconciliation of a contract with an index, and of two indexes with each other.

Schemas: contract (pos, dataset, variable, pages array<int>); index (seq, variable, pages array<int>, category, raw_texts array<string>);
domains (domain, pages array<int>). Every table carries an order of its own (pos, seq), since first and last rows matter. With a doc_id in each table
every document is held against its own index only; without one all rows are of one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions import pages as P
from pagelattice.functions.names import candidate_names, parse_name

#: Categories that stand for data sets, and what is compared as a bag.
DATASET_CATEGORIES = ["dataset", "dataset_name"]
NOT_SUBMITTED = "not_submitted"


def page_set(c: Column) -> Column:
    """Sorted distinct union of a group's page arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def document_key(df: DataFrame) -> list[str]:
    return [c for c in ("doc_id",) if c in df.columns]


def contract_pages(contract: DataFrame) -> DataFrame:
    """The contract with `pages`, sorted and distinct: as they are, else from page_tokens, else from page_string."""
    if "pages" in contract.columns:
        return contract
    text = F.array_join("page_tokens", ",") if "page_tokens" in contract.columns else F.col("page_string")
    return contract.withColumn("pages", P.parse_pages(P.page_tokens(text)))


def variable_index(index: DataFrame) -> DataFrame:
    """One row per document and normalised name that is neither a data set nor not submitted: pages, first category, distinct raw texts in order."""
    category = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    key = document_key(index)
    rows = index.select(*key, P.normalize_text(F.col("variable")).alias("name"), "pages", category.alias("category"), "raw_texts", "seq")
    rows = rows.where((F.col("name") != "") & ~F.col("category").isin(*DATASET_CATEGORIES, NOT_SUBMITTED))
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("raw_texts", F.array().cast("array<string>")).alias("raw"))))
    first = F.min_by("category", "seq")
    return rows.groupBy(*key, "name").agg(page_set(F.col("pages")).alias("pages"), F.when(first == "", "unknown").otherwise(first).alias("category"), P.distinct_texts(F.flatten(F.transform(ordered, lambda r: r["raw"]))).alias("raw_texts")).withColumn("page_count", F.size("pages"))


def domain_index(index: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per document and normalised domain name, from domain rows and from index rows of data set categories."""
    tagged = index.where(F.lower(F.trim(F.coalesce("category", F.lit("")))).isin(DATASET_CATEGORIES))
    key = document_key(index)
    rows = domains.select(*key, "domain", "pages").union(tagged.select(*key, "variable", "pages")).select(*key, P.normalize_text(F.col("domain")).alias("name"), "pages").where("name <> ''")
    return rows.groupBy(*key, "name").agg(page_set(F.col("pages")).alias("pages")).withColumn("page_count", F.size("pages"))


def best_matches(rows: DataFrame, variables: DataFrame) -> DataFrame:
    """For each row (pos, pages, candidates) the candidate in `variables` with the best relation, then the first: pos, matched_name, match_path, matched_pages, relation. Rows without one are left out.
    With doc_id in both, pos counts within a document and only its own names are looked up."""
    key = document_key(rows)
    named = rows.select(*key, "pos", "pages", F.posexplode("candidates").alias("ord", "candidate")).select(*key, "pos", "pages", "ord", "candidate.name", "candidate.path")
    found = named.join(variables.select(*key, "name", F.col("pages").alias("matched_pages")), [*key, "name"]).withColumn("relation", P.relation(F.col("pages"), F.col("matched_pages")))
    best = F.max_by(F.struct(F.col("name").alias("matched_name"), F.col("path").alias("match_path"), "matched_pages", "relation"), F.struct(P.relation_rank(F.col("relation")), -F.col("ord")))
    return found.groupBy(*key, "pos").agg(best.alias("b")).select(*key, "pos", "b.*")


@dataclass
class CrossValidation:
    detail: DataFrame
    extra_variables: DataFrame
    extra_domains: DataFrame
    summary_by_dataset: DataFrame
    summary: DataFrame


DIFFS = {"matched": "MATCH", "vlm_resolved": "VLM_RESOLVED", "page_mismatch": "PAGE_MISMATCH", "missing_in_pdf": "MISSING_IN_PDF", "low_confidence": "LOW_CONFIDENCE"}


def cross_validate(contract: DataFrame, index: DataFrame, domains: DataFrame) -> CrossValidation:
    """The contract held against an index of the same document, for each document. Rows without a variable are left out; nothing is run until a part is used.

    The contract may have page_tokens or page_string for pages. With doc_id all parts have it in front, and there is a row of the summary for each document of the contract.
    """
    key = document_key(contract)
    if not key == document_key(index) == document_key(domains):
        raise ValueError("all of contract, index and domains need a doc_id, or none")
    rows = contract_pages(contract).where(F.trim(F.coalesce("variable", F.lit(""))) != "").withColumn("parsed", parse_name(F.col("variable")))
    rows = rows.withColumn("candidates", candidate_names(F.col("parsed"))).withColumn("dataset_key", P.normalize_text(F.col("dataset"))).withColumn("dataset_key", F.when(F.col("dataset_key") == "", "UNKNOWN").otherwise(F.col("dataset_key")))
    variables, found_domains = variable_index(index), domain_index(index, domains)
    kind = F.col("parsed.kind")
    best = best_matches(rows.where(kind != "low_confidence"), variables)
    none = F.lit("")
    diff = (
        F.when(kind == "low_confidence", "LOW_CONFIDENCE")
        .when(F.col("relation").isNull(), "MISSING_IN_PDF")
        .when(F.col("relation") != "exact", "PAGE_MISMATCH")
        .when(kind.isin("vlm", "multi_criteria"), "VLM_RESOLVED")
        .otherwise("MATCH")
    )
    detail = rows.join(best, [*key, "pos"], "left").select(
        *key,
        "pos",
        "dataset_key",
        F.coalesce("dataset", none).alias("XML_Dataset"),
        F.col("variable").alias("XML_Variable"),
        P.format_pages(F.col("pages")).alias("XML_Pages"),
        F.size("pages").alias("XML_PageCount"),
        F.coalesce("matched_name", none).alias("PDF_Matched_Name"),
        F.coalesce(P.format_pages(F.col("matched_pages")), none).alias("PDF_Pages"),
        F.when(F.col("matched_pages").isNull(), 0).otherwise(F.size("matched_pages")).alias("PDF_PageCount"),
        diff.alias("diff_type"),
        F.coalesce("relation", none).alias("page_subset"),
        F.coalesce("match_path", none).alias("match_path"),
        F.when(F.col("relation").isNull(), none).otherwise(P.diff_detail(F.col("pages"), F.col("matched_pages"))).alias("page_diff_detail"),
        F.when(kind == "low_confidence", "Unable to parse XML variable into simple or VLM pattern.").otherwise(none).alias("note"),
    )
    known = rows.select(*key, F.explode("candidates").alias("c")).select(*key, F.col("c.name").alias("name")).distinct()
    extra = variables.join(known, [*key, "name"], "left_anti").select(
        *key, F.lit("EXTRA_IN_PDF").alias("diff_type"), F.col("name").alias("PDF_Name"), P.format_pages(F.col("pages")).alias("PDF_Pages"), F.col("page_count").alias("PDF_PageCount"), F.col("category").alias("Category"),
        F.when(F.col("name").contains("="), "value_pair").otherwise("unmapped_variable").alias("subtype"), F.array_join("raw_texts", " | ").alias("RawTexts"),
    )
    extra_domains = found_domains.join(rows.select(*key, F.col("dataset_key").alias("name")).distinct(), [*key, "name"], "left_anti").select(
        *key, F.lit("EXTRA_IN_PDF").alias("diff_type"), F.col("name").alias("PDF_Domain"), P.format_pages(F.col("pages")).alias("PDF_Pages"), F.col("page_count").alias("PDF_PageCount"), F.lit("extra_domain").alias("subtype")
    )
    count = lambda d: F.count_if(F.col("diff_type") == d)
    label = F.max_by(F.when(F.col("XML_Dataset") == "", "UNKNOWN").otherwise(F.col("XML_Dataset")), "pos")
    by_dataset = detail.groupBy(*key, "dataset_key").agg(label.alias("Dataset"), F.count("*").alias("XML_Variable_Count"), *(count(d).alias(d) for d in DIFFS.values())).drop("dataset_key")
    # one pass over the parts together: each row says which of them it is of
    parts = {"total_pdf_variables": variables, "total_pdf_domains": found_domains, "extra_in_pdf_variables": extra, "extra_in_pdf_domains": extra_domains}
    tagged = detail.select(*key, F.lit("detail").alias("part"), "diff_type")
    for name, part in parts.items():
        tagged = tagged.union(part.select(*key, F.lit(name), F.lit("")))
    of = lambda p: F.count_if(F.col("part") == p)
    total = tagged.groupBy(*key).agg(of("detail").alias("total_xml_variables"), *(count(d).alias(n) for n, d in DIFFS.items()), *(of(n).alias(n) for n in parts))
    if key:
        total = total.where("total_xml_variables > 0")
    return CrossValidation(detail.drop("pos", "dataset_key"), extra, extra_domains, by_dataset, total)


@dataclass
class Reconciliation:
    joined: DataFrame

    @property
    def consensus(self) -> DataFrame:
        return self.joined.where("status = 'consensus'").select(*document_key(self.joined), "Variable", "PageString", "PageCount", "PyMuPDF_Pages", "OpenCV_Pages", "Category", "RawTexts")

    @property
    def page_mismatch(self) -> DataFrame:
        return self.joined.where("status = 'page_mismatch'").select(*document_key(self.joined), "Variable", "PageString", "PageCount", "PyMuPDF_Pages", "OpenCV_Pages", "Category", "RawTexts", "MismatchReason", "PyMuPDF_PageCount", "OpenCV_PageCount")

    def only(self, side: str) -> DataFrame:
        """side: pymupdf or opencv."""
        return self.joined.where(F.col("status") == f"{side}_only").select(*document_key(self.joined), "Variable", F.col("PageString").alias("Pages"), "PageCount", "Category", "RawTexts")

    @property
    def summary(self) -> DataFrame:
        count = lambda s: F.count_if(F.col("status") == s)
        both = count("consensus") + count("page_mismatch")
        return self.joined.groupBy(*document_key(self.joined)).agg(*(count(s).alias(f"{s}_count") for s in ("consensus", "page_mismatch", "pymupdf_only", "opencv_only")), (both + count("pymupdf_only")).alias("total_pymupdf"), (both + count("opencv_only")).alias("total_opencv"))


def reconcile(left: DataFrame, right: DataFrame) -> Reconciliation:
    """Two parsers' term indexes, by document and upper-case name; of rows with one name the last counts. Pages are bags: sorted, with duplicates. Pass an empty table for a parser that failed.
    With doc_id in both, all parts have it in front and counts are per document."""
    key = document_key(left)
    if key != document_key(right):
        raise ValueError("both indexes need a doc_id, or none")

    def side(df: DataFrame, prefix: str) -> DataFrame:
        last = F.max_by(F.struct("pages", "category", "raw_texts"), "seq")
        return df.where(F.coalesce("variable", F.lit("")) != "").groupBy(*key, F.upper("variable").alias("Variable")).agg(last.alias(prefix))

    rows = side(left, "l").join(side(right, "r"), [*key, "Variable"], "full_outer")
    none, empty = F.lit(""), F.array().cast("array<int>")
    lp, rp = F.coalesce("l.pages", empty), F.coalesce("r.pages", empty)
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    same_set = F.array_sort(F.array_distinct(lp)) == F.array_sort(F.array_distinct(rp))
    same_bag = F.array_sort(lp) == F.array_sort(rp)
    bag = (F.col("Variable") == "NOT SUBMITTED") | (F.coalesce("l.category", none) == NOT_SUBMITTED) | (F.coalesce("r.category", none) == NOT_SUBMITTED)
    agreed = same_set & (~bag | same_bag)
    status = F.when(both & agreed, "consensus").when(both, "page_mismatch").when(F.col("l").isNotNull(), "pymupdf_only").otherwise("opencv_only")
    reason = F.when(both & ~agreed, F.when(bag & same_set, "occurrence_count_mismatch").when(bag & ~same_bag, "page_or_occurrence_mismatch").otherwise("page_set_mismatch"))
    texts = [F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t != "") for c in ("l.raw_texts", "r.raw_texts")]
    merged = F.array_sort(F.array_union(lp, rp))
    one = F.when(F.col("l").isNotNull(), lp).otherwise(rp)
    return Reconciliation(
        rows.select(
            *key,
            "Variable",
            status.alias("status"),
            F.when(both, P.format_pages(merged)).otherwise(P.format_pages(one)).alias("PageString"),
            F.when(both, F.size(merged)).otherwise(F.size(one)).alias("PageCount"),
            P.format_pages(lp).alias("PyMuPDF_Pages"),
            P.format_pages(rp).alias("OpenCV_Pages"),
            F.when(F.col("l").isNotNull(), F.coalesce("l.category", F.lit("unknown"))).otherwise(F.coalesce("r.category", F.lit("unknown"))).alias("Category"),
            F.when(both, F.array_join(F.array_distinct(F.concat(*texts)), " | ")).otherwise(F.array_join(F.concat(*texts), " | ")).alias("RawTexts"),
            reason.alias("MismatchReason"),
            F.size(lp).alias("PyMuPDF_PageCount"),
            F.size(rp).alias("OpenCV_PageCount"),
        )
    )


def name_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of distinct names in both, only left and only right."""
    a, b = left.select(F.upper("variable").alias("name")).distinct(), right.select(F.upper("variable").alias("name")).distinct()
    parts = [("both", a.intersect(b)), ("left_only", a.exceptAll(b)), ("right_only", b.exceptAll(a))]
    return parts[0][1].agg(F.count("*").alias("both")).crossJoin(parts[1][1].agg(F.count("*").alias("left_only"))).crossJoin(parts[2][1].agg(F.count("*").alias("right_only")))


def first_per_name(items: DataFrame) -> DataFrame:
    """The first row of each name by pos, whatever it holds; rows without a name go. items: pos, name, ..."""
    first = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    return items.where(F.coalesce("name", F.lit("")) != "").withColumn("_n", first).where("_n = 1").drop("_n")
