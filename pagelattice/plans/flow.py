"""From files to results: Define-XML held against annotated documents, and CSV files of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pagelattice.operators import classify as C
from pagelattice.operators import index as I
from pagelattice.operators import reconcile as R
from pagelattice.plans import report
from pagelattice.sources import define_xml


def cross_validate_documents(contract: DataFrame, annotations: DataFrame, page_text: DataFrame, vocabulary: C.Vocabulary) -> R.CrossValidation:
    """Each document's contract (doc_id, pos, dataset, variable, page_tokens) against the index of its own annotations (doc_id, page, seq, content) and pages (doc_id, page, text)."""
    found = I.structural_index(annotations, page_text, vocabulary)
    return R.cross_validate(contract, found.variables, found.domains)


def cross_validate_files(spark: SparkSession, xml_path: str, annotations: DataFrame, page_text: DataFrame, vocabulary: C.Vocabulary, out: str | None = None, doc_id: Column | None = None) -> R.CrossValidation:
    """The same for the Define-XML files under `xml_path`, whose doc_id (by default the file's name) is that of the annotations; `out`: where the four CSV files go."""
    found = cross_validate_documents(define_xml.read_define_xml(spark, xml_path, doc_id), annotations, page_text, vocabulary)
    if out:
        report.write_cross_validation(found, out)
    return found


def reconcile_parsers(structural: I.DocumentIndex, ocr: I.DocumentIndex) -> R.Reconciliation:
    """The indexes of two parsers of the same documents held against each other."""
    return R.reconcile(structural.variables, ocr.variables)
