"""An extension: the pages of each term, kept up to date over a stream of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import text as X


def stream_terms(annotations: DataFrame) -> DataFrame:
    """annotations: a streaming DataFrame of doc_id, page, content. Per document and candidate term its pages so far; write with output mode 'update' or 'complete'."""
    terms = annotations.select("doc_id", "page", F.explode(X.candidates(X.clean(F.col("content")))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.array_sort(F.collect_set("page")).alias("pages"))
