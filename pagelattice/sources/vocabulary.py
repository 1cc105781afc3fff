"""Vocabulary files: terms by category, and words never taken for terms."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.operators.classify import Vocabulary

CATEGORIES = ["dataset", "variable"]


def _or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """A missing file counts as empty."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """category, term: distinct, in upper case; header names in any case, with white space or a byte order mark around; other categories go."""

    def read() -> DataFrame:
        df = spark.read.option("header", True).csv(path)
        return df.toDF(*[c.replace("﻿", "").strip().lower() for c in df.columns])

    rows = _or_empty(read, spark, "category string, term string")
    return rows.select(F.lower(F.trim("category")).alias("category"), F.upper(F.trim("term")).alias("term")).where(F.col("category").isin(CATEGORIES) & (F.col("term") != "")).distinct()


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """term: one a line, in upper case; empty lines and those that begin with # go."""
    rows = _or_empty(lambda: spark.read.text(path), spark, "value string")
    return rows.select(F.upper(F.trim(F.regexp_replace("value", "﻿|\r", ""))).alias("term")).where(~F.col("term").startswith("#") & (F.col("term") != "")).distinct()


#: Terms that a vocabulary file can have at most: they become constants of plans.
MOST_TERMS = 100_000


def _collected(rows: DataFrame) -> list:
    """All rows of a vocabulary file, which is configuration of a few hundred; a file that is too large for constants is refused."""
    found = rows.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary file has at most {MOST_TERMS} terms")
    return found


def load_vocabulary(spark: SparkSession, exact: str, affixes: str, blacklist: str, affix_mode: str = "compat") -> Vocabulary:
    """affix_mode compat takes affixes as they are spelled; strict takes off a leading apostrophe and leaves out bare '--'."""
    by: dict[tuple[str, str], list[str]] = {}
    for kind, path in (("exact", exact), ("affix", affixes)):
        for r in _collected(read_terms(spark, path).orderBy("category", "term")):
            by.setdefault((kind, r["category"]), []).append(r["term"])
    if affix_mode == "strict":
        by = {k: sorted({t.lstrip("'") for t in v} - {"--"}) if k[0] == "affix" else v for k, v in by.items()}
    words = [r["term"] for r in _collected(read_blacklist(spark, blacklist).orderBy("term"))]
    return Vocabulary(by.get(("exact", "dataset"), []), by.get(("exact", "variable"), []), by.get(("affix", "dataset"), []), by.get(("affix", "variable"), []), words)
