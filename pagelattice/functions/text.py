"""What annotation texts hold: cleaned text, candidate tokens, value pairs, SUPP pairs, not-submitted marks. Column functions, one text each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and words that decide what is found in a text.
STOPWORDS = ["AND", "OR", "IF", "THEN", "THE", "A", "IN", "ON", "FOR", "WITH", "IS", "ARE", "TO", "BY", "OF", "NOTE"]
CLEANUPS = [r"\(\s*[A-Za-z\s]{0,3}\s*\)", r"^\(\s*[^)]{0,15}\)\s*", r"^\(\s*[^)]{1,15}\s+", r"^\(\s*"]
TOKEN = r"(?U)\b([A-Z][A-Z0-9]{1,7})\b"
ASSIGNED = r"(=\s*)[A-Z0-9](?:[A-Z0-9\s/\-]{0,79}([A-Z0-9/\-]))?"
LHS = r"([A-Z][A-Z0-9]{1,7}(?:/[A-Z][A-Z0-9]{1,7})*)"
VALUE = r"([A-Z0-9][A-Z0-9\s/\-]{0,80}?)"
PAIR = LHS + r"\s*=\s*" + VALUE + r"(?=\s+(?:when|if|then)\b|\s*\||\s*;|$)"
SUPP_PAIR = LHS + r"\s*=\s*" + VALUE + r"\s+in\s+(SUPP[A-Z]{2,8})\b"
SUPP_IN, SUPP_DOT = r"([A-Z][A-Z0-9]*?)\s+in\s+(SUPP[A-Z]{2,})", r"(SUPP[A-Z]{2,})\.([A-Z][A-Z0-9]*?)(?:\s|$|[,;])"
OCR_SUPP_VALUE = r"(?i)([A-Z][A-Z0-9]{1,7})\s*=\s*([A-Z0-9][A-Z0-9\s/\-]{0,80}?)\s+in\s+(SUPP[A-Z]{2,8})\b"
OCR_SUPP_IN, OCR_SUPP_DOT = r"(?i)(?<![=A-Z0-9])([A-Z][A-Z0-9]{1,7})\s+in\s+(SUPP[A-Z]{2,8})\b", r"(?i)(SUPP[A-Z]{2,8})\.([A-Z][A-Z0-9]{1,7})(?:\s|$|[,;])"
NOT_SUBMITTED = r"(?i)\b(?:NOT\s+SUBMITTED|NOTSUBMITTED)\b"


def let(c: Column, then) -> Column:
    """then(c), with c evaluated once however often it is used."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


def clean(c: Column) -> Column:
    """An annotation without the marks of check boxes that its text begins with or holds; '' if nothing is left."""
    out = F.coalesce(strip(c), F.lit(""))
    for p in CLEANUPS:
        out = F.regexp_replace(out, p, "")
    return strip(F.regexp_replace(out, r"\s{2,}", " "))


def candidates(c: Column, blacklist: list[str] | None = None) -> Column:
    """Distinct capital tokens of 2 to 8 characters that do not begin inside an assigned value, without stop words and `blacklist`."""
    tokens = F.array_distinct(found(F.regexp_replace(F.coalesce(c, F.lit("")), ASSIGNED, "$1_$2"), TOKEN))
    return F.array_except(tokens, F.array(*map(F.lit, [*STOPWORDS, *(blacklist or [])])))


def value_pairs(c: Column) -> Column:
    """array of struct(variable, value, pair), in order: VAR=VALUE, a shared value once for each variable, then those before 'in SUPPxx'."""

    def pairs(pattern: str) -> Column:
        both = F.arrays_zip(found(c, pattern, 1).alias("lhs"), found(c, pattern, 2).alias("value"))
        values = F.transform(both, lambda m: F.struct(m["lhs"].alias("lhs"), strip(F.regexp_replace(strip(m["value"]), r"\s{2,}", " ")).alias("value")))
        each = F.transform(values, lambda m: F.transform(F.split(m["lhs"], "/"), lambda v: F.struct(v.alias("variable"), m["value"].alias("value"), F.concat(v, F.lit("="), m["value"]).alias("pair"))))
        return F.flatten(each)

    ok = lambda p: F.length(p["variable"]).between(2, 8) & (p["value"] != "") & (p["pair"] != "VSSTAT=NOT DONE")
    return F.filter(F.concat(pairs(PAIR), pairs(SUPP_PAIR)), ok)


def _supp(variable: Column, dataset: Column) -> Column:
    return F.transform(F.arrays_zip(variable.alias("v"), dataset.alias("d")), lambda m: F.struct(m["v"].alias("variable"), m["d"].alias("dataset")))


def supp_pairs(c: Column) -> Column:
    """array of struct(variable, dataset), with duplicates: VAR in SUPPxx, then SUPPxx.VAR."""
    both = F.concat(_supp(found(c, SUPP_IN, 1), found(c, SUPP_IN, 2)), _supp(found(c, SUPP_DOT, 2), found(c, SUPP_DOT, 1)))
    return F.filter(both, lambda p: (F.length(p["variable"]) <= 8) & (F.length(p["dataset"]) <= 8))


def ocr_supp_pairs(c: Column) -> Column:
    """The same for recognised text: any case, distinct, and VAR=VALUE in SUPPxx gives VAR, and the value too where VAR is QNAM."""
    triples = F.arrays_zip(found(c, OCR_SUPP_VALUE, 1).alias("v"), found(c, OCR_SUPP_VALUE, 2).alias("x"), found(c, OCR_SUPP_VALUE, 3).alias("d"))
    pair = lambda v, d: F.struct(F.upper(v).alias("variable"), F.upper(d).alias("dataset"))
    value = lambda m: F.upper(F.regexp_replace(strip(m["x"]), r"\s{2,}", " "))
    named = F.flatten(F.transform(triples, lambda m: F.when((F.upper(m["v"]) == "QNAM") & value(m).rlike(r"^[A-Z][A-Z0-9]{1,7}$"), F.array(pair(m["v"], m["d"]), pair(value(m), m["d"]))).otherwise(F.array(pair(m["v"], m["d"])))))
    others = F.concat(_supp(F.transform(found(c, OCR_SUPP_IN, 1), F.upper), F.transform(found(c, OCR_SUPP_IN, 2), F.upper)), _supp(F.transform(found(c, OCR_SUPP_DOT, 2), F.upper), F.transform(found(c, OCR_SUPP_DOT, 1), F.upper)))
    return F.array_distinct(F.filter(F.concat(named, others), lambda p: (F.length(p["variable"]) <= 8) & (F.length(p["dataset"]) <= 8)))


def not_submitted_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(NOT_SUBMITTED))


def domain_tokens(c: Column) -> Column:
    return F.array_distinct(found(c, r"(?U)\b([A-Z]{1,3})\b"))


def lhs_tokens(c: Column) -> Column:
    return found(c, r"(?U)\b([A-Z][A-Z0-9]{1,7})\s*=")


def paren_labels(c: Column) -> Column:
    """Upper-case words directly before an opening parenthesis."""
    return F.array_distinct(F.transform(found(c, r"(?U)(\w+)\s*\("), F.upper))


def oid_dataset(c: Column) -> Column:
    """The data set in IT.<data set>.<variable>; '' for other identifiers."""
    p = F.split(F.coalesce(c, F.lit("")), r"\.")
    return F.when((F.size(p) >= 3) & (F.get(p, F.lit(0)) == "IT"), F.get(p, F.lit(1))).otherwise("")
