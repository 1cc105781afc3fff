"""Scores and gates of recognised text, and the choice between recognisers. Column functions, one text each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelattice.functions import text as X

#: Patterns and weights of the score.
UPPER = r"(?U)\b[A-Z][A-Z0-9]{1,7}\b"
LABEL = r"(?U)\b[A-Z][A-Z0-9]{1,7}\s*(?:\(|=)"
ASSIGN = r"(?U)\b[A-Z][A-Z0-9]{1,7}(?:/[A-Z][A-Z0-9]{1,7})*\s*="
PAREN = r"(?U)\b[A-Z][A-Z0-9]{1,7}\s*\("
SUPP = r"(?U)\bSUPP[A-Z]{2,8}\b"
SLASH = r"(?U)\b[A-Z][A-Z0-9]{1,7}/[A-Z][A-Z0-9]{1,7}\b"
QNAM = r"(?U)\bQNAM\s*="
SPLIT_LHS = r"(?U)\b[A-Z]{2,6}\s+[A-Z]{2,8}\s*="
DRIFT = r"(?U)\b(?:QONAM|ONAM|INAM|JNAM|QDNAM)\s*="


def normalize(c: Column) -> Column:
    """Line ends as spaces, runs of white space as one space, none outside."""
    return X.strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " "), r"(?U)\s{2,}", " "))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _only(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, ""))


def lowercase_ratio(c: Column) -> Column:
    letters = _only(c, r"\P{L}")
    return F.when(letters > 0, _only(c, r"\P{Ll}") / letters).otherwise(0.0)


def score(c: Column) -> Column:
    """How much a text looks like an annotation rather than a page's body; -10 for an empty one."""
    return X.let(normalize(c), _score)


def _score(n: Column) -> Column:
    words, chars = F.size(F.split(n, r"(?U)\s+")), F.length(n)
    penalty = F.when(chars > 220, F.least(F.lit(6.0), (chars - 220) / 35.0)).otherwise(0.0) + F.when(words > 22, F.least(F.lit(5.0), (words - 22) / 5.0)).otherwise(0.0)
    total = (
        _count(n, UPPER) * 2.0 + _count(n, LABEL) * 4.0 + _count(n, ASSIGN) * 4.5 + F.when(n.rlike(SUPP), 3.0).otherwise(0.0)
        + _count(n, X.NOT_SUBMITTED) * 5.0 + _count(n, SLASH) * 2.0 - lowercase_ratio(n) * 2.5 - penalty
    )
    return F.when(n == "", -10.0).otherwise(F.round(total, 2))


def gate(c: Column, scored: Column, least: float = 1.5) -> Column:
    """Whether a text with that score is let through as an annotation."""

    def passes(n: Column) -> Column:
        upper, lower = _count(n, UPPER), lowercase_ratio(n)
        sure = n.rlike(X.NOT_SUBMITTED) | n.rlike(SUPP) | n.rlike(ASSIGN) | n.rlike(PAREN)
        return (n != "") & (sure | ((upper >= 2) & (lower <= 0.45)) | ((upper == 1) & (lower <= 0.2) & (F.length(n) <= 14)))

    return (scored >= least) & X.let(normalize(c), passes)


def quality(c: Column, known: list[str]) -> Column:
    """Bias between two readings of a picture; known: vocabulary terms in upper case."""
    inside = lambda t: t.isin(*known) if known else F.lit(False)
    each = lambda t: F.when(inside(t), 0.2).when(F.length(t) <= 4, -0.9).otherwise(-0.4)

    def bias(n: Column) -> Column:
        tokens = F.aggregate(X.lhs_tokens(n), F.lit(0.0), lambda a, t: a + each(t))
        marks = F.when(n.rlike(QNAM), 1.0).otherwise(0.0) - F.when(n.rlike(SPLIT_LHS), 1.2).otherwise(0.0) - F.when(n.rlike(DRIFT), 1.0).otherwise(0.0)
        return F.when(n == "", -5.0).otherwise(marks + tokens)

    return X.let(normalize(c), bias)


def needs_second_pass(c: Column, known: list[str]) -> Column:
    def risky(n: Column) -> Column:
        short = F.exists(X.lhs_tokens(n), lambda t: (F.length(t) <= 4) & ~(t.isin(*known) if known else F.lit(False)))
        return (n != "") & (short | n.rlike(SPLIT_LHS) | n.rlike(DRIFT) | (n.rlike(SUPP) & ~n.rlike(QNAM)))

    return X.let(normalize(c), risky)


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def _pick(now: Column, other: Column, known: list[str], margin: float, bonus=lambda t: F.lit(0.0)) -> Column:
    """`other` if it is not empty and its score, quality and bonus are at least those of `now` and a margin."""

    def better(t: Column) -> Column:
        wins = score(t["other"]) + quality(t["other"], known) + bonus(t) >= score(t["now"]) + quality(t["now"], known) + margin
        return F.when((F.coalesce(t["other"], F.lit("")) != "") & wins, t["other"]).otherwise(t["now"])

    return X.let(F.struct(now.alias("now"), other.alias("other")), better)


def pick_repaired(text: Column, repaired: Column, known: list[str]) -> Column:
    """The repaired text unless it is empty or scores less."""
    return _pick(text, repaired, known, 0.0)


def pick_second(first: Column, second: Column, known: list[str]) -> Column:
    """A second reading of a suspicious text, if it is better by 0.35."""
    return _pick(first, second, known, 0.35)


def pick_easyocr(text: Column, easy: Column, confidence: Column, known: list[str]) -> Column:
    return _pick(text, easy, known, -0.1, lambda t: confidence * 2.5)


def pick_trocr(text: Column, trocr: Column, known: list[str]) -> Column:
    return _pick(text, trocr, known, -0.05, lambda t: F.when(t["other"].contains("="), 0.8).otherwise(0.0) + F.when(t["other"].rlike(SUPP), 0.5).otherwise(0.0))


def analysis_texts(primary: Column, *assists: Column) -> Column:
    """Distinct texts to look for terms in: the chosen reading if it passes at 1.8, others at 1.25 or with an assignment or SUPP name. None: noise."""
    first = X.let(primary, lambda t: F.when(gate(t, score(t), 1.8), normalize(t)))
    more = [X.let(a, lambda t: F.when(gate(t, score(t), 1.25) | F.coalesce(t, F.lit("")).rlike(ASSIGN) | F.coalesce(t, F.lit("")).rlike(SUPP), normalize(t))) for a in assists]
    return F.array_distinct(F.filter(F.array(first, *more), lambda t: t.isNotNull() & (t != "")))
