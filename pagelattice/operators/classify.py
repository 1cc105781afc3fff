"""Classification of terms against a vocabulary, and the fold of a term's classifications into one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import text as X

#: How strongly a level or a category counts where a term has several.
LEVEL_RANKS = {"exact": 3, "suffix_prefix": 2, "supp": 1, "none": 0}
CATEGORY_RANKS = {"dataset_name": 3, "not_submitted": 3, "standard_variable": 2, "supp_variable": 1}


@dataclass
class Vocabulary:
    """Upper-case terms. exact_*: names; *_affixes: '--X' ends with X, 'X--' begins with X.

    The sets are configuration: a few hundred words from files, held by the driver and folded into the plan as constants.
    """

    exact_dataset: list[str]
    exact_variable: list[str]
    dataset_affixes: list[str]
    variable_affixes: list[str]
    blacklist: list[str]


def _in(c: Column, words: list[str]) -> Column:
    return c.isin(*words) if words else F.lit(False)


def _affixed(term: Column, affixes: list[str], skip_bare: bool) -> Column:
    out = F.lit(False)
    for a in affixes:
        if a.startswith("--") and (a != "--" or not skip_bare):
            out = out | term.endswith(a[2:])
        if a.endswith("--") and (a != "--" or not skip_bare):
            out = out | term.startswith(a[:-2])
    return out


def classify(term: Column, context: Column, vocabulary: Vocabulary, profile: str = "structural", labels: Column | None = None) -> Column:
    """struct(category, match_level), by the first test that holds. profile 'ocr' skips bare affixes and takes any term beside a SUPP name as one of its variables.

    A term before an opening parenthesis in the context names a data set; whole words decide, in any case. labels: these words, where they have been found before.
    """
    ocr = profile == "ocr"
    up, ctx = F.upper(term), F.coalesce(context, F.lit(""))
    label = F.array_contains(X.paren_labels(ctx) if labels is None else labels, up)
    supp = F.get(X.found(ctx, r"(SUPP[A-Z]{2,8})"), F.lit(0))
    made = lambda c, m: F.struct((c if isinstance(c, Column) else F.lit(c)).alias("category"), F.lit(m).alias("match_level"))
    out = (
        F.when(_in(up, vocabulary.blacklist), made("blacklist", "none"))
        .when(up.contains("NOT") & up.contains("SUBMITTED"), made("not_submitted", "none"))
        .when(label, made("dataset_name", "exact"))
        .when(_in(up, vocabulary.exact_dataset), made("dataset_name", "exact"))
        .when(_in(up, vocabulary.exact_variable), made("standard_variable", "exact"))
        .when(_affixed(up, vocabulary.variable_affixes, ocr), made("standard_variable", "suffix_prefix"))
        .when(_affixed(up, vocabulary.dataset_affixes, ocr), made("dataset_name", "suffix_prefix"))
    )
    if ocr:
        out = out.when(ctx.rlike(r"(?U)\bSUPP[A-Z]{2,8}\b"), made("supp_variable", "supp"))
    else:
        out = out.when(up.contains("SUPP"), made(F.coalesce(supp, F.lit("supp_variable")), "supp"))
    return out.otherwise(made("unknown", "none"))


def dataset_override(found: Column, term: Column, vocabulary: Vocabulary) -> Column:
    """A known data set is one whatever else it looks like, unless it says not submitted."""
    known = _in(F.upper(term), vocabulary.exact_dataset) & (found["category"] != "not_submitted")
    level = F.when(found["match_level"] == "none", "exact").otherwise(found["match_level"])
    return F.when(known, F.struct(F.lit("dataset_name").alias("category"), level.alias("match_level"))).otherwise(found)


def strong_signal(term: Column, context: Column) -> Column:
    """Whether the context gives a term weight: before = : ; , ( or WHEN, IF, THEN; or a term alone in at most two words."""
    ctx, up = F.upper(F.coalesce(context, F.lit(""))), F.upper(term)
    marked = X.found(ctx, r"(?U)(?=\b([A-Z][A-Z0-9]*)\s*[=:;,(])|(?=\b([A-Z][A-Z0-9]*)\s+(?:WHEN|IF|THEN)\b)", 1)
    before = X.found(ctx, r"(?U)(?=\b([A-Z][A-Z0-9]*)\s+(?:WHEN|IF|THEN)\b)", 1)
    alone = up.rlike(r"^[A-Z][A-Z0-9]{1,7}$") & (F.size(F.filter(F.split(ctx, r"(?U)\s+"), lambda w: w != "")) <= 2)
    return F.array_contains(marked, up) | F.array_contains(before, up) | alone


def ocr_demotion(found: Column, term: Column, context: Column, vocabulary: Vocabulary) -> Column:
    """A data set name that is not in the vocabulary counts only before = or ( or as a SUPP name."""
    ctx = F.upper(F.coalesce(context, F.lit("")))
    marked = F.array_contains(X.found(ctx, r"(?U)\b([A-Z0-9_]+)\s*[=(]"), F.upper(term))
    weak = (found["category"] == "dataset_name") & ~_in(F.upper(term), vocabulary.exact_dataset) & ~term.startswith("SUPP") & ~marked
    return F.when(weak, F.struct(F.lit("unknown").alias("category"), F.lit("none").alias("match_level"))).otherwise(found)


def ocr_keep(found: Column, term: Column, context: Column, vocabulary: Vocabulary) -> Column:
    """Whether a recognised candidate is kept: weak ones need a strong signal."""
    n, outside = F.length(term), ~_in(F.upper(term), vocabulary.exact_dataset)
    weak = (found["category"] == "unknown") | ((found["category"] == "standard_variable") & (n <= 3) & outside) | ((found["match_level"] == "suffix_prefix") & (n <= 2) & outside) | ((found["category"] == "dataset_name") & (n <= 2) & outside)
    return ~weak | strong_signal(term, context)


def _rank(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def fold_order(category: Column, level: Column, seq: Column) -> Column:
    """The largest of a term's classifications counts: the highest level, then the highest category rank, then the last; an unknown category never replaces one of its own level."""
    return F.struct(_rank(level, LEVEL_RANKS).alias("level"), _rank(category, CATEGORY_RANKS).alias("category"), (category != "unknown").cast("int").alias("known"), seq.alias("seq"))


def fold(category: Column, level: Column, seq: Column) -> tuple[Column, Column]:
    """Aggregates for a term's category and level."""
    order = fold_order(category, level, seq)
    return F.max_by(category, order), F.max_by(level, order)


def nearest_unique(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """token, nearest: the vocabulary term within one edit, where there is exactly one. tokens(token), terms(term).

    Candidates share a token or a token with one character taken out, so the join is by equality and not over all pairs.
    """

    def cuts(c: Column) -> Column:
        return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))

    t = tokens.where("token <> ''").select("token").distinct().select("token", F.explode(cuts(F.col("token"))).alias("cut"))
    v = terms.where("term <> ''").select("term").distinct().select("term", F.explode(cuts(F.col("term"))).alias("cut"))
    pairs = t.join(v, "cut").select("token", "term").distinct().where(F.levenshtein("token", "term", 1) >= 0)
    return pairs.groupBy("token").agg(F.count("*").alias("n"), F.min("term").alias("nearest")).where("n = 1").drop("n")


def leading_character(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """token, full: the terms that are the token with one more character before it, sorted, as an array."""
    v = terms.select("term").distinct().where("length(term) > 1").select("term", F.expr("substring(term, 2)").alias("token"))
    return tokens.select("token").distinct().join(v, "token").groupBy("token").agg(F.array_sort(F.collect_list("term")).alias("full"))
