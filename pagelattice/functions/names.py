"""Dotted names of value-level metadata as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelattice.functions.pages import normalize_text
from pagelattice.functions.text import let

#: Operators that can stand in the fourth place of a name.
OPERATORS = ["EQ", "IN"]


def name_parts(c: Column) -> Column:
    """Stripped non-empty parts between the dots of a normalised name."""
    return F.filter(F.transform(F.split(normalize_text(c), r"\."), lambda p: F.trim(p)), lambda p: p != "")


def parse_name(c: Column) -> Column:
    """struct(kind, normalized, target_var, dataset, qualifier, operator, value, qualifier_key, criteria); kinds are tried in the order of the branches."""
    return let(F.struct(normalize_text(c).alias("whole"), name_parts(c).alias("parts")), _parsed)


def _parsed(name: Column) -> Column:
    p, whole, none = name["parts"], name["whole"], F.lit("")
    n = F.size(p)
    at = lambda i: F.coalesce(F.get(p, F.lit(i)), none)
    rest = F.array_join(F.slice(p, 5, F.greatest(n - 4, F.lit(0))), ".")
    places = F.when(n >= 4, F.sequence(F.lit(1), n - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))
    triples = F.transform(places, lambda i: F.struct(F.get(p, i).alias("dataset"), F.get(p, i + 1).alias("qualifier"), F.get(p, i + 2).alias("value")))
    one = lambda d, q, v: F.array(F.struct(d.alias("dataset"), q.alias("qualifier"), v.alias("value")))
    no_criteria = F.filter(triples, lambda x: F.lit(False))
    pair = lambda q, v: F.concat(q, F.lit("="), v)

    def made(kind, target=none, dataset=none, qualifier=none, operator=none, value=none, key=none, criteria=no_criteria):
        return F.struct(F.lit(kind).alias("kind"), whole.alias("normalized"), target.alias("target_var"), dataset.alias("dataset"), qualifier.alias("qualifier"), operator.alias("operator"), value.alias("value"), key.alias("qualifier_key"), criteria.alias("criteria"))

    many = F.array_join(F.transform(triples, lambda x: pair(x["qualifier"], x["value"])), " AND ")
    return (
        F.when(n == 1, made("simple", at(0)))
        .when((n >= 5) & at(3).isin(OPERATORS), made("vlm", at(0), at(1), at(2), at(3), rest, pair(at(2), rest), one(at(1), at(2), rest)))
        .when(n == 4, made("vlm", at(0), at(1), at(2), none, at(3), pair(at(2), at(3)), one(at(1), at(2), at(3))))
        .when((n >= 7) & ((n - 1) % 3 == 0), made("multi_criteria", at(0), key=many, criteria=triples))
        .otherwise(made("low_confidence"))
    )


def candidate_names(parsed: Column) -> Column:
    """array of struct(name, path): the names by which a document may mention it, best first."""
    c = lambda name, path: F.struct(name.alias("name"), path.alias("path"))
    target = c(parsed["target_var"], F.lit("path_A_target_var"))
    criteria = F.transform(parsed["criteria"], lambda x, i: c(F.concat(x["qualifier"], F.lit("="), x["value"]), F.concat(F.lit("path_B_criteria_"), i.cast("string"))))
    return (
        F.when(parsed["kind"] == "vlm", F.array(target, c(parsed["qualifier_key"], F.lit("path_B_qualifier_value"))))
        .when(parsed["kind"] == "multi_criteria", F.concat(F.array(target), criteria))
        .otherwise(F.array(c(parsed["normalized"], F.lit("simple"))))
    )
