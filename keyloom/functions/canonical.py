"""Canonical forms of column metadata, so that spellings of one thing compare equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Integer types by rank.
INTEGER_RANKS = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "integer": 4, "bigint": 5}
# Collations that order alike under two names.
COLLATIONS = {
    "utf8mb4_uca1400_ai_ci": "utf8mb4_0900_ai_ci",
    "utf8mb4_uca1400_as_cs": "utf8mb4_0900_as_cs",
    "utf8mb3_uca1400_ai_ci": "utf8mb3_general_ci",
}


def column_type(t: Column) -> Column:
    """Lower case outside the parameters (labels of an enum are data); integers without a display width."""
    params = F.regexp_extract(t, r"(?s)^[^(]*(\(.*\))[^)]*$", 1)
    low = F.when(params == "", F.lower(t)).otherwise(F.concat(F.lower(F.regexp_extract(t, r"(?s)^([^(]*)\(.*\)[^)]*$", 1)), params, F.lower(F.regexp_extract(t, r"(?s)^[^(]*\(.*\)([^)]*)$", 1))))
    return F.regexp_replace(F.regexp_replace(low, r"^(tinyint|smallint|mediumint|int|integer|bigint)\s*\([^)]*\)\s*", "$1 "), r"^(tinyint|smallint|mediumint|int|integer|bigint)\s+$", "$1")


def default_value(d: Column) -> Column:
    """Null for none or NULL, the body of a quoted literal, current_timestamp in one spelling, else as it is."""
    body = F.replace(F.regexp_extract(d, r"(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    low = F.lower(d)
    stamp = F.when(low == "current_timestamp()", "current_timestamp").otherwise(low)
    return F.when(low == "null", F.lit(None)).when(d.rlike(r"(?s)^'.*'$"), body).when(F.startswith(low, F.lit("current_timestamp")), stamp).otherwise(d)


def extra(e: Column) -> Column:
    t = F.replace(F.replace(F.lower(e), F.lit("default_generated"), F.lit("")), F.lit("current_timestamp()"), F.lit("current_timestamp"))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def collation(c: Column) -> Column:
    low, out = F.lower(c), None
    for a, b in COLLATIONS.items():
        out = F.when(low == a, b) if out is None else out.when(low == a, b)
    return out.otherwise(low)


def expression(e: Column) -> Column:
    """An expression without what a server adds in printing it: case, parentheses, blanks, backslashes, introducers."""
    return F.translate(F.regexp_replace(F.lower(e), "_utf8mb[43]", ""), "() \t\n\\", "")


def character_set(c: Column) -> Column:
    return F.split(c, "_")[0]


def capacity(t: Column) -> Column:
    """Declared length of a type, the largest long without one."""
    n = F.regexp_extract(t, r"\((\d+)", 1)
    return F.when(n == "", F.lit(9223372036854775807)).otherwise(F.expr("1") * n.try_cast("long"))


def integer_rank(t: Column) -> Column:
    out = None
    for name, rank in INTEGER_RANKS.items():
        out = F.when(t == name, rank) if out is None else out.when(t == name, rank)
    return out.otherwise(0)


def is_signed(t: Column) -> Column:
    return ~F.contains(F.lower(t), F.lit("unsigned"))


def generation_kind(e: Column) -> Column:
    return F.when(F.contains(F.upper(e), F.lit("STORED")), "STORED").otherwise("VIRTUAL")


def reference_rule(r: Column) -> Column:
    return F.when(F.upper(r) == "NO ACTION", "RESTRICT").otherwise(F.upper(r))


def data_type(t: Column) -> Column:
    """timestamp counts as datetime."""
    return F.when(F.lower(t) == "timestamp", "datetime").otherwise(F.lower(t))
