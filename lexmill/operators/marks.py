"""Runs in the marks of a node's children - (a), (b), (c) or (1), (2), (3) or (i), (ii) - and the hints made of them.

A run is a stretch of children whose marks follow one another: their value minus their place among the children is the same, and so is
their place minus their number among those. So runs are groups, found by one sort and one aggregation, and no child list is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks that a summary lists at most, from how many on a run is written as a range, and the signs between them.
LISTED, RANGE = 12, 3
DASH, MORE = "–", "…"
ROMAN = "^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def _token(mark: Column) -> Column:
    return F.regexp_replace(mark, r"^[()]+|[()]+$", "")


def roman_value(token: Column) -> Column:
    """The number of a lower-case Roman numeral: each pair that subtracts counts as a sign of its own."""
    left, total = token, F.lit(0)
    for sign, n in (("cm", 900), ("cd", 400), ("xc", 90), ("xl", 40), ("ix", 9), ("iv", 4), ("m", 1000), ("d", 500), ("c", 100), ("l", 50), ("x", 10), ("v", 5), ("i", 1)):
        rest = F.replace(left, F.lit(sign), F.lit(""))
        total = total + ((F.length(left) - F.length(rest)) / len(sign)).cast("int") * n
        left = rest
    return total


def _digits(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]{1,9}$"), token.cast("int"))


def _letter(token: Column) -> Column:
    return F.when(token.rlike("^[A-Za-z]$"), F.ascii(token))


def summaries(children: DataFrame, parent: str, mark: str, ordinal: str) -> DataFrame:
    """(parent, n, summary): the marks of each parent's children. ``ordinal``: a child's place among them, 0, 1, 2 ... without gaps.

    More than two children of which all marks are numbers, or all single letters, without a gap: "first–last". Else up to ``LISTED``
    marks in order, and of more the first ``LISTED`` and the last. Null marks count as "". Marks keep their brackets. No children, no row.
    """
    m = F.coalesce(F.col(mark), F.lit(""))
    token = _token(m)
    steps = [s - F.col(ordinal) for s in (_digits(token), _letter(token))]
    whole = [c for k, s in enumerate(steps) for c in (F.count(s).alias(f"n{k}"), F.min(s).alias(f"lo{k}"), F.max(s).alias(f"hi{k}"))]
    few = F.collect_list(F.when(F.col(ordinal) < LISTED, F.struct(F.col(ordinal).alias("o"), m.alias("m"))))  # at most LISTED a parent
    rows = children.groupBy(parent).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(m, F.col(ordinal)).alias("first"), F.max_by(m, F.col(ordinal)).alias("last"), few.alias("few"), *whole
    )
    run = lambda k: (F.col(f"n{k}") == F.col("n")) & (F.col(f"lo{k}") == F.col(f"hi{k}"))
    listed = F.array_join(F.transform(F.array_sort("few"), lambda x: x["m"]), ", ")
    text = (
        F.when((F.col("n") >= RANGE) & (run(0) | run(1)), F.concat("first", F.lit(DASH), "last")).when(F.col("n") <= LISTED, listed)
        .otherwise(F.concat(listed, F.lit(f", {MORE} "), "last"))
    )
    return rows.select(parent, "n", text.alias("summary"))


def runs(children: DataFrame, parent: str, mark: str, ordinal: str, roman: bool = False) -> DataFrame:
    """(parent, place, kind, first, last, n): every maximal run of marks that follow one another, ``place`` the ordinal of its first child.

    Kinds are digit, letter, roman (if ``roman``: lower-case numerals are numbers and not letters) and other, whose runs are single marks.
    """
    token = _token(F.coalesce(F.col(mark), F.lit("")))
    digits, letter = _digits(token), _letter(token)
    numeral = F.when(token.rlike(ROMAN) & (F.length(token) > 0), roman_value(token)) if roman else F.lit(None).cast("int")
    kind = F.when(digits.isNotNull(), "digit").when(numeral.isNotNull(), "roman").when(letter.isNotNull(), "letter").otherwise("other")
    value = F.coalesce(digits, numeral, letter)
    # marks without a value are runs of their own: their place stands for it, and the place itself for the difference
    key = F.when(value.isNull(), F.col(ordinal)).otherwise(value - F.col(ordinal))
    rows = children.select(parent, F.col(mark).alias("m"), F.col(ordinal).alias("o"), kind.alias("kind"), key.alias("key"))
    # one difference may come again after a gap of other marks: 1 2 x 4 5 is two runs, which differ by the marks that the gap has left out
    run = F.col("o") - F.row_number().over(Window.partitionBy(parent, "kind", "key").orderBy("o"))
    found = rows.withColumn("run", run).groupBy(parent, "kind", "key", "run").agg(F.min("o").alias("place"), F.min_by("m", "o").alias("first"), F.max_by("m", "o").alias("last"), F.count(F.lit(1)).alias("n"))
    return found.select(parent, "place", "kind", "first", "last", "n")


def pinpoint_hints(missing: DataFrame, summary: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, suggestion): what a pinpoint that isn't there could mean. Null-safe: a part that isn't known is left out.

    ``missing``: id, label (the deepest existing ancestor's display), ancestor, level (its children's, plural), token (the first mark that is
    missing), section, first (the pinpoint's first mark). ``summary``: of ``summaries``. ``sections``: section, all that exist.
    """
    s = summary.select(F.col(summary.columns[0]).alias("ancestor"), "summary")
    letter = F.when(F.col("first").rlike("^[A-Za-z]$"), F.concat("section", F.upper("first")))
    known = sections.select(F.col("section").alias("sibling")).distinct()
    rows = missing.withColumn("asked", letter).join(s, "ancestor", "left").join(known, F.col("asked") == F.col("sibling"), "left")
    has = F.when(F.col("summary").isNotNull(), F.concat("label", F.lit(" has "), "level", F.lit(" "), "summary")).otherwise(F.concat("label", F.lit(" has no subdivisions")))
    gone = F.when(F.col("summary").isNotNull() & (F.col("token") != ""), F.concat(F.lit("no ("), "token", F.lit(")")))
    mean = F.when(F.col("sibling").isNotNull(), F.concat(F.lit("did you mean § "), "sibling", F.lit("?")))
    return rows.select("id", F.concat_ws("; ", has, gone, mean).alias("suggestion"))
