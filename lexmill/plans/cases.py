"""Court decisions: whether a cited one exists, bears the cited name, and on which printed page a place of its opinion stands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexmill.functions.names import names_match
from lexmill.operators.lookup import keep_first
from lexmill.session import ship

#: Fixed value: reporters of which a miss proves nothing, as not all of their decisions are listed.
PARTIAL = r"(?i)\bT\.\s?C\.|\bB\.\s?T\.\s?A\."
#: A star page inside an opinion: the printed page that begins there.
STAR_PAGE = r"\*(\d{1,5})(?!\d)"
_SCORED = DoubleType()


@F.pandas_udf(_SCORED)
def _agreement(cited: pd.Series, reported: pd.Series) -> pd.Series:
    """Similarity of two names, negative where they disagree."""
    found = [names_match(c, r) for c, r in zip(cited, reported, strict=True)]
    return pd.Series([score if ok else -score for ok, score in found], dtype="float64")


def case_id(reporter_cite: Column) -> Column:
    """A decision's id from its volume, reporter and page: '/us/case/290-u-s-111'. White space and periods of reporters may differ."""
    spaced = F.regexp_replace(F.lower(reporter_cite), r"[^0-9a-z]+", " ")
    # "t. c. memo" and "t.c. memo" are one: single letters that follow one another stand apart
    apart = F.regexp_replace(F.regexp_replace(spaced, r"(?<=[a-z])(?=\d)", " "), r"\s+", "-")
    return F.concat(F.lit("/us/case/"), F.trim(apart, F.lit("-")))


def partly_covered(reporter_cite: Column) -> Column:
    return reporter_cite.rlike(PARTIAL)


def history(n_citing: Column, last_cited: Column) -> Column:
    """A clause on the later decisions that cite one; null where their number isn't known."""
    n = F.format_number(n_citing, 0)
    many = F.concat(F.lit("cited in "), n, F.when(n_citing == 1, " later decision").otherwise(" later decisions"), F.coalesce(F.concat(F.lit(", most recently "), last_cited), F.lit("")))
    return F.when(n_citing == 0, "no later decision that is known cites this one").when(n_citing > 0, many)


def resolve(citations: DataFrame, cases: DataFrame, this_year: int) -> DataFrame:
    """Citations of decisions with status, note and the name, court and address of the decision found.

    ``citations``: reporter_cite, case_name, case_year, pin_page. ``cases``: id (``case_id``), name, court, url, text, n_citing, last_cited; of two with one
    id the one with a text stands. Missing: not_found if dated after ``this_year``, unverifiable where a miss proves nothing, else
    not_found. Found under another name: not_found. A null name agrees with all; a citation without reporter is unverifiable. Each pair of names is
    compared once, and only where a decision was found.
    """
    ship(citations.sparkSession)
    held = keep_first(cases.select("id", "name", "court", "url", F.col("text").isNotNull().alias("has_text"), "n_citing", "last_cited"), ["id"], [~F.col("has_text"), F.col("name"), F.col("url")])
    rows = citations.withColumn("case_id", case_id(F.col("reporter_cite"))).join(held.withColumnRenamed("id", "c_id"), F.col("case_id") == F.col("c_id"), "left")
    pairs = rows.where("c_id is not null and case_name is not null").select(F.col("case_name").alias("n_cited"), F.col("name").alias("n_held")).distinct()
    scores = pairs.withColumn("agreement", _agreement("n_cited", "n_held"))
    rows = rows.join(scores, (F.col("case_name") == F.col("n_cited")) & (F.col("name") == F.col("n_held")), "left")
    missing, other = F.col("c_id").isNull(), F.coalesce(F.col("agreement") < 0, F.lit(False))
    future = F.coalesce(F.col("case_year") > this_year, F.lit(False))
    partly = F.coalesce(partly_covered(F.col("reporter_cite")), F.lit(True))
    status = F.when(missing & future, "not_found").when(missing & partly, "unverifiable").when(missing | other, "not_found").otherwise("verified")
    unread = F.when(~F.col("has_text"), F.when(F.col("pin_page").isNotNull(), "no opinion is held: page and wording weren't compared").otherwise("no opinion is held: wording wasn't compared"))
    note = (
        F.when(missing & future, F.concat(F.lit("dated "), F.col("case_year").cast("string"), F.lit(", a year to come"))).when(missing & partly, "not every decision of this court is listed, so a miss proves nothing")
        .when(missing, "no decision is reported there").when(other, F.concat(F.lit("that is "), "name", F.lit(", not "), "case_name"))
        .otherwise(F.concat_ws("; ", unread, history(F.col("n_citing"), F.col("last_cited"))))
    )
    return rows.select(*citations.columns, "case_id", status.alias("status"), note.alias("note"), F.col("name").alias("found_name"), "court", "url")


def pages(cases: DataFrame) -> DataFrame:
    """(id, page, start, end): the stretches of every opinion between its star pages, in characters; what stands before the first has no page."""
    texts = cases.where("text is not null").select("id", "text")
    pieces = F.split("text", STAR_PAGE, -1)  # the text between marks; every mark's length is its digits and the star
    marks = F.regexp_extract_all("text", F.lit(STAR_PAGE), F.lit(1))
    sizes = F.transform(pieces, lambda p, i: F.length(p) + F.when(i == 0, 0).otherwise(F.length(F.get(marks, i - 1)) + 1))
    rows = texts.select("id", F.posexplode(F.arrays_zip(sizes.alias("size"), F.concat(F.array(F.lit(None).cast("string")), marks).alias("page"))).alias("k", "x"), sizes.alias("all"))
    start = F.aggregate(F.slice("all", 1, F.col("k")), F.lit(0), lambda a, n: a + n)
    return rows.select("id", F.col("x.page").cast("int").alias("page"), start.alias("start"), (start + F.col("x.size")).alias("end"))


def printed_page(places: DataFrame, cases: DataFrame) -> DataFrame:
    """``places`` (id, at) with the ``page`` on which each character of an opinion was printed: that of the last star page at or before it."""
    p = pages(cases).select(F.col("id").alias("p_id"), "page", "start", "end")
    held = places.join(p, (F.col("id") == F.col("p_id")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")), "left")
    return held.select(*places.columns, "page")
