"""Look-up of defined terms: which definitions match, which of them govern a place, and which don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.definitions import governs

# Scopes from the widest to the narrowest, and the section of general definitions.
SCOPES = ("title", "subtitle", "chapter", "subchapter", "part", "subpart", "section", "subsection", "paragraph", "subparagraph")
GENERAL = "7701"


def _breadth() -> Column:
    place = F.array_position(F.array(*[F.lit(f"this {s}") for s in SCOPES]), F.col("scope"))
    return F.when(place > 0, place - 1).otherwise(len(SCOPES))


def ranked(asked: DataFrame, definitions: DataFrame, headings: DataFrame, limit: int = 5) -> DataFrame:
    """For every row of ``asked`` (ask, term_norm), its best definitions with their ``rank`` from 1 to ``limit``.

    General definitions of a wide scope come first, then those whose section's heading (``headings``: section_id, heading) names
    the term, wider scopes, definitions of their own, shallow places, and ids in order. An equi-join on the term; ranks are
    taken within one question, whose definitions are few.
    """
    d = definitions.select("provision_id", "term_norm", "scope", "by_reference")
    d = d.withColumn("section_id", F.array_join(F.slice(F.split("provision_id", "/"), 1, 5), "/"))
    rows = asked.select("ask", "term_norm").distinct().join(d, "term_norm").join(headings.select("section_id", "heading"), "section_id", "left")
    best = F.struct(
        ~((F.element_at(F.split("section_id", "/"), -1) == f"s{GENERAL}") & (_breadth() <= 1)),
        ~F.contains(F.lower(F.coalesce("heading", F.lit(""))), F.col("term_norm")),
        _breadth(), F.col("by_reference").isNotNull(), F.size(F.split("provision_id", "/")), "provision_id",
    )
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("ask", "term_norm").orderBy(best))).where(F.col("rank") <= limit)
    return rows.select("ask", "term_norm", "rank", "provision_id", "scope", "by_reference")


def governing(found: DataFrame, used_in: Column) -> DataFrame:
    """Of the definitions found, those that reach the place of use."""
    return found.where(governs(F.col("scope"), F.col("provision_id"), used_in))


def scope_conflicts(found: DataFrame, used_in: Column) -> DataFrame:
    """Of the definitions found, those that don't reach the place of use."""
    return found.where(~governs(F.col("scope"), F.col("provision_id"), used_in))
