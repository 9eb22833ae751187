"""Verification of documents: every citation resolved by joins, summaries by aggregation.

Citations are extracted once per document and then only (document, identifier) rows move. Provisions, guidance and cases are joined
by equality; the verdict is one CASE in order of precedence. Absent and not covered stay different: guidance of a year that isn't wholly
indexed is unverifiable, not missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.cite import extract, guidance_id
from lexmill.functions.ids import prefixes_of, section_of
from lexmill.operators import fuzzy, lookup
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize

SEVERITIES = ("ok", "info", "warning", "error")
INOPERATIVE = {"repealed": "repealed", "omitted": "repealed", "transferred": "repealed", "reserved": "reserved"}


def severity(status: Column) -> Column:
    return (
        F.when(status.isin("verified"), "ok").when(status == "unverifiable", "info")
        .when(status.isin("repealed", "reserved", "superseded", "source_unavailable"), "warning").otherwise("error")
    )


def resolve(citations: DataFrame, provisions: DataFrame, guidance: DataFrame | None = None, covered_years: list[int] = (), offline: bool = True) -> DataFrame:
    """Citations with status, severity, heading and the deepest ancestor that exists.

    ``provisions``: id, heading, status. ``guidance``: id, status (superseded or active). A section that is missing is not_found
    (for regulations without a reachable source: source_unavailable); a missing pinpoint under an existing section is pinpoint_not_found.
    """
    citations = materialize(citations, "citations")  # read twice; texts are scanned once
    cited = materialize(citations.select("canonical_id").where("canonical_id is not null").distinct(), "cited")
    # Only what is cited, and what is above it, is taken from the provisions: these are never broadcast, however small their files look.
    asked = broadcast_if_small(cited.select(F.explode(prefixes_of(F.col("canonical_id"))["id"]).alias("a_id")).distinct())
    named = provisions.select("id", "heading", "status").hint("merge").join(asked, F.col("id") == F.col("a_id"), "left_semi")
    # a provision that is listed twice counts once, the listing with a heading first
    held = materialize(lookup.keep_first(named, ["id"], [F.col("heading").isNull(), F.col("heading"), F.col("status")]), "held")
    p = held.select(F.col("id").alias("p_id"), "heading", F.col("status").alias("p_status"))
    found = cited.join(p, F.col("canonical_id") == F.col("p_id"), "left").join(held.select(F.col("id").alias("s_id")), section_of(F.col("canonical_id")) == F.col("s_id"), "left")
    missed = found.where("p_id is null and s_id is not null").select(F.col("canonical_id").alias("d_id"))
    deepest = lookup.deepest_existing(missed, "d_id", held, "id").select("d_id", F.col("found").alias("ancestor"))
    found = materialize(found.join(deepest, F.col("canonical_id") == F.col("d_id"), "left").withColumnRenamed("canonical_id", "f_id"), "found")
    rows = citations.join(broadcast_if_small(found), F.col("canonical_id") == F.col("f_id"), "left")
    rows = rows.withColumn("g_key", F.when(F.col("source") == "irs_guidance", guidance_id(F.col("guidance_type"), F.col("guidance_number"))))
    if guidance is not None:
        rows = rows.join(broadcast_if_small(guidance.select(F.col("id").alias("g_id"), F.col("status").alias("g_status"))), F.col("g_key") == F.col("g_id"), "left")
    else:
        rows = rows.withColumns({"g_id": F.lit(None).cast("string"), "g_status": F.lit(None).cast("string")})
    year = F.regexp_extract("guidance_number", r"^(\d{4})-", 1).try_cast("int")
    inoperative = F.coalesce(*[F.when(F.col("p_status") == k, v) for k, v in INOPERATIVE.items()])
    status = (
        F.when((F.col("source") == "irs_guidance") & (F.col("g_status") == "superseded"), "superseded")
        .when((F.col("source") == "irs_guidance") & F.col("g_id").isNotNull(), "verified")
        .when((F.col("source") == "irs_guidance") & F.coalesce(year.isin(list(covered_years)), F.lit(False)), "not_found")
        .when(F.col("canonical_id").isNull(), "unverifiable")
        .when(F.col("p_id").isNotNull(), F.coalesce(inoperative, F.lit("verified")))
        .when(F.col("s_id").isNotNull(), "pinpoint_not_found")
        .when((F.col("source") == "reg") & F.lit(offline), "source_unavailable")
        .otherwise("not_found")
    )
    rows = rows.withColumn("status", status).withColumn("severity", severity(F.col("status")))
    return rows.drop("p_id", "p_status", "s_id", "f_id", "d_id", "g_key", "g_id", "g_status")


def suggestions(results: DataFrame, provisions: DataFrame) -> DataFrame:
    """(section, suggestion): up to three existing sections near each that wasn't found."""
    missing = results.where("status = 'not_found' and section is not null").select("section").distinct()
    known = provisions.where(F.size(F.split("id", "/")) == 5).select(F.substring_index(F.col("id"), "/s", -1).alias("name"))
    best = fuzzy.nearest(missing, "section", known, "name")
    return best.groupBy(F.col("query").alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: F.concat(F.lit("§ "), x["name"])), ", ").alias("suggestion"))


def summary(results: DataFrame) -> DataFrame:
    """One row per document: citations, counts by severity (zero where none) and the worst severity."""
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return results.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_citations"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES], F.max_by("severity", order).alias("worst")
    )


def verify(docs: DataFrame, provisions: DataFrame, guidance: DataFrame | None = None, covered_years: list[int] = (), **columns: str) -> DataFrame:
    """Documents -> resolved citations."""
    return resolve(extract(docs, **columns), provisions, guidance, covered_years)
