"""What kind of authority a citation is, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of guidance by their abbreviation, and the first years in which two of the kinds count.
GUIDANCE = {
    "Rev. Rul.": "published_ruling", "Rev. Proc.": "published_ruling", "Notice": "irb_pronouncement", "Ann.": "irb_pronouncement",
    "I.R.B.": "irb_pronouncement", "T.D.": "regulation", "PLR": "private_ruling", "TAM": "private_ruling", "CCA": "internal_memorandum",
    "GCM": "internal_memorandum", "AOD": "internal_memorandum", "FSA": "internal_memorandum",
}
SINCE = {"private_ruling": 1976, "internal_memorandum": 1981}
SOURCES = {"irc": "statute", "reg": "regulation", "case": "case", "secondary": "secondary"}


def _from(values: dict[str, object], key: Column) -> Column:
    found = F.lit(None)
    for k, v in values.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def ruling_year(number: Column) -> Column:
    """The year that a ruling's number encodes: ``YYYY-n``, nine digits or more (YYYY first), seven or eight (YY of the 1900s); else null.

    Years outside 1950 to 2100 are no years.
    """
    n = F.trim(number)
    year = (
        F.when(n.rlike(r"^[0-9]{4}-[0-9]+$") | n.rlike(r"^[0-9]{9,}$"), F.substring(n, 1, 4).try_cast("int"))
        .when(n.rlike(r"^[0-9]{7,8}$"), 1900 + F.substring(n, 1, 2).try_cast("int"))
    )
    return F.when(year.between(1950, 2100), year)


def kind_of(source: Column, guidance_type: Column) -> Column:
    """statute, regulation, case, secondary or a kind of guidance; what is in neither list is ``unclassified``."""
    return F.coalesce(_from(SOURCES, source), _from(GUIDANCE, guidance_type), F.lit("unclassified"))


def classify(citations: DataFrame, source: str = "source", guidance_type: str = "guidance_type", number: str = "guidance_number") -> DataFrame:
    """Adds authority_kind, is_authority and cutoff_unchecked (the kind counts from a year on, and the number has none).

    Commentary and unclassified citations are no authority, nor are rulings from before their kind's first year. No shuffle, no UDF.
    """
    kind, year = kind_of(F.col(source), F.col(guidance_type)), ruling_year(F.col(number))
    since = _from(SINCE, kind)
    counts = ~kind.isin("secondary", "unclassified") & ~F.coalesce(year < since, F.lit(False))
    return citations.withColumns({"authority_kind": kind, "is_authority": counts, "cutoff_unchecked": since.isNotNull() & year.isNull()})


def kind_counts(classified: DataFrame) -> DataFrame:
    """Citations by authority_kind."""
    return classified.groupBy("authority_kind").agg(F.count(F.lit(1)).alias("n"))


# What a reader is told, by kind and by what verification found: reason, and what to mind.
REASONS = {
    "statute": "a provision of the statute", "regulation": "a regulation that construes the statute, whether final, temporary or proposed", "case": "a court's decision",
    "secondary": "commentary is no authority; what it rests on may be", "published_ruling": "a revenue ruling or revenue procedure",
    "irb_pronouncement": "a pronouncement published in the bulletin", "private_ruling": "a private ruling of after 31 October 1976",
    "internal_memorandum": "an internal memorandum of after 12 March 1981", "unclassified": "none of the kinds that the regulation lists",
}
CAVEATS = {
    "case": "no authority any more if overruled or reversed", "private_ruling": "binds the taxpayer who asked for it alone; no authority if revoked or at odds with what was published later",
    "unclassified": "classify it by hand", "secondary": "cite the authorities behind it",
}
REG_CAVEATS = {"proposed": "weighs less than a final regulation on the same point", "temporary": "expires three years after its issue; check that it is in force"}
UNCHECKED, TOO_OLD = "its number names no year, so the first year was not checked", "from before the first year of its kind"
ABSENT, ENDED = "does not exist, so it is authority for nothing", "no longer operative"
STATUS_CAVEATS = {"not_yet_effective": "did not govern the tax year cited", "source_unavailable": "could not be checked against the official source"}


def analyse(citations: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, display, authority_kind, is_authority, reason, caveats, unresolved): each document's authorities once, in the light of what was verified.

    ``citations``: doc_id, start, canonical_id, display, source, guidance_type, guidance_number, reg_kind; the first of a document's citations of one
    identifier (or display, where it has none) stands. ``statuses``: doc_id, start, key, status; the last of a key counts. Absent and ended authorities
    are none; what a status leaves open is a caveat. Rows of a null doc_id are one document. No citations, no rows.
    """
    names = ["display", "source", "guidance_type", "guidance_number", "reg_kind"]
    keyed = citations.withColumn("key", F.coalesce("canonical_id", "display")).withColumn("of", F.struct("doc_id"))
    rows = keyed.groupBy("of", "key").agg(F.min(F.struct("start", *names)).alias("x")).select(F.col("of.doc_id").alias("doc_id"), "key", *[F.col(f"x.{c}").alias(c) for c in names])
    rows = classify(rows)
    if statuses is None:
        rows = rows.withColumn("status", F.lit(None).cast("string"))
    else:
        last = statuses.groupBy(F.col("doc_id").alias("s_doc"), F.col("key").alias("s_key")).agg(F.max_by("status", F.struct("start", "status")).alias("status"))
        rows = rows.join(last, F.col("doc_id").eqNullSafe(F.col("s_doc")) & F.col("key").eqNullSafe(F.col("s_key")), "left").drop("s_doc", "s_key")
    kind, status = F.col("authority_kind"), F.col("status")
    absent, ended = F.coalesce(status.isin("not_found", "pinpoint_not_found"), F.lit(False)), F.coalesce(status.isin("repealed", "superseded"), F.lit(False))
    old = kind.isin(*SINCE) & ~F.col("is_authority")
    reason = F.when(absent, ABSENT).when(ended, ENDED).when(old, TOO_OLD).otherwise(_from(REASONS, kind))
    caveats = F.array(
        F.when(F.col("cutoff_unchecked"), UNCHECKED), F.when(~old, _from(CAVEATS, kind)), F.when(kind == "regulation", _from(REG_CAVEATS, F.col("reg_kind"))), _from(STATUS_CAVEATS, status)
    )
    counts = F.col("is_authority") & ~absent & ~ended
    return rows.select(
        "doc_id", "key", "display", "authority_kind", counts.alias("is_authority"), reason.alias("reason"), F.filter(caveats, lambda c: c.isNotNull()).alias("caveats"), absent.alias("unresolved")
    )


def report(analysed: DataFrame) -> DataFrame:
    """(doc_id, n_authority, n_not_authority, n_caveats, unresolved): one row a document, ``unresolved`` the displays of what doesn't exist, in order."""
    gone = F.array_sort(F.collect_set(F.when(F.col("unresolved"), F.col("display"))))  # a document's own citations
    return analysed.groupBy("doc_id").agg(
        F.count_if("is_authority").alias("n_authority"), F.count_if(~F.col("is_authority")).alias("n_not_authority"), F.sum(F.size("caveats")).cast("long").alias("n_caveats"), gone.alias("unresolved")
    )
