"""Look-ups of citations as they are written, for whole tables of questions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.cite import parse_citation
from lexmill.functions.ids import PREFIX, parent_of, section_of, source_url
from lexmill.operators.lookup import keep_first, truncate_words
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize
from lexmill.session import ship

#: Characters of a text that are shown, if nothing else is asked for.
MAX_CHARS = 6000

#: A section and its pinpoints, written in full and nothing else: what most questions are. They can be read in one way only, so they never leave the JVM.
PLAIN = r"\A(?:26 U\.S\.C\. )?§ ([0-9]{1,9}[A-Z]?)((?:\((?:[0-9a-z]{1,6}|[A-Z]{1,4})\))*)\z"

_PARSED = [("canonical_id", pa.string()), ("display", pa.string()), ("source", pa.string()), ("url", pa.string()), ("problem", pa.string())]


def coerce(asked: DataFrame, ask: str = "ask", citation: str = "citation") -> DataFrame:
    """(ask, citation, canonical_id, display, source, url, problem): what each text cites. A text that holds none or several citations has a problem and no id.

    Sections as ``PLAIN`` has them are read by expressions; each distinct text of another form is parsed once by the grammar.
    """
    ship(asked.sparkSession)

    def one(text: str | None) -> dict:
        try:
            c = parse_citation(text or "")
        except ValueError as e:
            return {"problem": str(e)}
        return {"canonical_id": c["canonical_id"], "display": c["display"], "source": c["source"], "url": source_url(c["source"], c["section"], c["path"])}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r.get(n) for r in rows], t) for n, t in _PARSED]], ["c", *[n for n, _ in _PARSED]])

    rows = asked.select(F.col(ask).alias("ask"), F.col(citation).alias("citation"))
    is_plain = F.coalesce("citation", F.lit("")).rlike(PLAIN)
    section, pinpoints = (F.regexp_extract("citation", PLAIN, n) for n in (1, 2))
    before, after = source_url("irc", "\0").split("\0")
    plain = rows.where(is_plain).select(
        "ask", "citation", F.concat(F.lit(PREFIX["irc"]), section, F.replace(F.replace(pinpoints, F.lit(")"), F.lit("")), F.lit("("), F.lit("/"))).alias("canonical_id"),
        F.concat(F.lit("§ "), section, pinpoints).alias("display"), F.lit("irc").alias("source"), F.concat(F.lit(before), section, F.lit(after)).alias("url"), F.lit(None).cast("string").alias("problem"),
    )
    rows = rows.where(~is_plain)
    texts = rows.select(F.coalesce("citation", F.lit("")).alias("c")).distinct()
    parsed = materialize(texts.mapInArrow(scan, "c string, " + ", ".join(f"{n} string" for n, _ in _PARSED)), "parsed")
    return plain.unionByName(rows.join(parsed, F.coalesce("citation", F.lit("")) == F.col("c")).drop("c"))


def lookup(asked: DataFrame, provisions: DataFrame, *, whole: bool = True, max_chars: int = MAX_CHARS, ask: str = "ask", citation: str = "citation") -> DataFrame:
    """(ask, citation, canonical_id, display, url, problem, heading, status, text, truncated, n_children): one row a question.

    ``provisions``: id, heading, status, text (its own), full_text (with what is below). ``whole`` asks for the latter. A provision
    that isn't there has problem "not found" and no text. Of provisions with one id the one with a heading stands.
    """
    names = ["heading", "status", "text", "full_text"]
    found = coerce(asked, ask, citation)
    wanted = broadcast_if_small(found.select(F.col("canonical_id").alias("w")).where("w is not null").distinct())
    held = keep_first(provisions.select("id", *names).join(wanted, F.col("id") == F.col("w"), "left_semi"), ["id"], [F.col("heading").isNull(), F.col("heading"), F.col("text")])
    below = provisions.select(parent_of(F.col("id")).alias("p"), "id").join(wanted, F.col("p") == F.col("w"), "left_semi").groupBy("p").agg(F.count_distinct("id").alias("n"))
    rows = found.join(held, F.col("canonical_id") == F.col("id"), "left").join(below, F.col("canonical_id") == F.col("p"), "left")
    text, cut = truncate_words(F.col("full_text" if whole else "text"), max_chars)
    problem = F.coalesce("problem", F.when(F.col("canonical_id").isNull(), "has no text of its own").when(F.col("id").isNull(), "not found"))
    return rows.select(
        "ask", "citation", "canonical_id", "display", "url", problem.alias("problem"), "heading", "status", text.alias("text"), cut.alias("truncated"), F.coalesce("n", F.lit(0)).alias("n_children")
    )


def subdivisions(asked: DataFrame, provisions: DataFrame, ask: str = "ask", citation: str = "citation") -> DataFrame:
    """(ask, id, ordinal, num, heading): the direct children of what each question cites, one row each. ``provisions``: id, ordinal, num, heading."""
    found = coerce(asked, ask, citation).where("canonical_id is not null").select("ask", "canonical_id")
    wanted = broadcast_if_small(materialize(found, "wanted"))
    children = provisions.select(parent_of(F.col("id")).alias("p"), "id", "ordinal", "num", "heading")
    return children.join(wanted, F.col("p") == F.col("canonical_id")).select("ask", "id", "ordinal", "num", "heading")


def section_numbers(provisions: DataFrame, source: str) -> DataFrame:
    """(section): the sections of a source, in the order of text."""
    return provisions.where((F.col("source") == source) & (F.col("id") == section_of(F.col("id")))).select("section").distinct().orderBy("section")


def notes_of(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes (id, ordinal, topic, heading, text ...) of the provisions in the first column of ``asked``, in order."""
    wanted = broadcast_if_small(asked.select(F.col(asked.columns[0]).alias("w")).distinct())
    return notes.join(wanted, F.col("id") == F.col("w"), "left_semi").orderBy("id", "ordinal")


def rate_months(rates: DataFrame) -> DataFrame:
    """(month): the months that have a rate, in order."""
    return rates.select("month").where("month is not null").distinct().orderBy("month")


def text_lengths(provisions: DataFrame) -> DataFrame:
    """(source, n, n_sections, mean_chars): how many provisions and sections a source has, and the mean length of their own texts; empty ones don't count for it."""
    size = F.length("text")
    is_section = F.col("id") == section_of(F.col("id"))
    return provisions.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_section).alias("n_sections"), F.avg(F.when(size > 0, size)).alias("mean_chars"))
