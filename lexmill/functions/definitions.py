"""Defined terms, their scopes, and references relative to the provision that makes them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.ids import canonical_id
from lexmill.operators.lookup import nearest_ancestor_value
from lexmill.session import ship

# Scope phrases, reach of each, and words that start no term.
SCOPE = re.compile(r"[Ff]or\s+(?:the\s+)?purposes?\s+of\s+(this\s+(?:title|subtitle|chapter|subchapter|part|section|subsection|paragraph|subparagraph)|(?:sub)?(?:section|paragraph)\s+\([0-9A-Za-z]+\))|[Ii]n\s+(this\s+(?:title|section|subsection|paragraph))\b")
REACH = {"title": "title", "subtitle": "title", "chapter": "title", "subchapter": "title", "part": "title", "section": "section", "subsection": "subsection", "paragraph": "paragraph", "subparagraph": "paragraph"}
STOP = {"the", "a", "an", "such", "any", "this", "that", "it", "which", "no", "each", "every", "rules", "provisions"}
MARKED = re.compile(r"[Tt]he\s+terms?\s+[“\"']([^”\"']{2,80})[”\"'](?:\s+and\s+[“\"']([^”\"']{2,80})[”\"'])?\s+(means?|includes?|has\s+the\s+(?:same\s+)?meaning)|[“\"]([^”\"]{2,80})[”\"]\s+(means?)\b")
PLAIN = re.compile(r"[Tt]he\s+term\s+([a-z][a-z -]{2,60}?)\s+(means?)\b")
BY_REFERENCE = re.compile(r"(?:given|provided|defined)\s+(?:such\s+term\s+|to\s+such\s+term\s+)?(?:by|in)\s+(section\s+[\w.()-]+)")
RELATIVE = re.compile(r"\bthis\s+(section|subsection|paragraph|subparagraph|clause)\b|\b(subsection|paragraph|subparagraph|clause)\s+\(([0-9A-Za-z]{1,6})\)", re.I)
DEPTH = {"section": 0, "subsection": 1, "paragraph": 2, "subparagraph": 3, "clause": 4}
SCHEMA = "array<struct<term:string,term_norm:string,scope:string,by_reference:string,text:string>>"


def normalize_term(term: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", term.casefold())).strip()


def scope_before(text: str, position: int) -> str | None:
    """The last scope phrase in the 240 characters before."""
    found = None
    for m in SCOPE.finditer(text, max(position - 240, 0), position):
        found = m[1] or m[2]
    return found


def extract_definitions(text: str | None) -> list[dict]:
    """Terms that a text defines, in order; quoted forms first, then unquoted ones where no quoted one lies."""
    if not text:
        return []
    spans, out = [], []
    for pattern in (MARKED, PLAIN):
        for m in pattern.finditer(text):
            if any(s < m.end() and m.start() < e for s, e in spans):
                continue
            terms = [x for x in (m.groups()[:2] + m.groups()[3:4] if pattern is MARKED else (m[1],)) if x]
            if any(normalize_term(t).split(" ")[0] in STOP or not normalize_term(t) for t in terms):
                continue
            spans.append(m.span())
            end = min(len(text), m.start() + 600)
            by = BY_REFERENCE.search(text, m.end(), min(m.end() + 160, len(text)))
            out += [(m.start(), {"term": t.strip(" ,"), "term_norm": normalize_term(t), "scope": scope_before(text, m.start()), "by_reference": by[1] if by else None, "text": text[m.start() : end]}) for t in terms]
    return [d for _, d in sorted(out, key=lambda x: x[0])]


def relative_targets(source: str, section: str, path: list[str], text: str) -> list[tuple[str, str]]:
    """(id, raw) of "this subsection", "paragraph (2)" and the like, seen from a provision; what can't be resolved is left out.

    "This" names the ancestor that many steps deep; a marker replaces that ancestor's own step, so one step less is kept.
    Regulations start one level lower: their paragraph is the first step of a path.
    """
    ancestors = [path[:n] for n in range(len(path) + 1)]

    def target(m: re.Match) -> str | None:
        steps = max(DEPTH[(m[1] or m[2]).lower()] - (source == "reg"), 0)
        last = [] if m[1] else [m[3]]
        kept = steps - len(last)
        return canonical_id(source, section, [*ancestors[kept], *last]) if 0 <= kept < len(ancestors) else None

    return [(found, m[0]) for m in RELATIVE.finditer(text) if (found := target(m))]


def reach(scope: Column) -> Column:
    """title, section, subsection or paragraph; a scope that names another place reaches the section, none reaches all."""
    word = F.regexp_extract(scope, r"^this (\w+)$", 1)
    known = F.coalesce(*[F.when(word == k, v) for k, v in REACH.items()])
    return F.when(scope.isNull(), "title").otherwise(F.coalesce(known, F.lit("section")))


def within(reaches: Column, defined_in: Column, used_in: Column) -> Column:
    """Whether one id lies within ``reach`` of another."""
    same = lambda depth: F.substring_index(defined_in, "/", depth) == F.substring_index(used_in, "/", depth)
    return F.when(reaches == "section", same(5)).when(reaches == "subsection", same(6)).when(reaches == "paragraph", same(7)).otherwise(F.lit(True))


def governs(scope: Column, defined_in: Column, used_in: Column) -> Column:
    """Whether a definition at one id reaches the provision at another. Of many pairs, take ``reach`` once a definition and ``within`` a pair."""
    return within(reach(scope), defined_in, used_in)


def definitions(provisions: DataFrame) -> DataFrame:
    """(provision_id, term, term_norm, scope, by_reference, text) of provisions (id, text); a term without a scope of its own takes the
    nearest ancestor's. Texts without a defining word never leave the JVM."""
    ship(provisions.sparkSession)
    struct = pa.struct([(n, pa.string()) for n in ("term", "term_norm", "scope", "by_reference", "text")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            stated = [m[1] or m[2] if (m := SCOPE.search(t)) else None for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(stated, pa.string()), pa.array([extract_definitions(t) for t in texts], pa.list_(struct))], ["id", "stated", "d"])

    rows = provisions.select("id", "text").where(F.col("text").ilike("%means%") | F.col("text").ilike("%term%") | F.col("text").ilike("%purposes of%"))
    found = rows.mapInArrow(scan, f"id string, stated string, d {SCHEMA}")
    scopes = nearest_ancestor_value(found.select("id").distinct(), "id", found.select(F.col("id").alias("sid"), F.col("stated").alias("inherited")), "sid", "inherited")
    each = found.select("id", F.explode("d").alias("d")).select(F.col("id").alias("provision_id"), "d.*")
    out = each.join(scopes, F.col("provision_id") == F.col("id"), "left")
    return out.select("provision_id", "term", "term_norm", F.coalesce("scope", "inherited").alias("scope"), "by_reference", "text")


def uses_term(text: Column, term: str) -> Column:
    """Substring for long terms, whole words for short ones."""
    return F.contains(F.lower(text), F.lit(term)) if len(term) >= 6 else F.lower(text).rlike(rf"\b{re.escape(term)}\b")
