"""Citation grammar: whole text -> citations in document order.

A hand-written scanner: heads (an authority, a section mark or both) are found by one pattern, bodies are read token by
token, so that lists, ranges, hyphens inside section numbers and pinpoints need no look-back. Pure Python, one call a text;
``extract`` wraps it for Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lexmill.functions import readers
from lexmill.functions.ids import DASHES, canonical_id, display, validate_path
from lexmill.session import ship

MAX_RANGE = 26

# Fixed values of the grammar.
HEAD = re.compile(
    r"""(?:(?P<usc>\b26\s+U\.?\s?S\.?\s?C\.?(?:A\.?)?)|(?P<cfr>\b26\s+C\.?\s?F\.?\s?R\.?)
    |(?P<reg>(?:\b(?:Temp(?:orary)?|Prop(?:osed)?)\.?\s+)*(?:\bTreas(?:ury)?\.?\s+)?\bReg(?:ulation)?s?\b\.?)
    |(?P<irc>\bI\.?R\.?C\.?(?!\w)|\bInternal\s+Revenue\s+Code\b|\bCode\b))?
    \s*(?P<mark>§§?|[Ss]ections?\b|[Ss]ecs?\.|[Ss]s\.)?\s*(?=[\d])""",
    re.X,
)
REG_NUMBER = re.compile(r"\d+[A-Za-z]?\.[0-9A-Za-z]+(?:\([a-z]\))?-\d+[A-Za-z]{0,2}")
IRC_NUMBER = re.compile(r"\d+[A-Za-z]{1,3}-\d+[A-Za-z]?|\d+[A-Za-z]{0,3}(?![A-Za-z])")
PINPOINT = re.compile(r"\s?\(([0-9A-Za-z]{1,6})\)")
LIST = re.compile(r"\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+")
RANGE = re.compile(r"\s*[–—-]\s*|\s+(?:through|to)\s+")
MASKED = (re.compile(r"```.*?```|~~~.*?~~~", re.S), re.compile(r"`[^`\n]*`"), re.compile(r"(?:https?://|www\.|ftp://)[^\s<>\"')\]]+"), re.compile(r"\]\([^)\s]+\)"))

SCHEMA = (
    "array<struct<start:int,end:int,raw:string,source:string,section:string,path:array<string>,reg_kind:string,canonical_id:string,display:string,"
    "guidance_type:string,guidance_number:string,case_name:string,reporter_cite:string,pin_page:int,case_year:int,warnings:array<string>>>"
)
FIELDS = re.findall(r"(\w+):", SCHEMA)

Citation = dict[str, Any]


def mask(text: str) -> str:
    """Code, URLs and link targets become spaces of equal length; lines stay."""
    spans = [m.span() for p in MASKED for m in p.finditer(text)]
    chars = list(text)
    for s, e in spans:
        chars[s:e] = ["\n" if c == "\n" else " " for c in chars[s:e]]
    return "".join(chars)


def _new(start: int, end: int, raw: str, source: str, **more: Any) -> Citation:
    return dict.fromkeys(FIELDS) | {"start": start, "end": end, "raw": raw, "source": source, "path": [], "warnings": []} | more


def _element(text: str, at: int, bare: bool) -> tuple[str | None, list[str], int] | None:
    """(section or None, path, end) of one element of a body; a bare pinpoint only where one may stand."""
    m = REG_NUMBER.match(text, at) or IRC_NUMBER.match(text, at)
    section, end = (m[0], m.end()) if m else (None, at)
    if not m and not bare:
        return None
    path = []
    while p := PINPOINT.match(text, end):
        path.append(p[1])
        end = p.end()
    return (section, path, end) if m or path else None


def _between(a: str, b: str) -> list[str] | None:
    """Every step of a range, both ends included, of numbers or of letters of one case; None unless it rises by less than MAX_RANGE."""
    both = a + b
    if both.isdecimal() and a and b:
        number, name = int, str
    elif len(a) == len(b) == 1 and both.isalpha() and (both.islower() or both.isupper()):
        number, name = ord, chr
    else:
        return None
    steps = range(number(a), number(b) + 1)
    return [*map(name, steps)] if 1 < len(steps) <= MAX_RANGE else None


def _body(text: str, at: int) -> tuple[list[tuple[str, list[str], list[str]]], int] | None:
    """(targets: section, path, warnings; end) of a citation's body that starts at ``at``."""
    first = _element(text, at, False)
    if not first:
        return None
    section, path, end = first
    targets = [(section, path, [])]
    while True:
        gap, ranged = LIST.match(text, end), False
        nxt = _element(text, gap.end(), bool(targets[-1][1])) if gap else None
        if not nxt and (gap := RANGE.match(text, end)):
            nxt, ranged = _element(text, gap.end(), bool(targets[-1][1])), True
        if not nxt:
            return targets, end
        section, path, end = nxt
        last = targets[-1]
        if not ranged:
            targets.append((section or last[0], path, []))
            continue
        inside = None
        if section and not path and not last[1]:
            inside = [(s, [], []) for s in _between(last[0], section) or []]
        elif section is None and len(path) == len(last[1]) == 1:
            inside = [(last[0], [t], []) for t in _between(last[1][0], path[0]) or []]
        if inside:
            targets[-1:] = inside
        else:
            note = "range endpoints not expanded"
            targets[-1] = (last[0], last[1], [*last[2], note])
            targets.append((section or last[0], path, [note]))


def _sections(text: str, masked: str) -> Iterator[tuple[int, int, int, list[Citation]]]:
    at = 0
    while m := HEAD.search(masked, at):
        at = m.end() + 1
        named = m["usc"] or m["cfr"] or m["reg"] or m["irc"]
        if not m["mark"] and not (m["usc"] or m["cfr"] or m["reg"]):
            continue
        found = _body(masked, m.end())
        start = m.start("usc") if m["usc"] else m.start("cfr") if m["cfr"] else m.start("reg") if m["reg"] else m.start("irc") if m["irc"] else m.start("mark")
        if not found or (not named and not m["mark"]):
            continue
        targets, end = found
        at = end
        if readers.of_public_law(masked[max(start - 30, 0) : start]) or readers.of_instrument(masked[end : end + 80]):
            continue
        head = m["reg"] or ""
        out = []
        for section, path, warnings in targets:
            section = section.translate(DASHES)
            source = "reg" if REG_NUMBER.fullmatch(section) else "irc"
            kind = None
            if source == "reg":
                kind = "proposed" if "Prop" in head else "temporary" if "Temp" in head or re.search(r"-\d+T$", section) else "final"
            out.append(
                _new(
                    start, end, text[start:end], source, section=section, path=path, reg_kind=kind, canonical_id=canonical_id(source, section, path),
                    display=display(source, section, path, kind), warnings=[*warnings, *validate_path(path, source == "reg")],
                )
            )
        yield start, end, 3 if out[0]["source"] == "reg" else 2, out


def _others(text: str, masked: str) -> Iterator[tuple[int, int, int, list[Citation]]]:
    for read in (readers.guidance, readers.cases, readers.commentary):
        for x in read(masked):
            yield x.start, x.end, 1, [_new(x.start, x.end, text[x.start : x.end], x.source, display=x.display, **x.fields)]


def resolve_overlaps(found: list[tuple[int, int, int, Any]]) -> list[tuple[int, int, int, Any]]:
    """One sweep from left to right: a span that begins inside the last winner takes its place only if it is longer, or as long and of more priority."""
    rank = lambda x: (x[1] - x[0], x[2])
    won: list[tuple[int, int, int, Any]] = []
    for x in sorted(found, key=lambda x: (x[0], *(-r for r in rank(x)))):
        if not won or won[-1][1] <= x[0]:
            won.append(x)
        elif rank(x) > rank(won[-1]):
            won[-1] = x
    return won


def extract_citations(text: str | None) -> list[Citation]:
    """Every citation, in order of place and identifier; null and empty texts have none."""
    if not text:
        return []
    masked = mask(text)
    kept = resolve_overlaps([*_sections(text, masked), *_others(text, masked)])
    return sorted((c for x in kept for c in x[3]), key=lambda c: (c["start"], c["canonical_id"] or ""))


def parse_citation(text: str) -> Citation:
    """The one citation in ``text``, which may be a bare number; ValueError for none or several."""
    cited = extract_citations(text) or (extract_citations(f"§ {text}") if re.match(r"\d", text) else [])
    found = {c["canonical_id"] or c["display"]: c for c in cited}
    if len(found) != 1:
        raise ValueError(f"{len(found)} citations in {text!r}")
    return next(iter(found.values()))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per citation: doc_id and the citation's fields. Texts without a digit have none and never leave the JVM."""
    ship(docs.sparkSession)
    kind, arrow = dict(docs.dtypes)[id_col], to_arrow_type(_parse_datatype_string(SCHEMA))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract_citations(t) for t in b.column(1).to_pylist()], arrow)], ["doc_id", "c"])

    rows = docs.where(F.col(text_col).rlike("[0-9]")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, c {SCHEMA}").select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.*")




def guidance_id(kind: Column, number: Column) -> Column:
    """'rev-rul-2019-24' from a kind and a number."""
    slug = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "-"), F.lit("-"))
    return F.concat_ws("-", slug(kind), slug(number))
