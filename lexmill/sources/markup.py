"""Statute XML, regulation XML and bulletin HTML as rows.

Parsers are pure functions from bytes to records; ``read`` runs one over files (Spark's binaryFile source, so any store that Spark
reads) and returns a tagged table. Malformed files give one record of kind ``corrupt`` instead of failing the job.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import date
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lexmill.functions.readers import NUMBERED, guidance
from lexmill.functions.ids import DASHES, REG_LEVELS, canonical_id, is_roman, roman_to_int, split_id
from lexmill.session import ship

SCHEMA = (
    "kind string, id string, source string, section string, path array<string>, level string, num string, heading string, text string, full_text string,"
    " parent_id string, ordinal int, status string, topic string, to_id string, external boolean, dates array<date>, applies_after date, path_in string"
)
FIELDS = re.findall(r"(\w+) \w", SCHEMA)

# Fixed values of the formats.
LEVEL_TAGS = ("section", "subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem", "subsubitem")
STATUS = {"repealed": "repealed", "reserved": "reserved", "omitted": "omitted", "transferred": "transferred", "renumbered": "transferred"}
NOT_TEXT = {"notes", "note", "sourceCredit", "toc", "footnote", "editorialNote"}
NOTE_TOPICS = {"effectiveDate", "effectiveDateOfAmendment", "amendments", "prospectiveAmendment", "sourceCredit", "miscellaneous", "savingsProvision", "transitionRules", "construction", "repeals", "shortTitle", "regulations"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE = r"([A-Z][a-z]{2,8})\.?\s+(\d{1,2}),\s+(\d{4})"
APPLIES = tuple(
    re.compile(p + r"\s+" + DATE)
    for p in (r"taxable\s+years?\s+beginning\s+(?:on\s+or\s+)?after", r"taxable\s+years?\s+ending\s+after", r"property\s+[^.;]{0,80}?\s+after", r"effective(?:\s+on)?")
)

Record = dict[str, Any]


def record(kind: str, **values: Any) -> Record:
    return dict.fromkeys(FIELDS) | {"kind": kind} | values


def text_date(month: str, day: str, year: str) -> date | None:
    try:
        return date(int(year), MONTHS.index(month.lower()[:3]) + 1, int(day))
    except ValueError:
        return None


def dates_in(text: str) -> list[date]:
    return [d for m in re.finditer(DATE, text) if (d := text_date(*m.groups()))]


def applicability_date(text: str) -> date | None:
    """The date after which a note applies, from the first formula that has one."""
    return next((d for p in APPLIES if (m := p.search(text)) and (d := text_date(*m.groups()))), None)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _text(e: ET.Element, skip: Callable[[str], bool]) -> str:
    out = [e.text or ""]
    for child in e:
        if not skip(_tag(child)):
            out.append(_text(child, skip))
        out.append(child.tail or "")
    return " ".join(out) if any(_tag(c) in LEVEL_TAGS for c in e) else "".join(out)


def section_ids(identifier: str) -> list[str]:
    """The identifiers of a section of its own; none for one that is nested in another law, or quoted."""
    ids = [i.translate(DASHES) for i in identifier.split()]
    return ids if all(i.startswith("/us/usc/t26/s") and i.count("/") == 4 for i in ids) else []


def section_records(section: ET.Element) -> Iterator[tuple[str, list[Record]]]:
    """(identifier, records) of a section: provisions with their tree, explicit references and notes; one of two ids gives one tree each."""
    for i in section_ids(section.get("identifier", "")):
        yield i, [*_provision(section, i, None, 0, "active"), *_notes(section, i)]


def statute_records(data: bytes) -> Iterator[Record]:
    """Records of all sections of a statute, the first of each identifier."""
    seen: set[str] = set()
    root = ET.fromstring(data)
    for section in [root] if _tag(root) == "section" else root.iter():
        if _tag(section) == "section":
            for i, rows in section_records(section):
                if i not in seen:
                    seen.add(i)
                    yield from rows


def _provision(e: ET.Element, identifier: str, parent: str | None, ordinal: int, inherited: str) -> list[Record]:
    source, section, path = split_id(identifier)
    status = STATUS.get(e.get("status", "").lower(), inherited)
    own = lambda t: t in LEVEL_TAGS or t in NOT_TEXT or t in ("num", "heading")
    children = [c for c in e if _tag(c) in LEVEL_TAGS]
    below: list[Record] = []
    fulls: dict[ET.Element, str] = {}
    for k, c in enumerate(children):
        num = next((x.get("value") or _flat("".join(x.itertext())).strip("().—") for x in c if _tag(x) == "num"), str(k))
        child_id = (c.get("identifier") or f"{identifier}/{num}").translate(DASHES)
        if parent is None and not child_id.startswith(identifier):
            child_id = f"{identifier}/{num}"
        rows = _provision(c, child_id, identifier, k, status)
        fulls[c] = " ".join(x for x in (f"({num})", rows[0]["heading"], rows[0]["full_text"]) if x)
        below += rows
    heading = next((_flat("".join(x.itertext())) for x in e if _tag(x) == "heading"), None)
    num = next((x.get("value") or _flat("".join(x.itertext())) for x in e if _tag(x) == "num"), None)
    full = [e.text or ""]  # in document order, so that text after the children stays after them
    for c in e:
        full += [fulls[c] if c in fulls else "" if own(_tag(c)) else _text(c, lambda t: t in NOT_TEXT), c.tail or ""]
    me = record(
        "provision", id=identifier, source=source, section=section, path=path, level=_tag(e), num=num, heading=heading, text=_flat(_text(e, own)),
        full_text=_flat(" ".join(full)), parent_id=parent, ordinal=ordinal, status=status,
    )
    refs = {x.get("href", "").translate(DASHES) for c in e if not own(_tag(c)) for x in c.iter() if _tag(x) == "ref" and x.get("href")}
    return [me, *below, *[record("ref", id=identifier, to_id=h, external=not h.startswith("/us/usc/t26/")) for h in sorted(refs)]]


def _notes(section: ET.Element, identifier: str) -> Iterator[Record]:
    k = 0
    for n in section.iter():
        if _tag(n) != "note" or n.get("topic") not in NOTE_TOPICS or n.get("role") == "crossHeading":
            continue
        heading = next((_flat("".join(x.itertext())) for x in n if _tag(x) == "heading"), None)
        text = _flat(_text(n, lambda t: t == "heading"))
        yield record("note", id=identifier, ordinal=k, topic=n.get("topic"), heading=heading, text=text, dates=dates_in(text), applies_after=applicability_date(text))
        k += 1


# Regulations: paragraphs are flat; their markers give the tree.
_MARK = re.compile(r"\s*(?:\((<i>)?\s*([0-9A-Za-z]{1,5})\s*(?:</i>)?\))")


def marker_levels(token: str, italic: bool) -> list[int]:
    """Levels (1 a, 2 1, 3 i, 4 A, 5 italic 1, 6 italic i) whose shape the token has."""
    if italic:
        return [5] if token.isdigit() else [6] if is_roman(token) else []
    if token.isdigit():
        return [2]
    if token.isupper():
        return [4]
    return [1, 3] if is_roman(token) else [1]


def follows(previous: str, token: str, level: int) -> bool:
    """Whether ``token`` comes next after ``previous`` at a level."""
    if level in (2, 5):
        return previous.isdigit() and token.isdigit() and int(token) == int(previous) + 1
    if level in (3, 6):
        return is_roman(previous) and is_roman(token) and roman_to_int(token) == roman_to_int(previous) + 1
    if len(previous) == len(token) == 1:
        return ord(token) == ord(previous) + 1
    return previous in "zZ" and token == previous.replace("z", "aa").replace("Z", "AA") or (len(token) == 2 == len(previous) and token[0] == token[1] and ord(token[0]) == ord(previous[0]) + 1)


FIRST = {1: "a", 2: "1", 3: "i", 4: "A", 5: "1", 6: "i"}


def assign_level(token: str, italic: bool, stack: list[tuple[int, str]]) -> int | None:
    """Continue an open level (the deepest that fits), else open the next one, else the deepest shape that the stack allows."""
    shapes = marker_levels(token, italic)
    depth = stack[-1][0] if stack else 0
    for level, previous in reversed(stack):
        if level in shapes and follows(previous, token, level):
            return level
    for level in shapes:
        if level == depth + 1 and token == FIRST[level]:
            return level
    allowed = [x for x in shapes if x <= depth + 1]
    return max(allowed) if allowed else min(shapes, default=None)


def regulation_records(data: bytes) -> Iterator[Record]:
    root = ET.fromstring(data)
    for div in root.iter("DIV8"):
        if div.get("TYPE") == "SECTION":
            yield from _regulation(div)


def _regulation(div: ET.Element) -> list[Record]:
    section = re.sub(r"^§\s*", "", div.get("N", "")).strip().translate(DASHES)
    top = canonical_id("reg", section)
    heading = re.sub(r"^§+\s*\S+\s*", "", _flat("".join(div.find("HEAD").itertext()))) if div.find("HEAD") is not None else None
    reserved = bool(heading and "[reserved]" in heading.lower())
    rows = {top: record("provision", id=top, source="reg", section=section, path=[], level="section", num=section, heading=heading, text="", parent_id=None, ordinal=0, status="reserved" if reserved else "active")}
    count: dict[str, int] = {}
    stack: list[tuple[int, str]] = []
    node = top
    for p in div.iter("P"):
        flat = _flat((p.text or "") + "".join(f"<i>{''.join(c.itertext())}</i>{c.tail or ''}" if c.tag == "I" else "".join(c.itertext()) + (c.tail or "") for c in p))
        run_in = None
        while m := _MARK.match(flat):
            token, italic = m[2], bool(m[1])
            level = assign_level(token, italic, stack)
            if level is None:
                break
            flat = flat[m.end() :]
            stack = [x for x in stack if x[0] < level] + [(level, token)]
            path = [t for _, t in stack]
            parent, node = canonical_id("reg", section, path[:-1]), canonical_id("reg", section, path)
            if parent not in rows:
                parent = top
            if node not in rows:
                count[parent] = count.get(parent, -1) + 1
                rows[node] = record("provision", id=node, source="reg", section=section, path=path, level=REG_LEVELS[min(len(path), len(REG_LEVELS) - 1)], num=token, text="", parent_id=parent, ordinal=count[parent], status="active")
            run = re.match(r"\s*<i>([^<]+?)\.?</i>\s*[.—–-]*\s*", flat)
            if run:
                run_in, flat = run[1], flat[run.end() :]
                rows[node]["heading"] = rows[node]["heading"] or run_in
        body = _flat(re.sub(r"</?i>", "", flat))
        rows[node]["text"] = f"{rows[node]['text']} {body}".strip()
    for r in reversed(list(rows.values())):
        parts = [r["text"]] + [f"({c['num']}) " + " ".join(x for x in (c["heading"], c["full_text"]) if x) for c in rows.values() if c["parent_id"] == r["id"]]
        r["full_text"] = _flat(" ".join(parts))
    out = list(rows.values())
    credit = " ".join(_flat("".join(c.itertext())) for c in div.iter("CITA"))
    if credit:
        found = dates_in(credit)
        out.append(record("note", id=top, ordinal=0, topic="sourceCredit", text=credit, dates=sorted(found), applies_after=min(found, default=None)))
    return out


class _Outline(HTMLParser):
    """Articles (title, text) and tables (caption before them, rows) of a page, tolerant of unclosed tags."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "col"}

    def __init__(self) -> None:
        super().__init__()
        self.articles: list[dict[str, str]] = []
        self.tables: list[dict[str, Any]] = []
        self.open: list[tuple[str, str]] = []
        self.caption = self.buffer = ""
        self.row: list[str] | None = None
        self.depth: int | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = (dict(attrs).get("class") or "").split()
        if "article" in classes:
            self.articles.append({"title": "", "text": ""})
            self.depth = len(self.open)
        if tag == "table":
            self.tables.append({"caption": _flat(self.caption), "rows": []})
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag == "p" and "title" in classes:
            self.caption = ""
        if tag not in self.VOID:
            self.open.append((tag, "title" if any(c.startswith("title") for c in classes) else ""))

    def handle_endtag(self, tag: str) -> None:
        if tag == "tr" and self.row is not None and self.tables:
            self.tables[-1]["rows"].append([_flat(c) for c in self.row])
            self.row = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if self.depth is not None and len(self.open) <= self.depth:
            self.depth = None

    def handle_data(self, data: str) -> None:
        if any(t in ("script", "style") for t, _ in self.open):
            return
        if self.row:
            self.row[-1] += data
        if any(t == "p" and k for t, k in self.open):
            self.caption += data
        if self.depth is not None and self.articles:
            title = any(t == "h2" and k for t, k in self.open)
            self.articles[-1]["title" if title else "text"] += data + ("" if title else " ")


def _outline(data: bytes) -> _Outline:
    page = _Outline()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    return page


ACTS = ("supersed", "obsolet", "revok", "modif", "amplif", "clarif", "supplement", "distinguish")
VERBS = dict(zip(ACTS, ("supersedes", "obsoletes", "revokes", "modifies", "amplifies", "clarifies", "supplements", "distinguishes"), strict=True))


def guidance_slug(kind: str, number: str) -> str:
    slug = lambda x: re.sub("[^0-9a-z]+", "-", x.lower()).strip("-")
    return f"{slug(kind)}-{slug(number)}"


def relations(text: str) -> list[tuple[str, str]]:
    """(guidance id, verb): guidance named within 70 characters of a verb stem, once each."""
    out = {}
    for m in re.finditer("|".join(ACTS), text, re.I):
        for g in guidance(text[max(m.start() - 70, 0) : m.end() + 70]):
            if g.fields["guidance_type"] in NUMBERED.values():
                out[guidance_slug(g.fields["guidance_type"], g.fields["guidance_number"]), VERBS[m[0].lower()]] = None
    return list(out)


def bulletin_records(data: bytes) -> Iterator[Record]:
    """Guidance documents of a bulletin, first of each id, and what they act on."""
    seen: set[str] = set()
    for a in _outline(data).articles:
        named = next(guidance(_flat(a["title"])), None)
        text = _flat(a["text"])
        if not named or named.fields["guidance_type"] not in NUMBERED.values() or not text:
            continue
        kind, number = named.fields["guidance_type"], named.fields["guidance_number"]
        key = guidance_slug(kind, number)
        if key in seen:
            continue
        seen.add(key)
        yield record("guidance", id=key, source="irs_guidance", num=number, topic=kind, heading=_flat(a["title"]), text=text)
        for target, verb in relations(text):
            if target != key:
                yield record("relation", id=key, to_id=target, topic=verb)


def rate_rows(data: bytes) -> list[tuple[date, float | None, float | None]]:
    """(month, long-term tax-exempt rate, adjusted federal long-term rate) of tables whose caption names a ruling, a table and a month."""
    out: dict[date, tuple[date, float | None, float | None]] = {}
    for t in _outline(data).tables:
        m = re.search(r"(?:Rev\.?\s*Rul\.?|Revenue Ruling)\s*[\d–-]+.*?\b([A-Z][a-z]{2,8})\s+(\d{4})", t["caption"])
        month = text_date(m[1], "1", m[2]) if m else None
        if not month or month in out:
            continue
        found: list[float | None] = [None, None]
        for row in t["rows"]:
            percent = re.search(r"(\d+(?:\.\d+)?)\s*%?$", row[-1]) if row else None
            if percent and re.search(r"long-term tax-exempt rate", row[0], re.I):
                found[0] = float(percent[1])
            elif percent and re.search(r"adjusted federal long-term rate", row[0], re.I):
                found[1] = float(percent[1])
        if any(x is not None for x in found):
            out[month] = (month, *found)
    return list(out.values())


PARSERS: dict[str, Callable[[bytes], Iterator[Record]]] = {"statute": statute_records, "regulation": regulation_records, "bulletin": bulletin_records}


def parse(parser: str, data: bytes) -> list[Record]:
    try:
        return list(PARSERS[parser](data))
    except ET.ParseError as e:
        return [record("corrupt", text=str(e))]


def read(spark: SparkSession, path: str, parser: str) -> DataFrame:
    """Records of every file under ``path``; filter by ``kind``."""
    ship(spark)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(SCHEMA)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([r | {"path_in": name} for r in parse(parser, data)], arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, SCHEMA)
