"""Readers for what stands beside statutes: guidance, court decisions and commentary, and what makes a section another document's.

Each starts from what is rare - a number, a surname, the name of a genre - and reads the words around it against plain lists of names. In names,
white space after a period may be missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# Fixed values, in the order of their source. Guidance: names of a kind, and the abbreviation it goes by.
NUMBERED = {
    "Rev. Rul.": "Rev. Rul.", "Revenue Ruling": "Rev. Rul.", "Rev. Proc.": "Rev. Proc.", "Revenue Procedure": "Rev. Proc.", "Notice": "Notice", "Announcement": "Ann.",
    "Ann.": "Ann.", "PLR": "PLR", "Priv. Ltr. Rul.": "PLR", "TAM": "TAM",
}
MEMORANDA = {"CCA": "CCA", "GCM": "GCM", "FSA": "FSA", "AOD": "AOD", "ILM": "ILM"}
DECISIONS = {"T.D.": "T.D.", "Treasury Decision": "T.D."}
TAXPAYER_SPECIFIC = {"PLR", "TAM", "CCA", "GCM", "FSA", "AOD", "ILM"}
# Reporters; "#" stands for the number of a series.
REPORTERS = (
    "T.C. Memo.", "T.C. Memo", "T.C. Summary Opinion", "T.C. No.", "T.C.M.", "T.C.M. 2d", "T.C.", "B.T.A.", "F. 2d", "F. 3d", "F. 4th", "F. Supp.", "F. Supp. #", "U.S.", "S. Ct.",
    "L. Ed.", "L. Ed. 2d", "Fed. Cl.", "Cl. Ct.", "A.F.T.R.", "A.F.T.R. 2d", "U.S.T.C.",
)
# Words that introduce a case and are no part of its name, and the small words inside names of parties.
SIGNALS = {
    "See", "Compare", "Accord", "Cf", "But", "Contra", "Citing", "Quoting", "Following", "Also", "Versus", "Per", "Under", "Applying", "Distinguishing", "Overruling", "Quoted", "Cited",
}
SMALL = {"of", "the", "and", "for", "de", "van", "von"}
# Journals, authors of treatises with the marks of a place in them, and names of genres.
JOURNALS = ("L. Rev.", "L. J.", "J. Tax'n", "J. Corp. Tax'n", "Tax L. Rev.", "Tax Law.", "Tax Lawyer", "L. Q.", "Rev.")
AUTHORS = ("Mertens", "Bittker & Eustice", "Bittker", "Eustice", "Saltzman", "Rabkin & Johnson", "Rabkin", "Cavitch", "McKee & Nelson", "McKee", "Nelson & Whitmire")
MARKS = ("¶", "§", "ch.", "vol.", "para.")
GENRES = (
    "Tax Management Portfolio", "BNA Portfolio", "Portfolio No.", "practice guide", "practitioner's guide", "practitioners guide", "practitioner guide", "treatise", "law review article",
)
# Documents that have sections of their own, and the words between "of" and their name.
INSTRUMENTS = {
    "Act", "Agreement", "Plan", "Contract", "Lease", "Law", "Rules", "Regulations", "Protocol", "Treaty", "Convention", "Constitution", "Charter", "Bylaws", "Indenture", "Note", "Order", "Statute",
}
POINTERS, JOINING = {"the", "this", "that", "such"}, {"and", "of", "for", "to", "on"}


def _squeezed(name: str) -> str:
    return re.sub(r"[\s.]+", "", name)


_GUIDANCE = {_squeezed(k): (v, k.endswith("Ann."), shape) for shape, names in enumerate((NUMBERED, MEMORANDA, DECISIONS)) for k, v in names.items()}
_SHAPES = (r"\d{4}-\d{1,3}|\d{2}-\d{1,3}|\d{6,12}", r"\d{4}-\d{1,3}|\d{4,12}", r"\d{4,5}")
_NUMBER = re.compile(r"(?<![\d–—-])\d{1,12}(?:[-–—]\d{1,3})?\b")
_NAME_WORDS = max(len(re.findall("[A-Z]", _squeezed(n))) for n in (*NUMBERED, *DECISIONS))
_REPORTERS = {_squeezed(r) for r in REPORTERS}
_WORD = re.compile(r"[A-Za-z0-9]+\.?")
_PAGE = re.compile(r"\s+(\d+)")
_JOURNALS = {_squeezed(j) for j in JOURNALS}
_AUTHOR = re.compile(r"\b(?:" + "|".join(re.escape(a).replace(r"\ \&\ ", r"\s*(?:&|and)\s*") for a in AUTHORS) + r")\b")
_GENRE = re.compile(r"\b(?:" + "|".join(r"\s+".join(map(re.escape, g.split())) for g in GENRES) + ")", re.I)
_PLACE = re.compile(r"(\b|(?=[¶§]))(?:" + "|".join(map(re.escape, MARKS)) + r")\s?\d[\w.-]*", re.A)


class Found(NamedTuple):
    """What a reader found, with the fields that its kind has."""

    start: int
    end: int
    source: str
    display: str
    fields: dict


def _name_before(text: str, end: int) -> tuple[int, str] | None:
    """(start, squeezed name) of the longest name of guidance that ends right before a place."""
    best, at, name = None, end, ""
    for _ in range(_NAME_WORDS):
        stop = len(text[:at].rstrip(" \t\n\r.")) if at else 0
        gap = text[stop:at]
        start = stop
        while start and text[start - 1].isalpha() and text[start - 1].isascii():
            start -= 1
        if start == stop:
            break
        name, at = text[start:stop] + name, start
        known = _GUIDANCE.get(name)
        if known and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and (not known[1] or "." in gap or name != "Ann"):
            best = (start, name)
    return best


def guidance(text: str) -> Iterator[Found]:
    """A number of the shape that the name before it asks for; or a volume and page of the bulletin."""
    for m in _NUMBER.finditer(text):
        plain = re.sub("[–—]", "-", m[0])
        if before := _name_before(text[: m.start()][-40:], min(m.start(), 40)):
            start, name = before[0] + max(m.start() - 40, 0), before[1]
            kind, _, shape = _GUIDANCE[name]
            if re.fullmatch(_SHAPES[shape], plain):
                yield Found(start, m.end(), "other" if kind in TAXPAYER_SPECIFIC else "irs_guidance", f"{kind} {plain}", {"guidance_type": kind, "guidance_number": plain})
                continue
        after = re.match(r"\s+([IRB](?:[.\s]{0,2}[IRB]){2})\.?\s+(\d+)\b", text[m.end() : m.end() + 40])
        if after and _squeezed(after[1]) == "IRB" and re.fullmatch(r"\d{4}-\d{1,2}", m[0]):
            number = f"{m[0]} I.R.B. {after[2]}"
            yield Found(m.start(), m.end() + after.end(), "irs_guidance", number, {"guidance_type": "I.R.B.", "guidance_number": number})


def _reporters(text: str, at: int) -> list[int]:
    """Where the reporters that start at a place end, the longest first."""
    name, end, ends = "", at, []
    for _ in range(8):  # no reporter has more words
        m = _WORD.match(text, end)
        if not m:
            break
        series = name == "FSupp" and re.fullmatch(r"\d[a-z]{0,2}", m[0])
        name, end = name + m[0].rstrip("."), m.end()
        if name in _REPORTERS or series:
            ends.insert(0, end)
        gap = re.match(r"\s+" if not m[0].endswith(".") else r"\s*", text[end:])
        if not gap:
            break
        end += gap.end()
    return ends


def _party_before(text: str, end: int) -> tuple[int, str]:
    """(start, words) of the run of name words that ends at a place; empty if there is none."""
    start = at = end
    while at:
        stop = len(text[:at].rstrip())
        begin = stop
        while begin and not text[begin - 1].isspace() and (text[begin - 1].isalnum() or text[begin - 1] in "_&.'’-"):
            begin -= 1
        word = text[begin:stop]
        if at != end and stop == at or not (word[:1].isupper() or word in SMALL) or (begin and not text[begin - 1].isspace() and text[begin - 1].isalnum()):
            break
        start = at = begin
    return start, text[start:end]


def _case_name(text: str, end: int) -> int | None:
    """Where the name "one v. other" that ends at a place begins."""
    stop = len(text[:end].rstrip())
    if stop == end:
        return None
    stop -= text[:stop].endswith(",")
    if text[:stop][-1:].isspace():
        return None
    begin, other = _party_before(text, stop)
    # the small v stands between the parties
    versus = re.search(r"\sv\.?\s+$", text[:begin])
    if not other or not versus:
        return None
    if other.split()[0] in SMALL:
        return None
    start, one = _party_before(text, versus.start())
    # a name begins with a capital, and not with a signal
    for m in re.finditer(r"\S+", one):
        if m[0][0].isupper() and re.match(r"\w*", m[0])[0] not in SIGNALS:
            return start + m.start()
    return None


def _next(text: str, at: int) -> int:
    """The next place that is no white space."""
    return at + len(text[at:]) - len(text[at:].lstrip())


def cases(text: str) -> Iterator[Found]:
    """Volume, reporter, page; or a memorandum of a year and number. A page after a comma is a pinpoint unless a reporter follows, a year may stand in brackets."""
    done = 0
    for m in re.finditer(r"(?<!\w)\d+(?=\s+[A-Z])|\bT\.\s?C\.\s?Memo\.?(?=\s+\d{4}-\d)", text):
        if m.start() < done:
            continue
        year = None
        if m[0][0].isdigit():
            page = next((p for e in _reporters(text, _next(text, m.end())) if (p := _PAGE.match(text, e))), None)
            if not page:
                continue
            end = page.end()
        else:
            number = re.match(r"\s+(\d{4})-\d+", text[m.end() :])
            end, year = m.end() + number.end(), number[1]
        cite = re.sub(r"\s+", " ", text[m.start() : end])
        pin = None
        more = re.match(r",\s*(\d{1,5})(\s*[-–]\s*\d{1,5})?(?!\d|\.\d)", text[end:])
        if more:
            if not _reporters(text, _next(text, end + more.end())):
                pin, end = int(more[1]), end + more.end()
        bracket = re.match(r"\s*\(([A-Za-z0-9.\s]{1,20}\s)?(\d{4})\)", text[end:])
        if bracket:
            year, end = bracket[2], end + bracket.end()
        start = _case_name(text[done:], m.start() - done)
        start = None if start is None else start + done
        name = re.sub(r"\s+", " ", text[start : m.start()]).strip().rstrip(",") if start is not None else None
        fields = {"case_name": name, "reporter_cite": cite, "pin_page": pin, "case_year": int(year) if year else None}
        done = end
        yield Found(m.start() if start is None else start, end, "case", f"{name}, {cite}" if name else cite, fields)


def commentary(text: str) -> Iterator[Found]:
    """A volume, journal and page; an author and a place in the treatise; the name of a genre."""
    found = lambda s, e: Found(s, e, "secondary", text[s:e], {})
    for m in re.finditer(r"\b\d{1,3}(?=\s+[A-Z])", text):
        words, end = [], m.end()
        while len(words) < 10 and (w := re.match(r"\s+([A-Z][A-Za-z&.']*)", text[end : end + 40])):
            words.append(w[1])
            end += w.end()
            page = re.match(r"\s+\d{1,4}\b", text[end:])
            names = ["".join(words[k:]) for k in range(max(len(words) - 4, 0), len(words))]
            title = next((k for k, n in enumerate(names) if _squeezed(n) in _JOURNALS), None)
            if page and title is not None and max(len(words) - 4, 0) + title <= 4:
                yield found(m.start(), end + page.end())
                break
    for m in _AUTHOR.finditer(text):
        near = re.match(r"[^.;\n]{0,80}", text[m.end() :])
        place = _PLACE.search(text, m.end(), m.end() + near.end() + 40)
        if place and place.start() <= m.end() + near.end():
            yield found(m.start(), place.end())
    for m in _GENRE.finditer(text):
        number = re.match(r"\s?\d+", text[m.end() :]) if m[0].endswith(".") else re.match(r"\b", text[m.end() - 1 :])
        if m[0].endswith(".") and number:
            yield found(m.start(), m.end() + number.end())
        elif not m[0].endswith(".") and not re.match(r"\w", text[m.end() :]):
            yield found(m.start(), m.end())


def of_public_law(before: str) -> bool:
    """Whether a text ends in the number of a public law, which the section that follows is then part of."""
    rest = before.rstrip().removesuffix(",").rstrip()
    rest = rest.rstrip("0123456789")
    rest = (rest[:-1] if rest[-1:] in ("-", "–") else rest).rstrip("0123456789").rstrip().lower()
    rest = rest.removesuffix(".").removesuffix("no").rstrip() if rest.endswith(("no", "no.")) else rest
    return bool(re.search(r"(?:pub\.?\s?l|p\.?l)\.?$", rest))


def of_instrument(after: str) -> bool:
    """Whether a text goes on "of the ... Act" or the like: names in capitals up to the name of a document that has sections of its own."""
    words = re.findall(r"\S+", after)
    if words[:1] != ["of"] or len(words) < 3 or words[1] not in POINTERS:
        return False
    for k, w in enumerate(words[2:]):
        bare = re.match(r"[\w-]*", w)[0]
        if re.match(r"\w*", w)[0] in INSTRUMENTS:
            return True
        if bare != w or not (bare[:1].isupper() or (k and bare in JOINING)):
            return False
    return False
