"""Quotations: extraction, association with citations, and scoring against sources. Pure functions on one text."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from lexmill.functions.textnorm import normalize

# Thresholds and word lists.
MIN_WORDS, EXACT, CLOSE, ELSEWHERE = 4, 0.97, 0.88, 0.95
ABBREVIATIONS = set(
    "mr mrs ms dr prof sr jr st vs v no nos inc corp co ltd sec secs reg regs treas rev rul proc ann cir ct fed supp cl stat pub art para cf etc al ch pt vol dept"
    " u.s u.s.c i.r.c c.f.r t.c t.d i.e e.g id op cit ed eds jan feb mar apr jun jul aug sept sep oct nov dec approx".split()
)
EDITORIAL = re.compile(r"\s*[(\[](?:emphasis|citations?|footnotes?|internal quotation marks|alterations?)\s+(?:added|omitted|in original|supplied)[^)\]]*[)\]]\s*$", re.I)
SIGNALS = re.compile(r"\b(?:see|also|e\.g\.|cf\.|accord|but|compare|id\.|generally|and|under|per|quoting|citing)\b|[\s,.;:()]+", re.I)


@dataclass(frozen=True)
class Quote:
    start: int
    end: int
    text: str
    kind: str


def strip_editorial(text: str) -> str:
    return EDITORIAL.sub("", text)


def extract_quotes(text: str | None) -> list[Quote]:
    """Block quotes, then curly, then straight ones that lie in no earlier one; code is skipped, fewer than four words are dropped."""
    if not text:
        return []
    masked = re.sub(r"```.*?```|~~~.*?~~~|`[^`\n]*`", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    found: list[Quote] = []

    def add(start: int, end: int, body: str, kind: str) -> None:
        body = strip_editorial(body).strip()
        if len(body.split()) >= MIN_WORDS and not any(q.start < end and start < q.end for q in found):
            found.append(Quote(start, end, body, kind))

    for m in re.finditer(r"(?:^[ \t]*>[^\n]*(?:\n|\Z))+", masked, re.M):
        add(m.start(), m.end(), " ".join(re.sub(r"^[ \t]*>[ \t]?", "", line) for line in text[m.start() : m.end()].splitlines()), "blockquote")
    for m in re.finditer(r"“([^“”]+)”", masked):
        if "\n\n" not in m[1]:
            add(*m.span(), text[m.start(1) : m.end(1)], "curly")
    for m in re.finditer(r'"([^"]{8,}?)"', masked):
        if "\n\n" not in m[1]:
            add(*m.span(), text[m.start(1) : m.end(1)], "straight")
    return sorted(found, key=lambda q: q.start)


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines and sentence ends; abbreviations, initials, bare numbers and a lower-case next word end none."""
    out, start = [], 0
    for m in re.finditer(r"\n\s*\n|[.!?]+[\"”’)\]]*(?=\s)", text):
        if not m[0].startswith("\n"):
            word = re.search(r"([\w.]*)$", text[start : m.start()])[1].lower()
            after = text[m.end() :].lstrip()[:1]
            if m[0][0] == "." and (word.rstrip(".") in ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or (word.isdigit() and not text[start : m.start() - len(word)].strip())):
                continue
            if after.islower():
                continue
        if text[start : m.end()].strip():
            out.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def associate(quotes: list[Quote], spans: list[tuple[int, int]], text: str) -> dict[int, int | None]:
    """Quote number -> citation number: the nearest before it in its sentence, else the nearest after it there, else of the next
    sentence if that is nothing but citations, else the last one of the sentence before."""
    sentences = split_sentences(text)
    where = lambda at: next((i for i, (s, e) in enumerate(sentences) if s <= at < e), None)
    home = [where(s) for s, _ in spans]
    out: dict[int, int | None] = {}
    for k, q in enumerate(quotes):
        i = where(q.start)
        here = [c for c, h in enumerate(home) if h == i and not (q.start <= spans[c][0] < q.end)]
        before, after = [c for c in here if spans[c][1] <= q.start], [c for c in here if spans[c][0] >= q.end]
        later = [c for c, h in enumerate(home) if i is not None and h == i + 1]
        if later:
            s, e = sentences[i + 1]
            rest = list(text[s:e])
            for c in later:
                rest[spans[c][0] - s : spans[c][1] - s] = " " * (spans[c][1] - spans[c][0])
            if SIGNALS.sub("", "".join(rest)):
                later = []
        earlier = [c for c, h in enumerate(home) if i is not None and h == i - 1]
        pick = before[-1:] or after[:1] or later[:1] or earlier[-1:]
        out[k] = pick[0] if pick else None
    return out


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """``difflib``'s matching blocks without junk, (place in a, place in b, size), with its empty one at the end; the longest stretches are found by ``str.find``.

    Of stretches of one length the first in ``a``, then the first in ``b``, stands, as there.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, size, x, y = alo, 0, alo, blo
        while i + size < ahi:
            j = b.find(a[i : i + size + 1], blo, bhi)
            if j < 0:
                i += 1
                continue
            size, x, y = size + 1, i, j
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
        if not size:
            continue
        found.append((x, y, size))
        if alo < x and blo < y:
            todo.append((alo, x, blo, y))
        if x + size < ahi and y + size < bhi:
            todo.append((x + size, ahi, y + size, bhi))
    out: list[tuple[int, int, int]] = []
    for x, y, size in sorted(found):
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((x, y, size))
    return [*out, (len(a), len(b), 0)]


def partial_ratio(needle: str, hay: str) -> tuple[float, int, int]:
    """(score, start, end): the best window of ``hay`` by share of matching characters, windows placed where blocks match."""
    if not needle or not hay:
        return 0.0, 0, 0
    if needle in hay:
        at = hay.index(needle)
        return 1.0, at, at + len(needle)
    n, best, seen = len(needle), (0.0, 0, 0), set()
    for x, y, _ in matching_blocks(needle, hay):
        s = min(max(y - x, 0), max(len(hay) - n, 0))
        if s in seen:
            continue
        seen.add(s)
        window = hay[s : s + n]
        score = 2.0 * sum(size for _, _, size in matching_blocks(needle, window)) / (n + len(window))
        if score > best[0]:
            best = (score, s, s + len(window))
    return best


def segments(quote: str) -> list[str]:
    """Normalised pieces between ellipses."""
    return [x for x in (normalize(p).strip(" ,;.") for p in re.split(r"(?:\*\s*){3}|\.\s*\.\s*\.(?:\s*\.)?|…", quote)) if x]


def _pattern(segment: str) -> re.Pattern[str]:
    """[t] stands for its letter, [longer text] for one to eight words."""
    out = ""
    for part in re.split(r"(\[[^\]]*\])", segment):
        if part.startswith("["):
            out += re.escape(part[1:-1]) if len(part) <= 3 else r"\S+(?:\s\S+){0,7}"
        else:
            out += re.escape(part)
    return re.compile(out)


def score_quote(quote: str, source: str) -> float:
    """1.0 if all pieces occur in order without overlap, else the length-weighted mean of their best windows, in order.

    A source much shorter than the quote can't hold it and scores 0.
    """
    hay, parts = normalize(source), segments(quote)
    if not parts or len(hay) < EXACT * max(map(len, parts)):
        return 0.0
    at = 0
    for p in parts:
        m = _pattern(p).search(hay, at)
        if not m:
            break
        at = m.end()
    else:
        return 1.0
    at, total = 0, 0.0
    for p in parts:
        score, _, end = partial_ratio(p, hay[at:])
        total += score * len(p)
        at += end if score >= CLOSE else 0
    return total / sum(map(len, parts))


def outcome(cited: float | None, section: float | None, corpus: float | None) -> str:
    """The verdict from the scores against the cited provision, the rest of its section and the corpus."""
    if cited is not None and cited >= EXACT:
        return "quote_exact"
    if cited is not None and cited >= CLOSE:
        return "quote_close"
    if section is not None and section >= ELSEWHERE:
        return "wrong_pinpoint"
    if corpus is not None and corpus >= ELSEWHERE:
        return "misattributed"
    return "quote_not_found"


def word_diff(quote: str, source: str) -> str:
    """Words of the source that the quote drops as ~~struck~~, words that it adds as **bold**."""
    a, b, out = source.split(), quote.split(), []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, False).get_opcodes():
        if op == "equal":
            out += a[i:j]
            continue
        out += [f"~~{' '.join(a[i:j])}~~"] if j > i else []
        out += [f"**{' '.join(b[k:m])}**"] if m > k else []
    return " ".join(out)


def longest_prefix(quote: str, source: str) -> int:
    """How many leading words of the quote occur in a row in the source."""
    words, hay = normalize(quote).split(" "), f" {normalize(source)} "
    lo, hi = 0, len(words)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if f" {' '.join(words[:mid])} " in hay else (lo, mid - 1)
    return lo
