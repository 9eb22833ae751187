"""Normalised text with offsets into its source."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# Characters that vanish, and what others fold to.
INVISIBLE = {"­", "​", "‌", "‍", "﻿", "⁠"}
FOLD = dict.fromkeys("‘’‚‛′`´", "'") | dict.fromkeys("“”„‟″«»", '"') | dict.fromkeys("‐‑‒–—―−", "-") | {"…": "..."}


@dataclass(frozen=True)
class Normalized:
    text: str
    at: tuple[int, ...]  # the source offset of every character

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        """Where a span of the normalised text lies in the source."""
        if start >= end:
            return (self.at[start],) * 2 if start < len(self.at) else (0, 0)
        return self.at[start], self.at[end - 1] + 1


def normalize_mapped(text: str) -> Normalized:
    """Invisible characters dropped, quotes and dashes folded, compatibility forms and case folded, white space collapsed."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if c in INVISIBLE:
            continue
        folded = " " if c.isspace() else unicodedata.normalize("NFKC", FOLD.get(c, c)).casefold()
        for x in folded:
            if x.isspace() and (not out or out[-1] == " "):
                continue
            out.append(" " if x.isspace() else x)
            at.append(i)
    while out and out[-1] == " ":
        out.pop(), at.pop()
    return Normalized("".join(out), tuple(at))


class _Folds(dict):
    """What each character becomes, found once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "" if c in INVISIBLE else " " if c.isspace() else unicodedata.normalize("NFKC", FOLD.get(c, c)).casefold()
        return self[code]


_folds = _Folds()


def normalize(text: str) -> str:
    """``normalize_mapped`` without the offsets."""
    return re.sub(r"\s+", " ", text.translate(_folds)).strip(" ")


def loose(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", normalize(text))).strip()
