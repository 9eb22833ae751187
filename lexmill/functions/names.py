"""Names of parties: normalisation and fuzzy agreement."""

from __future__ import annotations

import difflib
import re

# Words that carry no name, and the revenue authority's spellings.
NOISE = {"inc", "co", "corp", "ltd", "llc", "the", "of", "and", "et", "al", "v", "vs", "in", "re", "estate"}
AUTHORITY = re.compile(r"\b(?:comm(?:'r|issioner)?(?:\s+of\s+internal\s+revenue)?|c\.?i\.?r\.?)\b", re.I)
AGREE = 0.75


def normalize_name(name: str) -> str:
    words = re.findall(r"[a-z0-9]+", AUTHORITY.sub("commissioner", name).lower())
    return " ".join(w for w in words if w not in NOISE)


def token_set_ratio(a: str, b: str) -> float:
    """The best agreement of the shared words with either side's shared and own words."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    ratio = lambda p, q: difflib.SequenceMatcher(None, p, q, False).ratio()
    return max(ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


def names_match(cited: str | None, reported: str | None) -> tuple[bool, float]:
    """Whether two case names agree; an empty side agrees with all."""
    a, b = normalize_name(cited or ""), normalize_name(reported or "")
    if not a or not b:
        return True, 1.0
    score = token_set_ratio(a, b)
    return score >= AGREE, score
