"""Plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None, lower: bool = True) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text, False)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def shingle_set(text: str | None, n: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, int]:
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def contamination(text: str | None, items: list[tuple[object, str | None]]) -> tuple[int, int, int, str]:
    get = lambda t: ALNUM.findall((t or "").translate(LOWER))
    d, hit, found = get(text), set(), set()
    for item, t in items:
        w = get(t)
        wins = [w[i : i + 10] for i in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []
        for win in wins:
            for i in range(len(d) - len(win) + 1):
                if d[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def repeated(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - length + 1):
                w = t[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1) if i is not None else ():
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def unigram_scores(rows: list[tuple[int | None, str | None, bool]]) -> list[tuple]:
    count = Counter()
    for _, t, train in rows:
        if train:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    return [
        (i, len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x)) for i, t, _ in rows for x in [[*words(t), None]]
    ]


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    t, out = text or "", []
    assign = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", *m.span()) for m in re.finditer(assign, t) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def perspectives(rows: list[tuple]) -> set[tuple]:
    """(conv, perspective, pos, segment, start, train)."""
    out, by = set(), defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "unknown", text or ""))
    for c, turns in by.items():
        for me in {r for _, _, r, _ in turns} - {"system"}:
            at = 0
            for pos, (_, _, role, text) in enumerate(sorted(turns)):
                head = "<|system|>" if role == "system" else "<|assistant|>" if role == me else f"<|user name={role}|>"
                segment = f"{head}\n{text}<|end|>\n"
                out.add((c, me, pos, segment, at, role == me))
                at += len(segment)
    return out
