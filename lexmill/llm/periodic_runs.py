"""Periodic runs of words by the harmonic grid.

A run of period p and two periods or more holds two consecutive multiples of p, jp and (j + 1)p. So for each period p the pairs of
neighbouring multiples are asked how far the words from them on agree (forward LCE) and how far the words before them agree (backward
LCE); a pair whose two answers add up to p or more gives a maximal repetition. All periods together make n ln n pairs.

An LCE is the least entry between two ranks of the LCP array: the words of a batch of texts are sorted once as suffixes (prefix doubling on
rank pairs), once reversed, each with its LCP array and a table of minima over powers of two (RMQ). Pairs whose own words
differ can't lie in a run and aren't asked. Everything is a NumPy expression over a batch of texts; a separator between two texts that
occurs once ends every match.

A run of 12 words or more of any period repeats six words of its text in a row (11 of period 1, 6 of period 6, p of a period p above), so texts
without a repeated six-word window have none and need no sorting. Words are told apart by 64-bit hashes. Each text is worked on where it
is read: nothing is shuffled. A text of n words takes about
8 n log2 n bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import _SPACE, U, chunks, mix, word_hashes
from lexmill.session import ship

#: Words that a run has at least, whatever its period.
LEAST = 12
#: Grid pairs that are looked at together.
PAIRS = 1 << 20
#: Words that are sorted together; a longer text is taken alone.
GROUP = 1 << 16

_RESULT = "doc_id {}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUNS = ", runs array<struct<start:int,length:int,period:int>>, collapsed string"


class Suffixes:
    """Sorted suffixes of a word sequence with the longest common extension of any two."""

    def __init__(self, x: np.ndarray) -> None:
        n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        levels = [rank.astype(np.int32)]  # of windows of 1, 2, 4 ... words
        reach = 1
        while rank.max() < n - 1:
            later = np.zeros(n, np.int64)
            later[: n - reach] = rank[reach:] + 1
            rank = np.unique((rank << 32) | later, return_inverse=True)[1].astype(np.int64)
            levels.append(rank.astype(np.int32))
            reach *= 2
        self.rank = rank
        at = np.empty(n, np.int64)
        at[rank] = np.arange(n)
        # neighbours in order: as many words as the widest equal windows, then the next
        i, j = at[:-1].copy(), at[1:].copy()
        lcp = np.zeros(n, np.int32)
        for k in range(len(levels) - 2, -1, -1):
            same = np.flatnonzero((i < n) & (j < n))
            same = same[levels[k][i[same]] == levels[k][j[same]]]
            lcp[same + 1] += 1 << k
            i[same] += 1 << k
            j[same] += 1 << k
        del levels
        self.table = [lcp]
        width = 1
        while 2 * width <= n:
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on agree, for unequal places."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            of = level == k
            t = self.table[k]
            out[of] = np.minimum(t[lo[of]], t[hi[of] - (1 << int(k))])
        return out


def _grid(counts: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of jp, period) for all neighbouring multiples of all periods up to half of each text, in pieces of about PAIRS."""
    half = counts // 2
    text = np.repeat(np.arange(len(counts)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    pairs = (counts[text] - 1) // period  # jp and (j + 1)p both inside
    ends = np.cumsum(pairs)
    s = 0
    while s < len(pairs):
        done = ends[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        n = pairs[s:e]
        p = np.repeat(period[s:e], n)
        j = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[text[s:e]], n) + j * p, p
        s = e


def runs_of(x: np.ndarray, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of the runs of texts that stand one after the other in ``x``, ordered by start, then period."""
    none = np.zeros(0, np.int64)
    if not len(x):
        return none, none, none
    # a separator of its own behind every text
    words = np.unique(x, return_inverse=True)[1].astype(np.int64)
    first = np.cumsum(counts) - counts
    starts = first + np.arange(len(counts))
    whole = np.empty(len(x) + len(counts), np.int64)
    place = np.arange(len(x)) + np.repeat(np.arange(len(counts)), counts)
    whole[place] = words
    whole[starts + counts] = len(x) + np.arange(len(counts))
    n = len(whole)
    found = [(i, p) for at, p in _grid(counts, starts) for same in [whole[at] == whole[at + p]] for i, p in [(at[same], p[same])] if len(i)]
    if not found:
        return none, none, none
    forward = Suffixes(whole)
    ahead = [forward.common(i, i + p) for i, p in found]
    del forward
    backward = Suffixes(whole[::-1])
    starts_, lengths_, periods_ = [], [], []
    edge = np.repeat(starts, counts + 1)
    for (i, p), after in zip(found, ahead, strict=True):
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > edge[i])  # word jp - 1 is of the same text
        before[inner] = backward.common(n - i[inner], n - i[inner] - p[inner])
        ok = (before + after >= p) & (before + after + p >= least)
        starts_.append((i - before)[ok]), lengths_.append((before + after + p)[ok]), periods_.append(p[ok])
    s, m, p = (np.concatenate(v) for v in (starts_, lengths_, periods_))
    order = np.lexsort((p, m, s))
    s, m, p = s[order], m[order], p[order]
    fresh = np.ones(len(s), bool)  # of one stretch, its smallest period: the others are multiples of it
    fresh[1:] = (s[1:] != s[:-1]) | (m[1:] != m[:-1])
    s, m, p = s[fresh], m[fresh], p[fresh]
    s = s - np.repeat(np.arange(len(counts)), counts + 1)[s]  # without separators
    order = np.lexsort((p, s))
    return s[order], m[order], p[order]


def repeats_six(h: np.ndarray, counts: np.ndarray, n: int = 6) -> np.ndarray:
    """Which texts hold some ``n`` words in a row twice or more."""
    before = np.cumsum(counts) - counts
    windows = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + before[text]
    g = np.zeros(len(at), U)
    for k in range(n):
        g = (g ^ h[at + k]) * U(0x9FB21C651E98DF25) + U(k + 1)
        g ^= g >> U(29)
    g = np.sort((mix(g ^ mix(text.astype(U) + U(1))) & ~U(0xFFFFF)) | (text.astype(U) & U(0xFFFFF)))
    out = np.zeros(len(counts), bool)
    out[(g[1:][g[1:] == g[:-1]] & U(0xFFFFF)).astype(np.int64)] = True
    return out


def _collapse(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one space between the words of a text, number of each byte's word, number of words before each row and in all)."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    number = np.cumsum(first) - 1
    return inside, number, np.searchsorted(np.flatnonzero(first), offsets)


def _scan(with_runs: bool):  # noqa: ANN202
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    run = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())])

    def piece(raw: np.ndarray, offsets: np.ndarray, out: dict[str, list]) -> None:
        h, before = word_hashes(raw, offsets, lower=False)
        counts = np.diff(before)
        inside, number, _ = _collapse(raw, offsets)
        some = np.flatnonzero(repeats_six(h, counts))
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        dropped = np.zeros(len(h) + 1, np.int32)
        k = 0
        while k < len(some):  # texts of about GROUP words together
            e = max(k + 1, k + int(np.searchsorted(np.cumsum(counts[some[k:]]), GROUP, side="right")))
            rows = some[k:e]
            place = np.concatenate([np.arange(before[r], before[r + 1]) for r in rows])
            s, m, p = runs_of(h[place], counts[rows])
            ends = np.cumsum(counts[rows])
            of = np.searchsorted(ends, s, side="right")
            np.add.at(dropped, place[s + p], 1)
            np.add.at(dropped, place[s + m - 1] + 1, -1)
            s = s - (ends - counts[rows])[of]
            cut = np.searchsorted(of, np.arange(len(rows) + 1))
            found |= {int(r): (s[a:b], m[a:b], p[a:b]) for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True) if b > a}
            k = e
        keep = np.cumsum(dropped[:-1]) == 0
        # the bytes of the kept words, each followed by one space
        use = inside.copy()
        use[inside] = keep[number[inside]]
        last = np.zeros(len(raw), bool)
        last[:-1] = use[:-1] & (~inside[1:] | (number[1:] != number[:-1]))
        if len(raw):
            last[-1] = use[-1]
        width = use.astype(np.int8) + last
        body = np.full(int(width.sum()), 0x20, np.uint8)
        at = np.cumsum(width, dtype=np.int64) - width
        body[at[use]] = raw[use]
        size = np.r_[at, len(body)] if len(raw) else np.zeros(1, np.int64)
        view = memoryview(body)
        for r in range(len(counts)):
            s, e = size[offsets[r]], size[offsets[r + 1]]
            text = view[s : max(s, e - 1)]  # without the last space
            out["collapsed_sha256"].append(hashlib.sha256(text).hexdigest())
            if with_runs:
                out["collapsed"].append(bytes(text).decode())
            out["n_words"].append(int(counts[r]))
            if r in found:
                a, m, p = found[r]
                best = np.lexsort((p, a, -m))[0]
                out["start"].append(int(a[best])), out["length"].append(int(m[best])), out["period"].append(int(p[best]))
                out["exponent_milli"].append(1000 * int(m[best]) // int(p[best]))
                lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(a.tolist(), m.tolist(), p.tolist(), strict=True))
            else:
                a = m = p = np.zeros(0, np.int64)
                for c in ("start", "length", "period", "exponent_milli"):
                    out[c].append(None)
                lines = ""
            out["n_runs"].append(len(a))
            out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
            if with_runs:
                out["runs"].append([{"start": x, "length": y, "period": z} for x, y, z in zip(a.tolist(), m.tolist(), p.tolist(), strict=True)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in names[1:] + (["runs", "collapsed"] if with_runs else [])}
            for _, _, raw, offsets in chunks(b.column("body")):
                piece(raw, offsets, out)
            columns = [b.column("doc_id"), *[pa.array(out[c], pa.string() if c.endswith("sha256") else pa.int64()) for c in names[1:]]]
            if with_runs:
                columns += [pa.array(out["runs"], pa.list_(run)), pa.array(out["collapsed"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names + (["runs", "collapsed"] if with_runs else []))

    return scan


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_runs, the longest run's start, length, period and exponent_milli, and digests.

    A run is a maximal stretch of words with a smallest period q and a length of max(12, 2 q) words or more. Of several longest runs the first
    counts, then the shortest period; without a run the four are null. ``runs_sha256`` is of every run's "start,length,period"
    line, ``collapsed_sha256`` of the words joined by single spaces, without those that a run holds past its first period. ``with_runs`` adds
    the runs themselves and the collapsed text. A null text has no words, and both digests are of nothing. Ids of any type, null and
    repeated ones too, go with their rows. An empty table gives no rows; extra columns are ignored.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_scan(with_runs), _RESULT.format(kind) + (_RUNS if with_runs else ""))
