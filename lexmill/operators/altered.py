"""Where altered quotations may come from: seeds that no match above a share can escape, counted along diagonals.

A stretch of text that agrees with a quotation of n characters by a share s (twice the matching characters over both lengths) differs from it by at
most E = 2 (1 - s) n single insertions and deletions. Of k pieces of the quotation each such edit spoils one at most, so k - E pieces stand in the
text unchanged, and as far apart as in the quotation but for E places. All pieces of all quotations are looked for at once by a trie, in one
pass over the texts; a hit's place less its piece's place in the quotation is its diagonal; only texts with k - E hits of a quotation on neighbouring
diagonals go on. Of those, the stretch around the diagonals is held against the quotation by a bit-parallel longest common subsequence: if more
than E characters of the quotation have no partner there, no window of the stretch agrees enough. What is left are the candidates. There are
no rare words to share and no number of candidates to keep to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.quote import segments
from lexmill.functions.textnorm import normalize
from lexmill.operators.containment import SHORTEST, Trie, byte_chunks
from lexmill.plans.scratch import materialize
from lexmill.session import ship

#: Characters of quotations that are looked for in one pass, and the length that pieces have where edits leave room for it.
BLOCK, PIECE = 1 << 20, 8
#: UTF-8 bytes of a character at most: edits are counted in characters, places in bytes.
WIDE = 4


def seeds(quote: str, share: float) -> list[tuple[int, int, list[tuple[int, bytes]], bytes, int]]:
    """For each way in which a source can match: how many pieces must be met, how far their diagonals may lie apart, the pieces with their
    places, and the stretch itself with the number of its bytes that may have no partner.

    Each stretch between ellipses is one way; one with brackets matches by its longest literal part, too. One with less than three bytes is none.
    """
    out = []
    for s in segments(quote):
        n = len(s)
        edits = int(2 * (1 - share) * n + 1e-9)
        k = max(edits + 1, n // PIECE)
        cuts = [i * n // k for i in range(k + 1)]
        pieces = [(len(s[:a].encode()), s[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out.append((k - edits, WIDE * edits, pieces, s.encode(), edits * (1 if s.isascii() else WIDE)))
        if "[" in s:
            part = max(re.split(r"\[[^\]]*\]", s), key=len)
            out.append((1, 0, [(0, part.encode())], part.encode(), 0))
    # a piece that is too short to be looked for counts as met
    usable = [(need - sum(len(p) < SHORTEST for _, p in w[0]), band, [x for x in w[0] if len(x[1]) >= SHORTEST], *w[1:]) for need, band, *w in out]
    return [(max(need, 1), *w) for need, *w in usable if w[1]]


def common(masks: dict[int, int], n: int, text: bytes) -> int:
    """Length of the longest common subsequence of a text and a pattern of ``n`` bytes, given where each byte stands in the pattern (Hyyrö's form)."""
    full = (1 << n) - 1
    v = full
    for c in text:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Probes:
    """All ways of a block of quotations, with the trie of their pieces."""

    def __init__(self, asks: list[int], quotes: list[str], share: float) -> None:
        ways = [(ask, *w) for ask, q in zip(asks, quotes, strict=True) for w in seeds(q, share)]
        self.ask = np.array([w[0] for w in ways], np.int64)
        self.need, self.band = np.array([w[1] for w in ways], np.int64), np.array([w[2] for w in ways], np.int64)
        self.whole, self.free = [w[4] for w in ways], [w[5] for w in ways]
        self.masks: dict[int, dict[int, int]] = {}
        every = [(p, k, at) for k, w in enumerate(ways) for at, p in w[3]]
        number = {p: i for i, p in enumerate(sorted({p for p, _, _ in every}))}
        self.trie = Trie(list(number), whole=0)
        piece = np.array([number[p] for p, _, _ in every], np.int64)
        order = np.argsort(piece, kind="stable")
        self.way, self.place = (np.array([x[c] for x in every], np.int64)[order] for c in (1, 2))
        self.first = np.searchsorted(piece[order], np.arange(len(number) + 1))

    def candidates(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, ask) pairs that can match, each once."""
        text, piece, at = self.trie.places(raw, offsets)
        uses = self.first[piece + 1] - self.first[piece] if len(piece) else piece
        row = np.repeat(self.first[piece], uses) + np.arange(int(uses.sum())) - np.repeat(np.cumsum(uses) - uses, uses) if len(piece) else piece
        text, at = np.repeat(text, uses), np.repeat(at, uses)
        way = self.way[row]
        diagonal = at - self.place[row] - offsets[text]
        order = np.lexsort((diagonal, way, text))
        text, way, diagonal = text[order], way[order], diagonal[order]
        # hits of a way in a text from each hit's diagonal up to the band's end
        group = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (way[1:] != way[:-1])]) if len(text) else np.zeros(0, np.int64)
        number = np.cumsum(np.isin(np.arange(len(text)), group)) - 1
        span = 1 << 40
        key = number * span + diagonal + (span >> 1)
        hits = np.searchsorted(key, key + self.band[way], side="right") - np.arange(len(key))
        ok = np.flatnonzero(hits >= self.need[way])
        kept, done = [], None
        for i, t, w, d in zip(ok.tolist(), text[ok].tolist(), way[ok].tolist(), diagonal[ok].tolist(), strict=True):
            band = int(self.band[w])
            if done is not None and done[:2] == (t, w) and d <= done[2] + band:
                continue  # the stretch that was looked at holds this one's
            done = (t, w, d)
            lo, hi = int(offsets[t]) + max(d - band, 0), min(int(offsets[t]) + d + len(self.whole[w]) + 3 * band, int(offsets[t + 1]))
            if self._agrees(w, raw[lo:hi].tobytes()):
                kept.append(i)
        ok = np.array(kept, np.int64)
        pair = np.unique((text[ok] << 32) | np.searchsorted(self.asks, self.ask[way[ok]]))
        return pair >> 32, self.asks[pair & 0xFFFFFFFF]

    def _agrees(self, way: int, stretch: bytes) -> bool:
        pattern = self.whole[way]
        if way not in self.masks:
            masks: dict[int, int] = {}
            for k, c in enumerate(pattern):
                masks[c] = masks.get(c, 0) | (1 << k)
            self.masks[way] = masks
        return common(self.masks[way], len(pattern), stretch) >= len(pattern) - self.free[way]

    @property
    def asks(self) -> np.ndarray:
        if not hasattr(self, "_asks"):
            self._asks = np.unique(self.ask)
        return self._asks


def _scan(probes):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = pa.array([normalize(t) for t in b.column("text").to_pylist()], pa.large_string())
            for first, _, raw, offsets in byte_chunks(flat):
                text, ask = probes.value.candidates(raw, offsets)
                if len(text):
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(first + text)), pa.array(ask)], ["id", "ask"])

    return scan


def candidates(quotes: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """(ask, id): for every quotation (``quotes``: ask, quote) the texts (``texts``: id, text) that can hold it by ``share`` or more; none is missed.

    ``ask`` is a whole number. Null quotations and texts, and quotations without a piece of three bytes, have none. Empty tables give no rows.
    """
    spark = texts.sparkSession
    ship(spark)
    kind = dict(texts.dtypes)["id"]
    asked = materialize(quotes.select(F.col("ask").cast("long").alias("ask"), "quote").where("quote is not null"), "quotes")
    blocks = -(-(asked.agg(F.sum(F.length("quote"))).first()[0] or 0) // BLOCK)
    rows = texts.select("id", "text").where("text is not null")
    found = []
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == block).collect()  # about BLOCK characters
        probes = Probes([r["ask"] for r in held], [r["quote"] for r in held], share)
        if len(probes.ask):
            found.append(rows.mapInArrow(_scan(spark.sparkContext.broadcast(probes)), f"id {kind}, ask long"))
    return reduce(DataFrame.unionByName, found).select("ask", "id") if found else rows.select(F.lit(0).cast("long").alias("ask"), "id").limit(0)
