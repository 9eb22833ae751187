"""Best-fit packing by a configuration linear program.

1. One Arrow-batched scan tokenizes every whole text, ends it with ``end_id`` and cuts what is longer than the capacity into
   full pieces (the first takes the remainder). Only the pieces' sizes and checksums are written.
2. The length histogram - at most ``capacity`` counts, whatever the corpus' size - defines the configuration program: cover
   every length's count with as few sequences as possible, each a multiset of lengths that fits. It is solved by
   multiplicative weights: a knapsack dynamic program prices configurations under the weights (and so gives a bound from below),
   configurations that fill a sequence are used in whole steps, and lengths that stay uncovered gain weight for the next
   round. What the best round leaves is packed by best fit on counts; the plan never has more sequences than best fit alone.
3. Every piece gets a rank among the pieces of its length: position inside its scan partition plus the partition's
   offset, so a length that a third of all pieces share is ranked by many tasks. Ranks map to sequences and
   offsets by the plan's ranges (some thousand rows, bounded by the histogram and the passes, not by the corpus).
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.scratch import materialize
from lexmill.session import ship

#: The public vocabulary's pre-tokens, for texts of the characters below, where \w has no mark or
#: number but 0-9, and Python and the vocabulary's own library agree on white space.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7EÀ-ÖØ-öø-ÿ]")
SPECIAL = "<|endoftext|>"
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 200_000


class Encoder:
    """Ids as little-endian 32-bit bytes. Equal to the ``tokenizers`` file's ids, by way of the same vocabulary's ranks where that is faster."""

    def __init__(self, json_path: str, ranks_path: str | None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        self.ranks = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def exact(self, text: str) -> bytes:
        if self.ranks is None or SPECIAL in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text or self.ranks is None or NOT_PLAIN.search(text):
            return self.exact(text)
        known, parts = self.known, PRETOKEN.findall(text)
        if len(known) > REMEMBERED:
            known.clear()
        for new in {p for p in parts if p not in known}:
            known[new] = np.array(self.ranks.encode_ordinary(new), "<u4").tobytes()
        return b"".join(map(known.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    return Encoder(json_path, ranks_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: the remainder first, then full pieces."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(json_path: str, ranks_path: str | None, capacity: int, end_id: int):  # noqa: ANN202
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = int(end_id).to_bytes(4, "little")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column("body")):
                ids = memoryview(encode(t.as_py() or "") + end)
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(i), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names,
            )

    return scan


def tokenize_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, *, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_pieces(json_path, ranks_path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _price(capacity: int, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unbounded knapsack: the best value at every capacity. ``lengths`` ascend."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + values[:k]).max()) if k else best[c - 1]
    return best


def _fill(best: np.ndarray, values: np.ndarray, room: int, left: np.ndarray, config: dict[int, int]) -> int:
    """Add to ``config`` the program's choices for ``room`` among lengths of which some are left; the room that stays.

    Every choice is the program's own step, (value + best value of the rest) at its highest, the longest of equal ones.
    """
    have = left[: room + 1] >= 1
    for n, a in config.items():
        if n <= room:
            have[n] = left[n] - a >= 1
    while room > 0:
        lengths = np.flatnonzero(have[1 : room + 1]) + 1
        if not len(lengths):
            break
        v = values[lengths] + best[room - lengths]
        n = int(lengths[len(v) - 1 - int((v[::-1] >= v.max() - 1e-9).argmax())])
        config[n] = config.get(n, 0) + 1
        have[n] = left[n] - config[n] >= 1
        room -= n
    return room


def _best_fit(left: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Best-fit decreasing on counts: bins that hold the same multiset move together."""
    bins: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]  # by the room that is left
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        for room in range(n, capacity):
            while todo and bins[room]:
                config, times = bins[room].pop()
                moved = min(times, todo)
                if moved < times:
                    bins[room].append((config, times - moved))
                bins[room - n].append((config | {n: config.get(n, 0) + 1}, moved))
                todo -= moved
            if not todo:
                break
        a = capacity // n
        if todo // a:
            bins[capacity - a * n].append(({n: a}, todo // a))
        if todo % a:
            bins[capacity - todo % a * n].append(({n: todo % a}, 1))
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for held in bins:
        for config, times in held:
            key = tuple(sorted(config.items()))
            out[key] = out.get(key, 0) + times
    return out


@dataclass(frozen=True)
class Plan:
    """Configurations with their number of sequences; a proven least number of sequences, and how many the program gave before rounding's rest."""

    configs: list[tuple[dict[int, int], int]]
    bound: int
    priced: int

    @property
    def sequences(self) -> int:
        return sum(k for _, k in self.configs)


def solve(counts: dict[int, int], capacity: int, *, rounds: int = 8, rate: float = 0.01) -> Plan:
    """Configurations that hold every length as often as it counts.

    The covering program asks for as few uses of configurations as cover all counts. Its prices are weights, first the lengths
    themselves. Each round one dynamic program gives the best value of any configuration: prices divided by it solve the
    dual, so their total bounds the number of sequences from below. Configurations are read off the same program, from the
    longest length down, and used in whole steps, as often as their lengths are left (the rounding); those that waste room are left
    out, and what they would cover is packed by best fit on counts. Then the weights of lengths that the round left uncovered
    grow by a factor, and the next round prices again. The round with the fewest sequences counts; a round that meets the bound
    is the last.
    """
    whole = np.zeros(capacity + 1)
    for n, k in counts.items():
        whole[n] = k
    full, whole[capacity] = int(whole[capacity]), 0
    every = np.flatnonzero(whole)
    size, weight = np.arange(capacity + 1) / capacity, np.ones(capacity + 1)
    bound, found = 0, None
    for _ in range(rounds):
        values, left = size * weight, whole.copy()
        best = _price(capacity, every, values[every])
        if len(every):
            bound = max(bound, int(np.ceil((whole * values).sum() / best[capacity] - 1e-6)))
        used: dict[tuple[tuple[int, int], ...], int] = {}
        for n in every[::-1]:
            while left[n] >= 1:
                config = {int(n): 1}
                if _fill(best, values, capacity - int(n), left, config):
                    break
                step = int(min(left[k] // a for k, a in config.items()))
                for k, a in config.items():
                    left[k] -= a * step
                key = tuple(sorted(config.items()))
                used[key] = used.get(key, 0) + step
        priced = sum(used.values())
        for c, x in _best_fit(left.astype(np.int64), capacity).items():
            used[c] = used.get(c, 0) + x
        if found is None or sum(used.values()) < sum(found[0].values()):
            found = used, priced
        if sum(found[0].values()) <= bound:
            break
        weight[every] *= np.exp(rate * left[every] / whole[every])
    configs, priced = found or ({}, 0)
    out = [(dict(c), x) for c, x in configs.items()] + ([({capacity: 1}, full)] if full else [])
    return Plan(out, bound + full, priced)


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """``solve``'s plan, or that of best fit alone if it has fewer sequences."""
    found = solve(counts, capacity)
    whole = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        whole[n] = k
    plain = [(dict(c), x) for c, x in _best_fit(whole, capacity).items()]
    return found if found.sequences <= sum(x for _, x in plain) else Plan(plain, found.bound, 0)


def _ranges(configs: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in a sequence, offset), by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in configs:
        offset = 0
        for n, a in config.items():
            rows.append((n, used.get(n, 0), sequence, a, offset))
            used[n] = used.get(n, 0) + a * times
            offset += n * a
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    *,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end token alone. Rows with equal or null ids are packed apart; an empty table gives no rows;
    extra columns are ignored. Offsets are gapless from 0 in every sequence.
    """
    pieces = tokenize_pieces(docs, json_path, ranks_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    pieces = materialize(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    ranges = _ranges(plan(counts, capacity).configs)
    held = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("at", F.row_number().over(inside) - 1)
    ranked = ranked.join(held, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ranges[:, 0] * (1 << 50) + ranges[:, 1]
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = ranges[np.searchsorted(key, n * (1 << 50) + rank, side="right") - 1]
            k = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(r[:, 2] + k // r[:, 3]), pa.array(r[:, 4] + k % r[:, 3] * n)], [*b.schema.names[:5], "sequence_id", "offset"]
            )

    kind = dict(pieces.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
