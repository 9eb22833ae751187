"""Exact substring dedup by bucket-pointer refinement on sampled suffixes.

A byte goes if it lies in a ``length``-byte string that also starts in a document with a smaller id. Sorting every suffix of
a corpus would shuffle many times its size, so suffixes are sampled first, without losing a match: of the q-grams inside each
``length``-byte window the one with the least hash is its anchor. The choice depends on the window's bytes alone, so equal
windows have the same anchor at the same place, and only the surroundings of anchors that several documents share need sorting.

1. One scan turns texts into blocks (some MB; one row each, written once as a bucketed table, so that the co-groups below
   don't shuffle it).
2. Blocks send their sorted distinct anchor hashes in slices by hash range, and the digests of their texts with least ids; a
   range answers which anchors other blocks share, in the block's order, and the least id of every text. A text that a smaller id
   has as well is covered whole and takes no further part.
3. For shared anchors blocks send distinct surroundings (contexts: every window around the anchor lies in its context) with the
   least id. A context that a smaller id has is covered whole. Where an anchor has several contexts, their suffixes are sorted by
   bucket-pointer refinement: buckets of 8-byte grams are refined by the bucket numbers at later offsets - 8, 16, then the
   rest - each refinement's numbers being used by the next, until a bucket is one ``length``-byte string; its least id decides.
4. Blocks unite the covered ranges.

Hashes only bring candidates together: contexts are compared byte by byte, texts by 128 bits. Equal anchors, contexts and texts
of one block travel once, so a passage in a third of all documents is one entry a block and
context. Groups are hash ranges, not keys.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import batches
from lexmill.llm.batches import U, chunks, deltas, mix, powers, squeeze, undelta, unsqueeze
from lexmill.plans.scratch import materialize, materialize_bucketed
from lexmill.session import ship

Q = 16
BLOCK = 4 << 20
SEGMENT = (2 << 20) - 4096
#: Contexts that are sorted at once.
GROUP = 40_000
NO_ID = np.iinfo(np.int64).max

_BLOCKS = "block binary, ids binary, valid binary, sizes binary, places binary, body binary"
_SLICES = "p int, block binary, keys binary, digests binary, halves binary, least binary"
_CONTEXTS = "p int, block binary, body binary, lo binary, hi binary, least binary"
_BACK = "block binary, kind int, p int, data binary, more binary"


def _blocks(length: int):  # noqa: ANN202
    names = ["block", "ids", "valid", "sizes", "places", "body"]

    def row(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        import zstandard

        ids, valid, sizes, raw = (np.concatenate(x) for x in zip(*held, strict=True))
        places = anchors(raw, np.r_[0, np.cumsum(sizes)], length)
        data = [
            uuid.uuid4().bytes, squeeze(ids), squeeze(valid.astype(np.uint8)), squeeze(sizes.astype(np.uint64)),
            squeeze(np.diff(places, prepend=0).astype(np.uint32)), zstandard.compress(raw.tobytes(), 1),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], names)

    def scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in found:
            ids = b.column("doc_id")
            valid = np.asarray(ids.is_valid())
            ids = ids.fill_null(NO_ID).to_numpy()
            for first, end, raw, offsets in chunks(b.column("body")):
                held.append((ids[first:end], valid[first:end], np.diff(offsets), raw))
                size += len(raw)
                if size >= BLOCK:
                    yield row(held)
                    held, size = [], 0
            held = [(*x[:3], x[3].copy()) for x in held]  # the batch's memory goes
        if held:
            yield row(held)

    return scan


def _places(row: dict) -> np.ndarray:
    return np.cumsum(unsqueeze(row["places"], np.uint32), dtype=np.int64)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, which are not null, offsets, bytes) of a block."""
    import zstandard

    sizes = unsqueeze(row["sizes"], np.uint64).astype(np.int64)
    return unsqueeze(row["ids"], np.int64), unsqueeze(row["valid"], np.uint8).astype(bool), np.r_[0, np.cumsum(sizes)], np.frombuffer(zstandard.decompress(row["body"]), np.uint8)


def _keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48-bit hashes of the q-grams at the places."""
    h = np.zeros(len(at), U)
    for k, r in enumerate(powers(batches._R, Q)):
        h += batches._BYTE[raw[at + k]] * r
    return mix(h) >> U(16)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors of all windows that lie in one document, in order."""
    at = []
    for s in range(0, max(len(raw) - length + 1, 0), SEGMENT):
        part = raw[s : s + SEGMENT + length - 1]
        n, w = len(part), length - Q + 1
        run = np.zeros(n + 1, U)
        np.cumsum(batches._BYTE[part] * powers(batches._R, n), out=run[1:])
        gram = mix((run[Q:] - run[:-Q]) * powers(batches._R_INV, n)[: n - Q + 1])
        least = (gram & ~U(0xFFFFFF)) | np.arange(len(gram), dtype=U)  # by hash, then place
        have = 1
        while 2 * have <= w:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < w:
            least = np.minimum(least[: have - w], least[w - have :])
        edge = offsets[(offsets > s) & (offsets < s + n)] - s  # windows must not hold the start of a document past their own start
        ok = np.ones(len(least), bool)
        for k in np.unique(edge):
            ok[max(k - length + 1, 0) : k] = False
        chosen = np.zeros(len(gram), bool)
        chosen[(least[ok] & U(0xFFFFFF)).astype(np.int64)] = True
        i = np.flatnonzero(chosen)
        at.append(i + s)
    return np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)


#: 128 bits, compared whole: a text goes only if both halves are those of a smaller id's text.
_DIGEST = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _digests(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    view = memoryview(raw)
    return np.frombuffer(b"".join(hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in zip(offsets[:-1], offsets[1:], strict=True)), _DIGEST)


def _unique(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct combination of 64-bit values comes first, in their order; the number of each row's combination)."""
    n = len(columns[0])
    order = np.lexsort(columns[::-1])
    fresh = np.ones(n, bool)
    fresh[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def _bounds(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    width = (1 << bits) // parts + 1
    return np.r_[0, np.searchsorted(keys, np.array([k * width for k in range(1, parts)], U)), len(keys)].astype(np.int64)


def _least(inverse: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NO_ID)
    order = np.argsort(inverse, kind="stable")
    if len(order):
        groups = inverse[order]
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        out[groups[starts]] = np.minimum.reduceat(values[order], starts)
    return out


def _texts(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct digests ascending, least id of each, each text's digest's number)."""
    every = _digests(raw, offsets)
    first, inverse = _unique(every["a"], every["b"])
    return every[first], _least(inverse, ids, len(first)), inverse


def _send_anchors(parts: int, length: int):  # noqa: ANN202
    def scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for row in b.to_pylist():
                ids, _, offsets, raw = _read(row)
                keys = np.unique(_keys(raw, _places(row)))
                digest, least, _ = _texts(ids, raw, offsets)
                k, d = _bounds(keys, parts, 48), _bounds(digest["a"], parts, 64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(parts), pa.int32()), pa.array([row["block"]] * parts, pa.binary()), pa.array([deltas(keys[s:e]) for s, e in zip(k[:-1], k[1:], strict=True)], pa.binary()),
                        pa.array([deltas(digest["a"][s:e]) for s, e in zip(d[:-1], d[1:], strict=True)], pa.binary()), pa.array([squeeze(digest["b"][s:e]) for s, e in zip(d[:-1], d[1:], strict=True)], pa.binary()),
                        pa.array([squeeze(least[s:e]) for s, e in zip(d[:-1], d[1:], strict=True)], pa.binary()),
                    ],
                    ["p", "block", "keys", "digests", "halves", "least"],
                )

    return scan


def _answers(blocks: list[bytes], kind: int, p: int, data: list[bytes], more: list[bytes]) -> pa.Table:
    n = len(blocks)
    return pa.table(
        [pa.array(blocks, pa.binary()), pa.array([kind] * n, pa.int32()), pa.array([p] * n, pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary())],
        names=["block", "kind", "p", "data", "more"],
    )


def _join_anchors(table: pa.Table) -> pa.Table:
    """Kind 0: which of a block's anchors another block has (bits), and the least id of each of its texts."""
    p = table.column("p")[0].as_py()
    keys = [undelta(x) for x in table.column("keys").to_pylist()]
    whole = np.sort(np.concatenate(keys))
    shared = np.unique(whole[1:][whole[1:] == whole[:-1]])
    bits = []
    for k in keys:
        at = np.minimum(np.searchsorted(shared, k), max(len(shared) - 1, 0))
        bits.append(np.packbits(shared[at] == k).tobytes() if len(shared) and len(k) else np.packbits(np.zeros(len(k), bool)).tobytes())
    digest = [undelta(x) for x in table.column("digests").to_pylist()]
    first, inverse = _unique(np.concatenate(digest), np.concatenate([unsqueeze(x, np.uint64) for x in table.column("halves").to_pylist()]))
    least = _least(inverse, np.concatenate([unsqueeze(x, np.int64) for x in table.column("least").to_pylist()]), len(first))
    cut = np.split(least[inverse], np.cumsum([len(d) for d in digest])[:-1])
    return _answers(table.column("block").to_pylist(), 0, p, bits, [squeeze(x) for x in cut])


class _Block:
    """A block with what the first exchange answered: copies of whole texts, and the contexts of shared anchors."""

    def __init__(self, row: dict, back: list[dict], parts: int, length: int) -> None:
        self.ids, self.valid, self.offsets, self.raw = _read(row)
        digest, _, inverse = _texts(self.ids, self.raw, self.offsets)
        back = sorted((x for x in back if x["kind"] == 0), key=lambda x: x["p"])
        least = np.concatenate([unsqueeze(x["more"], np.int64) for x in back])[inverse]
        self.copy = self.valid & (least < self.ids)
        at = _places(row)
        keys = _keys(self.raw, at)
        distinct, number = np.unique(keys, return_inverse=True)
        bounds = np.diff(_bounds(distinct, parts, 48))
        shared = np.concatenate([np.unpackbits(np.frombuffer(x["data"], np.uint8), count=n) for x, n in zip(back, bounds, strict=True)]).astype(bool)
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        use = self.valid[doc] & ~self.copy[doc]
        at, number, doc = at[use], number[use], doc[use]
        # or by several documents of this block
        order = np.lexsort((doc, number))
        a, b = order[:-1], order[1:]
        shared[number[a[(number[a] == number[b]) & (doc[a] != doc[b])]]] = True
        use = shared[number]
        self.at, self.doc = at[use], doc[use]
        side = length - Q
        self.width = width = 2 * side + Q
        start = self.at - side
        lo = np.maximum(self.offsets[self.doc] - start, 0)
        hi = np.minimum(self.offsets[self.doc + 1] - start, width)
        h = self._hash(start, lo, hi)
        _, self.first, self.context = np.unique(h, return_index=True, return_inverse=True)
        self.lo, self.hi = lo, hi
        self.start = start
        same = self.first[self.context]
        if len(h) and not all((self._bytes(np.arange(s, min(s + GROUP, len(h)))) == self._bytes(same[s : s + GROUP])).all() for s in range(0, len(h), GROUP)):
            whole = self._bytes(np.arange(len(h)))  # equal hashes of unequal bytes
            whole = np.ascontiguousarray(np.c_[whole, lo.astype(np.uint8), hi.astype(np.uint8)])
            _, self.first, self.context = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
        anchor = self._gram(self.at[self.first])
        self.part = (anchor % U(parts)).astype(np.int64)
        self.order = np.argsort(self.part, kind="stable")
        self.cuts = np.searchsorted(self.part[self.order], np.arange(parts + 1))
        self.least = _least(self.context, self.ids[self.doc], len(self.first))

    def _run(self) -> np.ndarray:
        if not hasattr(self, "run"):
            self.run = np.zeros(len(self.raw) + 1, U)
            step = 1 << 20
            base = U(1)
            for s in range(0, len(self.raw), step):
                part = self.raw[s : s + step]
                np.cumsum(batches._BYTE[part] * (powers(batches._R, len(part)) * base), out=self.run[s + 1 : s + len(part) + 1])
                self.run[s + 1 : s + len(part) + 1] += self.run[s]
                base = base * powers(batches._R, step + 1)[step] if len(part) == step else base
        return self.run

    def _span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hash of each byte range, equal for equal bytes wherever they lie."""
        inverse = np.ones(len(s), U)
        power, bit = batches._R_INV, s.astype(U)
        for k in range(40):
            if not (bit >> U(k)).any():
                break
            inverse = np.where((bit >> U(k)) & U(1), inverse * power, inverse)
            power = power * power
        run = self._run()
        return mix((run[e] - run[s]) * inverse)

    def _hash(self, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, U)
        with np.errstate(over="ignore"):
            return mix(self._span(start + lo, start + hi) + lo.astype(U) * U(0x9E3779B1) + hi.astype(U) * U(0x85EBCA77C2B2AE63))

    def _gram(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, U)
        with np.errstate(over="ignore"):
            return self._span(at, at + Q)

    def _bytes(self, i: np.ndarray) -> np.ndarray:
        """The context of each place, with zeros outside its document."""
        place = np.arange(self.width)
        at = self.start[i][:, None] + place
        out = self.raw[np.clip(at, 0, len(self.raw) - 1)]
        out[(place < self.lo[i][:, None]) | (place >= self.hi[i][:, None])] = 0
        return out

    def bytes_of(self, contexts: np.ndarray) -> np.ndarray:
        return self._bytes(self.first[contexts])


def _send_contexts(parts: int, length: int):  # noqa: ANN202
    schema = pa.schema([("p", pa.int32()), *[(x, pa.binary()) for x in ("block", "body", "lo", "hi", "least")]])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        if not left.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        b = _Block(row, right.to_pylist(), parts, length)
        out: dict[str, list] = {k: [] for k in schema.names}
        for p in np.flatnonzero(np.diff(b.cuts)):
            c = b.order[b.cuts[p] : b.cuts[p + 1]]
            i = b.first[c]
            body = zstandard.compress(b.bytes_of(c).tobytes(), 1)
            for k, v in zip(schema.names, (int(p), row["block"], body, squeeze(b.lo[i].astype(np.uint8)), squeeze(b.hi[i].astype(np.uint8)), squeeze(b.least[c])), strict=True):
                out[k].append(v)
        return pa.table(out, schema=schema)

    return send


def _refine(ids: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket numbers of pairs of bucket numbers."""
    return np.unique((ids.astype(U) << U(32)) | later.astype(U), return_inverse=True)[1].reshape(ids.shape)


def _covered_windows(body: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For distinct contexts of whole anchor buckets: bit o is set if a smaller id has the window at offset o as well."""
    m, width = body.shape
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, 8, axis=1)).view(np.uint64)[..., 0]
    ids, reach = np.unique(grams, return_inverse=True)[1].reshape(grams.shape), 8
    while 2 * reach <= length:
        ids = _refine(ids[:, :-reach], ids[:, reach:])
        reach *= 2
    if reach < length:
        step = length - reach
        ids = _refine(ids[:, : width - length + 1], ids[:, step : step + width - length + 1])
    place = np.arange(width - length + 1)
    valid = (place >= lo[:, None]) & (place + length <= hi[:, None])
    # a bucket of windows at one offset; equal windows have their anchor, and so their offset, in common
    ids = np.where(valid, ids, -1)
    owner = np.broadcast_to(least[:, None], ids.shape)
    flat = ids.ravel() + 1
    best = _least(flat, owner.ravel(), int(flat.max(initial=0)) + 1)
    smaller = valid & (best[ids + 1] < owner)
    return (smaller.astype(np.uint64) << place.astype(np.uint64)).sum(1, dtype=np.uint64)


def _join_contexts(length: int):  # noqa: ANN202
    def reduce(table: pa.Table) -> pa.Table:
        """Kind 1: the least id of each context, and the windows that are covered where that id stands itself."""
        import zstandard

        p = table.column("p")[0].as_py()
        side = length - Q
        width = 2 * side + Q
        body = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8).reshape(-1, width) for x in table.column("body").to_pylist()])
        lo, hi = (np.concatenate([unsqueeze(x, np.uint8) for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("lo", "hi"))
        least = [unsqueeze(x, np.int64) for x in table.column("least").to_pylist()]
        weight = powers(batches._R, width)
        h, anchor = np.zeros(len(body), U), np.zeros(len(body), U)
        for k in range(width):
            v = batches._BYTE[body[:, k]] * weight[k]
            h += v
            if side <= k < side + Q:
                anchor += v
        h = mix(mix(h) + lo.astype(U) * U(0x9E3779B1) + hi.astype(U) * U(0x85EBCA77C2B2AE63))
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        same = first[inverse]
        if not all((c[s : s + GROUP] == c[same[s : s + GROUP]]).all() for c in (body, lo, hi) for s in range(0, len(h), GROUP)):  # else their bytes tell them apart
            whole = np.ascontiguousarray(np.c_[body, lo.astype(np.uint8), hi.astype(np.uint8)])
            _, first, inverse = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
        own = _least(inverse, np.concatenate(least), len(first))
        masks = np.zeros(len(first), U)
        # anchors with several contexts, in groups of whole anchors
        anchor = anchor[first]
        order = np.argsort(anchor, kind="stable")
        bounds = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
        several = np.diff(bounds) > 1
        starts, ends = bounds[:-1][several], bounds[1:][several]
        k = 0
        while k < len(starts):
            e = max(k + 1, int(np.searchsorted(np.cumsum(ends[k:] - starts[k:]), GROUP, side="right")) + k)
            c = np.concatenate([order[s:t] for s, t in zip(starts[k:e], ends[k:e], strict=True)])
            i = first[c]
            masks[c] = _covered_windows(body[i], lo[i], hi[i], own[c], length)
            k = e
        cut = np.split(inverse, np.cumsum([len(x) for x in least])[:-1])
        return _answers(table.column("block").to_pylist(), 1, p, [squeeze(own[i]) for i in cut], [squeeze(masks[i]) for i in cut])

    return reduce


def _cut(parts: int, length: int):  # noqa: ANN202
    span = pa.struct([("s", pa.int64()), ("e", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span))])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        rows = right.to_pylist()
        b = _Block(left.to_pylist()[0], rows, parts, length)
        back = sorted((x for x in rows if x["kind"] == 1), key=lambda x: x["p"])
        own, mask = np.full(len(b.first), NO_ID), np.zeros(len(b.first), U)
        if back:
            own[b.order] = np.concatenate([unsqueeze(x["data"], np.int64) for x in back])
            mask[b.order] = np.concatenate([unsqueeze(x["more"], np.uint64) for x in back])
        starts, ends = [], []  # of covered ranges
        whole = (own[b.context] < b.ids[b.doc]) & (b.hi - b.lo >= length)
        starts.append((b.start + b.lo)[whole]), ends.append((b.start + b.hi)[whole])
        rest = np.flatnonzero(~whole & (mask[b.context] > 0))
        bits, at = mask[b.context[rest]], b.start[rest]
        for o in range(b.width - length + 1):
            i = at[((bits >> U(o)) & U(1)).astype(bool)] + o
            starts.append(i), ends.append(i + length)
        size = np.diff(b.offsets)
        i = b.copy & (size >= length)
        starts.append(b.offsets[:-1][i]), ends.append(b.offsets[1:][i])
        n = len(b.raw) + 1
        gone = np.cumsum(np.bincount(np.concatenate(starts), minlength=n) - np.bincount(np.concatenate(ends), minlength=n))[:-1] > 0
        kept, sha, spans = ~gone, [], []
        before = np.r_[0, np.cumsum(gone)]
        for s, e in zip(b.offsets[:-1], b.offsets[1:], strict=True):
            if before[e] == before[s]:
                sha.append(hashlib.sha256(b.raw[s:e]).hexdigest())
                spans.append([])
                continue
            sha.append(hashlib.sha256(b.raw[s:e][kept[s:e]]).hexdigest())
            edge = np.flatnonzero(np.diff(np.r_[False, gone[s:e], False]))
            spans.append([{"s": int(x), "e": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        ids = pa.array(b.ids, pa.int64(), mask=~b.valid)
        return pa.table([ids, pa.array(size), pa.array(before[b.offsets[1:]] - before[b.offsets[:-1]]), pa.array(sha), pa.array(spans, pa.list_(span))], schema=schema)

    return cut


def repeated_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, parts: int | None = None) -> DataFrame:
    """One row per input row: doc_id (long), n_bytes, n_removed, kept_sha256 (of the bytes that stay), spans (s, e: removed byte runs).

    Null texts are empty; texts shorter than ``length`` bytes stay. Rows with a null id stay whole and cover nothing; rows of one
    id don't cover one another. An empty table gives no rows; extra columns are ignored. ``length`` is 32 to 64. ``parts``: hash ranges.
    """
    if not 32 <= length <= 64:
        raise ValueError("length must be between 32 and 64 bytes")
    spark = docs.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    blocks = materialize_bucketed(rows.mapInArrow(_blocks(length), _BLOCKS), "block", parts, "blocks")
    sent = blocks.mapInArrow(_send_anchors(parts, length), _SLICES)
    shared = materialize(sent.groupBy("p").applyInArrow(_join_anchors, _BACK), "anchors")
    by_block = blocks.groupBy("block")
    contexts = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_contexts(parts, length), _CONTEXTS)
    covered = materialize(contexts.groupBy("p").applyInArrow(_join_contexts(length), _BACK), "covered")
    back = shared.unionByName(covered)
    return by_block.cogroup(back.groupBy("block")).applyInArrow(
        _cut(parts, length), "doc_id long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<s:long,e:long>>"
    )
