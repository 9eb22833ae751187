"""Language-model scoring with a weighted backoff automaton.

The model has n-grams of up to ``order`` words over words and an end mark. Its root holds the add-one unigrams; every history of up
to ``order`` - 1 words (a text's start counts as one) is a state. A state has an arc for every n-gram that occurs ``min_count`` times or
more and gains over its failure path; the arc's weight is the absolutely discounted probability. A state's failure arc leads to the
history without its first word and carries the mass its arcs leave, normalised over the words they don't cover, so every state's
probabilities sum to one. Scoring runs once from left to right: each token takes the longest history's arc or else fails to
the next, and logarithms are added up (the traversal of a block of texts is one NumPy expression for each order).

Counting and look-ups are exact over all documents and words, and neither the vocabulary nor the model ever has to fit in one place:

1. One scan turns texts into blocks (some MB of text; one row each, written once): local word numbers and the hashes they stand for.
2. Each block sends its sorted hashes with its training counts in slices by hash range; a range's totals go back to every
   block in the block's own order, so that only numbers travel. A slice group holds at most one entry for each word of the range
   and block: a word in every document is one entry a block.
3. Then, order by order, 64-bit hashes of n-grams are counted in the same way. An n-gram is sent if its history and its last words
   occur ``min_count`` times, as it can't occur more often than they do. Of the blocks that hold an n-gram its range names one as owner.
4. From the totals a block computes its arcs, and sends for each history the mass of those it owns; a history's failure weight
   goes back to every block in the block's own order.
5. A block meets all its answers in a co-group and is scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import U, chunks, deltas, mix, squeeze, undelta, unsqueeze, word_hashes
from lexmill.plans.scratch import append_bucketed, materialize_bucketed
from lexmill.session import ship

#: Text bytes of a block.
BLOCK = 16 << 20
#: ``Model.arcs`` takes bigrams as history * SPAN + word.
SPAN = 1 << 20
#: Stands for the end mark, and as a history for the start.
END = U(0x5851F42D4C957F2D)

_BLOCK_SCHEMA = "block binary, ids binary, train binary, n binary, words binary, vocab binary"


def _ids(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], ["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _block(held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row from (ids, training flags, words a row, word hashes) of consecutive pieces."""
    ids, train, n, h = (list(x) for x in zip(*held, strict=True))
    vocab, local, count = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocab), np.uint32)  # frequent words get small numbers, which squeeze well
    rank[np.argsort(-count, kind="stable")] = np.arange(len(vocab), dtype=np.uint32)
    keys = deltas(vocab)
    row = [
        uuid.uuid4().bytes, _ids(pa.concat_arrays(ids)), squeeze(np.concatenate(train).astype(np.uint8)), squeeze(np.concatenate(n).astype(np.uint32)),
        squeeze(rank[local]), len(keys).to_bytes(8, "little") + keys + squeeze(rank),
    ]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["block", "ids", "train", "n", "words", "vocab"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        train = b.column("train").to_numpy(zero_copy_only=False)
        for first, end, raw, offsets in chunks(b.column("body")):
            h, before = word_hashes(raw, offsets)
            held.append((b.column("doc_id").slice(first, end - first), train[first:end], np.diff(before), h))
            size += len(raw)
            if size >= BLOCK:
                yield _block(held)
                held, size = [], 0
    if held:
        yield _block(held)


def _vocab(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, local number of each)."""
    n = int.from_bytes(packed[:8], "little")
    return undelta(packed[8 : 8 + n]), unsqueeze(packed[8 + n :], np.uint32)


def _slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted 64-bit keys of equal ranges begin and end."""
    width = (1 << 64) // parts + 1
    return np.r_[0, np.searchsorted(keys, np.array([k * width for k in range(1, parts)], U)), len(keys)] if parts > 1 else np.array([0, len(keys)])


def _send(kind: int, block: bytes, keys: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each hash range that the sorted keys reach; the values' last axis goes with the keys."""
    at = _slices(keys, parts)
    p = np.flatnonzero(np.diff(at))
    cut = [slice(at[k], at[k + 1]) for k in p]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(p), pa.int32()), pa.array(p, pa.int32()), pa.array([block] * len(p), pa.binary()),
            pa.array([deltas(keys[i]) for i in cut], pa.binary()), pa.array([squeeze(values[..., i].ravel()) for i in cut], pa.binary()),
        ],
        schema=_UP_SCHEMA,
    )


_UP = "kind int, p int, block binary, keys binary, counts binary"
_UP_SCHEMA = pa.schema([("kind", pa.int32()), ("p", pa.int32()), ("block", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
_BACK = "block binary, kind int, p int, data binary"
#: Kinds of answers: NUMBERS of the training text, 2 * order for totals, 2 * order + 1 for failure weights.
NUMBERS = 1


def _unigrams(parts: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                train, n, words, keys, number = _read(row)
                count = np.bincount(words[np.repeat(train, n)], minlength=len(keys)).astype(np.uint32)[number]
                yield _send(2, row["block"], keys, count, parts)

    return scan


def _answer(blocks: list[bytes | None], kinds: list[int], p: int, data: list[bytes]) -> pa.Table:
    n = len(blocks)
    return pa.table([pa.array(blocks, pa.binary()), pa.array(kinds, pa.int32()), pa.array([p] * n, pa.int32()), pa.array(data, pa.binary())], names=["block", "kind", "p", "data"])


def _by_key(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(where each distinct key comes first, each entry's distinct key, bounds of the blocks' entries)."""
    keys = [undelta(x) for x in table.column("keys").to_pylist()]
    _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return first, inverse, np.cumsum([len(k) for k in keys])[:-1].tolist()


def _reduce(min_count: int):  # noqa: ANN202
    def reduce(table: pa.Table) -> pa.Table:
        """In each block's order: totals of words; twice the totals of n-grams (0 below min_count), plus 1 for the owner; failure weights."""
        kind, p = table.column("kind")[0].as_py(), table.column("p")[0].as_py()
        blocks = table.column("block").to_pylist()
        first, inverse, cuts = _by_key(table)
        kinds = [kind] * len(blocks)
        if kind % 2:
            mass = np.concatenate([unsqueeze(x, np.float32).reshape(2, -1) for x in table.column("counts").to_pylist()], axis=1)
            arcs, below = (np.bincount(inverse, m, len(first)) for m in mass)
            alpha = np.where(arcs > 0, np.log10(np.maximum(1 - arcs, 1e-12) / np.maximum(1 - below, 1e-12)), 0.0).astype(np.float32)
            return _answer(blocks, kinds, p, [squeeze(alpha[i]) for i in np.split(inverse, cuts)])
        count = np.concatenate([unsqueeze(x, np.uint32) for x in table.column("counts").to_pylist()])
        total = np.bincount(inverse, count, len(first)).astype(np.uint64)
        if kind == 2:
            numbers = np.array([total.sum(), (total > 0).sum()], np.int64)
            return _answer([*blocks, None], [*kinds, NUMBERS], p, [*(squeeze(total[i]) for i in np.split(inverse, cuts)), numbers.tobytes()])
        total[total < min_count] = 0
        out = 2 * total[inverse]
        out[first] += (total > 0).astype(np.uint64)
        return _answer(blocks, kinds, p, [squeeze(x) for x in np.split(out, cuts)])

    return reduce


class Model:
    """What every task needs: some numbers, whatever the corpus. Words and their counts are only given for ``arcs``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, train_docs: int, tokens: int, distinct: int, discount: float, min_count: int) -> None:
        order = np.argsort(hashes)
        self.counts = np.r_[counts[order], train_docs].astype(np.float64)  # the last is the end mark, and as a history the start
        self.train_docs, self.tokens, self.distinct, self.discount, self.min_count = train_docs, tokens, distinct, discount, min_count
        self.least = min_count  # an n-gram can't occur more often than its history

    def log_base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.distinct + 1.0))

    def weights(self, count: np.ndarray, history: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram from its count, its history's and the log10 probability on its failure path; nan where it has no arc."""
        log = np.log10(np.maximum(count - self.discount, 1e-9) / np.maximum(history, 1))
        return np.where((count >= self.min_count) & (count * (log - below) >= 1), log, np.nan)

    def arcs(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """``weights`` of bigrams of the model's own words."""
        return self.weights(count, self.counts[keys // SPAN], self.log_base(self.counts[keys % SPAN]))


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, number = _vocab(row["vocab"])
    return unsqueeze(row["train"], np.uint8).astype(bool), unsqueeze(row["n"], np.uint32), unsqueeze(row["words"], np.uint32), keys, number


def _before(x: np.ndarray, first: np.ndarray, at_first: int) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = at_first
    return out


def _walk(model: Model, order: int, step: int, row: dict, back: list[dict], parts: int) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Go through a block with the totals of orders up to ``step`` and the failure weights below it.

    Returns what is to be sent next (failure masses of this order, counts of the next one), words a row, and of each token, an end
    mark after each row: the total, the log10 probability at the root and, after the last step, that of the model.
    """
    found: dict[int, list[bytes]] = {}
    for x in sorted(back, key=lambda x: (x["kind"], x["p"])):
        found.setdefault(x["kind"], []).append(x["data"])
    got = lambda kind, dtype: np.concatenate([np.zeros(0, dtype), *[unsqueeze(x, dtype) for x in found.pop(kind, [])]])
    train, n, words, vocab, number = _read(row)
    size = n.astype(np.int64) + 1
    first = np.cumsum(size) - size
    end = len(vocab)
    word = np.full(int(size.sum()), end, np.int32)
    inside = np.ones(len(word), bool)
    inside[first + size - 1] = False
    word[inside] = words
    use = np.repeat(train, size)
    hashes = np.full(end + 1, END)
    hashes[number] = vocab
    total = np.zeros(end + 1, np.int64)
    total[number], total[end] = got(2, np.uint64), model.train_docs
    count = total[word]
    base = logs = model.log_base(count)
    up: list[pa.RecordBatch] = []
    at, keys = word, hashes
    for k in range(2, min(step + 1, order) + 1):
        history = _before(at, first, end if k == 2 else -1)
        e = np.flatnonzero((history >= 0) & (at >= 0))
        e = e[(total[history[e]] >= model.least) & (total[at[e]] >= model.min_count)]
        of = history[e]
        grams, example, inverse = np.unique(mix(keys[of] * U(0x9FB21C651E98DF25) + hashes[word[e]]), return_index=True, return_inverse=True)
        if k > step:
            up.append(_send(2 * k, row["block"], grams, np.bincount(inverse[use[e]], minlength=len(grams)).astype(np.uint32), parts))
            break
        totals = got(2 * k, np.uint64)
        own, totals = (totals & U(1)).astype(bool), (totals >> U(1)).astype(np.int64)
        below = logs[e[example]]
        arc = model.weights(totals, total[of[example]], below)
        asked = np.unique(history)  # also those that only words without an arc follow here
        asked = asked[asked >= 0]
        asked = asked[total[asked] >= model.least]
        asked = asked[np.argsort(keys[asked])]
        if k == step:
            own &= ~np.isnan(arc)
            mass = [np.bincount(of[example][own], 10.0 ** x[own], len(keys))[asked].astype(np.float32) for x in (arc, below)]
            up.append(_send(2 * k + 1, row["block"], keys[asked], np.stack(mass), parts))
        else:
            alpha = np.zeros(len(keys) + 1, np.float32)  # the last is for no history
            alpha[asked] = got(2 * k + 1, np.float32)
            failed = logs + alpha[history]
            taken = arc[inverse]
            failed[e] = np.where(np.isnan(taken), failed[e], taken)
            logs = failed
        at = np.full(len(word), -1, np.int32)
        at[e] = inverse
        keys, total = grams, totals
    return up, n, count, base, logs


def _ask(model: Model, order: int, step: int, parts: int):  # noqa: ANN202
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        up = [x for row in left.to_pylist() for x in _walk(model, order, step, row, right.to_pylist(), parts)[0]]
        return pa.Table.from_batches(up, _UP_SCHEMA)

    return ask


def _score(model: Model, order: int, parts: int, id_type: pa.DataType):  # noqa: ANN202
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    schema = pa.schema([("doc_id", id_type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        _, n, count, base, logs = _walk(model, order, order + 1, row, right.to_pylist(), parts)
        starts = np.r_[0, np.cumsum(n.astype(np.int64) + 1)[:-1]]
        ids = pa.ipc.open_stream(row["ids"]).read_all().column("doc_id").combine_chunks()
        return pa.table(
            [ids.cast(id_type), pa.array(n.astype(np.int64) + 1), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))],
            names=names,
        )

    return score


def score_texts(
    docs: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    history_share: float = 0.0,
    discount: float = 0.5,
    min_count: int = 4,
    parts: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``train`` says which rows the model learns from (null: not). Null and empty texts are the end mark alone. Rows with equal or null ids are
    kept apart; an empty table gives no rows; without a training row every token is unknown and the model is uniform; extra
    columns are ignored. ``history_share``: histories below this share of all training tokens get no arcs; at 0 all may have some.
    ``parts``: hash ranges; one should hold some million distinct words.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = materialize_bucketed(rows.mapInArrow(_blocks, _BLOCK_SCHEMA), "block", parts, "blocks")
    by_block = blocks.groupBy("block")
    name = f"lexmill_answers_{uuid.uuid4().hex}"

    def answer(up: DataFrame) -> DataFrame:
        """All answers so far: each is shuffled to its block once and written there, so that no later step shuffles it again."""
        new = up.groupBy("kind", "p").applyInArrow(_reduce(min_count), _BACK)
        return append_bucketed(new.repartition(parts, "block"), "block", parts, name)

    back = answer(blocks.mapInArrow(_unigrams(parts), _UP))
    tokens = distinct = 0
    for r in back.where(F.col("kind") == NUMBERS).select("data").toLocalIterator():
        a, b = np.frombuffer(r["data"], np.int64)
        tokens, distinct = tokens + int(a), distinct + int(b)
    train_docs = rows.where("train").count()
    tokens, distinct = tokens + train_docs, distinct + (train_docs > 0)
    model = Model(np.zeros(0, U), np.zeros(0), train_docs, tokens, distinct, discount, min_count)
    model.least = max(min_count, tokens * history_share)
    for step in range(1, order + 1 if order > 1 else 1):
        back = answer(by_block.cogroup(back.where("block is not null").groupBy("block")).applyInArrow(_ask(model, order, step, parts), _UP))
    back = back.where("block is not null")
    scored = by_block.cogroup(back.groupBy("block")).applyInArrow(
        _score(model, order, parts, id_type), f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long")).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
