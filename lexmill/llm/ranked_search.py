"""Ranked lexical search by WAND over document shards.

Documents are scanned once into shards: some MB of text become one row with the ids, the lengths and the postings of all terms that the
queries hold, sorted by term and document. Corpus statistics (documents, terms, and each term's documents) are summed over the shards.
Then every shard is searched with them: a term's maximum impact is the best score that one of its postings reaches. Each query has
a cursor in each of its terms' lists. Sorted by the document they stand at, the cursors' maxima are added up until the query's heap
threshold is met: the document there is the pivot, and none before it can enter the heap, so the cursors in front jump to it. Once all
of them stand at the pivot it is scored in full. Heaps go with a task from shard to shard, so later shards skip more. The tasks' heaps are
merged by ranking.

A step moves the cursors of all queries at once, as a NumPy expression over a (query, term) array. All is exact: bounds and scores are
integers, and a document whose bound only equals the threshold is scored, as its id may win the tie. Queries go in blocks of some MB of text,
each over all shards of its own scan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.batches import NOT_ALNUM, chunks, squeeze, unsqueeze, word_hashes
from lexmill.plans.scratch import materialize
from lexmill.session import ship

#: Text bytes of a shard.
SHARD = 8 << 20
#: Characters of query text that are worked on together.
QUERIES = 4 << 20
#: The saturation's parts.
GAIN, TF, LENGTH = 1_000_000_000, 1000, 8
_NONE = np.iinfo(np.int32).max

_SHARDS = "ids binary, valid binary, sizes binary, terms binary, docs binary, tfs binary"


def _shards(vocabulary: np.ndarray):  # noqa: ANN202
    """Rows of documents to shards. ``vocabulary``: sorted hashes of the queries' terms."""
    names = ["ids", "valid", "sizes", "terms", "docs", "tfs"]

    def row(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, valid, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
        first = np.cumsum([0, *[len(x[0]) for x in held[:-1]]])
        term, doc, tf = (np.concatenate(x) for x in zip(*[(x[3], x[4] + n, x[5]) for x, n in zip(held, first, strict=True)], strict=True))
        order = np.argsort(term, kind="stable")  # documents stay in order
        data = [squeeze(ids), squeeze(valid.astype(np.uint8)), squeeze(sizes.astype(np.uint32)), *[squeeze(x[order].astype(np.uint32)) for x in (term, doc, tf)]]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            ids = b.column("doc_id")
            valid = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            for first, end, raw, offsets in chunks(b.column("body")):
                h, before = word_hashes(raw, offsets, gap=NOT_ALNUM)
                n = np.diff(before)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                asked = np.flatnonzero(vocabulary[at] == h)
                doc = np.repeat(np.arange(len(n)), n)[asked]
                key, tf = np.unique((doc << 32) | at[asked], return_counts=True)
                held.append((ids[first:end].copy(), valid[first:end].copy(), n, key & 0xFFFFFFFF, key >> 32, tf))
                size += len(raw)
                if size >= SHARD:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    return scan


class Shard:
    """A shard's postings; ``key`` is term * 2**32 + document, ascending."""

    def __init__(self, row: dict) -> None:
        self.ids, self.valid = unsqueeze(row["ids"], np.int64), unsqueeze(row["valid"], np.uint8).astype(bool)
        self.sizes = unsqueeze(row["sizes"], np.uint32).astype(np.int64)
        self.term, self.doc, self.tf = (unsqueeze(row[c], np.uint32).astype(np.int64) for c in ("terms", "docs", "tfs"))
        self.key = (self.term << 32) | self.doc

    def impacts(self, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        """What each posting adds to a score."""
        m = 100 - 75 + (75 * self.sizes * n_docs) // max(n_terms, 1)
        return weight[self.term] * ((GAIN * self.tf) // (TF * self.tf + LENGTH * m[self.doc]))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of each term; term -1 has all documents, -2 all terms."""
    for b in batches:
        for row in b.to_pylist():
            s = Shard(row)
            term, n = np.unique(s.term, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[term, -1, -2]), pa.array(np.r_[n, np.count_nonzero(s.sizes), s.sizes.sum()].astype(np.int64))], ["term", "n"]
            )


class Heaps:
    """The best ``k`` documents of every query; ties go to the smaller id, and ids that are null come last."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(queries)]
        #: A score below this can't enter.
        self.least = np.ones(queries, np.int64)

    def offer(self, q: int, score: int, valid: bool, doc_id: int) -> None:
        heap, entry = self.heaps[q], (score, valid, -doc_id)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[q] = heap[0][0]


def wand(shard: Shard, impact: np.ndarray, terms: np.ndarray, times: np.ndarray, heaps: Heaps) -> int:
    """Offer the shard's documents to the heaps and return how many were scored.

    ``terms`` and ``times``: a row for each query, its terms (-1 fills up) and how often it holds each.
    """
    key, n = shard.key, len(shard.key)
    if not n:
        return 0
    starts = np.flatnonzero(np.r_[True, shard.term[1:] != shard.term[:-1]])
    most = np.zeros(int(max(shard.term[-1], terms.max())) + 2, np.int64)  # of each term, 0 for one that the shard lacks
    most[shard.term[starts]] = np.maximum.reduceat(impact, starts)
    bound = most[terms] * times  # -1 reads the last entry, which no term has
    place = np.searchsorted(key, np.maximum(terms, 0) << 32)
    base = terms << 32
    doc_of = np.r_[shard.doc, _NONE]
    term_of = np.r_[shard.term, -2]
    at = np.where((term_of[place] == terms) & (bound > 0), doc_of[place], _NONE)
    live = np.arange(len(terms))
    scored = 0
    while True:
        order = np.argsort(at, axis=1)
        docs = np.take_along_axis(at, order, 1)
        sums = np.cumsum(np.where(docs < _NONE, np.take_along_axis(bound, order, 1), 0), axis=1)
        enough = sums >= heaps.least[live][:, None]
        going = enough[:, -1]
        if not going.all():  # the rest of their lists together can't reach the heap
            live, at, place, bound, base, terms, times, docs, enough = (x[going] for x in (live, at, place, bound, base, terms, times, docs, enough))
            if not len(live):
                return scored
        pivot = docs[np.arange(len(live)), enough.argmax(1)]
        ready = docs[:, 0] == pivot
        on = at == pivot[:, None]
        if ready.any():
            r = np.flatnonzero(ready)
            score = (np.where(on[r], impact[np.minimum(place[r], n - 1)], 0) * times[r]).sum(1)
            scored += len(r)
            better = score >= heaps.least[live[r]]
            for q, s, d in zip(live[r[better]].tolist(), score[better].tolist(), pivot[r[better]].tolist(), strict=True):
                heaps.offer(q, s, bool(shard.valid[d]), int(shard.ids[d]))
        # cursors before the pivot jump to it, those of a scored pivot leave it
        goal = pivot + ready
        r, c = np.nonzero(at < goal[:, None])
        to = np.searchsorted(key, base[r, c] + goal[r])
        place[r, c] = to
        at[r, c] = np.where(term_of[to] == terms[r, c], doc_of[to], _NONE)


def _search(terms: np.ndarray, times: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, k: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(terms), k)
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                wand(shard, shard.impacts(weight, n_docs, n_terms), terms, times, heaps)
        found = [(q, -d if valid else None, s) for q, heap in enumerate(heaps.heaps) for s, valid, d in heap]
        q, d, s = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["q", "doc_id", "score"])

    return scan


def _terms(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct term hashes, how often the text holds each) of every text."""
    out = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        out.append(np.unique(word_hashes(raw, np.array([0, len(raw)]), gap=NOT_ALNUM)[0], return_counts=True))
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query id, rank from 1, doc_id, score): each query's ``k`` best documents with a score above 0, equal scores by ascending id.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z as a-z, told apart by 64-bit hashes. Ids of
    documents are whole numbers; rows of one id are documents of their own, those of a null id come last among equals. Null and empty
    texts hold no term, count for no statistic and are never found; such queries, and those of terms that no document holds, have no
    rows. Equal query rows get equal rows each. Empty tables give no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = materialize(queries.select(F.col(query_id).alias("qid"), F.coalesce(F.col(query_text), F.lit("")).alias("query")), "queries")
    each = asked.select("query").distinct()
    blocks = -(-(each.agg(F.sum(F.length("query"))).first()[0] or 0) // QUERIES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    answers = []
    for block in range(blocks):
        texts = [r["query"] for r in each.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()]  # some QUERIES characters
        answers.append(_answer(rows, texts, k))
    if not answers:
        return asked.join(rows.limit(0), F.lit(True)).select(F.col("qid").alias(query_id), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    found = answers[0]
    for x in answers[1:]:
        found = found.unionByName(x)
    return asked.join(found, "query").select(F.col("qid").alias(query_id), "rank", "doc_id", "score")


def _answer(rows: DataFrame, texts: list[str], k: int) -> DataFrame:
    spark = rows.sparkSession
    held = _terms(texts)
    vocabulary = np.unique(np.concatenate([h for h, _ in held]))
    width = max(len(h) for h, _ in held)
    terms, times = np.full((len(texts), max(width, 1)), -1, np.int64), np.zeros((len(texts), max(width, 1)), np.int64)
    for q, (h, n) in enumerate(held):
        terms[q, : len(h)], times[q, : len(h)] = np.searchsorted(vocabulary, h), n
    if not len(vocabulary):
        vocabulary = np.zeros(1, np.uint64)
    shards = materialize(rows.mapInArrow(_shards(vocabulary), _SHARDS), "shards")
    totals = {r["term"]: r["n"] for r in shards.mapInArrow(_totals, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # terms of the block
    n_docs, n_terms = totals.get(-1, 0), totals.get(-2, 0)
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * totals.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    found = shards.mapInArrow(_search(terms, times, weight, n_docs, n_terms, k), "q int, doc_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(texts)), "q int, query string")
    return materialize(found.join(names, "q").select("query", "rank", "doc_id", "score"), "found")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d),
p AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY rid, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
q AS (SELECT r, any_value(item_id) AS item_id, term, count(*) AS c FROM (SELECT row_number() OVER () AS r, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY r, term),
h AS (
  SELECT r, rid, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
    CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY r, rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0) WHERE rank <= 10
"""
