"""Which of many terms each of many texts uses: one pass over the texts with a trie of the terms.

The terms of a block become a trie over their bytes, as sorted arrays. In a task, every place of a batch of texts whose first three bytes begin
some term starts a walker; all walkers go down the trie together, a byte a step, each step one search of (node, byte) in the trie's edges, and
stop where no edge leads on. So every place is asked for all terms at once, the longest first by its depth, and the work follows
the text's length and the matches, not the number of terms. The trie is broadcast: a block holds terms of at most ``BLOCK`` bytes, and
more terms take more blocks, each one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.scratch import materialize
from lexmill.session import ship

#: Bytes of the terms that are looked for in one pass; its trie takes some twelve times as much.
BLOCK = 4 << 20
#: Bytes of text that are walked together.
CHUNK = 1 << 20
#: Shorter terms are none, and a term below the second length counts only as a whole word.
SHORTEST, WHOLE = 3, 6
_WORD = np.array([b >= 128 or chr(b).isalnum() or chr(b) == "_" for b in range(256)])


class Trie:
    """Edges as sorted keys node * 256 + byte; ``term`` has the number of the term that ends in a node, or -1.

    Terms are distinct and have three bytes or more; those of less than ``whole`` characters count only as whole words.
    """

    def __init__(self, terms: list[bytes], whole: int = WHOLE) -> None:
        # in order, the terms with one beginning stand together: level by level, a node is a run of terms
        order = sorted(range(len(terms)), key=terms.__getitem__)
        body = np.frombuffer(b"".join(terms[i] for i in order), np.uint8)
        size = np.array([len(terms[i]) for i in order], np.int64)
        start = np.cumsum(size) - size
        node = np.zeros(len(terms), np.int64)
        keys, ends, count = [], [], 1
        names = np.array(order, np.int64)
        for depth in range(int(size.max(initial=0))):
            on = size > depth
            node, size, start, names = node[on], size[on], start[on], names[on]
            key, child = np.unique((node << 8) | body[start + depth], return_inverse=True)
            keys.append(key)
            node = count + child
            count += len(key)
            last = size == depth + 1
            ends.append((node[last], names[last]))
            if depth == SHORTEST - 1:
                self.roots = (body[start].astype(np.int64) << 16) | (body[start + 1].astype(np.int64) << 8) | body[start + 2]
                self.roots, first = np.unique(self.roots, return_index=True)
                self.root_nodes = node[first]
        # deeper nodes have larger numbers, so the keys of all levels are in order
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.child = np.arange(1, count, dtype=np.int32)
        self.term = np.full(count, -1, np.int32)
        for n, t in ends:
            self.term[n] = t
        # of longer terms more bytes are looked at before a walker starts
        self.ahead = int(min(8, min(map(len, terms), default=0)))
        if self.ahead > SHORTEST:
            self.first_bytes = np.unique(self._hash(body, np.cumsum([0, *[len(terms[i]) for i in order]])[:-1]))
        self.whole = np.array([len(t.decode()) < whole for t in terms])
        if not hasattr(self, "roots"):
            self.roots = self.root_nodes = np.zeros(0, np.int64)

    def _hash(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """24 bits of the first ``ahead`` bytes from each place on."""
        h = np.zeros(len(at), np.uint64)
        for k in range(self.ahead):
            h = h * np.uint64(257) + raw[at + k]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)

    def places(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, byte) of every place of a term in the texts that lie between the offsets of ``raw``."""
        none = np.zeros(0, np.int64)
        if len(raw) < SHORTEST or not len(self.roots):
            return none, none, none
        if not hasattr(self, "begins"):
            self.begins = np.zeros(1 << 24, bool)
            self.begins[self.roots] = True
            if self.ahead > SHORTEST:
                self.goes_on = np.zeros(1 << 24, bool)
                self.goes_on[self.first_bytes] = True
        wide = raw.astype(np.int32)
        gram = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        at = np.flatnonzero(self.begins[gram])
        if self.ahead > SHORTEST:
            at = at[at + self.ahead <= len(raw)]
            at = at[self.goes_on[self._hash(raw, at)]]
        text = np.searchsorted(offsets, at, side="right") - 1
        limit = offsets[text + 1]
        inside = at + SHORTEST <= limit
        at, text, limit = at[inside], text[inside], limit[inside]
        node = self.root_nodes[np.searchsorted(self.roots, gram[at])]
        begin = offsets[text]
        found = []
        depth = SHORTEST
        while len(at):
            term = self.term[node]
            hit = np.flatnonzero(term >= 0)
            if len(hit):
                t, s, e = term[hit], at[hit], at[hit] + depth
                left = (s == begin[hit]) | ~_WORD[raw[s - 1]]
                right = (e == limit[hit]) | ~_WORD[raw[np.minimum(e, len(raw) - 1)]]
                ok = ~self.whole[t] | (left & right)
                found.append((text[hit][ok], t[ok].astype(np.int64), s[ok]))
            on = at + depth < limit
            at, text, limit, begin, node = at[on], text[on], limit[on], begin[on], node[on]
            key = (node.astype(np.int64) << 8) | raw[at + depth]
            to = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[to] == key
            at, text, limit, begin, node = at[on], text[on], limit[on], begin[on], self.child[to[on]]
            depth += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def byte_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in pieces of about CHUNK bytes."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    s = 0
    while s < n:
        e = min(max(int(np.searchsorted(offsets, offsets[s] + CHUNK, side="right")) - 1, s + 1), n)
        yield s, e, raw[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
        s = e


def _scan(trie, numbers: np.ndarray):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for b in batches:
            for first, _, raw, offsets in byte_chunks(b.column("body")):
                text, term, _ = t.places(raw, offsets)
                if len(text):
                    key, n = np.unique((text << 32) | term, return_counts=True)
                    ids = b.column("id").take(pa.array(first + (key >> 32)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(numbers[key & 0xFFFFFFFF]), pa.array(n.astype(np.int64))], ["id", "t", "n"])

    return scan


def used_terms(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, t, n), (t, term)): how often each text uses each term, letter case aside, and the terms by number.

    A term (first column of ``terms``) of six characters or more counts wherever it stands, even inside a word and overlapping itself; a shorter
    one only where no letter, digit, underscore or character beyond ASCII touches it; of less than three characters it is none. Numbers run
    from the longest term on, equal lengths in alphabetical order: of a text's terms the least number is the longest. Null texts and terms use and are
    nothing; texts without a term have no row. Rows of one id are texts of their own, each with its own rows. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    each = terms.select(F.lower(F.col(terms.columns[0])).alias("term")).where(F.length("term") >= SHORTEST).distinct()
    # terms are numbered by length and text: a global order of a table of terms, never of texts
    named = each.select((F.row_number().over(Window.orderBy(F.desc(F.length("term")), "term")) - 1).cast("long").alias("t"), "term")
    named = materialize(named, "terms")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("body")).where("body is not null")
    size = named.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    found = []
    for block in range(blocks):
        held = named.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).collect()  # terms of about BLOCK bytes
        if held:
            trie = spark.sparkContext.broadcast(Trie([r["term"].encode() for r in held]))
            found.append(rows.mapInArrow(_scan(trie, np.array([r["t"] for r in held], np.int64)), f"id {kind}, t long, n long"))
    if not found:
        return rows.select("id", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("n")).limit(0), named
    return reduce(DataFrame.unionByName, found), named


def term_summary(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_terms, n_places, longest): of each id whose texts use a term, how many different ones, how often in all, and the longest."""
    found, named = used_terms(docs, terms, id_col=id_col, text_col=text_col)
    each = found.groupBy("id").agg(F.count_distinct("t").alias("n_terms"), F.sum("n").alias("n_places"), F.min("t").alias("t"))
    return each.join(named, "t").select(F.col("id").alias(id_col), "n_terms", "n_places", F.col("term").alias("longest"))


def best_terms(found: DataFrame, named: DataFrame, k: int, relevance: DataFrame | None = None) -> DataFrame:
    """(id, rank, term): each text's ``k`` most relevant terms; equal ones the longest first, then by text.

    ``relevance``: (id, t, score), 0 where it has no row. Each task keeps its best ``k`` of an id before rows are shuffled.
    """
    rows = found.select("id", "t").distinct()
    rows = rows.withColumn("score", F.lit(0)) if relevance is None else rows.join(relevance, ["id", "t"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "t"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).join(named, "t").select("id", "rank", "term")
