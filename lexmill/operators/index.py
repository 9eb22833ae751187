"""A stored inverted index: blocks of postings, segments, tombstones, and top-k that reads no more than it must.

Texts are inverted where they are read. Up to ``BLOCK_DOCS`` documents of a task form a block, and for each of its tokens the block gives
one row: which of its documents hold it, how often, where, and - as the row's head - the most occurrences and the shortest of those
documents. Rows are then shuffled once, to files by range of documents (``slice``) and hash of the token (``bucket``), sorted by
token; where terms are not the tokens themselves, each segment has a dictionary of both. A term of every document is spread over all slices, and a query reads its terms' buckets only.

All terms' blocks cover the same documents, so a query's blocks can be compared by what their heads allow at best. ``top`` scores each query's
most promising blocks first; the k-th best score found is a threshold, and of the other blocks only those whose bound reaches it are read
further. No block that could hold one of the k best is left out: the result is that of scoring everything.

New documents are a segment of their own, deleted ones are listed as tombstones, and ``compact`` writes what lives as one segment. A
manifest names the segments of a version; it is written last, so a reader sees a whole version, and one that has opened the index
keeps the version it has opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import analyzer
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize
from lexmill.session import ship

#: Documents and tokens of a block; whichever is reached first ends it.
BLOCK_DOCS, BLOCK_TOKENS = 4096, 1_000_000
#: Documents of a slice of the files.
SLICE_DOCS = 1 << 16
#: The saturation and length parameters, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Scores are whole numbers of this part, so sums don't depend on their order.
UNIT = 1_000_000_000
#: Blocks of a query that are read before the threshold is known.
FIRST = 2
#: The bucket of the rows that list a block's documents.
DOCS = -1
#: Fixed value: tokens of a snippet.
SNIPPET = 28

#: ``ends``: how many places belong to the documents up to each. ``lens``, ``ids`` and ``facets`` are those of a block's documents, in the row that lists them.
_POSTINGS = "token string, block long, n int, most int, least int, docs array<int>, ends array<int>, lens array<int>, places array<int>, ids array<{}>, facets array<string>"


def _invert(kind: pa.DataType, segment: int, keep_places: bool):  # noqa: ANN202
    names = ["token", "block", "n", "most", "least", "docs", "ends", "lens", "places", "ids", "facets"]

    def rows(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, facets, lists = (table.column(c).combine_chunks() for c in ("id", "facet", "t"))
        lens = np.diff(np.asarray(lists.offsets)).astype(np.int32)
        n = len(lens)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None], pa.string()), pa.array([number], pa.int64()), pa.array([n], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32()),
                pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())), pa.array([lens.tolist()], pa.list_(pa.int32())),
                pa.array([None], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.cast(kind)),
                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), facets),
            ],
            names,
        )
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        if not len(code):
            return
        doc = np.repeat(np.arange(n, dtype=np.int32), lens)
        start = np.cumsum(lens, dtype=np.int64) - lens
        order = np.argsort(code, kind="stable")  # places stay in order
        code, doc = code[order], doc[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])  # of each posting
        tf = np.diff(np.r_[first, len(code)]).astype(np.int32)
        post_doc, post_code = doc[first], code[first]
        head = np.flatnonzero(np.r_[True, post_code[1:] != post_code[:-1]])  # of each token
        bounds = pa.array(np.r_[head, len(first)].astype(np.int32))
        cut = lambda values: pa.ListArray.from_arrays(bounds, pa.array(values))
        begin = first[head]  # where each token's places begin
        ends = (np.r_[first[1:], len(code)] - np.repeat(begin, np.diff(np.r_[head, len(first)]))).astype(np.int32)
        m = len(head)
        places = pa.nulls(m, pa.list_(pa.int32()))
        if keep_places:
            place = (np.arange(len(code)) - np.repeat(start, lens)).astype(np.int32)[order]
            places = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(code)].astype(np.int32)), pa.array(place))
        out = pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(post_code[head])), pa.array(np.full(m, number)), pa.array(np.diff(np.r_[head, len(first)]).astype(np.int32)),
                pa.array(np.maximum.reduceat(tf, head)), pa.array(np.minimum.reduceat(lens[post_doc], head)), cut(post_doc), cut(ends), pa.nulls(m, pa.list_(pa.int32())),
                places, pa.nulls(m, pa.list_(kind)), pa.nulls(m, pa.list_(pa.string())),
            ],
            names,
        )
        for s in range(0, m, 4096):
            yield out.slice(s, 4096)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # a task that runs again gives its blocks the same numbers
        number = (segment << 48) | (TaskContext.get().partitionId() << 24)
        held: list[pa.RecordBatch] = []
        n_docs = n_tokens = 0
        for b in batches:
            at = 0
            ends = np.asarray(b.column("t").offsets).astype(np.int64) if b.num_rows else np.zeros(1, np.int64)
            while at < b.num_rows:
                room = min(at + BLOCK_DOCS - n_docs, int(np.searchsorted(ends, ends[at] + BLOCK_TOKENS - n_tokens, side="right")) - 1)
                end = min(max(room, at + (not held)), b.num_rows)
                if end > at:
                    held.append(b.slice(at, end - at))
                    n_docs, n_tokens, at = n_docs + end - at, n_tokens + int(ends[end] - ends[at]), end
                if at < b.num_rows or n_docs >= BLOCK_DOCS or n_tokens >= BLOCK_TOKENS:
                    yield from rows(held, number)
                    number, held, n_docs, n_tokens = number + 1, [], 0, 0
        if held:
            yield from rows(held, number)

    return scan


@dataclass(frozen=True)
class Index:
    """An opened version of a stored index. ``segments``: (number, documents, tokens) each; ``gone``: folders of tombstones; ``places``: whether the
    places of terms are stored, which ``near`` and ``phrases`` read."""

    spark: SparkSession
    path: str
    version: int
    analyzer: str
    buckets: int
    id_type: str
    segments: tuple[tuple[int, int, int], ...] = ()
    gone: tuple[str, ...] = ()
    places: bool = True
    #: Segments that have been opened: their files don't change, so they are listed once.
    opened: dict[int, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    # -- writing ------------------------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",), facet_col: str | None = None) -> Index:
        """A version with ``docs`` as a further segment. A document's tokens are those of ``columns`` one after the other.

        Null texts have no tokens, but count as documents; rows of equal or null ids are documents of their own. No rows, no segment.
        """
        ship(self.spark)
        number = max((s[0] for s in self.segments), default=-1) + 1
        found = [analyzer.tokens(F.col(c), self.analyzer) for c in columns]
        rows = docs.select(
            F.col(id_col).cast(self.id_type).alias("id"), (F.col(facet_col).cast("string") if facet_col else F.lit(None).cast("string")).alias("facet"),
            (found[0] if len(found) == 1 else F.concat(*found)).alias("t"),
        )
        slices = -(-docs.count() // SLICE_DOCS)
        if not slices:
            return self
        kind = rows.select("id").limit(0).toArrow().schema.field("id").type
        posts = rows.mapInArrow(_invert(kind, number, self.places), _POSTINGS.format(self.id_type))
        posts = posts.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))
        posts = posts.withColumn("bucket", F.when(F.col("token").isNull(), DOCS).otherwise(self._bucket(F.col("token"))))
        posts = posts.repartition(slices * self.buckets, "slice", "bucket")
        posts.sortWithinPartitions("slice", "bucket", "token", "block").write.partitionBy("slice", "bucket").parquet(self._segment(number))
        self._name(number, self._read(number).where("token is not null").select("token").distinct())
        of = self._read(number).where(F.col("bucket") == DOCS).select(F.size("lens").cast("long").alias("d"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
        n = of.agg(F.sum("d").alias("d"), F.sum("t").alias("t")).first()
        return self._commit(segments=(*self.segments, (number, n["d"], n["t"])))

    def _name(self, number: int, tokens: DataFrame) -> None:
        """Write a segment's dictionary: each distinct token's term is computed once, however many blocks hold it."""
        if self.analyzer != analyzer.PLAIN:
            terms = materialize(tokens, "tokens").select("token", analyzer.term_of(F.col("token"), self.analyzer).alias("term"))
            terms = terms.withColumn("bucket", self._bucket(F.col("term"))).repartition(self.buckets, "bucket")
            terms.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self._dictionary(number))

    def delete(self, ids: DataFrame) -> Index:
        """A version without the documents whose id is in the first column of ``ids``; ids that no document has delete nothing."""
        if not self.segments:
            return self
        keys = broadcast_if_small(ids.select(F.col(ids.columns[0]).cast(self.id_type).alias("k")).distinct())
        dead = self.documents().join(keys, F.col("id") == F.col("k"), "left_semi").select("block", "doc", "len")
        folder = f"{self.path}/gone-{uuid.uuid4().hex}"
        dead.write.parquet(folder)
        return self._commit(gone=(*self.gone, folder))

    def compact(self) -> Index:
        """A version whose living documents are one segment. Postings keep their blocks; rows are copied, not inverted anew."""
        if not self.segments:
            return self
        number = max(s[0] for s in self.segments) + 1
        slices = -(-sum(s[1] for s in self.segments) // SLICE_DOCS)
        rows = self._postings()
        dead = self._dead()
        if dead is not None:
            of = dead.groupBy("block").agg(F.collect_set("doc").alias("dead"))  # at most BLOCK_DOCS a block
            rows = rows.join(broadcast_if_small(of, 20_000), "block", "left")
            of_dead = F.filter(F.transform("docs", lambda d, i: F.when(F.array_contains("dead", d), i)), lambda i: i.isNotNull())
            rows = rows.withColumn("lost", of_dead).withColumn("keep", F.array_except(F.sequence(F.lit(0), F.greatest(F.size("docs") - 1, F.lit(0))), "lost"))
            same = F.col("dead").isNull() | (F.col("bucket") == DOCS)
            missing = lambda i: F.aggregate(F.filter("lost", lambda x: x < i), F.lit(0), lambda a, x: a + _times("ends", x))
            kept = {
                "docs": F.transform("keep", lambda i: F.get("docs", i)),
                "ends": F.transform("keep", lambda i: F.get("ends", i) - missing(i)), "places": F.flatten(F.transform("keep", lambda i: _places_of("places", "ends", i))),
            }
            rows = rows.withColumns({c: F.when(same, F.col(c)).otherwise(x) for c, x in kept.items()}).drop("lost")
            # a document's number stays, its entry becomes empty
            alive = lambda c: F.transform(c, lambda x, i: F.when(~F.array_contains("dead", i), x))
            rows = rows.withColumn("live", F.when((F.col("bucket") == DOCS) & F.col("dead").isNotNull(), alive("lens")).otherwise(F.col("lens")))
            rows = rows.withColumn("lens", F.col("live")).drop("live", "keep", "dead")
            rows = rows.where((F.col("bucket") == DOCS) | (F.size("docs") > 0))
            rows = rows.withColumn("n", F.when(F.col("bucket") == DOCS, F.col("n")).otherwise(F.size(F.array_distinct("docs"))))
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).repartition(slices * self.buckets, "slice", "bucket")
        rows.sortWithinPartitions("slice", "bucket", "token", "block").write.partitionBy("slice", "bucket").parquet(self._segment(number))
        self._name(number, self._read(number).where("token is not null").select("token").distinct())
        n_docs, n_tokens = self.totals()
        return self._commit(segments=((number, n_docs, n_tokens),), gone=())

    def _commit(self, **changes: tuple) -> Index:
        new = replace(self, version=self.version + 1, **changes)
        row = [(new.version, new.analyzer, new.buckets, new.id_type, [list(s) for s in new.segments], list(new.gone), new.places)]
        schema = "version int, analyzer string, buckets int, id_type string, segments array<array<long>>, gone array<string>, places boolean"
        # a version that exists isn't written over: of two writers that began from one version the second fails
        self.spark.createDataFrame(row, schema).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/v={new.version}")
        return new

    # -- reading ------------------------------------------------------------------------------------------------------------------

    def _segment(self, number: int) -> str:
        return f"{self.path}/segment-{number}"

    def _dictionary(self, number: int) -> str:
        return f"{self.path}/dictionary-{number}"

    def _read(self, number: int) -> DataFrame:
        if number not in self.opened:
            schema = _POSTINGS.format(self.id_type) + ", slice int, bucket int"
            self.opened[number] = self.spark.read.schema(schema).parquet(self._segment(number))
        return self.opened[number]

    def _postings(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._read(s[0]) for s in self.segments])

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def _tokens(self, terms: DataFrame) -> DataFrame:
        """(term, token): the tokens of the segments that stand for the terms in question."""
        wanted = terms.select("term").distinct()
        if self.analyzer == analyzer.PLAIN:
            return wanted.withColumn("token", F.col("term"))
        read = lambda number: self.spark.read.schema("token string, term string, bucket int").parquet(self._dictionary(number))
        known = reduce(DataFrame.unionByName, [read(s[0]) for s in self.segments]).select("term", "token")
        return known.join(broadcast_if_small(wanted), "term", "left_semi").distinct()

    def _dead(self) -> DataFrame | None:
        return self.spark.read.schema("block long, doc int, len int").parquet(*self.gone).distinct() if self.gone else None

    def documents(self) -> DataFrame:
        """(block, doc, id, len, facet) of the living documents."""
        rows = self._postings().where(F.col("bucket") == DOCS).select("block", F.posexplode(F.arrays_zip("ids", "lens", "facets")).alias("doc", "x"))
        rows = rows.select("block", "doc", F.col("x.ids").alias("id"), F.col("x.lens").alias("len"), F.col("x.facets").alias("facet")).where("len is not null")
        dead = self._dead()
        return rows if dead is None else rows.join(broadcast_if_small(dead.select("block", "doc")), ["block", "doc"], "left_anti")

    def totals(self) -> tuple[int, int]:
        """(living documents, their tokens)."""
        n, t = sum(s[1] for s in self.segments), sum(s[2] for s in self.segments)
        dead = self._dead()
        if dead is not None:
            gone = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
            n, t = n - gone["n"], t - gone["t"]
        return n, t

    def terms_of(self, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
        """(qid, term, times) of the queries, through the index's analyzer."""
        found = queries.select(F.col(query_id).alias("qid"), F.explode(analyzer.tokens(F.col(query_text), self.analyzer)).alias("token"))
        counted = found.groupBy("qid", "token").agg(F.count(F.lit(1)).alias("times"))
        return counted.withColumn("term", analyzer.term_of(F.col("token"), self.analyzer)).groupBy("qid", "term").agg(F.sum("times").alias("times"))

    def _of(self, terms: DataFrame, *columns: str) -> DataFrame:
        """Posting rows of the terms in question, a row for each of a term's tokens; only their buckets are opened. ``terms`` may have their tokens beside them."""
        held = terms if "token" in terms.columns else self._tokens(terms)
        wanted = held.select("term", "token").withColumn("b", self._bucket(F.col("token")))
        buckets = [r["b"] for r in wanted.select("b").distinct().collect()]  # at most ``buckets``
        rows = self._postings().where(F.col("bucket").isin(buckets)).select("token", "block", *columns)
        return rows.join(broadcast_if_small(wanted.select("term", "token")), "token").select("term", "block", *columns)

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df): in how many living documents each of the terms stands; terms of none are left out."""
        if self.analyzer == analyzer.PLAIN:
            df = self._of(terms, "n").groupBy("term").agg(F.sum("n").alias("df"))
        else:  # several tokens of one term may stand in one document
            rows = self._of(terms, "n", "docs").groupBy("term", "block").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.flatten(F.collect_list("docs")).alias("docs"))
            df = rows.groupBy("term").agg(F.sum(F.when(F.col("rows") == 1, F.col("n")).otherwise(F.size(F.array_distinct("docs")))).alias("df"))
        dead = self._dead()
        if dead is not None:
            blocks = broadcast_if_small(dead.select("block").distinct())
            held = self._of(terms, "docs").join(blocks, "block", "left_semi").select("term", "block", F.explode("docs").alias("doc")).distinct()
            lost = held.join(broadcast_if_small(dead.select("block", "doc")), ["block", "doc"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("lost"))
            df = df.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
        return df.where("df > 0")

    def rare_terms(self, queries: DataFrame, query_id: str, query_text: str, k: int, shortest: int = 1) -> DataFrame:
        """(qid, term, df, rank): each query's ``k`` rarest terms that the index has; ties by text. Shorter terms than ``shortest`` don't count."""
        terms = self.terms_of(queries, query_id, query_text).where(F.length("term") >= shortest)
        df = broadcast_if_small(materialize(self.frequencies(terms), "df"))
        order = Window.partitionBy("qid").orderBy("df", "term")
        return terms.join(df, "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "term", "df", "rank")

    # -- ranking ------------------------------------------------------------------------------------------------------------------

    def top(self, queries: DataFrame, k: int, *, query_id: str = "qid", query_text: str = "text", every: bool = False, facet: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(qid, rank, id, score): the ``k`` best documents of each query by BM25, equal scores by ascending id, null ids first.

        ``every``: only documents that hold all terms of the query. ``facet``: only documents of that facet. ``allowed``: (qid, block, doc),
        only these. A query without terms, or of terms that no document holds, has no rows.
        """
        n_docs, n_tokens = self.totals() if self.segments else (0, 0)
        kind = queries.select(F.col(query_id).alias("qid")).limit(0)
        if not n_docs:
            return kind.select("qid", F.lit(1).alias("rank"), F.lit(None).cast(self.id_type).alias("id"), F.lit(0.0).alias("score")).limit(0)
        terms = materialize(self.terms_of(queries, query_id, query_text), "asked")
        held = materialize(self._tokens(terms), "held")
        df = materialize(self.frequencies(held), "df")
        idf = F.greatest(F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        asked = terms.join(broadcast_if_small(df), "term", "left").withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("qid")))
        numbers = materialize(terms.select("qid").distinct().withColumn("q", F.monotonically_increasing_id()), "numbers")
        asked = asked.where("df is not null").select("qid", "term", "need", (F.col("times") * idf).alias("weight"))
        asked = materialize(asked.join(broadcast_if_small(numbers), "qid"), "weights")
        mean = n_tokens / n_docs or 1.0
        part = lambda tf, length: F.col("weight") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / F.lit(mean)))
        heads = self._of(held, "most", "least").join(broadcast_if_small(asked), "term")
        bound = F.sum((F.ceil(part(F.col("most"), F.col("least")) * UNIT) + 1).cast("long"))  # of several tokens of a term, too: parts add up to more than the part of their sum
        blocks = heads.groupBy("qid", "block").agg(bound.alias("bound"), F.count_distinct("term").alias("met"), F.first("need").alias("need"))
        blocks = materialize(blocks.where("met = need").drop("met", "need") if every else blocks.drop("met", "need"), "bounds")
        of_term = asked.groupBy("term").agg(F.collect_list(F.struct("q", "weight", "need")).alias("asks"))  # at most the queries
        of_term = broadcast_if_small(materialize(of_term, "asks"), 200_000)

        final = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "block", "doc")

        def scored(chosen: DataFrame) -> DataFrame:
            """(qid, block, doc, id, score): the ``k`` best documents of the chosen (qid, block)."""
            # posting rows meet by block, are scored there, and only a block's best documents leave it
            here = chosen.join(broadcast_if_small(numbers), "qid").groupBy("block").agg(F.collect_set("q").alias("qs"))
            dead, out = self._dead(), None
            if dead is not None:
                out = dead.select("block", "doc")
            if facet is not None:
                other = self.documents().where(~F.col("facet").eqNullSafe(F.lit(facet))).select("block", "doc")
                out = other if out is None else out.unionByName(other)
            here = here.withColumn("out", F.array().cast("array<int>")) if out is None else here.join(
                out.groupBy("block").agg(F.collect_set("doc").alias("out")), "block", "left").withColumn("out", F.coalesce("out", F.array().cast("array<int>")))  # of one block
            here = here.join(self._postings().where(F.col("bucket") == DOCS).select("block", "ids", "lens"), "block")
            posts = self._of(held, "docs", "ends").join(broadcast_if_small(chosen.select("block").distinct()), "block", "left_semi").join(of_term, "term")
            score = _score_block(k if allowed is None else None, every, mean)
            found = posts.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(score, f"q long, block long, doc int, id {self.id_type}, score long")
            found = found.join(broadcast_if_small(numbers), "q").drop("q")
            if allowed is not None:
                found = found.join(allowed, ["qid", "block", "doc"], "left_semi")
            return materialize(found.withColumn("r", F.row_number().over(final)).where(F.col("r") <= k).drop("r"), "scored")

        promising = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
        first = blocks.withColumn("r", F.row_number().over(promising)).where(F.col("r") <= FIRST).select("qid", "block")
        first = materialize(first, "first")
        early = scored(first)
        least = early.withColumn("r", F.row_number().over(final)).where(F.col("r") == k).select("qid", F.col("score").alias("least"))
        rest = blocks.join(broadcast_if_small(first), ["qid", "block"], "left_anti").join(broadcast_if_small(least), "qid", "left")
        late = scored(materialize(rest.where("least is null or bound >= least").select("qid", "block"), "rest"))
        found = early.unionByName(late).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        return found.select("qid", "rank", "id", (F.col("score") / F.lit(float(UNIT))).alias("score"))

    # -- places -------------------------------------------------------------------------------------------------------------------

    def _places(self, asked: DataFrame) -> DataFrame:
        """(qid, block, doc, need, at): for documents that hold all ``need`` terms of a query, the places of each: at is an array of (t, places).

        ``asked``: (qid, t, term), t numbering the query's terms from 0. The rarest term's documents are found first, and of the other terms'
        postings only those in such documents are shuffled.
        """
        if not self.places:
            raise ValueError(f"{self.path} stores no places")
        df = broadcast_if_small(materialize(self.frequencies(asked), "df"))
        need = Window.partitionBy("qid")
        terms = asked.join(df, "term", "left").withColumn("need", F.count(F.lit(1)).over(need)).withColumn("known", F.count("df").over(need)).where("known = need")
        terms = materialize(terms.withColumn("r", F.row_number().over(need.orderBy("df", "t"))).select("qid", "t", "term", "need", "r"), "terms")
        post = F.transform("docs", lambda d, i: F.struct(d.alias("doc"), _places_of("places", "ends", i).alias("places")))
        rows = self._of(terms, "docs", "ends", "places").join(broadcast_if_small(terms), "term").select("qid", "t", "block", "need", "r", F.explode(post).alias("p"))
        rows = rows.select("qid", "t", "block", "need", "r", "p.doc", "p.places")
        rare = rows.where("r = 1").select("qid", "block", "doc")
        dead = self._dead()
        if dead is not None:
            rare = rare.join(broadcast_if_small(dead.select("block", "doc")), ["block", "doc"], "left_anti")
        rare = broadcast_if_small(materialize(rare.distinct(), "rare"))
        met = rows.join(rare, ["qid", "block", "doc"], "left_semi").groupBy("qid", "block", "doc")
        found = met.agg(F.first("need").alias("need"), F.count_distinct("t").alias("n"), F.collect_list(F.struct("t", "places")).alias("at"))  # of one document
        return found.where("n = need").drop("n")

    def near(self, asked: DataFrame, distance: int) -> DataFrame:
        """(qid, block, doc, gap): documents where all terms of a query stand with at most ``distance`` tokens between the first and the last.

        ``gap`` is the least number of tokens in between. ``asked``: (qid, term), distinct.
        """
        numbered = asked.select("qid", "term", (F.row_number().over(Window.partitionBy("qid").orderBy("term")) - 1).alias("t"))
        found = self._places(numbered).select("qid", "block", "doc", least_window(F.col("at"), F.col("need")).alias("span"))
        return found.select("qid", "block", "doc", (F.col("span") - 1).alias("gap")).where(F.col("gap") <= distance)

    def phrases(self, queries: DataFrame, query_id: str = "qid", query_text: str = "text") -> DataFrame:
        """(qid, block, doc, times): documents in which a query's tokens stand one after the other, and how often. Queries without tokens have none."""
        t = analyzer.tokens(F.col(query_text), self.analyzer)
        asked = queries.select(F.col(query_id).alias("qid"), F.posexplode(t).alias("t", "token"))
        numbered = materialize(asked.select("qid", "t", analyzer.term_of(F.col("token"), self.analyzer).alias("term")), "phrase")
        # where the phrase would begin, from each of its words; in all of them, it does
        begins = lambda at: F.transform(at, lambda x: F.transform(x["places"], lambda p: p - x["t"]))
        word = lambda at, t: F.flatten(F.transform(F.filter(at, lambda x: x["t"] == t), lambda x: F.transform(x["places"], lambda p: p - x["t"])))
        # the first word's beginnings, narrowed by every further word: arrays of one document
        narrowed = F.aggregate(F.sequence(F.lit(0), F.col("need") - 1), F.flatten(begins(F.col("at"))), lambda a, k: F.array_intersect(a, word(F.col("at"), k.cast("int"))))
        return self._places(numbered).select("qid", "block", "doc", F.size(narrowed).alias("times")).where("times > 0")

    def snippets(self, hits: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SNIPPET) -> DataFrame:
        """``hits`` (qid, id, query) with ``snippet``: the ``width`` tokens of the text that hold the most of the query's terms, then the most of their
        occurrences, the earliest first; hits in ``**``, `` … `` where text is left out, white space as single spaces.

        The hits' texts alone are analysed. ``docs`` has one row an id.
        """
        keys = broadcast_if_small(hits, 200_000)
        rows = docs.select(F.col(id_col).cast(self.id_type).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).join(keys, "id")
        body = F.lower("body") if self.analyzer == analyzer.PLAIN else F.col("body")
        rows = materialize(rows.select(*hits.columns, "body", analyzer.tokens(F.col("body"), self.analyzer).alias("t"), F.split(body, analyzer.TOKEN[self.analyzer], -1).alias("between")), "texts")
        words = rows.select("query", F.explode(analyzer.tokens(F.col("query"), self.analyzer)).alias("token")).distinct()
        terms = words.select("query", analyzer.term_of(F.col("token"), self.analyzer).alias("term")).groupBy("query").agg(F.collect_set("term").alias("terms"))
        tokens = rows.select(F.explode(F.array_distinct("t")).alias("token")).distinct().withColumn("term", analyzer.term_of(F.col("token"), self.analyzer))
        at = rows.select("qid", "id", "query", F.posexplode("t").alias("place", "token")).join(tokens, "token").join(terms, "query")
        at = at.where(F.array_contains("terms", F.col("term"))).groupBy("qid", "id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("hits"))  # of one document
        rows = rows.join(at, ["qid", "id"], "left").withColumn("start", F.coalesce(best_window("hits", F.lit(width)), F.lit(0)))
        n = F.size("t")
        # a window at the end of the text begins earlier, so that it is full
        rows = rows.withColumn("start", F.greatest(F.least("start", n - width), F.lit(0)))
        hit = lambda i: F.exists(F.coalesce("hits", F.array().cast("array<struct<place:int,term:string>>")), lambda h: h["place"] == i)
        shown = lambda t, i: F.concat(F.when(i == 0, "").otherwise(F.get("between", F.col("start") + i)), F.when(hit(F.col("start") + i), F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t))
        text = F.array_join(F.transform(F.slice("t", F.col("start") + 1, F.lit(width)), shown), "")
        text = F.concat(F.when(F.col("start") > 0, " … ").otherwise(""), text, F.when(F.col("start") + width < n, " … ").otherwise(""))
        return rows.select(*hits.columns, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("snippet"))


def _score_block(k: int | None, every: bool, mean: float):  # noqa: ANN202
    """Scores of one block's documents for the queries that chose it: the ``k`` best of each, equal ones by id, or all."""

    def run(posts: pa.Table, here: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("id", here.schema.field("ids").type.value_type), ("score", pa.int64())])
        if not posts.num_rows or not here.num_rows:
            return schema.empty_table()
        ids = here.column("ids")[0].values
        wanted, out = set(here.column("qs")[0].as_py()), np.array(here.column("out")[0].as_py(), np.int64)
        lens = here.column("lens")[0].values.to_numpy(zero_copy_only=False).astype(np.float64)
        # the postings of all rows one after the other
        flat = lambda c: posts.column(c).combine_chunks()
        docs, asked, ends = flat("docs"), flat("asks"), np.asarray(flat("ends").flatten())
        doc, cuts = np.asarray(docs.flatten()), np.asarray(docs.offsets) - docs.offsets[0].as_py()
        tf, first = np.diff(ends, prepend=0), cuts[:-1]  # no posting row is empty
        tf[first] = ends[first]
        size = len(lens)
        rows: dict[str, list[slice]] = {}
        asks: dict[int, list[tuple[str, float]]] = {}
        needs: dict[int, int] = {}
        of_ask = asked.flatten()
        q_of, weight_of, need_of = (of_ask.field(c).to_pylist() for c in ("q", "weight", "need"))
        begin = (np.asarray(asked.offsets) - asked.offsets[0].as_py()).tolist()
        for i, name in enumerate(flat("term").to_pylist()):
            if name not in rows:
                rows[name] = []
                for j in range(begin[i], begin[i + 1]):
                    if q_of[j] in wanted:
                        asks.setdefault(q_of[j], []).append((name, weight_of[j]))
                        needs[q_of[j]] = need_of[j]
            rows[name].append(slice(int(cuts[i]), int(cuts[i + 1])))
        over, under = tf * (K1 + 1), tf + K1 * (1 - B + B * lens[doc] / mean)
        tokens: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for name, at in rows.items():
            if len(at) == 1:
                tokens[name] = doc[at[0]], over[at[0]], under[at[0]]
            else:  # several tokens of one term
                d, place = np.unique(np.concatenate([doc[x] for x in at]), return_inverse=True)
                n = np.bincount(place, np.concatenate([tf[x] for x in at]))
                tokens[name] = d, n * (K1 + 1), n + K1 * (1 - B + B * lens[d] / mean)
        parts_of: dict[tuple[str, float], np.ndarray] = {}  # most queries give a term the same weight
        gone = np.zeros(size, bool)
        gone[out[out < size]] = True
        block, found = posts.column("block")[0].as_py(), []
        for q, terms in asks.items():
            total, met = np.zeros(size, np.int64), np.zeros(size, np.int32 if every else bool)
            for key in terms:
                d, over, under = tokens[key[0]]
                if key not in parts_of:
                    parts_of[key] = np.floor(key[1] * over / under * UNIT + 0.5).astype(np.int64)
                total[d] += parts_of[key]
                met[d] = met[d] + 1 if every else True
            docs = np.flatnonzero((met == needs[q] if every else met) & ~gone)
            if k is not None and len(docs) > k:
                least = np.partition(total[docs], len(docs) - k)[len(docs) - k]
                docs = docs[total[docs] >= least]
            if k is not None and len(docs) > k:
                tied = pa.table({"s": total[docs], "id": ids.take(pa.array(docs)), "d": docs})
                order = pc.sort_indices(tied, sort_keys=[("s", "descending"), ("id", "ascending"), ("d", "ascending")], null_placement="at_start")
                docs = docs[order.to_numpy()[:k]]
            found.append((np.full(len(docs), q), docs, total[docs]))
        if not found:
            return schema.empty_table()
        q, docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.array(q, pa.int64()), pa.array(np.full(len(q), block), pa.int64()), pa.array(docs, pa.int32()), ids.take(pa.array(docs)), pa.array(scores, pa.int64())], schema=schema)

    return run


def _times(ends: str, i: Column) -> Column:
    """How often the i-th document of a posting row holds the term."""
    return F.get(ends, i) - F.when(i > 0, F.get(ends, i - 1)).otherwise(0)


def _places_of(places: str, ends: str, i: Column) -> Column:
    return F.slice(places, F.when(i > 0, F.get(ends, i - 1)).otherwise(0) + 1, _times(ends, i))


def least_window(at: Column, need: Column) -> Column:
    """Of sorted places of several terms - an array of (t, places) - how far the first and last of the shortest stretch that holds all lie apart.

    A sweep over the places in order, which keeps each term's last one; linear in the places.
    """
    events = F.array_sort(F.flatten(F.transform(at, lambda x: F.transform(x["places"], lambda p: F.struct(p.alias("p"), x["t"].alias("t"))))))
    none = F.lit(-1)
    start = F.struct(F.array_repeat(none, need.cast("int")).alias("last"), F.lit(2**31 - 1).alias("best"))

    def step(state: Column, e: Column) -> Column:
        last = F.transform(state["last"], lambda v, i: F.when(i == e["t"], e["p"]).otherwise(v))
        # an array of one, so that it is computed once
        return F.get(F.transform(F.array(last), lambda x: F.struct(x.alias("last"), F.when(F.array_min(x) >= 0, F.least(state["best"], e["p"] - F.array_min(x) + 1)).otherwise(state["best"]).alias("best"))), F.lit(0))

    return F.aggregate(events, start, step)["best"] - 1


def best_window(hits: str, width: Column) -> Column:
    """Of sorted hits (place, term), the place from which ``width`` places hold the most different terms, then the most hits; the earliest first.

    A window begins at a hit and holds at most ``width`` hits, so only so many behind each are looked at.
    """
    h = F.col(hits)
    at = F.transform(h, lambda x: x["place"])
    value = lambda i: F.filter(F.slice(h, i + 1, width), lambda x: x["place"] < F.get(at, i) + width)  # noqa: E731  at most ``width`` hits fit
    of = lambda i: F.get(F.transform(F.array(value(i)), lambda w: F.struct(F.size(F.array_distinct(F.transform(w, lambda x: x["term"]))).alias("d"), F.size(w).alias("n"), (-F.get(at, i)).alias("s"))), F.lit(0))
    return -F.array_max(F.transform(F.sequence(F.lit(0), F.size(h) - 1), of))["s"]


def create(spark: SparkSession, path: str, *, kind: str = analyzer.PLAIN, buckets: int = 32, id_type: str = "long", places: bool = True) -> Index:
    """An empty index in a new folder; one without ``places`` ranks, but finds neither phrases nor terms near each other."""
    return Index(spark, path.rstrip("/"), -1, kind, buckets, id_type, places=places)._commit()


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The last version of an index, or the one asked for."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/manifest").orderBy(F.desc("version"))
    r = (rows if version is None else rows.where(F.col("version") == version)).first()
    if r is None:
        raise ValueError(f"no version {version} of {path}")
    return Index(spark, path.rstrip("/"), r["version"], r["analyzer"], r["buckets"], r["id_type"], tuple(tuple(s) for s in r["segments"]), tuple(r["gone"]), r["places"])
