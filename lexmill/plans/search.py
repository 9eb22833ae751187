"""Search as one call: BM25 candidates of a stored index, ranked anew by relevance, authority, depth and length together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import analyzer
from lexmill.operators.graph import authority_counts
from lexmill.operators.index import Index
from lexmill.operators.search import FUSION, FUSION_CONSTANT
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize

#: Candidates that are ranked anew, and what a word of a query is.
CANDIDATES = 200
QUERY_WORD = r"[0-9A-Za-z][0-9A-Za-z'\-]*"


def phrases_of(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(qid, text): the words of a query that the analyzer takes apart - with a hyphen or an apostrophe; their parts must stand together."""
    found = queries.select(F.col(query_id).alias("qid"), F.explode(F.regexp_extract_all(F.coalesce(F.col(query_text), F.lit("")), F.lit(QUERY_WORD), F.lit(0))).alias("text"))
    return found.where(F.col("text").rlike(r"[0-9A-Za-z]['\-]+[0-9A-Za-z]")).distinct()


def search(
    made: Index, queries: DataFrame, provisions: DataFrame, edges: DataFrame | None = None, *, query_id: str = "qid", query_text: str = "text", facet: str | None = None, limit: int = 10
) -> DataFrame:
    """(qid, rank, id, score): the ``limit`` best of each query, equal scores by ascending id.

    All words of a query must occur, the parts of a hyphenated word side by side. The ``CANDIDATES`` best by BM25 are ranked by relevance,
    by how many distinct nodes refer to them (``edges``: from_id, to_id; or to their section, ``owner``), by depth (shallow first) and
    by length (long first), equal ones by relevance; the weights over constant plus rank add up. ``provisions``: id, depth, length, one row an id, and
    owner if edges lead to sections. ``facet``: only documents of that facet, before candidates are cut. A query without words has no rows.
    """
    allowed = _together(made, queries, query_id, query_text)
    if allowed is None:
        hits = made.top(queries, CANDIDATES, query_id=query_id, query_text=query_text, every=True, facet=facet)
    else:
        bound, free = allowed
        hits = made.top(free, CANDIDATES, query_id=query_id, query_text=query_text, every=True, facet=facet)
        hits = hits.unionByName(made.top(queries.join(free.select(query_id), query_id, "left_anti"), CANDIDATES, query_id=query_id, query_text=query_text, every=True, facet=facet, allowed=bound))
    hits = broadcast_if_small(materialize(hits, "hits"))
    owner = F.col("owner") if "owner" in provisions.columns else F.col("id")
    rows = provisions.select(owner.alias("owner"), "id", "depth", "length").join(hits.drop("score"), "id")
    if edges is not None:
        wanted = broadcast_if_small(rows.select("owner").distinct())
        counts = authority_counts(edges.join(wanted, F.col("to_id") == F.col("owner"), "left_semi")).withColumnRenamed("to_id", "owner")
        rows = rows.join(counts, "owner", "left").withColumn("n_from", F.coalesce("n_from", F.lit(0)))
    else:
        rows = rows.withColumn("n_from", F.lit(0))
    orders = {"relevance": [F.col("rank")], "authority": [F.desc("n_from"), F.col("rank")], "depth": [F.col("depth"), F.col("rank")], "length": [F.desc("length"), F.col("rank")]}
    places = {f"by_{name}": F.row_number().over(Window.partitionBy("qid").orderBy(*order)) for name, order in orders.items()}  # at most CANDIDATES rows a query
    score = reduce(lambda a, name: a + FUSION[name] / (FUSION_CONSTANT + F.col(f"by_{name}")), ("authority", "depth", "length"), FUSION["relevance"] / (FUSION_CONSTANT + F.col("by_relevance")))
    rows = rows.withColumns(places).withColumn("score", F.round(score, 9))
    final = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", final).where(F.col("rank") <= limit).select("qid", "rank", "id", "score")


def _together(made: Index, queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame] | None:
    """(documents allowed to queries with phrases, queries without), or None if no query has one."""
    asked = materialize(phrases_of(queries, query_id, query_text), "phrases")
    if asked.isEmpty() or not made.segments:
        return None
    numbered = asked.withColumn("key", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    found = made.phrases(numbered, "key", "text").join(numbered.select(F.col("key").alias("qid"), F.col("qid").alias("of")), "qid")
    need = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    met = found.groupBy(F.col("of").alias("qid"), "block", "doc").agg(F.count(F.lit(1)).alias("n")).join(need, "qid").where("n = need")
    free = queries.join(asked.select(F.col("qid").alias(query_id)).distinct(), query_id, "left_anti")
    return materialize(met.select("qid", "block", "doc"), "allowed"), free


def with_headings(found: DataFrame, provisions: DataFrame) -> DataFrame:
    """With ``heading``: a provision's own, or else its section's. ``provisions``: id, owner (its section's id), heading."""
    own = provisions.select("id", "owner", "heading")
    section = provisions.select(F.col("id").alias("owner"), F.col("heading").alias("section_heading"))
    rows = found.join(own, "id", "left").join(section, "owner", "left")
    return rows.select(*found.columns, F.coalesce("heading", "section_heading").alias("heading"))


def find_definitions(made: Index, asked: DataFrame, definitions: DataFrame) -> DataFrame:
    """(ask, term_norm) of the terms that a question's words lead to: the term itself where it is defined, or else the terms of an index of distinct
    terms that hold all its words, best first by BM25, at most ``CANDIDATES``. ``asked``: ask, term_norm; ``made``: an index whose ids are terms.
    """
    terms = definitions.select("term_norm").distinct()
    exact = asked.join(terms, "term_norm", "left_semi").select("ask", "term_norm", F.lit(1).alias("rank"))
    open_ = materialize(asked.join(terms, "term_norm", "left_anti"), "open")
    more = made.top(open_, CANDIDATES, query_id="ask", query_text="term_norm", every=True)
    return exact.unionByName(more.select(F.col("qid").alias("ask"), F.col("id").alias("term_norm"), "rank"))
