"""Queries of the stored index, the analyzer and the terms of texts, and their SQL. The plain analyzer's tokens are what SQL can find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import analyzer
from lexmill.operators import containment, index
from lexmill.plans import quotes, search
from lexmill.plans.scratch import folder
from lexmill.session import table


def _documents(spark: SparkSession, sf: str, kind: str = analyzer.PLAIN, places: bool = True) -> index.Index:
    """The documents' index in two segments, English texts and others, without those that are labelled toxic."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    english = F.col("lang").eqNullSafe(F.lit("en"))
    made = index.create(spark, folder(spark, "index"), kind=kind, places=places)
    made = made.add(docs.where(english), facet_col="source").add(docs.where(~english), facet_col="source")
    return made.delete(table(spark, sf, "labels").where("toxic = 1").select("doc_id"))


def index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item by BM25 over any of its words."""
    found = _documents(spark, sf, places=False).top(table(spark, sf, "benchmark"), 10, query_id="item_id")
    return found.select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 5).alias("score"))


def index_near(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in which the four rarest words of an item, of four letters or more, stand with at most twelve words between."""
    made = _documents(spark, sf)
    rare = made.rare_terms(table(spark, sf, "benchmark"), "item_id", "text", 4, 4)
    found = made.near(rare.select("qid", "term"), 12)
    return found.join(made.documents().select("block", "doc", "id"), ["block", "doc"]).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "gap")


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search for the first two words of every item: documents that hold both, ranked by relevance, authority, depth and length together."""
    docs = table(spark, sf, "documents")
    head = F.array_join(F.slice(analyzer.tokens(F.col("text")), 1, 2), " ")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), head.alias("text"))
    provisions = docs.select(F.col("doc_id").alias("id"), F.size(F.split("text", "\n")).alias("depth"), F.length("text").alias("length"))
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"))
    found = search.search(_documents(spark, sf), queries, provisions, edges, limit=10)
    return found.select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def stem_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents with its stem and its number of documents."""
    return analyzer.dictionary(table(spark, sf, "documents"), "doc_id", "text").select("token", "term", "n_docs")


def item_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The best document of every item by stems, with the 28 words that hold most of the item."""
    made = _documents(spark, sf, analyzer.STEMMED, places=False)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    best = made.top(items, 1, query_text="query").join(items, "qid").select("qid", "id", "query", F.round("score", 5).alias("score"))
    out = made.snippets(best, table(spark, sf, "documents").select("doc_id", "text"))
    return out.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "score", "snippet")


def terms_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Which of all words and pairs of words of the benchmark each document uses."""
    t = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    words = table(spark, sf, "benchmark").select(t.alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.get("t", i - 1), F.get("t", i)))).otherwise(F.array().cast("array<string>"))
    terms = words.select(F.explode(F.concat("t", pairs)).alias("term"))
    return containment.term_summary(table(spark, sf, "documents"), terms)


def altered_quotations(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds a benchmark item, of which each eighth word is quoted without its first letter."""
    said = F.regexp_replace("text", r"((?:\S+\s+){7})\S(\S+)", "$1$2")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("ask"), said.alias("quote"))
    found = quotes.altered_quotes(asked, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("ask").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (index_topk, index_near, index_search, stem_dictionary, item_snippets, terms_in_documents, altered_quotations)
}

_LIVE = """d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(w)) AS DOUBLE) / count(*) AS mean FROM d),
p AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(k) AS k FROM (SELECT rid, doc_id, len(w) AS k, unnest(w) AS term FROM d) GROUP BY rid, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def _ranked(asked: str, every: bool) -> str:
    return f"""{_LIVE},
q AS (SELECT item_id, term, count(*) AS c FROM ({asked}) GROUP BY item_id, term),
h AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, count(*) AS met, CAST(sum(CAST(round(1000000000 * (c * greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6)
    * (tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * k / mean)))) AS BIGINT)) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, rid),
b AS (SELECT h.* FROM h{" JOIN (SELECT item_id, count(*) AS need FROM q GROUP BY item_id) n ON n.item_id = h.item_id AND need = met" if every else ""})"""


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
ORACLES: dict[str, str] = {
    "index_topk": f"""WITH {_ranked(f"SELECT item_id, unnest({_WORDS}) AS term FROM benchmark", False)}
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score / 1e9, 5) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 10""",
    "index_near": f"""WITH {_LIVE},
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
r AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS k FROM q JOIN f USING (term) WHERE length(term) >= 4) WHERE k <= 4),
e AS (SELECT rid, doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM d),
x AS (SELECT item_id, term, rid, doc_id, i FROM r JOIN e USING (term)),
n AS (SELECT item_id, count(*) AS need FROM r GROUP BY item_id),
m AS (SELECT item_id, rid FROM x JOIN n USING (item_id) GROUP BY item_id, rid, need HAVING count(DISTINCT term) = need),
c AS (
  SELECT a.item_id, a.rid, any_value(a.doc_id) AS doc_id, a.i, y.term, min(y.i) AS j
  FROM x a JOIN m USING (item_id, rid) JOIN x y ON y.item_id = a.item_id AND y.rid = a.rid AND y.i >= a.i AND y.i <= a.i + 13 GROUP BY a.item_id, a.rid, a.i, y.term)
SELECT item_id, any_value(doc_id) AS doc_id, CAST(min(span) - 1 AS INTEGER) AS gap
FROM (SELECT item_id, rid, any_value(doc_id) AS doc_id, max(j) - i AS span FROM c JOIN n USING (item_id) GROUP BY item_id, rid, i, need HAVING count(*) = need)
GROUP BY item_id, rid""",
    "index_search": f"""WITH {_ranked(f"SELECT item_id, unnest({_WORDS}[1:2]) AS term FROM benchmark", True)},
a AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS n_from FROM lineitem GROUP BY l_partkey),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r1 FROM b) WHERE r1 <= 200),
v AS (
  SELECT t.*, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n_from, 0) DESC, r1) AS r2, row_number() OVER (PARTITION BY item_id ORDER BY len(string_split(text, chr(10))), r1) AS r3,
    row_number() OVER (PARTITION BY item_id ORDER BY length(text) DESC, r1) AS r4
  FROM t JOIN d ON d.rid = t.rid LEFT JOIN a ON a.id = t.doc_id),
u AS (SELECT item_id, doc_id, round(1e0 / (10 + r1) + 1e0 / (10 + r2) + 1.5e0 / (10 + r3) + 1e0 / (10 + r4), 9) AS score FROM v)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM u) WHERE rank <= 10""",
    "terms_in_documents": """WITH w AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS t FROM benchmark),
t AS (
  SELECT DISTINCT term FROM (SELECT unnest(t) AS term FROM w UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM w)
  WHERE length(term) >= 3),
d AS (
  SELECT doc_id, lower(text) AS body, regexp_replace(lower(text), '([^\\x00-\\x2F\\x3A-\\x5E\\x60\\x7B-\\x7F]+)', chr(1) || '\\1' || chr(1), 'g') AS cut
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT *, list_transform(list_filter(range(1, length(pat)), lambda k: pat[1:k] = pat[length(pat) - k + 1:length(pat)] AND pat[1:k] <> chr(1)), lambda k: pat || pat[k + 1:length(pat)]) AS laps
  FROM (SELECT term, length(term) < 6 AS whole, CASE WHEN length(term) < 6 THEN regexp_replace(term, '([a-z]+)', chr(1) || '\\1' || chr(1), 'g') ELSE term END AS pat FROM t)),
x AS (
  SELECT doc_id, term, CASE WHEN len(list_filter(laps, lambda o: contains(hay, o))) > 0 THEN len(list_filter(range(1, length(hay) - length(pat) + 2), lambda i: hay[i:i + length(pat) - 1] = pat))
    ELSE (length(hay) - length(replace(hay, pat, ''))) // length(pat) END AS n
  FROM (SELECT doc_id, term, pat, laps, CASE WHEN whole THEN cut ELSE body END AS hay FROM d JOIN s ON contains(CASE WHEN whole THEN cut ELSE body END, pat)))
SELECT doc_id, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_places, min_by(term, {'k': -length(term), 't': term}) AS longest FROM x GROUP BY doc_id""",
}
