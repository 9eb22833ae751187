"""Inverted index, BM25, rank fusion, rare tokens, proximity and phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.index import least_window
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize

K1, B = 1.2, 0.75
#: Fusion weights by ranking and the constant added to ranks.
FUSION, FUSION_CONSTANT = {"relevance": 1.0, "authority": 1.0, "depth": 1.5, "length": 1.0}, 10


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, dl): one row per document and distinct term; documents without tokens have none."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k: int) -> DataFrame:
    """(id, score): the ``k`` best documents that hold every term. Only query terms leave the scan; ties by id."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    # one pass per document: no posting list of the whole vocabulary is built for one query
    counts = [_count(F.col("t"), q) for q in terms]
    row = t.select("id", F.size("t").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(counts)])
    stats = row.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    everything = F.lit(True)
    from math import log

    for i in range(len(terms)):
        n, df = stats["n"], stats[f"df{i}"] or 0
        idf = max(log((n - df + 0.5) / (df + 0.5)), 1e-6) if n else 0.0
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (stats["avgdl"] or 1.0)))
        everything = everything & (tf > 0)
    return row.where(everything).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _count(array: Column, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term))


def fuse(hits: DataFrame, id_col: str, rankings: dict[str, tuple[float, list[Column]]], k: int) -> DataFrame:
    """Reciprocal-rank fusion of a bounded candidate set (a search's first few hundred): sum of weight / (constant + rank)."""
    total = F.lit(0.0)
    rows = hits
    for name, (weight, order) in rankings.items():
        rows = rows.withColumn(f"__{name}", F.row_number().over(Window.orderBy(*order)))
        total = total + weight / (FUSION_CONSTANT + F.col(f"__{name}"))
    return rows.select(id_col, F.round(total, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def rare_tokens(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, term, df, rank): each query's ``k`` rarest tokens that the corpus has; ties by longer, then text."""
    q = queries.select(F.col(q_id).alias("q"), F.explode(F.array_distinct(tokens(F.col(q_text)))).alias("term"))
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("q").orderBy("df", F.desc(F.length("term")), "term")
    return q.join(df, "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "term", "df", "rank")


def near(docs: DataFrame, id_col: str, text_col: str, a: str, b: str, distance: int) -> DataFrame:
    """Ids of documents where ``a`` and ``b`` stand within ``distance`` tokens, with the least distance; one pass over their places in order."""
    t = tokens(F.col(text_col))
    places = lambda arr, w: F.filter(F.transform(arr, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    rows = docs.select(F.col(id_col).alias("id"), t.alias("t")).where(F.array_contains("t", a) & F.array_contains("t", b))
    at = F.array(*[F.struct(F.lit(k).alias("t"), places(F.col("t"), w).alias("places")) for k, w in enumerate((a, b))])
    return rows.select("id", least_window(at, F.lit(2)).alias("gap")).where(F.col("gap") <= distance)


def longest_prefixes(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, text_col: str) -> DataFrame:
    """(id, longest): the most of a query's first words that stand together in some document; queries without one have no row.

    Prefixes of every length join the documents' runs by equality of (length, hash). Only runs whose first two words begin a query are
    followed, each distinct one once.
    """
    q = queries.select(F.col(q_id).alias(q_id), tokens(F.col(q_text)).alias("t")).where(F.size("t") > 0)
    prefix = lambda t, n: F.xxhash64(F.slice(t, F.lit(1), n))
    nodes = q.select(q_id, F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda n: F.struct(n.alias("n"), prefix(F.col("t"), n).alias("g")))).alias("x")).select(q_id, "x.*")
    longest = q.agg(F.max(F.size("t"))).first()[0] or 0
    d = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), tokens(F.col(text_col)).alias("t")), "tokens")
    words = d.select(F.explode(F.array_distinct("t")).alias("w")).select(F.lit(1).alias("n"), F.xxhash64(F.array("w")).alias("g"))
    words = words.join(broadcast_if_small(nodes.where("n = 1").select("g").distinct()), "g", "left_semi").select("n", "g").distinct()
    begins = broadcast_if_small(nodes.where("n = 2").select("g").distinct())
    spots = d.select("rid", F.posexplode(F.transform("t", lambda x, i: F.xxhash64(F.slice("t", i + 1, 2)))).alias("i", "g"))  # noqa: ARG005
    spots = spots.join(begins, "g", "left_semi").groupBy("rid").agg(F.collect_list("i").alias("at"))
    runs = d.join(spots, "rid").select(F.explode(F.transform("at", lambda i: F.slice("t", i + 1, longest))).alias("t")).distinct()
    runs = runs.where(F.size("t") > 1).select(F.explode(F.transform(F.sequence(F.lit(2), F.size("t")), lambda n: F.struct(n.alias("n"), prefix(F.col("t"), n).alias("g")))).alias("x"))
    known = broadcast_if_small(nodes.where("n > 1").select("n", "g").distinct())
    met = runs.select("x.*").join(known, ["n", "g"], "left_semi").distinct().unionByName(words)
    return nodes.join(met, ["n", "g"]).groupBy(q_id).agg(F.max("n").alias("longest"))


#: Words of a run by which documents are proposed for a phrase.
RUN = 3


def phrase_counts(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_docs): in how many documents each query's text stands, letter case and widths of white space aside.

    A phrase may begin and end within a word, but its inner words are whole ones of the document. So a document is proposed by
    the rarest run of (up to RUN) inner words, by equality, and confirmed on the text; phrases without an inner word meet every document.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    q = queries.select(q_id, flat(F.col(q_text)).alias("needle"))
    each = q.where("needle is not null").select("needle").distinct()
    inner = F.split("needle", " ", -1)
    each = each.withColumn("t", F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))).withColumn("k", F.least(F.size("t"), F.lit(RUN)))
    runs = lambda t, k: F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.xxhash64(F.slice(t, i, k)))
    of = each.where("k > 0").select("needle", F.explode(F.array_distinct(runs(F.col("t"), F.col("k")))).alias("g"))
    lengths = [r["k"] for r in each.where("k > 0").select("k").distinct().collect()]  # at most RUN
    d = docs.select(F.col(id_col).alias("id"), flat(F.col(text_col)).alias("text")).where("text is not null and id is not null")
    of_text = lambda t: F.flatten(F.array(*[F.when(F.size(t) >= k, runs(t, F.lit(k))).otherwise(F.array().cast("array<bigint>")) for k in lengths]))
    # an array of one, so that the text is split once and not for each run
    own = F.array_distinct(F.flatten(F.transform(F.array(F.split("text", " ", -1)), of_text))) if lengths else F.array().cast("array<bigint>")
    seen = d.select(F.explode(own).alias("g")).join(broadcast_if_small(of.select("g").distinct()), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    best = of.join(seen, "g", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("b"))
    best = broadcast_if_small(materialize(best.where("b.df > 0").select("needle", F.col("b.g").alias("g")), "phrases"))
    near = d.select("text", F.explode(own).alias("g")).join(best, "g").where(F.contains("text", F.col("needle"))).select("needle")
    short = d.join(broadcast_if_small(each.where("k = 0").select("needle")), F.contains("text", F.col("needle"))).select("needle")
    counts = near.unionByName(short).groupBy("needle").agg(F.count(F.lit(1)).alias("n"))
    return q.join(counts, "needle", "left").groupBy(q_id).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))
