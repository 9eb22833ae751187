"""Every query over the driver's tables by name, and its SQL.

The tables hold no legal text, so provisions, edges and citations are derived from keys: an order is a section, a line of it a
subdivision, lines refer from parts to suppliers. Small dimensions are inline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill import history_queries, index_queries
from lexmill.functions import cite, definitions, ids
from lexmill.operators import authority, fuzzy, graph, lookup, models, search, spans, temporal, versions
from lexmill.plans import quotes, verify
from lexmill.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = index_queries.QUERIES | history_queries.QUERIES
ORACLES: dict[str, str] = index_queries.ORACLES | history_queries.ORACLES


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def inline(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as provisions: id, section, path."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("section"),
        F.array(F.char(97 + F.col("l_linenumber") % 26), F.col("l_partkey").cast("string")).alias("path"), "l_quantity", "l_linenumber", "l_partkey",
    )
    return rows.withColumn("id", ids.id_col(F.col("section"), F.col("path")))


_ID = "'/us/usc/t26/s' || l_orderkey || '/' || chr(CAST(97 + l_linenumber % 26 AS INTEGER)) || '/' || l_partkey"


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42")
def lookup_pk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_partkey = 42").select("p_partkey", "p_name", "p_brand")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal FROM lineitem")
def children_ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lookup.with_ordinal(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query(f"SELECT {_ID} AS id, '§ ' || l_orderkey || '(' || chr(CAST(97 + l_linenumber % 26 AS INTEGER)) || ')(' || l_partkey || ')' AS display FROM lineitem")
def path_id_build(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.aggregate("path", F.concat(F.lit("§ "), "section"), lambda a, t: F.concat(a, F.lit("("), t, F.lit(")")))
    return sections(spark, sf).select("id", shown.alias("display"))


@query(
    f"SELECT id, array_to_string(string_split(id, '/')[1:5], '/') AS section_id, array_to_string(string_split(id, '/')[1:6], '/') AS parent_id FROM (SELECT {_ID} AS id FROM lineitem)"
)
def path_id_split_parent(spark: SparkSession, sf: str) -> DataFrame:
    return sections(spark, sf).select("id", ids.section_of(F.col("id")).alias("section_id"), ids.parent_of(F.col("id")).alias("parent_id"))


@query(f"SELECT id, l_quantity FROM (SELECT {_ID} AS id, l_quantity FROM lineitem) WHERE starts_with(id, '/us/usc/t26/s7/')")
def prefix_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.subtree(sections(spark, sf), "id", "/us/usc/t26/s7").select("id", "l_quantity")


@query(
    f"""WITH RECURSIVE t AS (SELECT DISTINCT {_ID} AS id FROM lineitem), a AS (
    SELECT id, id AS ancestor FROM t UNION ALL
    SELECT id, array_to_string(string_split(ancestor, '/')[1:len(string_split(ancestor, '/')) - 1], '/') FROM a WHERE len(string_split(ancestor, '/')) > 5)
    SELECT id, ancestor, len(string_split(ancestor, '/')) - 5 AS depth FROM a"""
)
def recursive_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.ancestors(sections(spark, sf).select("id").distinct(), "id")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("s"), "l_linenumber")
    back = F.col("l_linenumber") % 2 == 0
    return rows.select(F.when(back, F.col("s")).otherwise(F.col("p")).alias("from_id"), F.when(back, F.col("p")).otherwise(F.col("s")).alias("to_id"))


_EDGES = """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS from_id,
 CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS to_id FROM lineitem"""


@query(
    f"""WITH e AS (SELECT DISTINCT * FROM ({_EDGES})), d0 AS (SELECT 'p1' AS node), d1 AS (SELECT DISTINCT to_id AS node FROM e JOIN d0 ON from_id = node),
    d2 AS (SELECT DISTINCT to_id AS node FROM e JOIN d1 ON from_id = node),
    a AS (SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2)
    SELECT 'p1' AS seed, node, min(depth) AS depth FROM a GROUP BY node"""
)
def closure_bfs_depth2(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(_edges(spark, sf), inline(spark, "id string", ("p1",)), 2)


@query(f"SELECT to_id, count(DISTINCT from_id) AS n_from FROM ({_EDGES}) GROUP BY to_id")
def authority_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.authority_counts(_edges(spark, sf))


@query(f"SELECT DISTINCT from_id, to_id, p_name FROM ({_EDGES}) LEFT JOIN (SELECT 'p' || p_partkey AS id, p_name FROM part WHERE p_partkey % 3 = 0) ON to_id = id")
def incoming_outgoing_left_join(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), "p_name")
    return graph.neighbours(_edges(spark, sf), parts, "to_id", "id", ["p_name"])


@query(
    f"""SELECT a, b FROM (SELECT id AS a, lead(id) OVER (ORDER BY id) AS b FROM (SELECT DISTINCT {_ID} AS id FROM lineitem))
    WHERE b IS NOT NULL AND array_to_string(string_split(a, '/')[1:5], '/') <> array_to_string(string_split(b, '/')[1:5], '/')"""
)
def anti_internal_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = sections(spark, sf).select("id").distinct()
    return graph.without_internal(lookup.successors(rows, "id"), "a", "b")


_OLD = "SELECT o_custkey AS k, o_orderpriority AS h, o_orderstatus AS t FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"
_NEW = _OLD.replace("<", ">=")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("h"), F.col("o_orderstatus").alias("t"), "o_orderkey", "o_orderdate")
    cut = F.lit("1995-06-01").cast("timestamp")
    halves = [o.where(c).drop("o_orderdate") for c in (F.col("o_orderdate") < cut, F.col("o_orderdate") >= cut)]
    return tuple(lookup.keep_first(h, ["k"], ["o_orderkey"]).drop("o_orderkey") for h in halves)  # type: ignore[return-value]


@query(
    f"""WITH b AS ({_OLD}), a AS ({_NEW}) SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed'
    WHEN b.t IS DISTINCT FROM a.t THEN 'changed' ELSE 'renamed' END AS change, b.t AS old, a.t AS new FROM b FULL JOIN a ON b.k = a.k
    WHERE b.k IS NULL OR a.k IS NULL OR b.t IS DISTINCT FROM a.t OR b.h IS DISTINCT FROM a.h"""
)
def full_outer_version_diff(spark: SparkSession, sf: str) -> DataFrame:
    return versions.compare_versions(*_halves(spark, sf), "k", "h", "t")


@query(f"SELECT 'removed' AS side, k FROM (SELECT k FROM ({_OLD}) EXCEPT SELECT k FROM ({_NEW})) UNION ALL SELECT 'added', k FROM (SELECT k FROM ({_NEW}) EXCEPT SELECT k FROM ({_OLD}))")
def set_difference_versions(spark: SparkSession, sf: str) -> DataFrame:
    b, a = _halves(spark, sf)
    gone, new = versions.missing_from(b, a, "k"), versions.missing_from(a, b, "k")
    return gone.select(F.lit("removed").alias("side"), "k").unionByName(new.select(F.lit("added").alias("side"), "k"))


_POINTS = [(f"{y}-{m:02d}", f"{y}-{m:02d}-15") for y in range(1992, 1999) for m in (1, 5, 9)]
_POINT_VALUES = ", ".join(f"('{r}', DATE '{d}')" for r, d in _POINTS)


@query(f"WITH p(release, enacted) AS (VALUES {_POINT_VALUES}) SELECT o_orderkey, release FROM orders ASOF LEFT JOIN p ON CAST(o_orderdate AS DATE) >= enacted")
def asof_release_point(spark: SparkSession, sf: str) -> DataFrame:
    points = inline(spark, "release string, enacted string", *_POINTS).withColumn("enacted", F.col("enacted").cast("date"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return temporal.asof_backward(orders, F.col("day"), points, F.col("enacted"), ["release"]).select("o_orderkey", "release")


_RATES = [("1994-01-01", 5.12), ("1995-03-01", 6.55), ("1996-07-01", 5.78)]


@query(
    "WITH r(month, rate) AS (VALUES " + ", ".join(f"(DATE '{m}', CAST({r} AS DOUBLE))" for m, r in _RATES) + ") SELECT o_orderkey, rate FROM orders LEFT JOIN r ON date_trunc('month', o_orderdate) = month"
)
def exact_month_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = inline(spark, "month string, rate double", *_RATES).select(F.col("month").cast("date").alias("month"), "rate")
    orders = table(spark, sf, "orders")
    return orders.join(rates, F.trunc("o_orderdate", "month") == F.col("month"), "left").select("o_orderkey", "rate")


_BANDS = [("low", 0.0, 10.0), ("mid", 5.0, 50.0), ("high", 50.0, 500.0)]


@query("WITH b(band, lo, hi) AS (VALUES " + ", ".join(f"('{b}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for b, lo, hi in _BANDS) + ") SELECT event_id, band FROM events JOIN b ON value >= lo AND value < hi")
def interval_point_in_range(spark: SparkSession, sf: str) -> DataFrame:
    bands = inline(spark, "band string, lo double, hi double", *_BANDS)
    events = table(spark, sf, "events").select("event_id", "value")
    return temporal.point_in_range(events, F.col("value"), bands, F.col("lo"), F.col("hi"), 25.0, ["band"]).select("event_id", "band")


@query(
    """SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS marker FROM events"""
)
def last_marker_before_offset(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(by)
    return table(spark, sf, "events").select("event_id", marker.alias("marker"))


_MISSES = ["163A", "162", "1013", "263", "45", "1400"]
_KNOWN = "SELECT DISTINCT CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 7 = 0 THEN 'A' ELSE '' END AS name FROM part"


@query(
    "WITH q(query) AS (VALUES " + ", ".join(f"('{m}')" for m in _MISSES) + f"""), n AS ({_KNOWN}), v AS (
    SELECT query, regexp_replace(query, '[A-Za-z-].*$', '') AS stem FROM q), vs AS (
    SELECT query, stem AS name FROM v UNION ALL SELECT query, stem || s FROM v, (VALUES ('A'), ('B'), ('C'), ('D'), ('T')) t(s)
    UNION ALL SELECT query, substr(query, 1, i - 1) || substr(query, i + 1, 1) || substr(query, i, 1) || substr(query, i + 2) FROM v, generate_series(1, 20) g(i) WHERE i < length(stem)),
    c AS (SELECT query, name, least(levenshtein(lower(query), lower(name)), 3) AS dist,
      least(abs(CAST(regexp_extract(query, '^(\\d+)', 1) AS INTEGER) - CAST(regexp_extract(name, '^(\\d+)', 1) AS INTEGER)), 6) AS gap,
      EXISTS (SELECT 1 FROM vs WHERE vs.query = q.query AND vs.name = n.name) AS variant FROM q, n WHERE query <> name)
    SELECT query, name, dist, gap, row_number() OVER (PARTITION BY query ORDER BY dist, gap, length(name), name) AS rank FROM c WHERE dist <= 2 OR gap <= 5 OR variant QUALIFY rank <= 3"""
)
def fuzzy_nearest_top3(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "A").otherwise("")).alias("name"))
    return fuzzy.nearest(inline(spark, "q string", *[(m,) for m in _MISSES]), "q", names, "name")


@query(
    """WITH q AS (SELECT CAST(p_partkey AS VARCHAR) AS query FROM part), v AS (
    SELECT query, query || s AS name FROM q, (VALUES ('A'), ('B'), ('C'), ('D'), ('T')) t(s)
    UNION SELECT query, substr(query, 1, i - 1) || substr(query, i + 1, 1) || substr(query, i, 1) || substr(query, i + 2) FROM q, generate_series(1, 20) g(i) WHERE i < length(query))
    SELECT query, name FROM v JOIN q n ON n.query = v.name WHERE v.query <> v.name""".replace("SELECT query, name FROM v JOIN q n", "SELECT v.query, v.name FROM v JOIN q n")
)
def variant_generator_join(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("query"))
    made = q.select("query", F.explode(fuzzy.variants(F.col("query"))).alias("name"))
    return made.join(q.select(F.col("query").alias("name")), "name", "left_semi").select("query", "name")


@query(
    """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), w AS (
    SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents)
    SELECT term, count(*) AS n_docs FROM w JOIN t USING (term) WHERE length(term) >= 6 GROUP BY term"""
)
def containment_join_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "benchmark").select(F.explode(search.tokens(F.col("text"))).alias("term")).distinct().where(F.length("term") >= 6)
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    return words.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


@query("WITH k(kind, word) AS (VALUES ('metal', 'BRASS'), ('metal', 'STEEL'), ('size', 'SMALL'), ('all', '')) SELECT DISTINCT p_partkey, kind FROM part JOIN k ON contains(p_type, word)")
def keyword_cross_join(spark: SparkSession, sf: str) -> DataFrame:
    # three fixed kinds, so keywords are expressions on the row instead of a join
    kinds = {"metal": ("BRASS", "STEEL"), "size": ("SMALL",), "all": ()}
    hit = {k: F.lit(not w) if not w else F.contains("p_type", F.lit(w[0])) if len(w) == 1 else F.contains("p_type", F.lit(w[0])) | F.contains("p_type", F.lit(w[1])) for k, w in kinds.items()}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in hit.items()]))
    return table(spark, sf, "part").where("p_type is not null").select("p_partkey", F.explode(found).alias("kind"))


@query(
    """SELECT c_custkey, 'kept' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT c_custkey, 'cleared' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)"""
)
def semi_anti_clear(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    kept = c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit("kept").alias("side"))
    return kept.unionByName(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit("cleared").alias("side")))


_OVERLAY = [(1, "New name", None), (2, None, 5.5), (999_999_999, "Added", 1.0)]


@query(
    """WITH o(k, n, b) AS (VALUES (1, 'New name', CAST(NULL AS DOUBLE)), (2, NULL, 5.5), (999999999, 'Added', 1.0))
    SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(n, c_name) AS c_name, coalesce(c_acctbal, b) AS c_acctbal FROM customer FULL JOIN o ON c_custkey = k"""
)
def coalesce_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    overlay = inline(spark, "c_custkey long, c_name string, c_acctbal double", *_OVERLAY)
    return versions.coalesce_upsert(base, overlay, "c_custkey", ["c_acctbal"])


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def keep_first_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.sha2("text", 256).alias("key"), "doc_id", "source")  # the digest is shuffled, not the text
    return lookup.keep_first(rows, ["key"], ["doc_id"]).select("doc_id", "source")


_SEVERITIES = ["info", "ok", "warning", "error"]
_SEVERITY = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'info' ELSE 'ok' END"


def _severity() -> Column:
    t = F.col("event_type")
    return F.when(t == "error", "error").when(t == "purchase", "warning").when(t == "click", "info").otherwise("ok")


@query(f"WITH s(severity) AS (VALUES ('info'), ('ok'), ('warning'), ('error'), ('fatal')) SELECT severity, count(event_id) AS n FROM s LEFT JOIN (SELECT event_id, {_SEVERITY} AS severity FROM events) USING (severity) GROUP BY severity")
def status_summary_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return versions.zero_filled_counts(table(spark, sf, "events").select(_severity().alias("severity")), "severity", [*_SEVERITIES, "fatal"])


@query(f"SELECT user_id, arg_max(s, o) AS worst FROM (SELECT user_id, {_SEVERITY} AS s, list_position(['ok', 'info', 'warning', 'error'], {_SEVERITY}) AS o FROM events) GROUP BY user_id")
def worst_severity_per_group(spark: SparkSession, sf: str) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, ("ok", "info", "warning", "error"))), _severity())
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by(_severity(), order).alias("worst"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, length(lang), lang DESC, doc_id) = 1")
def argbest_more_specific(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", "doc_id", "n_chars", "lang")
    return lookup.arg_best(rows, ["source"], [F.desc("n_chars"), F.length("lang").asc(), F.desc("lang"), F.asc("doc_id")]).select("source", "doc_id")


@query(
    """WITH h AS (SELECT doc_id, n_chars, length(lang) + doc_id % 5 AS depth, doc_id % 11 AS authority FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200), r AS (
    SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (ORDER BY authority DESC, n_chars DESC, doc_id) AS b,
      row_number() OVER (ORDER BY depth, n_chars DESC, doc_id) AS c, row_number() OVER (ORDER BY n_chars, doc_id) AS d FROM h)
    SELECT doc_id, round(1.0 / (10 + a) + 1.0 / (10 + b) + 1.5 / (10 + c) + 1.0 / (10 + d), 6) AS score FROM r ORDER BY score DESC, doc_id LIMIT 20"""
)
def rank_fusion_rrf(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select("doc_id", "n_chars", (F.length("lang") + F.col("doc_id") % 5).alias("depth"), (F.col("doc_id") % 11).alias("authority"))
    hits = hits.orderBy(F.desc("n_chars"), "doc_id").limit(200)
    best = [F.desc("n_chars"), F.asc("doc_id")]
    w = search.FUSION
    ranks = {"relevance": (w["relevance"], best), "authority": (w["authority"], [F.desc("authority"), *best]), "depth": (w["depth"], [F.asc("depth"), *best]), "length": (w["length"], [F.asc("n_chars"), F.asc("doc_id")])}
    return search.fuse(hits, "doc_id", ranks, 20)


@query(
    """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), s AS (
    SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'thing')) AS b FROM d), n AS (
    SELECT count(*) AS n, avg(dl) AS avgdl, sum(CAST(a > 0 AS INTEGER)) AS da, sum(CAST(b > 0 AS INTEGER)) AS db FROM s)
    SELECT id, round(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl))
      + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score
    FROM s, n WHERE a > 0 AND b > 0 ORDER BY score DESC, id LIMIT 25"""
)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(table(spark, sf, "documents"), "doc_id", "text", ["the", "thing"], 25)


@query(
    """WITH q AS (SELECT item_id AS q, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark), d AS (
    SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) GROUP BY term)
    SELECT q, term, df, row_number() OVER (PARTITION BY q ORDER BY df, length(term) DESC, term) AS rank FROM q JOIN d USING (term) QUALIFY rank <= 4"""
)
def rare_tokens_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.rare_tokens(table(spark, sf, "benchmark"), "item_id", "text", table(spark, sf, "documents"), "doc_id", "text", 4)


@query(
    """WITH p AS (SELECT doc_id AS id, unnest(t) AS term, unnest(range(len(t))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)
    ) SELECT a.id, min(abs(a.i - b.i)) AS gap FROM p a JOIN p b ON a.id = b.id AND a.term = 'thing' AND b.term = 'that' GROUP BY a.id HAVING gap <= 12"""
)
def near_window_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.near(table(spark, sf, "documents"), "doc_id", "text", "thing", "that", 12)


@query(
    r"""WITH b AS (SELECT item_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS needle FROM benchmark)
    SELECT item_id, count(doc_id) AS n_docs FROM b LEFT JOIN documents ON contains(regexp_replace(lower(text), '\s+', ' ', 'g'), needle) GROUP BY item_id"""
)
def phrase_containment(spark: SparkSession, sf: str) -> DataFrame:
    return search.phrase_counts(table(spark, sf, "benchmark"), "item_id", "text", table(spark, sf, "documents"), "doc_id", "text")


@query(
    """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), p AS (SELECT item_id, array_to_string(w[1:n], ' ') AS prefix, n FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS n FROM w)),
    d AS (SELECT ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents)
    SELECT item_id, max(n) AS longest FROM p WHERE EXISTS (SELECT 1 FROM d WHERE contains(t, ' ' || prefix || ' ')) GROUP BY item_id"""
)
def longest_prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.longest_prefixes(table(spark, sf, "benchmark"), "item_id", "text", table(spark, sf, "documents"), "text")


@query(
    """WITH h AS (SELECT o_custkey % 1000 AS e, CAST(o_orderdate AS DATE) AS d, o_custkey AS h, max(CAST(o_totalprice % 60 AS DECIMAL(9,4))) AS p FROM orders GROUP BY ALL),
    dates AS (SELECT DISTINCT e, d AS t FROM h),
    x AS (SELECT dates.e, t, h.h, arg_max(p, d) AS now, max(p) AS peak,
      least(min(p) FILTER (WHERE d >= CAST(t - INTERVAL 3 YEAR AS DATE)), arg_max(p, d) FILTER (WHERE d < CAST(t - INTERVAL 3 YEAR AS DATE))) AS low
      FROM dates JOIN h ON h.e = dates.e AND d <= t GROUP BY ALL)
    SELECT e AS company, CAST(t AS VARCHAR) AS "when", CAST(sum(CASE WHEN peak >= 5 THEN greatest(now - low, 0) ELSE 0 END) AS DOUBLE) AS total_increase,
      sum(CASE WHEN peak >= 5 THEN greatest(now - low, 0) ELSE 0 END) > 50 AS changed FROM x GROUP BY e, t"""
)
def owner_shift_3y(spark: SparkSession, sf: str) -> DataFrame:
    register = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 1000).alias("company"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("holder"), (F.col("o_totalprice") % 60).cast("decimal(9,4)").alias("percent")
    )
    out = models.owner_shift(register, "company", "day", "holder", "percent")
    return out.select("company", F.col("when").cast("string").alias("when"), F.col("total_increase").cast("double").alias("total_increase"), "changed")


@query(
    """WITH RECURSIVE s AS (
      SELECT o_custkey AS id, CAST(1000 + any_value(c_custkey) % 900 AS DECIMAL(20,2)) AS annual, CAST(count(*) * 1500 AS DECIMAL(20,2)) AS nol, list(CAST(floor(o_totalprice / 100) AS INTEGER) ORDER BY o_orderkey) AS incomes
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey), y AS (
    SELECT id, annual, incomes, 0 AS year, annual AS available, greatest(least(annual, incomes[1], nol), 0) AS absorbed, nol FROM s
    UNION ALL SELECT id, annual, incomes, year + 1, annual + available - absorbed, greatest(least(annual + available - absorbed, incomes[year + 2], nol - absorbed), 0), nol - absorbed
    FROM y WHERE year + 1 < len(incomes))
    SELECT id, CAST(year AS BIGINT) AS year, CAST(available AS DOUBLE) AS available, CAST(absorbed AS DOUBLE) AS absorbed,
      CAST(available - absorbed AS DOUBLE) AS carry, CAST(nol - absorbed AS DOUBLE) AS remaining FROM y"""
)
def limitation_schedule_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A customer as a company: its orders' totals are the years' incomes."""
    years = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    income = F.floor(F.col("o_totalprice") / 100).cast("decimal(20,2)")
    held = F.array_sort(F.collect_list(F.struct("o_orderkey", income.alias("x"))))  # of one company
    rows = years.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.transform(held, lambda x: x["x"]).alias("incomes"))
    money = lambda c: c.cast("decimal(20,2)")
    rows = rows.select("id", money(1000 + F.col("id") % 900).alias("annual"), money(F.col("n") * 1500).alias("nol"), "incomes")
    out = models.limitation_schedule(rows, "id", "annual", "nol", "incomes")
    return out.select("id", "year", *[F.col(c).cast("double").alias(c) for c in ("available", "absorbed", "carry", "remaining")])


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 YEAR AS DATE) AS VARCHAR) AS start FROM orders")
def window_start_29feb(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", day.cast("string").alias("day"), models.window_start(day).cast("string").alias("start"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_partkey + CAST(l_quantity AS INTEGER) AS b, 97 + l_linenumber AS c, 97 + l_linenumber + l_suppkey % 6 AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, 'number' AS kind, CAST(unnest(range(a, b + 1)) AS VARCHAR) AS item FROM l WHERE b > a AND b - a < 26
    UNION ALL SELECT l_orderkey, l_linenumber, 'letter', chr(CAST(unnest(range(c, d + 1)) AS INTEGER)) FROM l WHERE d > c"""
)
def range_expand_numeric_letter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    letter = 97 + F.col("l_linenumber")
    numbers = ids.range_items(F.col("l_partkey").cast("string"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).cast("string"), cite.MAX_RANGE)
    letters = ids.range_items(F.char(letter), F.char(letter + F.col("l_suppkey") % 6), cite.MAX_RANGE)
    each = lambda kind, items: rows.select("l_orderkey", "l_linenumber", F.lit(kind).alias("kind"), F.explode(items).alias("item"))
    return each("number", numbers).unionByName(each("letter", letters))


@query(
    """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 60 AS s, l_partkey % 60 + 1 + l_suppkey % 15 AS e, l_linenumber AS p FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY s, s - e, -p) AS k, count(*) OVER (PARTITION BY doc) AS n FROM l),
    r AS (
      SELECT doc, k, n, s, e, p, true AS fresh FROM o WHERE k = 1
      UNION ALL SELECT o.doc, o.k, o.n, CASE WHEN t THEN o.s ELSE r.s END, CASE WHEN t THEN o.e ELSE r.e END, CASE WHEN t THEN o.p ELSE r.p END, r.e <= o.s
      FROM r JOIN o ON o.doc = r.doc AND o.k = r.k + 1, LATERAL (SELECT r.e <= o.s OR (o.s - o.e, -o.p) < (r.s - r.e, -r.p) AS t))
    SELECT r.doc, r.s, r.e, CAST(r.p AS BIGINT) AS p FROM r LEFT JOIN r AS nxt ON nxt.doc = r.doc AND nxt.k = r.k + 1 WHERE r.k = r.n OR nxt.fresh"""
)
def overlap_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as spans."""
    start = F.col("l_partkey") % 60
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), start.alias("s"), (start + 1 + F.col("l_suppkey") % 15).alias("e"), F.col("l_linenumber").alias("p"))
    return spans.resolve_overlaps(rows, "doc", "s", "e", "p")


@query(f"SELECT {_ID} AS id, regexp_full_match(chr(CAST(97 + l_linenumber % 26 AS INTEGER)), '[a-z]{{1,2}}') AS ok1, regexp_full_match(CAST(l_partkey AS VARCHAR), '\\d+[A-Z]?') AS ok2 FROM lineitem")
def level_validate(spark: SparkSession, sf: str) -> DataFrame:
    fits = lambda d: F.rlike(F.get("path", F.lit(d)), F.lit(f"^(?:{ids.SHAPES[d]})$"))
    return sections(spark, sf).select("id", fits(0).alias("ok1"), fits(1).alias("ok2"))


@query(
    """SELECT doc_id, length(h) - length(replace(h, chr(10), '')) + 1 AS line, length(string_split(h, chr(10))[-1]) + 1 AS col FROM (SELECT doc_id, text[1:least(200, length(text))] AS h FROM documents)"""
)
def line_col_locate(spark: SparkSession, sf: str) -> DataFrame:
    line, col = lookup.line_col(F.col("text"), F.least(F.lit(200), F.length("text")))
    return table(spark, sf, "documents").select("doc_id", line.alias("line"), col.alias("col"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def sha256_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash"))


@query("SELECT l_partkey, arg_max(l_suppkey, {'a': l_shipdate, 'b': l_suppkey}) AS latest FROM lineitem GROUP BY l_partkey")
def guidance_relations_latest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_suppkey")).alias("latest"))


@query(
    """WITH y(year) AS (VALUES (2019), (2023), (2024), (2025), (2026)) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'verified'
    WHEN 2015 + doc_id % 14 IN (SELECT year FROM y) THEN 'not_found' ELSE 'unverifiable' END AS status FROM documents"""
)
def coverage_three_valued(spark: SparkSession, sf: str) -> DataFrame:
    spec = F.lit("2019,2023-2026")
    years = F.flatten(F.transform(F.split(spec, ","), lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.coalesce(F.nullif(F.split_part(p, F.lit("-"), F.lit(2)), F.lit("")), p).try_cast("int"))))
    year = (2015 + F.col("doc_id") % 14).cast("int")
    status = F.when(F.col("doc_id") % 3 == 0, "verified").when(F.array_contains(years, year), "not_found").otherwise("unverifiable")
    return table(spark, sf, "documents").select("doc_id", status.alias("status"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN make_date(1996, 1, 1) > CAST(o_orderdate AS DATE) THEN 'applies' ELSE 'not_yet' END AS status,
    o_orderkey % 5 <> 0 AND CAST(o_orderdate AS DATE) >= make_date(1996, 1, 1) AS pending FROM orders"""
)
def effective_year_check(spark: SparkSession, sf: str) -> DataFrame:
    after = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date"))
    first = F.make_date(F.lit(1996), F.lit(1), F.lit(1))
    return table(spark, sf, "orders").select("o_orderkey", temporal.status_for(after, F.lit(1996)).alias("status"), F.coalesce(after >= first, F.lit(False)).alias("pending"))


_AUTHORITY = "CASE WHEN k IN ('statute', 'regulation', 'case') THEN 'authority' WHEN k = 'ruling' AND y IS NULL THEN 'authority with caveat' WHEN k = 'ruling' AND y < 1977 THEN 'not authority' WHEN k = 'ruling' THEN 'authority' ELSE 'not authority' END"


@query(
    f"""SELECT p_partkey, {_AUTHORITY} AS verdict FROM (SELECT p_partkey, ['statute', 'regulation', 'case', 'ruling', 'treatise'][1 + p_partkey % 5] AS k,
    CASE WHEN p_partkey % 2 = 0 THEN 1970 + p_partkey % 20 END AS y FROM part)"""
)
def authority_classify(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("statute", "regulation", "case", "ruling", "treatise"))), (F.col("p_partkey") % 5).cast("int"))
    year = F.when(F.col("p_partkey") % 2 == 0, 1970 + F.col("p_partkey") % 20)
    verdict = (
        F.when(kind.isin("statute", "regulation", "case"), "authority").when((kind == "ruling") & year.isNull(), "authority with caveat")
        .when((kind == "ruling") & (year < 1977), "not authority").when(kind == "ruling", "authority").otherwise("not authority")
    )
    return table(spark, sf, "part").select("p_partkey", verdict.alias("verdict"))


_SCOPES = ("this section", "this subsection", "this paragraph", None)


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey, chr(CAST(97 + l_linenumber % 3 AS INTEGER)) AS a, l_partkey AS b, l_linenumber % 4 AS k FROM lineitem)
    SELECT d.l_orderkey, d.a || '/' || d.b AS defined_at, u.a || '/' || u.b AS used_at, d.k AS scope_kind,
      CASE d.k WHEN 1 THEN d.a = u.a WHEN 2 THEN d.a = u.a AND d.b = u.b ELSE true END AS governs
    FROM l d JOIN l u ON d.l_orderkey = u.l_orderkey"""
)
def scope_reaches(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a definition at one line of an order reaches each of the order's lines."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.char(97 + F.col("l_linenumber") % 3).alias("a"), F.col("l_partkey").alias("b"), (F.col("l_linenumber") % 4).alias("k")).distinct()
    at = F.concat_ws("/", "a", "b")
    d = rows.select("l_orderkey", at.alias("defined_at"), F.col("k").alias("scope_kind"), definitions.reach(F.get(F.array(*map(F.lit, _SCOPES)), F.col("k").cast("int"))).alias("reaches"))
    both = d.join(rows.select("l_orderkey", at.alias("used_at")), "l_orderkey")
    place = lambda c: F.concat(F.lit(ids.PREFIX["irc"]), F.col("l_orderkey"), F.lit("/"), F.col(c))
    governs = definitions.within(F.col("reaches"), place("defined_at"), place("used_at"))
    return both.select("l_orderkey", "defined_at", "used_at", "scope_kind", governs.alias("governs"))


@query(r"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs FROM pages")
def html_title_and_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).alias("n_paragraphs"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN regexp_matches(text[1:121], '\s') AND length(regexp_replace(text[1:121], '\s+\S*$', '')) > 0
    THEN regexp_replace(text[1:121], '\s+\S*$', '') ELSE text[1:120] END AS head, length(text) > 120 AS cut FROM documents"""
)
def truncate_word_boundary(spark: SparkSession, sf: str) -> DataFrame:
    head, cut = lookup.truncate_words(F.col("text"), 120)
    return table(spark, sf, "documents").select("doc_id", head.alias("head"), cut.alias("cut"))


@query(
    "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answers FROM conversations"
)
def conversation_pairing(spark: SparkSession, sf: str) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(before).alias("answers"))


@query(
    """SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def events_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _memos(spark: SparkSession, sf: str) -> DataFrame:
    """A memo per order: one statute citation, one ruling, one regulation."""
    o, section = table(spark, sf, "orders"), F.col("o_custkey") * 7 % 9000 + 1
    text = F.concat(
        F.lit("Under § "), section, F.lit("("), F.char(97 + F.col("o_orderkey") % 6), F.lit("), see Rev. Rul. 2019-"), 1 + F.col("o_orderkey") % 30,
        F.lit(" and Treas. Reg. § 1."), section, F.lit("-1."),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def _provisions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("section"), "p_name", "p_partkey")
    status = F.when(F.col("p_partkey") % 10 == 0, "repealed").otherwise("active")
    paths = F.explode(F.array(F.array().cast("array<string>"), *[F.array(F.lit(c)) for c in "abcd"]))
    return p.select("section", "p_name", status.alias("status"), paths.alias("path")).select(ids.id_col(F.col("section"), F.col("path")).alias("id"), F.col("p_name").alias("heading"), "status")


def _rulings(spark: SparkSession) -> DataFrame:
    return inline(spark, "id string, status string", *[(f"rev-rul-2019-{n}", "superseded" if n % 4 == 0 else "active") for n in range(1, 20)])


_VERIFIED = """WITH o AS (SELECT o_orderkey AS doc_id, o_custkey * 7 % 9000 + 1 AS s, p_partkey AS p, chr(CAST(97 + o_orderkey % 6 AS INTEGER)) AS c, 1 + o_orderkey % 30 AS r FROM orders LEFT JOIN part ON p_partkey = o_custkey * 7 % 9000 + 1), x AS (
  SELECT doc_id, '§ ' || s || '(' || c || ')' AS display, CASE WHEN p IS NULL THEN 'not_found' WHEN c > 'd' THEN 'pinpoint_not_found' WHEN s % 10 = 0 THEN 'repealed' ELSE 'verified' END AS status FROM o
  UNION ALL SELECT doc_id, 'Rev. Rul. 2019-' || r, CASE WHEN r > 19 THEN 'not_found' WHEN r % 4 = 0 THEN 'superseded' ELSE 'verified' END FROM o
  UNION ALL SELECT doc_id, 'Treas. Reg. § 1.' || s || '-1', 'source_unavailable' FROM o), y AS (
  SELECT *, CASE WHEN status = 'verified' THEN 'ok' WHEN status IN ('source_unavailable', 'superseded', 'repealed') THEN 'warning' ELSE 'error' END AS severity FROM x)
"""


@query(_VERIFIED + "SELECT doc_id, display, status, severity FROM y")
def resolve_citations(spark: SparkSession, sf: str) -> DataFrame:
    found = verify.verify(_memos(spark, sf), _provisions(spark, sf), _rulings(spark), [2019])
    return found.select("doc_id", "display", "status", "severity")


@query(
    _VERIFIED + """SELECT doc_id, count(*) AS n_citations, count(*) FILTER (WHERE severity = 'ok') AS n_ok, count(*) FILTER (WHERE severity = 'info') AS n_info,
  count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'error') AS n_error,
  arg_max(severity, list_position(['ok', 'info', 'warning', 'error'], severity)) AS worst FROM y GROUP BY doc_id"""
)
def verify_e2e(spark: SparkSession, sf: str) -> DataFrame:
    return verify.summary(verify.verify(_memos(spark, sf), _provisions(spark, sf), _rulings(spark), [2019]))


@query("SELECT o_orderkey AS doc_id, count(*) * 3 AS n FROM orders GROUP BY 1")
def extract_citations_e2e(spark: SparkSession, sf: str) -> DataFrame:
    return cite.extract(_memos(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT p_partkey AS id FROM part), v(k, scope) AS (VALUES (1, 'title'), (2, 'chapter'), (7, 'section'))
    SELECT '/us/usc/t26/s' || id || '/a/1' AS id, scope FROM t LEFT JOIN v ON k = id"""
)
def scope_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.concat(F.lit("/us/usc/t26/s"), "p_partkey", F.lit("/a/1")).alias("id"))
    stated = inline(spark, "sid string, scope string", ("/us/usc/t26/s1", "title"), ("/us/usc/t26/s2", "part"), ("/us/usc/t26/s2/a", "chapter"), ("/us/usc/t26/s7/a/1", "section"))
    return lookup.nearest_ancestor_value(nodes, "id", stated, "sid", "scope")


@query(
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'quote_exact' WHEN 1 THEN 'wrong_pinpoint' WHEN 2 THEN 'misattributed' ELSE 'quote_not_found' END AS status
    FROM orders"""
)
def quotes_e2e(spark: SparkSession, sf: str) -> DataFrame:
    said = F.array(*map(F.lit, ("all the ordinary and necessary expenses paid", "salaries shall not exceed amounts prescribed", "all income from whatever source derived", "purple elephants dance under seven moons")))
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("It says “"), F.get(said, (F.col("o_orderkey") % 4).cast("int")), F.lit("” in § 162(a).")).alias("text")
    )
    provisions = inline(
        spark, "id string, text string", ("/us/usc/t26/s162/a", "There shall be allowed as a deduction all the ordinary and necessary expenses paid."),
        ("/us/usc/t26/s162/b", "Reasonable salaries shall not exceed amounts prescribed by the rules of this title."), ("/us/usc/t26/s61", "Gross income means all income from whatever source derived, of any kind."),
    )
    return quotes.check_quotes(docs, provisions).select("doc_id", "status")


_CITED = "SELECT l_orderkey, l_linenumber, ['irc', 'reg', 'case', 'secondary', 'irs_guidance'][1 + (l_orderkey + l_linenumber) % 5] AS source, ['Rev. Rul.', 'Notice', 'T.D.', 'PLR', 'GCM', 'AOD', 'ILM'][1 + l_partkey % 7] AS guidance_type, CASE l_suppkey % 4 WHEN 0 THEN year(CAST(l_shipdate AS DATE)) || '-' || l_partkey WHEN 1 THEN 70 + l_suppkey % 30 || '12001' WHEN 2 THEN year(CAST(l_shipdate AS DATE)) || '01001' ELSE '' || l_partkey % 1000 END AS num FROM lineitem"
_CITED_ALL = _CITED.replace("SELECT ", "SELECT l_partkey, l_suppkey, l_returnflag, ", 1)
_KINDS = "CASE source WHEN 'irc' THEN 'statute' WHEN 'reg' THEN 'regulation' WHEN 'irs_guidance' THEN CASE guidance_type WHEN 'Rev. Rul.' THEN 'published_ruling' WHEN 'Notice' THEN 'irb_pronouncement' WHEN 'T.D.' THEN 'regulation' WHEN 'PLR' THEN 'private_ruling' WHEN 'ILM' THEN 'unclassified' ELSE 'internal_memorandum' END ELSE source END"


def _cited(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    year, rest = F.year(F.col("l_shipdate").cast("date")).cast("string"), F.col("l_suppkey") % 4
    number = (
        F.when(rest == 0, F.concat_ws("-", year, "l_partkey")).when(rest == 1, F.concat((70 + F.col("l_suppkey") % 30).cast("string"), F.lit("12001")))
        .when(rest == 2, F.concat(year, F.lit("01001"))).otherwise((F.col("l_partkey") % 1000).cast("string"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", pick(("irc", "reg", "case", "secondary", "irs_guidance"), (F.col("l_orderkey") + F.col("l_linenumber")) % 5).alias("source"),
        pick(("Rev. Rul.", "Notice", "T.D.", "PLR", "GCM", "AOD", "ILM"), F.col("l_partkey") % 7).alias("type"), number.alias("num"), *more,
    )


def _as_guidance(spark: SparkSession, sf: str) -> DataFrame:
    guidance = F.when(F.col("source") == "irs_guidance", F.col("type"))
    return authority.classify(_cited(spark, sf).withColumn("type", guidance), "source", "type", "num")


@query(
    f"""WITH c AS (SELECT *, {_KINDS} AS k, CASE WHEN num LIKE '%-%' OR length(num) >= 9 THEN CAST(num[1:4] AS INTEGER) WHEN length(num) >= 7 THEN 1900 + CAST(num[1:2] AS INTEGER) END AS y FROM ({_CITED}) t),
    s AS (SELECT *, CASE k WHEN 'private_ruling' THEN 1976 WHEN 'internal_memorandum' THEN 1981 END AS since FROM c)
    SELECT l_orderkey, l_linenumber, k AS authority_kind, k NOT IN ('secondary', 'unclassified') AND NOT coalesce(y < since, false) AS is_authority,
    since IS NOT NULL AND y IS NULL AS cutoff_unchecked FROM s"""
)
def authority_of_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _as_guidance(spark, sf).select("l_orderkey", "l_linenumber", "authority_kind", "is_authority", "cutoff_unchecked")


@query(f"SELECT {_KINDS} AS authority_kind, count(*) AS n FROM ({_CITED}) t GROUP BY 1")
def authority_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return authority.kind_counts(_as_guidance(spark, sf))


def _of_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Citations of an order's lines, several of one identifier, and what was found of them."""
    pick = F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("/id/"), F.col("l_partkey") % 40))
    start = F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")
    rows = _cited(spark, sf, "l_partkey", "l_suppkey", "l_returnflag").select(
        F.col("l_orderkey").alias("doc_id"), start.alias("start"), pick.alias("canonical_id"), F.concat_ws(" ", "source", "num").alias("display"), "source",
        F.when(F.col("source") == "irs_guidance", F.col("type")).alias("guidance_type"), F.col("num").alias("guidance_number"),
        F.when(F.col("l_returnflag") == "A", "proposed").otherwise("final").alias("reg_kind"), "l_returnflag", "l_partkey",
    )
    found = F.when(F.col("l_partkey") % 11 == 0, "not_found").when(F.col("l_returnflag") == "R", "repealed").when(F.col("l_returnflag") == "N", "source_unavailable").otherwise("verified")
    return rows, rows.select("doc_id", "start", F.coalesce("canonical_id", "display").alias("key"), found.alias("status"))


@query(
    f"""WITH c AS (
      SELECT l_orderkey AS doc_id, l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey * 1000000 + l_suppkey AS start, coalesce(CASE WHEN l_partkey % 3 <> 0 THEN '/id/' || l_partkey % 40 END, source || ' ' || num) AS key, source || ' ' || num AS display,
        source, {_KINDS} AS k, CASE WHEN num LIKE '%-%' OR length(num) >= 9 THEN CAST(num[1:4] AS INTEGER) WHEN length(num) >= 7 THEN 1900 + CAST(num[1:2] AS INTEGER) END AS y,
        CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS prop,
        CASE WHEN l_partkey % 11 = 0 THEN 'not_found' WHEN l_returnflag = 'R' THEN 'repealed' WHEN l_returnflag = 'N' THEN 'source_unavailable' ELSE 'verified' END AS status
      FROM ({_CITED_ALL}) t),
    u AS (SELECT doc_id, key, min_by({{'display': display, 'k': k, 'y': y, 'prop': prop, 'source': source}}, start) AS x, max_by(status, start) AS status FROM c GROUP BY doc_id, key),
    s AS (SELECT doc_id, x.display AS display, x.k AS k, x.y AS y, x.prop AS prop, status, CASE x.k WHEN 'private_ruling' THEN 1976 WHEN 'internal_memorandum' THEN 1981 END AS since FROM u),
    v AS (SELECT *, k NOT IN ('secondary', 'unclassified') AND NOT coalesce(y < since, false) AS counts FROM s)
    SELECT doc_id, count(*) FILTER (counts AND status NOT IN ('not_found', 'repealed')) AS n_authority, count(*) FILTER (NOT (counts AND status NOT IN ('not_found', 'repealed'))) AS n_not_authority,
      CAST(sum(CASE WHEN since IS NOT NULL AND y IS NULL THEN 1 ELSE 0 END + CASE WHEN k IN ('case', 'unclassified', 'secondary') OR (k = 'private_ruling' AND counts) THEN 1 ELSE 0 END
        + CASE WHEN k = 'regulation' THEN prop ELSE 0 END + CASE WHEN status = 'source_unavailable' THEN 1 ELSE 0 END) AS BIGINT) AS n_caveats,
      coalesce(string_agg(DISTINCT CASE WHEN status = 'not_found' THEN display END, '|' ORDER BY CASE WHEN status = 'not_found' THEN display END), '') AS unresolved
    FROM v GROUP BY doc_id"""
)
def authority_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    citations, statuses = _of_documents(spark, sf)
    return authority.report(authority.analyse(citations, statuses)).withColumn("unresolved", F.array_join("unresolved", "|"))
