"""Queries of the interval-coded history and of the marks of children, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import lookup, marks
from lexmill.plans import lookup as lookup_plan
from lexmill.plans.history import History
from lexmill.plans.scratch import folder
from lexmill.session import table

#: Releases of the orders' table: an order comes in with the first release after its date, is closed two years later and leaves after five.
RELEASES = (("r1", "1994-06-01"), ("r2", "1995-01-15"), ("r3", "1995-02-01"), ("r4", "1998-01-01"))
ASKED = ("1994-06-01", "1995-01-31", "1997-12-31", "1999-01-01")


def _state(orders: DataFrame, day: str) -> DataFrame:
    d, placed = F.lit(day).cast("date"), F.col("o_orderdate").cast("date")
    rows = orders.where((placed < d) & (F.add_months(placed, 60) >= d))
    return rows.select("o_orderkey", F.when(F.add_months(placed, 24) < d, "closed").otherwise("open").alias("state"), F.col("o_orderpriority").alias("text"))


def _history(spark: SparkSession, sf: str) -> History:
    made = History(spark, folder(spark, "history"), "o_orderkey long, state string, text string", "o_orderkey")
    for release, day in RELEASES:
        made.add(_state(table(spark, sf, "orders"), day), release, day)
    return made


def table_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The orders' table as it stood on four days, read from the intervals."""
    made = _history(spark, sf)
    parts = [made.open_as_of(day).select(F.lit(day).alias("as_of"), "o_orderkey", "state") for day in ASKED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def release_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What the last release changed against the first, from what the releases between wrote."""
    return _history(spark, sf).changes(1, len(RELEASES)).select("o_orderkey", "change", F.col("old.state").alias("old_state"), F.col("new.state").alias("new_state"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as children: numbers, but every fourth order's are letters, and a supplier's of some leave a gap behind them."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    value = F.col("l_linenumber") + F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0)
    mark: Column = F.when(F.col("l_orderkey") % 4 == 0, F.char(96 + value)).otherwise(value.cast("string"))
    return lookup.with_ordinal(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", F.concat(F.lit("("), mark, F.lit(")")).alias("mark"), "ordinal")


def mark_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The marks of each order's lines in short."""
    return marks.summaries(_lines(spark, sf), "l_orderkey", "mark", "ordinal")


def mark_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run of marks that follow one another."""
    found = marks.runs(_lines(spark, sf), "l_orderkey", "mark", "ordinal")
    return found.select("l_orderkey", F.col("place").cast("long").alias("place"), "kind", F.col("first").alias("first_mark"), F.col("last").alias("last_mark"), F.col("n").cast("long").alias("n"))


def lookup_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's first line as it would be cited, looked up among the lines and the orders that have a customer's number of three digits or more."""
    line = F.concat(F.lit("/us/usc/t26/s"), "l_orderkey", F.lit("/"), F.char(97 + F.col("l_linenumber") % 26))
    lines = table(spark, sf, "lineitem").select(line.alias("id"), F.concat(F.lit("line of part "), "l_partkey").alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    orders = table(spark, sf, "orders").where("o_custkey >= 100").select(
        F.concat(F.lit("/us/usc/t26/s"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("heading"), F.concat(F.lit("order of customer "), "o_custkey").alias("text")
    )
    provisions = lines.select("id", F.lit(None).cast("string").alias("heading"), "text").unionByName(orders)
    provisions = provisions.select("id", "heading", F.lit("active").alias("status"), "text", F.col("text").alias("full_text"))
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ask"), F.concat(F.lit("26 U.S.C. § "), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "(b)").otherwise("")).alias("citation"))
    out = lookup_plan.lookup(asked, provisions, max_chars=14)
    return out.select("ask", "canonical_id", "display", "heading", "text", "truncated", "n_children", F.col("problem").isNull().alias("found"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (table_as_of, release_changes, mark_summaries, mark_runs, lookup_citations)}

_DAYS = ", ".join(f"('{a}', DATE '{max(d for _, d in RELEASES if d <= a)}')" for a in ASKED)
_LINES = """SELECT *, CASE WHEN l_orderkey % 4 = 0 THEN chr(CAST(96 + v AS INTEGER)) ELSE CAST(v AS VARCHAR) END AS token FROM (
  SELECT l_orderkey, l_linenumber + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS o
  FROM lineitem)"""


def _state_sql(day: str) -> str:
    return f"""SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) + INTERVAL 24 MONTH < {day} THEN 'closed' ELSE 'open' END AS state FROM orders
    WHERE CAST(o_orderdate AS DATE) < {day} AND CAST(o_orderdate AS DATE) + INTERVAL 60 MONTH >= {day}"""


ORACLES: dict[str, str] = {
    "table_as_of": f"""SELECT as_of, o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) + INTERVAL 24 MONTH < day THEN 'closed' ELSE 'open' END AS state
    FROM orders, (VALUES {_DAYS}) v(as_of, day) WHERE CAST(o_orderdate AS DATE) < day AND CAST(o_orderdate AS DATE) + INTERVAL 60 MONTH >= day""",
    "release_changes": f"""WITH a AS ({_state_sql(f"DATE '{RELEASES[0][1]}'")}), b AS ({_state_sql(f"DATE '{RELEASES[-1][1]}'")})
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
      a.state AS old_state, b.state AS new_state FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.state IS DISTINCT FROM b.state""",
    "mark_summaries": f"""WITH l AS ({_LINES}), p AS (
      SELECT l_orderkey, count(*) AS n, min(v - o) = max(v - o) AS even, '(' || min_by(token, o) || ')' AS a, '(' || max_by(token, o) || ')' AS z,
        string_agg('(' || token || ')', ', ' ORDER BY o) FILTER (o < 12) AS few FROM l GROUP BY l_orderkey)
    SELECT l_orderkey, n, CASE WHEN n > 2 AND even THEN a || '–' || z WHEN n <= 12 THEN few ELSE few || ', … ' || z END AS summary FROM p""",
    "mark_runs": f"""WITH l AS ({_LINES}), g AS (SELECT *, o - row_number() OVER (PARTITION BY l_orderkey, v - o ORDER BY o) AS k FROM l)
    SELECT l_orderkey, min(o) AS place, CASE WHEN l_orderkey % 4 = 0 THEN 'letter' ELSE 'digit' END AS kind, '(' || min_by(token, o) || ')' AS first_mark, '(' || max_by(token, o) || ')' AS last_mark,
      count(*) AS n FROM g GROUP BY l_orderkey, v - o, k""",
    "lookup_citations": """WITH p AS (
      SELECT '/us/usc/t26/s' || l_orderkey || '/' || chr(CAST(97 + l_linenumber % 26 AS INTEGER)) AS id, NULL AS heading, min('line of part ' || l_partkey) AS text, '/us/usc/t26/s' || l_orderkey AS parent FROM lineitem GROUP BY 1, 4
      UNION ALL SELECT '/us/usc/t26/s' || o_orderkey, o_orderpriority, 'order of customer ' || o_custkey, NULL FROM orders WHERE o_custkey >= 100),
    n AS (SELECT parent, count(*) AS k FROM p GROUP BY parent),
    a AS (SELECT o_orderkey AS ask, '/us/usc/t26/s' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '/b' ELSE '' END AS canonical_id, '§ ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '(b)' ELSE '' END AS display FROM orders)
    SELECT ask, canonical_id, display, heading, CASE WHEN length(text) > 14 THEN regexp_replace(text[1:15], '\\s+\\S*$', '') ELSE text END AS text, coalesce(length(text) > 14, false) AS truncated,
      coalesce(k, 0) AS n_children, p.id IS NOT NULL AS found
    FROM a LEFT JOIN p ON p.id = canonical_id LEFT JOIN n ON n.parent = canonical_id""",
}
