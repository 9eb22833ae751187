"""Every query with SQL against DuckDB on the smallest tables, and operators on rows that tables don't have."""

import datetime
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.functions import definitions, ids
from lexmill.operators import components, fuzzy, graph, lookup, models, temporal
from lexmill.plans import verify
from lexmill.queries import ORACLES, QUERIES
from lexmill.session import TABLES
from lexmill.sources import markup, registers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, (bool, str)) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    a = sorted(repr([norm(r[c]) for c in order]) for r in got.collect())
    at = [rel.columns.index(c) for c in order]
    b = sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())
    assert a == b


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components_of_chains_stars_and_loops(spark, one_task):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert out == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 300, 301: 300}


def test_deepest_existing_stops_at_the_first_gap(spark):
    known = spark.createDataFrame([("/us/usc/t26/s1",), ("/us/usc/t26/s1/a",), ("/us/usc/t26/s1/a/1/A",)], "id string")
    asked = spark.createDataFrame([("/us/usc/t26/s1/a/1/A/i",), ("/us/usc/t26/s9/a",)], "q string")
    assert {r["q"]: r["found"] for r in lookup.deepest_existing(asked, "q", known, "id").collect()} == {"/us/usc/t26/s1/a/1/A/i": "/us/usc/t26/s1/a", "/us/usc/t26/s9/a": None}


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "from_id string, to_id string")
    out = graph.closure(e, spark.createDataFrame([("a",)], "id string"), 5)
    assert {r["node"]: r["depth"] for r in out.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_asof_before_everything_and_ties(spark):
    left = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-03-15"), (3, "2024-01-01"), (4, None)], "k int, d string").withColumn("d", F.col("d").cast("date"))
    right = spark.createDataFrame([("2020-03-15", "a"), ("2020-03-15", "b"), ("2021-01-01", "c")], "e string, v string").withColumn("e", F.col("e").cast("date"))
    out = {r["k"]: r["v"] for r in temporal.asof_backward(left, F.col("d"), right, F.col("e"), ["v"]).collect()}
    assert out == {1: None, 2: "b", 3: "c", 4: None}


def test_owner_shift_known_cases(spark):
    rows = [("x", "2020-01-01", "A", 50.0), ("x", "2021-01-01", "B", 50.01), ("x", "2021-01-01", "A", 49.99), ("y", "2020-01-01", "A", 0.0), ("y", "2021-01-01", "A", 50.0), ("z", "2020-01-01", "A", 4.0), ("z", "2021-01-01", "A", 4.9)]
    out = models.owner_shift(spark.createDataFrame(rows, "e string, d string, h string, p double"), "e", "d", "h", "p")
    got = {(r["e"], str(r["when"])): (round(r["total_increase"], 4), r["changed"]) for r in out.collect()}
    assert got["y", "2021-01-01"] == (50.0, False) and got["z", "2021-01-01"] == (0.0, False)


def test_limitation_carries_unused_ceiling(spark):
    row = spark.createDataFrame([("s", decimal.Decimal("1940000"), decimal.Decimal("10000000"), [decimal.Decimal("0"), decimal.Decimal("5000000")])], "id string, a decimal(20,2), n decimal(20,2), i array<decimal(20,2)>")
    out = models.limitation_schedule(row, "id", "a", "n", "i").orderBy("year").collect()
    assert [float(r["absorbed"]) for r in out] == [0.0, 3880000.0] and float(out[1]["remaining"]) == 6120000.0


def test_limitations_known_answers(spark):
    d = decimal.Decimal
    rows = [(1, "2024-03-10", d(50_000_000), None, True, 107), (2, "2024-04-10", d(50_000_000), None, True, None), (3, "2024-03-01", d(50_000_000), None, False, None), (4, "2024-03-01", d(50_000_000), d(500_000), True, None)]
    df = spark.createDataFrame(rows, "id int, change_date string, value decimal(20,2), rbig decimal(20,2), continuity boolean, short_days int").withColumn("change_date", F.col("change_date").cast("date"))
    rates = spark.createDataFrame([("2024-03-01", d("3.88"))], "month string, rate decimal(9,4)").withColumn("month", F.col("month").cast("date"))
    out = models.limitations(df, rates)
    assert {r["id"]: (r["annual"], r["first"]) for r in out.collect()} == {1: (d("1940000.00"), d("568712.33")), 2: (None, None), 3: (d(0), d(0)), 4: (d(2_440_000), d(2_440_000))}
    years = models.limitation_schedule(out.where("id = 1").withColumns({"nol": F.lit(10**7), "inc": F.array(F.lit(None).cast("decimal(20,2)"), F.lit(100).cast("decimal(20,2)"))}), "id", "annual", "nol", "inc", "first")
    assert [float(r["absorbed"]) for r in years.orderBy("year").collect()] == [568712.33, 100.0]


def test_verification_of_a_memo(spark, tmp_path):
    prov = spark.createDataFrame(
        [("/us/usc/t26/s162", "Trade expenses", "active"), ("/us/usc/t26/s162/a", None, "active"), ("/us/usc/t26/s163", None, "repealed"), ("/us/usc/t26/s1000", None, "reserved")],
        "id string, heading string, status string",
    )
    docs = spark.createDataFrame([(1, "§ 162(a), § 162(z), § 163, § 1000, § 164 and Rev. Rul. 2019-24; T.D. 9959; 290 U.S. 111"), (2, None), (3, "")], "doc_id long, text string")
    results = verify.verify(docs, prov, None, [2019])
    out = results.collect()
    assert {r["display"]: r["status"] for r in out} == {
        "§ 162(a)": "verified", "§ 162(z)": "pinpoint_not_found", "§ 163": "repealed", "§ 1000": "reserved", "§ 164": "not_found", "Rev. Rul. 2019-24": "not_found",
        "T.D. 9959": "unverifiable", "290 U.S. 111": "unverifiable",
    }
    assert {r["display"]: r["ancestor"] for r in out}["§ 162(z)"] == "/us/usc/t26/s162"
    hints = verify.suggestions(results, prov).collect()
    assert [(r["section"], r["suggestion"]) for r in hints] == [("164", "§ 163, § 162")]


def test_definitions_inherit_scope(spark):
    prov = spark.createDataFrame([("/us/usc/t26/s1", "For purposes of this section—"), ("/us/usc/t26/s1/a", "The term “widget” means a thing."), ("/us/usc/t26/s2", "nothing")], "id string, text string")
    out = definitions.definitions(prov)
    assert [(r["provision_id"], r["term_norm"], r["scope"]) for r in out.collect()] == [("/us/usc/t26/s1/a", "widget", "this section")]
    used = out.select(*[definitions.governs(F.col("scope"), F.col("provision_id"), F.lit(x)).alias(k) for k, x in (("same", "/us/usc/t26/s1/b/2"), ("other", "/us/usc/t26/s2"))]).first()
    assert used["same"] and not used["other"]


def test_files(spark, tmp_path):
    (tmp_path / "s.xml").write_bytes(b'<section xmlns="u" identifier="/us/usc/t26/s7"><heading>H</heading><content>Text.</content></section>')
    (tmp_path / "bad.xml").write_bytes(b"<section")
    kinds = {r["kind"] for r in markup.read(spark, f"file://{tmp_path}", "statute").collect()}
    assert kinds == {"provision", "corrupt"}
    (tmp_path / "r.csv").write_text("# c\ndate,holder,percent\n\n2020-01-01, A, 12.5\n")
    assert [(str(r["when"]), r["holder"], float(r["percent"])) for r in registers.read_register(spark, f"file://{tmp_path}/r.csv").collect()] == [("2020-01-01", "A", 12.5)]
    (tmp_path / "b.csv").write_text("2020-01-01,A,120\n")
    with pytest.raises(Exception, match="bad register row"):
        registers.read_register(spark, f"file://{tmp_path}/b.csv").collect()
    log = f"file://{tmp_path}/log"
    for k in range(2):
        registers.append_log(spark.createDataFrame([(k,)], "k int"), log)
    assert sorted(r["k"] for r in registers.read_log(spark, log).collect()) == [0, 1]


def test_fuzzy_finds_edits_gaps_and_variants(spark):
    q = spark.createDataFrame([("163A",), (None,)], "q string")
    n = spark.createDataFrame([("163",), ("164",), ("9999",), ("136A",), ("163A",), (None,)], "n string")
    assert [r["name"] for r in fuzzy.nearest(q, "q", n, "n").orderBy("rank").collect()] == ["163", "164", "136A"]


def test_id_columns_equal_functions(spark):
    rows = [("162", ["a", "1"]), ("1400Z–2", [])]
    df = spark.createDataFrame(rows, "s string, p array<string>").withColumn("id", ids.id_col(F.col("s"), F.col("p")))
    for r in df.withColumns({"sec": ids.section_of(F.col("id")), "par": ids.parent_of(F.col("id"))}).collect():
        assert (r["id"], r["sec"], r["par"]) == (ids.canonical_id("irc", r["s"], r["p"]), ids.section_id(r["id"]), ids.parent_id(r["id"]))
