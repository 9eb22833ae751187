"""Authority kinds, effective years, definition look-up and summaries on fixed cases."""

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.operators import authority, models, temporal, terms, versions
from lexmill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_ruling_years(spark):
    cases = {"2012-01": 2012, "202301001": 2023, "7512001": 1975, "75120010": 1975, "39000": None, "": None, None: None, "1949-3": None, " 1999-2 ": 1999, "12-5": None, "99999999999": None}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r["n"]: r["y"] for r in df.select("n", authority.ruling_year(F.col("n")).alias("y")).collect()} == cases


def test_kinds_and_cutoffs(spark):
    rows = [
        (1, "irc", None, None, "statute", True, False), (2, "secondary", None, None, "secondary", False, False), (3, "other", "PLR", "7512001", "private_ruling", False, False),
        (4, "other", "PLR", "202301001", "private_ruling", True, False), (5, "other", "GCM", "39000", "internal_memorandum", True, True), (6, "other", "AOD", "1981-2", "internal_memorandum", True, False),
        (7, "irs_guidance", "ILM", "1", "unclassified", False, False), (8, "irs_guidance", "T.D.", "9000", "regulation", True, False), (9, None, None, None, "unclassified", False, False),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "i int, source string, guidance_type string, guidance_number string")
    got = authority.classify(df).collect()
    assert sorted((r["i"], r["authority_kind"], r["is_authority"], r["cutoff_unchecked"]) for r in got) == [(r[0], *r[4:]) for r in rows]
    assert authority.kind_counts(authority.classify(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["authority_of_citations", "authority_kind_counts", "effective_year_check"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    at = [got.columns.index(c[0]) for c in want.description]
    assert sorted(tuple(r[i] for i in at) for r in got.collect()) == sorted(want.fetchall())


def test_later_amendments_begin_with_the_first_of_january(spark):
    notes = [("s1", "effectiveDateOfAmendment", "a", date(2020, 1, 1)), ("s1", "prospectiveAmendment", "b", date(2019, 12, 31)), ("s1", "other", "c", date(2022, 1, 1)), ("s1", "prospectiveAmendment", "d", None), ("s2", "prospectiveAmendment", "e", date(2030, 1, 1))]
    n = spark.createDataFrame(notes, "section_id string, topic string, heading string, applies_after date")
    s = spark.createDataFrame([("s1", 2020), ("s1", 2020), ("s3", 2020)], "section_id string, tax_year int")
    assert [(r["section_id"], r["heading"]) for r in temporal.later_amendments(n, s).collect()] == [("s1", "a")]


def test_definitions_are_ranked_and_reach(spark):
    d = [
        ("/us/usc/t26/s7701/a", "person", "this title", None), ("/us/usc/t26/s1/a/1", "person", "this paragraph", None), ("/us/usc/t26/s9", "person", "this section", None),
        ("/us/usc/t26/s9/b", "person", "this section", "s7701"), ("/us/usc/t26/s2", "other", None, None),
    ]
    d = spark.createDataFrame(d, "provision_id string, term_norm string, scope string, by_reference string")
    h = spark.createDataFrame([("/us/usc/t26/s9", "Person defined")], "section_id string, heading string")
    asked = spark.createDataFrame([(1, "person"), (1, "person"), (2, "absent")], "ask int, term_norm string")
    found = terms.ranked(asked, d, h)
    assert [r["provision_id"] for r in found.orderBy("rank").collect()] == ["/us/usc/t26/s7701/a", "/us/usc/t26/s9", "/us/usc/t26/s9/b", "/us/usc/t26/s1/a/1"]
    assert [r["rank"] for r in terms.ranked(asked, d, h, limit=2).orderBy("rank").collect()] == [1, 2]
    used = F.lit("/us/usc/t26/s9/c")
    reach = {r["provision_id"] for r in terms.governing(found, used).collect()}
    assert reach == {"/us/usc/t26/s7701/a", "/us/usc/t26/s9", "/us/usc/t26/s9/b"}
    assert {r["provision_id"] for r in terms.scope_conflicts(found, used).collect()} == {"/us/usc/t26/s1/a/1"}


def test_summaries(spark):
    s = spark.createDataFrame([("a", date(2020, 1, 1), 60, True), ("a", date(2019, 1, 1), 60, True), ("a", date(2018, 1, 1), 10, False), ("b", date(2020, 1, 1), 5, False)], "e string, when date, total_increase int, changed boolean")
    got = {r["e"]: (r["first_change"], r["peak_when"], r["peak"]) for r in models.shift_summary(s, "e").collect()}
    assert got == {"a": (date(2019, 1, 1), date(2019, 1, 1), 60), "b": (None, date(2020, 1, 1), 5)}
    y = spark.createDataFrame([("a", 5), ("a", 7)], "id string, absorbed int")
    assert [tuple(r) for r in models.total_absorbed(y, "id").collect()] == [("a", 12)]
    c = spark.createDataFrame([("x", "added"), ("y", "added"), ("z", "renamed")], "k string, change string")
    assert {r["change"]: r["n"] for r in versions.change_counts(c).collect()} == {"added": 2, "removed": 0, "changed": 0, "renamed": 1}


def test_documents_authorities_once_and_by_status(spark):
    rows = [
        (1, 5, "/s1", "§ 1", "irc", None, None, None), (1, 2, "/s1", "§ 1 first", "irc", None, None, None), (1, 9, None, "PLR 7512001", "irs_guidance", "PLR", "7512001", None),
        (1, 8, None, "GCM 39000", "irs_guidance", "GCM", "39000", None), (1, 7, "/r1", "Prop. Reg. 1", "reg", None, None, "proposed"), (1, 6, None, "Mertens § 4", "secondary", None, None, None),
        (2, 1, "/s1", "§ 1", "irc", None, None, None), (2, 2, "/s2", "§ 2", "irc", None, None, None), (2, 3, "/s3", "§ 3", "irc", None, None, None), (None, 1, "/s2", "§ 2", "irc", None, None, None),
    ]
    schema = "doc_id long, start int, canonical_id string, display string, source string, guidance_type string, guidance_number string, reg_kind string"
    found = [(2, 1, "/s1", "verified"), (2, 2, "/s2", "verified"), (2, 9, "/s2", "repealed"), (2, 3, "/s3", "not_found"), (1, 2, "/s1", "not_yet_effective"), (None, 1, "/s2", "pinpoint_not_found"), (5, 1, "/s1", "repealed")]
    statuses = spark.createDataFrame(found, "doc_id long, start int, key string, status string")
    out = {(r["doc_id"], r["key"]): r for r in authority.analyse(spark.createDataFrame(rows, schema), statuses).collect()}
    assert len(out) == 9 and out[1, "/s1"]["display"] == "§ 1 first"
    assert out[1, "/s1"]["is_authority"] and out[1, "/s1"]["caveats"] == [authority.STATUS_CAVEATS["not_yet_effective"]]
    assert not out[1, "PLR 7512001"]["is_authority"] and out[1, "PLR 7512001"]["reason"] == authority.TOO_OLD
    assert out[1, "GCM 39000"]["caveats"] == [authority.UNCHECKED] and out[1, "/r1"]["caveats"] == [authority.REG_CAVEATS["proposed"]]
    assert not out[1, "Mertens § 4"]["is_authority"] and out[2, "/s1"]["is_authority"] and out[2, "/s1"]["caveats"] == []
    assert out[2, "/s2"]["reason"] == authority.ENDED and out[2, "/s3"]["reason"] == authority.ABSENT and out[2, "/s3"]["unresolved"] and out[None, "/s2"]["unresolved"]
    totals = {r["doc_id"]: (r["n_authority"], r["n_not_authority"], r["unresolved"]) for r in authority.report(authority.analyse(spark.createDataFrame(rows, schema), statuses)).collect()}
    assert totals == {1: (3, 2, []), 2: (1, 2, ["§ 3"]), None: (0, 1, ["§ 2"])}
    assert authority.analyse(spark.createDataFrame(rows[:0], schema)).count() == 0
