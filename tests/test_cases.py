"""Cited decisions: existence, names, history and pages."""

import re

from pyspark.sql import functions as F

from lexmill.plans import cases

HELD = [
    ("290 U.S. 111", "Welch v. Helvering", "scotus", "u1", "An opinion", 1200, "2020-01-01"), ("12 F.3d 5", "Ash Mills v. Commissioner", "ca1", "u2", None, 0, None),
    ("12 F.3d 5", "Ash Mills v. Commissioner", "ca1", "u0", None, 0, None), ("9 T.C. 1", "Elm v. Oak", "tax", "u3", None, 1, None),
]


def _cases(spark):
    rows = spark.createDataFrame(HELD, "cite string, name string, court string, url string, text string, n_citing long, last_cited string")
    return rows.withColumn("id", cases.case_id(F.col("cite"))).drop("cite")


def test_resolution(spark):
    asked = [
        (1, "290 U. S. 111", "Welch v. Helvering", 1933, 115), (2, "290 U.S. 111", "Smith v. Jones", 1933, None), (3, "12 F. 3d 5", "Ash Mills v. Comm'r", 1993, 7), (4, "12 F.3d 6", None, 1993, None),
        (5, "8 T.C. 2", None, 1950, None), (6, "8 T.C. 2", None, 2090, None), (7, "9 T.C. 1", None, None, None), (8, None, "A v. B", None, None), (9, "T.C. Memo. 2003-45", None, 2003, None),
    ]
    df = spark.createDataFrame(asked, "k int, reporter_cite string, case_name string, case_year int, pin_page int")
    out = {r["k"]: r for r in cases.resolve(df, _cases(spark), 2026).collect()}
    assert {k: r["status"] for k, r in out.items()} == {1: "verified", 2: "not_found", 3: "verified", 4: "not_found", 5: "unverifiable", 6: "not_found", 7: "verified", 8: "unverifiable", 9: "unverifiable"}
    assert out[1]["note"] == "cited in 1,200 later decisions, most recently 2020-01-01" and out[2]["note"] == "that is Welch v. Helvering, not Smith v. Jones"
    assert out[3]["note"] == "no opinion is held: page and wording weren't compared; no later decision that is known cites this one" and out[3]["url"] == "u0"
    assert out[6]["note"] == "dated 2090, a year to come" and out[7]["note"].endswith("cited in 1 later decision") and len(out) == 9
    assert cases.resolve(df.limit(0), _cases(spark), 2026).count() == 0


def test_pages(spark):
    text = "Head *12 one two *13three *140 four *9"
    df = spark.createDataFrame([("a", text), ("b", "no marks"), ("c", None), ("d", "")], "id string, text string")
    places = spark.createDataFrame([("a", k) for k in range(len(text))] + [("b", 3), ("c", 0), ("a", 999)], "id string, at int")
    got = {(r["id"], r["at"]): r["page"] for r in cases.printed_page(places, df).collect()}
    for k in range(len(text)):
        before = [int(m[1]) for m in re.finditer(r"\*(\d{1,5})(?!\d)", text) if m.start() <= k]
        assert got["a", k] == (before[-1] if before else None), k
    assert got["b", 3] is None and got["c", 0] is None and got["a", 999] is None
