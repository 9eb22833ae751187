"""Look-ups of citations as they are written."""

from pyspark.sql import functions as F

from lexmill.plans import lookup

ROWS = [
    ("/us/usc/t26/s61", "Gross income", "active", "Own words here", "Own words here and those below", "irc", "61", 0, None),
    ("/us/usc/t26/s61", None, "active", "listed twice", "listed twice", "irc", "61", 0, None), ("/us/usc/t26/s61/a", None, "active", "", "", "irc", "61", 0, "a"),
    ("/us/usc/t26/s61/b", "Other", "repealed", "b text", "b text", "irc", "61", 1, "b"), ("/us/usc/t26/s7", "Seven", "active", None, None, "irc", "7", 0, None), ("/us/cfr/t26/s1.61-1", "Reg", "active", "x" * 50, "x" * 50, "reg", "1.61-1", 0, None),
]


def _provisions(spark):
    return spark.createDataFrame(ROWS, "id string, heading string, status string, text string, full_text string, source string, section string, ordinal int, num string")


def test_lookup(spark):
    asks = [(1, "§ 61"), (2, "I.R.C. § 61(b)"), (3, "26 U.S.C. § 99"), (4, "nothing"), (5, None), (6, "§ 61 and § 7"), (7, "Treas. Reg. § 1.61-1"), (8, "§ 61"), (9, "Rev. Rul. 2001-3")]
    out = {r["ask"]: r for r in lookup.lookup(spark.createDataFrame(asks, "ask int, citation string"), _provisions(spark), max_chars=20).collect()}
    assert len(out) == 9 and out[1]["heading"] == "Gross income" and out[1]["text"] == "Own words here and" and out[1]["truncated"] and out[1]["n_children"] == 2 and out[1]["problem"] is None
    assert out[8]["text"] == out[1]["text"] and out[2]["status"] == "repealed" and not out[2]["truncated"] and "section61" in out[2]["url"]
    assert out[3]["problem"] == "not found" and out[3]["text"] is None and all(out[k]["problem"] and out[k]["canonical_id"] is None for k in (4, 5, 6, 9))
    assert out[7]["text"] == "x" * 20
    own = lookup.lookup(spark.createDataFrame(asks[:1], "ask int, citation string"), _provisions(spark), whole=False).first()
    assert own["text"] == "Own words here"
    assert lookup.lookup(spark.createDataFrame([], "ask int, citation string"), _provisions(spark)).count() == 0


def test_children_sections_notes_months_and_lengths(spark):
    p = _provisions(spark)
    rows = lookup.subdivisions(spark.createDataFrame([(1, "§ 61"), (2, "§ 7"), (3, "no")], "ask int, citation string"), p).collect()
    assert sorted((r["ask"], r["ordinal"], r["num"]) for r in rows) == [(1, 0, "a"), (1, 1, "b")]
    assert [r["section"] for r in lookup.section_numbers(p, "irc").collect()] == ["61", "7"]
    notes = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 0, "z")], "id string, ordinal int, text string")
    assert [r["text"] for r in lookup.notes_of(spark.createDataFrame([("a",), ("a",)], "id string"), notes).collect()] == ["x", "y"]
    months = spark.createDataFrame([("2024-02-01",), ("2023-12-01",), (None,), ("2024-02-01",)], "m string").select(F.col("m").cast("date").alias("month"))
    assert [str(r["month"]) for r in lookup.rate_months(months).collect()] == ["2023-12-01", "2024-02-01"]
    totals = {r["source"]: (r["n"], r["n_sections"], r["mean_chars"]) for r in lookup.text_lengths(p).collect()}
    assert totals == {"irc": (5, 3, (14 + 12 + 6) / 3), "reg": (1, 1, 50.0)}


def test_plain_sections_are_read_like_the_grammar_does_and_stay_in_the_jvm(spark, monkeypatch):
    from lexmill.functions.cite import parse_citation
    from lexmill.functions.ids import source_url

    plain = [h + s + p for h in ("26 U.S.C. § ", "§ ") for s in ("1", "162", "263A", "007", "123456789") for p in ("", "(b)", "(a)(2)(B)(iv)", "(1)", "(IV)(aa)", "(no)(2024)", "(USC)(ch)")]
    other = ["26 USC § 162", "§ 162\n", "§ 162(Rabkin)", "§ 162 (a)", "§§ 1, 2", "26 U.S.C. § 1400Z-2", "", None, "§ 1.162-1", "§ 162(a), (b)", "notice 5"]
    texts = plain + other
    sent = []
    real = lookup.materialize
    monkeypatch.setattr(lookup, "materialize", lambda df, label="table": sent.append(real(df, label)) or sent[-1])
    out = lookup.coerce(spark.createDataFrame(list(enumerate(texts)), "ask int, citation string")).collect()
    assert len(out) == len(texts) and {r["c"] for r in sent[0].collect()} == {t or "" for t in other}
    for r in out:
        try:
            c = parse_citation(texts[r["ask"]] or "")
        except ValueError as e:
            assert r["problem"] == str(e) and r["canonical_id"] is None
            continue
        url = source_url(c["source"], c["section"], c["path"])
        assert (r["canonical_id"], r["display"], r["source"], r["url"], r["problem"]) == (c["canonical_id"], c["display"], c["source"], url, None), texts[r["ask"]]
