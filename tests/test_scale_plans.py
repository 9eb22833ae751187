"""Joins that have to hold at any size: what may be broadcast, and how many rows a join makes."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.operators import fuzzy, models
from lexmill.plans import verify
from lexmill.queries import QUERIES


def sent(df):
    """The plans below every broadcast of ``df``, before it runs."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.initialPlan()
        if p.nodeName() == "BroadcastExchange":
            out.append(p.treeString())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_names_are_never_broadcast(spark, tmp_path):
    spark.range(2000).select(F.col("id").cast("string").alias("n")).write.parquet(f"{tmp_path}/many-names")
    names = spark.read.parquet(f"{tmp_path}/many-names")
    out = fuzzy.nearest(spark.createDataFrame([("163A",), ("19",)], "q string"), "q", names, "n")
    assert sent(out) and not any("many-names" in p for p in sent(out))
    got = {(r["query"], r["rank"]): (r["name"], r["dist"], r["gap"]) for r in out.collect()}
    assert got["163A", 1] == ("163", 1, 0) and got["19", 1] == ("18", 1, 1) and len(got) == 6


def plain_shift(rows, kind):
    by = defaultdict(dict)
    for e, d, h, p in rows:
        if e is not None and d is not None:
            held = by[e, h]
            held[d] = p if held.get(d) is None else held[d] if p is None else max(p, held[d])
    out = {}
    for e, t in {(e, d) for (e, _), held in by.items() for d in held}:
        start = t.replace(year=t.year - 3, day=28 if (t.month, t.day) == (2, 29) else t.day)
        total = 0
        for held in (held for (x, _), held in by.items() if x == e):
            known = [d for d in sorted(held) if d <= t]
            counted = [held[d] for d in known if d >= start] + [held[d] for d in known if d < start][-1:]
            peak = max((held[d] for d in known if held[d] is not None), default=0)
            if known and peak >= 5 and held[known[-1]] is not None:
                total += max(held[known[-1]] - min(p for p in counted if p is not None), 0)
        out[e, t] = (kind(round(total, 6)), total > 50)
    return out


def test_owner_shift_equals_its_definition_without_pairs_of_dates_and_holders(spark):
    r = random.Random(3)
    day = lambda: datetime.date(1999, 2, 25) + datetime.timedelta(r.choice([0, 365, 366, 730, 1095, 1096, 1097, 1461, 2191, 2192, 3000]) + r.randint(0, 7))
    rows = [(r.choice(["x", "y", "z", None]), r.choice([day(), day(), None]) if r.random() < 0.1 else day(), r.choice(["A", "B", "C", None]), r.choice([None, 0, 3, 5, 17, 40, 60, 99])) for _ in range(400)]
    # a null day of a large holding is no peak; the series of one holder over the ends of February
    rows += [("n", None, "A", 99), ("n", datetime.date(2001, 1, 1), "A", 1), ("n", datetime.date(2002, 1, 1), "A", 4)]
    rows += [("f", d, "A", p) for d, p in ((datetime.date(2001, 2, 27), 9), (datetime.date(2001, 2, 28), 6), (datetime.date(2001, 3, 1), 30), (datetime.date(2004, 2, 28), 80), (datetime.date(2004, 2, 29), 81), (datetime.date(2004, 3, 1), 82))]
    rows += [("f", datetime.date(2004, 3, 2), "B", 0), ("f", datetime.date(2007, 2, 28), "B", 7), ("f", datetime.date(2007, 3, 1), "B", 8), ("f", datetime.date(2008, 2, 29), "B", 9)]
    for sql, kind in (("double", float), ("decimal(9,4)", float), ("int", int)):
        df = spark.createDataFrame(rows, "e string, d date, h string, p int").withColumn("p", F.col("p").cast(sql)).repartition(3)
        out = models.owner_shift(df, "e", "d", "h", "p")
        assert {(x["e"], x["when"]): (kind(x["total_increase"]), x["changed"]) for x in out.collect()} == plain_shift(rows, kind)
        assert "Join" not in out._jdf.queryExecution().toString()
    # sums of changes leave no rest: 0.1 and 0.2 come and go before 50 is reached, and 50 is no change
    back = [("s", f"2000-01-0{k}", h, p) for k, h, p in ((1, "A", 5.1), (1, "B", 5.2), (2, "A", 5.3), (3, "A", 5.1), (3, "B", 55.2))]
    out = models.owner_shift(spark.createDataFrame(back, "e string, d string, h string, p double"), "e", "d", "h", "p")
    assert {str(x["when"]): (x["total_increase"], x["changed"]) for x in out.collect()} == {"2000-01-01": (0.0, False), "2000-01-02": (pytest.approx(0.2), False), "2000-01-03": (50.0, False)}


def test_provisions_are_never_broadcast(spark, tmp_path, monkeypatch):
    rows = [(f"/us/usc/t26/s{i}" + x, None if i % 2 else f"h{i}", "repealed" if i % 5 == 0 else "active") for i in range(1, 400) for x in ("", "/a", "/a/1")]
    spark.createDataFrame(rows + [("/us/usc/t26/s7", "z", "active")], "id string, heading string, status string").write.parquet(f"{tmp_path}/many-provisions")
    provisions = spark.read.parquet(f"{tmp_path}/many-provisions")
    written = []
    monkeypatch.setattr(verify, "materialize", lambda df, *a, f=verify.materialize: written.append(df) or f(df, *a))
    text = "§ 7(a)(1)(B), § 7, § 8(c), § 10, § 900 and Rev. Rul. 2019-2; Rev. Rul. 2019-3; Treas. Reg. § 1.7-1"
    rulings = spark.createDataFrame([("rev-rul-2019-2", "superseded")], "id string, status string")
    out = verify.verify(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), provisions, rulings, [2019])
    got = {r["display"]: (r["status"], r["heading"], r["ancestor"]) for r in out.collect()}
    assert got == {
        "§ 7(a)(1)(B)": ("pinpoint_not_found", None, "/us/usc/t26/s7/a/1"), "§ 7": ("verified", "z", None), "§ 8(c)": ("pinpoint_not_found", None, "/us/usc/t26/s8"), "§ 10": ("repealed", "h10", None),
        "§ 900": ("not_found", None, None), "Rev. Rul. 2019-2": ("superseded", None, None), "Rev. Rul. 2019-3": ("not_found", None, None), "Treas. Reg. § 1.7-1": ("source_unavailable", None, None),
    }
    assert not any("many-provisions" in p for df in (out, *written) for p in sent(df))
    # what is kept of the provisions is what is cited or lies above it
    assert [df.count() for df in written if "p_status" not in df.columns and "heading" in df.columns] == [5]


def test_scopes_are_read_once_a_definition(spark):
    plan = QUERIES["scope_reaches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "governs" in above and "split" not in above and "regexp" not in above.lower()
