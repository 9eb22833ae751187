"""The interval-coded history against full copies, and runs of marks against a walk along them."""

import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions import ids
from lexmill.operators import marks
from lexmill.plans import history

SCHEMA = "id string, heading string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", since int, hash int").repartition(3)


def rows_of(df):
    return Counter((r["id"], r["heading"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def releases():
    r = random.Random(1)
    state = {f"/s{i}": (None if i % 5 == 0 else f"h{i}", f"text {i}") for i in range(300)}
    out = [dict(state)]
    for step in range(1, 5):
        for k in r.sample(sorted(state), 6):
            if step % 2:
                state[k] = (state[k][0], f"text {k} of {step}")
            else:
                del state[k]
        state[f"/new{step}"] = ("h", None)
        if step == 3:
            state |= dict(list(out[0].items())[:4])  # contents of old come back
        out.append(dict(state))
    return [[(k, *v) for k, v in s.items()] for s in out]


DAYS = ["2001-01-01", "2002-01-01", "2002-01-01", "2004-05-06", "2005-01-01"]


@pytest.fixture(scope="module")
def made(spark, releases):
    h = history.History(spark, tempfile.mkdtemp(prefix="history-") + "/h", SCHEMA, "id")
    for k, (rows, day) in enumerate(zip(releases, DAYS, strict=True), 1):
        extra = [(None, "no", "key"), rows[0]] if k == 1 else []
        assert h.add(frame(spark, rows + extra), f"r{k}", day) == k
    return h


def test_every_release_equals_its_copy(made, releases):
    for k, rows in enumerate(releases, 1):
        assert rows_of(made.as_of(k)) == Counter(rows)
    assert rows_of(made.open_as_of("2003-07-07")) == Counter(releases[2]) and rows_of(made.open_as_of("2099-01-01")) == Counter(releases[4])
    with pytest.raises(ValueError, match="earliest is of 2001-01-01"):
        made.resolve("2000-12-31")
    with pytest.raises(ValueError, match="no release 9"):
        made.as_of(9)


def test_a_release_writes_what_it_changes(made):
    log = {r["release"]: (r["n_rows"], r["n_written"], r["n_closed"]) for r in made.catalogue().collect()}
    assert log["r1"] == (300, 300, 0) and log["r2"] == (301, 7, 6)
    assert all(n <= 12 for k, (_, n, _) in log.items() if k != "r1")
    sizes = made.disk_usage()
    assert all(sizes[k] < sizes["r1"] for k in ("r2", "r3", "r4", "r5"))
    assert [r["seq"] for r in made.catalogue().collect()] == [5, 4, 3, 2, 1]


def test_intervals_and_changes(made, releases):
    spans = made.intervals().collect()
    assert len({(r["id"], r["since"]) for r in spans}) == len(spans)
    for k, rows in enumerate(releases, 1):
        assert Counter((r["id"], r["heading"], r["text"]) for r in spans if r["since"] <= k and (r["until"] is None or r["until"] > k)) == Counter(rows)
    for a, b in ((1, 5), (2, 3), (1, 4), (4, 4)):
        old, new = ({r[0]: r for r in releases[k - 1]} for k in (a, b))
        expected = {k: ("added" if k not in old else "removed" if k not in new else "changed") for k in old | new if old.get(k) != new.get(k)}
        got = {r["id"]: r for r in made.changes(a, b).collect()}
        assert {k: r["change"] for k, r in got.items()} == expected
        assert all((tuple(r["old"]) if r["old"] else None, tuple(r["new"]) if r["new"] else None) == (old.get(k), new.get(k)) for k, r in got.items())


def test_releases_again_out_of_order_and_broken_off(spark, made, releases):
    assert made.add(frame(spark, releases[0]), "r2", "2002-01-01") == 2  # there already
    with pytest.raises(ValueError, match="older"):
        made.add(frame(spark, releases[0]), "r0", "1999-01-01")
    h = history.History(spark, tempfile.mkdtemp(prefix="history-") + "/h", SCHEMA, "id")
    h.add(frame(spark, releases[0]), "a", "2001-01-01")
    broken = frame(spark, releases[1]).withColumn("text", F.when(F.col("id") == "/s7", F.raise_error("stopped")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stopped"):
        h.add(broken, "b", "2002-01-01")
    assert h.last() == 1 and rows_of(h.as_of(1)) == Counter(releases[0])
    assert h.add(frame(spark, releases[1]), "b", "2002-01-01") == 2 and rows_of(h.as_of(2)) == Counter(releases[1])
    # what a writer that broke off between the tables has left doesn't show, and is written over
    frame(spark, releases[2]).select("id", "heading", "text").withColumn("hash", F.lit(b"x")).write.parquet(f"{h.path}/rows/since=3")
    assert rows_of(h.as_of(2)) == Counter(releases[1])
    assert h.add(frame(spark, releases[2]), "c", "2003-01-01") == 3 and rows_of(h.as_of(3)) == Counter(releases[2])
    assert h.add(frame(spark, []), "none", "2004-01-01") == 4 and h.as_of(4).count() == 0


def kind_of(token, roman):
    if token.isascii() and token.isdigit():
        return "digit", int(token)
    if roman and ids.is_roman(token) and token == token.lower():
        return "roman", ids.roman_to_int(token)
    if len(token) == 1 and token.isascii() and token.isalpha():
        return "letter", ord(token)
    return "other", None


def plain_runs(tokens, roman):
    out = []
    for o, t in enumerate(tokens):
        kind, v = kind_of((t or "").strip("()"), roman)
        if out and kind != "other" and out[-1][1] == kind and out[-1][5] + 1 == v:
            out[-1] = (*out[-1][:3], t, out[-1][4] + 1, v)
        else:
            out.append((o, kind, t, t, 1, v))
    return [x[:5] for x in out]


def plain_summary(tokens):
    t = [(x or "") for x in tokens]
    bare = [x.strip("()") for x in t]
    whole = any(all(f(b) for b in bare) and [g(b) for b in bare] == list(range(g(bare[0]), g(bare[0]) + len(bare))) for f, g in ((str.isdigit, int), (lambda b: len(b) == 1 and b.isalpha(), ord)))
    return f"{t[0]}–{t[-1]}" if len(t) > 2 and whole else ", ".join(t) if len(t) <= 12 else ", ".join(t[:12]) + ", … " + t[-1]


def _parents():
    r = random.Random(4)
    groups = {0: ["(1)", "(2)", "(x)", "(4)", "(5)"], 1: ["(a)", "(b)", "(c)"], 2: ["(i)", "(ii)", "(iii)", "(iv)", "(vi)"], 3: [str(i) for i in range(40)], 4: ["(1)", "(2)"], 5: [None, "", "(1A)"]}
    groups |= {6: ["(1)", "(3)", "(2)", "(4)"], 7: ["(h)", "(i)", "(j)"], 8: ["(Z)"], 9: [f"({i}x)" for i in range(13)], 10: ["1", "2", "b", "c", "5", "6", "2", "3", "9"]}
    for k in range(11, 60):
        groups[k] = [f"({r.choice(['1', '2', '3', '4', 'a', 'b', 'c', 'i', 'v', 'xix', 'xx', 'q!'])})" for _ in range(r.randint(1, 30))]
    return groups


@pytest.mark.parametrize("roman", [False, True])
def test_runs_and_summaries(spark, roman):
    groups = _parents()
    df = spark.createDataFrame([(p, t, o, 1, 2) for p, ts in groups.items() for o, t in enumerate(ts)], "parent int, mark string, ordinal long, n int, first int").repartition(3)
    got = {p: [] for p in groups}
    for r in marks.runs(df, "parent", "mark", "ordinal", roman).collect():
        got[r["parent"]].append((r["place"], r["kind"], r["first"], r["last"], r["n"]))
    assert {p: sorted(x, key=lambda y: y[0]) for p, x in got.items()} == {p: plain_runs(t, roman) for p, t in groups.items()}
    if not roman:
        assert {r["parent"]: (r["n"], r["summary"]) for r in marks.summaries(df, "parent", "mark", "ordinal").collect()} == {p: (len(t), plain_summary(t)) for p, t in groups.items()}
        assert marks.summaries(df.limit(0), "parent", "mark", "ordinal").count() == marks.runs(df.limit(0), "parent", "mark", "ordinal").count() == 0


def test_roman_values(spark):
    df = spark.createDataFrame([(i, ids.int_to_roman(i)) for i in range(1, 4000)], "i int, t string")
    assert df.where(marks.roman_value(F.col("t")) != F.col("i")).count() == 0


def test_pinpoint_hints(spark):
    summary = spark.createDataFrame([("/s263/a", "(1)–(3)")], "parent string, summary string")
    sections = spark.createDataFrame([("263",), ("263A",)], "section string")
    rows = [("1", "§ 263(a)", "/s263/a", "paragraphs", "9", "263", "a"), ("2", "§ 263(b)", "/s263/b", "paragraphs", "1", "263", "b"), ("3", "§ 263(a)", "/s263/a", "paragraphs", "", "263", "1")]
    missing = spark.createDataFrame(rows, "id string, label string, ancestor string, level string, token string, section string, first string")
    out = {r["id"]: r["suggestion"] for r in marks.pinpoint_hints(missing, summary, sections).collect()}
    assert out["1"] == "§ 263(a) has paragraphs (1)–(3); no (9); did you mean § 263A?"
    assert out["2"] == "§ 263(b) has no subdivisions" and out["3"] == "§ 263(a) has paragraphs (1)–(3)"


def test_runs_read_the_children_once(spark):
    groups = {0: ["1", "2", "x", "4", "5"], 1: ["1", "3", "2", "4"], 2: [None, "", "b"]}
    df = spark.createDataFrame([(p, t, o) for p, ts in groups.items() for o, t in enumerate(ts)], "parent int, mark string, ordinal long")
    out = marks.runs(df, "parent", "mark", "ordinal")
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in plan and "Union" not in plan and plan.count("Exchange") == 1
    assert sorted((r["parent"], r["place"], r["n"]) for r in out.collect()) == [(0, 0, 2), (0, 2, 1), (0, 3, 2), (1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)]
