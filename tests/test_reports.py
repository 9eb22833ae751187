"""Reports of documents: rows, counts and files that appear together."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.plans import reports

DOCS = [(1, "One.\nSee § 1(a) and\n“four words of text” there."), (2, "Nothing."), (3, None), (4, "\n\n§ 9 | and § 8\n")]
RESULTS = [(1, 9, 15, "§ 1(a)", "verified", "ok", None), (4, 2, 5, "§ 9 | x", "not_found", "error", "did you mean\n§ 90?"), (4, 12, 15, "§ 8", "repealed", "warning", None), (4, 2, 5, "§ 7", "unverifiable", "info", None)]
QUOTES = [(1, 20, 41, "four words of text", "misattributed", "/s2", None), (4, 1, 2, "some “quoted” words", "quote_exact", "/s9", "/s9")]


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    results = spark.createDataFrame(RESULTS, "doc_id long, start int, end int, display string, status string, severity string, suggestion string")
    quotes = spark.createDataFrame(QUOTES, "doc_id long, start int, end int, quote string, status string, p_id string, cited string")
    found = reports.located(reports.findings(results, quotes), docs)
    return found, reports.counts(found, docs)


def test_counts_and_lines(made):
    found, summary = made
    rows = {r["doc_id"]: r for r in summary.collect()}
    assert [rows[4][c] for c in ("n_findings", "n_ok", "n_info", "n_warning", "n_error", "n_orphans", "worst")] == [4, 1, 1, 1, 1, 0, "error"]
    assert rows[1]["n_orphans"] == 1 and rows[1]["by_status"] == {"verified": 1, "misattributed": 1} and rows[1]["worst"] == "error"
    assert [rows[2][c] for c in ("n_findings", "n_ok", "worst", "by_status")] == [0, 0, "ok", {}] and set(rows) == {1, 2, 3, 4}
    assert {(r["doc_id"], r["name"]): r["line"] for r in found.collect()} == {(1, "§ 1(a)"): 2, (1, "four words of text"): 3, (4, "§ 9 | x"): 3, (4, "§ 8"): 3, (4, "§ 7"): 3, (4, "some “quoted” words"): 2}


def test_one_file_a_document_in_every_format(made, tmp_path):
    found, summary = made
    for form in reports.ENDINGS:
        reports.write_reports(reports.lines(found, summary, form), f"file://{tmp_path}/{form}", form)
        assert sorted(p.name for p in (tmp_path / form).iterdir()) == [f"{k}{reports.ENDINGS[form]}" for k in (1, 2, 3, 4)]
    full = json.loads((tmp_path / "json/4.json").read_text())
    assert full["document"]["n_error"] == 1 and [x["name"] for x in full["findings"]] == ["some “quoted” words", "§ 7", "§ 9 | x", "§ 8"]
    assert json.loads((tmp_path / "json/2.json").read_text())["findings"] == []
    text = (tmp_path / "markdown/4.md").read_text()
    assert "**Some citations or quotations are wrong.**" in text and "| 3 | citation | § 9 \\| x | error not_found | did you mean § 90? |" in text
    assert "Nothing is cited or quoted." in (tmp_path / "markdown/3.md").read_text()
    assert (tmp_path / "github/4.txt").read_text() == "::error file=4,line=3::not_found: did you mean%0A§ 90?\n::warning file=4,line=3::repealed: § 8\n"
    assert (tmp_path / "github/2.txt").read_text() == ""
    with pytest.raises(ValueError, match="no format"):
        reports.lines(found, summary, "pdf")


def test_a_failed_task_leaves_no_report(spark, made, tmp_path):
    found, summary = made
    rows = reports.lines(found, summary)
    broken = rows.withColumn("line", F.when((F.col("doc_id") == 4) & (F.col("pos.k") == 2), F.raise_error(F.lit("stopped"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stopped"):
        reports.write_reports(broken, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []
    reports.write_reports(rows, str(tmp_path / "out"))
    before = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    with pytest.raises(Exception, match="stopped"):
        reports.write_reports(broken, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if p.is_file()} == before
    reports.write_reports(rows.where("doc_id < 0"), str(tmp_path / "none"))


def test_a_document_with_many_findings_and_odd_ids(spark, tmp_path):
    docs = spark.createDataFrame([("a/b", "x"), ("a_b", "y"), (None, "z"), ("..", "w")], "doc_id string, text string")
    results = spark.range(20_000).select(F.lit("a/b").alias("doc_id"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.lit("§ 1").alias("display"), F.lit("verified").alias("status"), F.lit("ok").alias("severity"))
    found = reports.located(reports.findings(results), docs)
    reports.write_reports(reports.lines(found, reports.counts(found, docs)), str(tmp_path / "o"))
    names = [p.name for p in Path(tmp_path / "o").iterdir()]
    assert len(names) == 4 and "a_b.json" in names and all("/" not in n for n in names)
    sizes = Counter(len(json.loads(p.read_text())["findings"]) for p in Path(tmp_path / "o").iterdir())
    assert sizes == {20_000: 1, 0: 3}
