"""Files to corpus, derived tables and the command line."""

from pyspark.sql import functions as F

from lexmill.__main__ import main
from lexmill.plans import build
from test_functions import REGULATION, STATUTE

SECOND = STATUTE.replace(b"wages,", b"wages and this subsection, under section 4,").replace(b"<heading>Gross income</heading>", b"<heading>Income</heading>")


def test_corpus_from_files(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/corpus"
    for name, data in (("a", STATUTE), ("b", SECOND)):
        (src / name).mkdir(parents=True)
        (src / name / "s.xml").write_bytes(data)
    (src / "r").mkdir()
    (src / "r" / "r.xml").write_bytes(REGULATION.replace(b"1.61-1", b"1.61-1T").replace(b"1957", b"1990"))
    for r, name in (("r1", "a"), ("r2", "b")):
        main(["ingest", "--files", f"file://{src}/{name}", "--parser", "statute", "--corpus", out, "--release", r])
    build.ingest(spark, f"file://{src}/r", "regulation", out, "r2")
    prov, refs, notes = (build.corpus(spark, out, k, "r2") for k in ("provision", "ref", "note"))
    assert prov.where("source = 'irc'").count() == 5
    edges = {(r["from_id"], r["to_id"], r["kind"]) for r in build.xrefs(prov.where("source = 'irc'"), refs).collect()}
    assert edges == {("/us/usc/t26/s61/a", "/us/usc/t26/s62", "explicit"), ("/us/usc/t26/s61/a/1", "/us/usc/t26/s61/a", "relative"), ("/us/usc/t26/s61/a/1", "/us/usc/t26/s4", "implicit")}
    assert [(r["section_id"], str(r["applies_after"])) for r in build.commencements(notes).collect()] == [("/us/usc/t26/s61", "2017-12-31")]
    sunset = build.temporary_sunsets(prov, notes, "2026-01-01").collect()
    assert [(str(r["expires"]), r["expired"], r["applies"]) for r in sunset] == [("1993-11-25", True, True)]
    main(["diff", "--corpus", out, "--before", "r1", "--after", "r2", "--out", f"file://{tmp_path}/diff"])
    diff = {r["id"]: r["change"] for r in spark.read.parquet(f"file://{tmp_path}/diff").where("id like '/us/usc%'").collect()}
    assert diff == {"/us/usc/t26/s61": "renamed", "/us/usc/t26/s61/a/1": "changed"}
    seeds = spark.createDataFrame([("/us/usc/t26/s61/a/1",)], "id string")
    assert [(r["node"], r["depth"]) for r in build.reading_list(seeds, prov, build.xrefs(prov, refs)).collect()] == [("/us/usc/t26/s4", 1)]
    assert build.dictionary(prov).where(F.lit(True)).count() == 0
