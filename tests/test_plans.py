"""Quotation plan, names and streams."""



from lexmill.functions.names import names_match
from lexmill.plans.quotes import check_quotes
from lexmill.session import table
from lexmill.streaming.verify import verify_stream, windowed_counts

PROVISIONS = [
    ("/us/usc/t26/s162", "In general. There shall be allowed as a deduction all the ordinary and necessary expenses paid. Reasonable allowance for salaries and travel."),
    ("/us/usc/t26/s162/a", "There shall be allowed as a deduction all the ordinary and necessary expenses paid."),
    ("/us/usc/t26/s162/b", "Reasonable allowance for salaries and travel shall not exceed amounts prescribed."),
    ("/us/usc/t26/s61", "Gross income means all income from whatever source derived, including compensation."),
]


def test_five_outcomes(spark):
    memos = [
        (1, "It says “all the ordinary and necessary expenses paid” in § 162(a)."),
        (2, "It says “allowed as a deductoin all the ordinary and necesary expenses” in § 162(a)."),
        (3, "It says “salaries and travel shall not exceed amounts prescribed” in § 162(a)."),
        (4, "It says “all income from whatever source derived” in § 162(a)."),
        (5, "It says “purple elephants dance under seven moons tonight” in § 162(a)."),
        (6, "Nothing quoted."), (7, None),
        (8, "“all income from whatever source derived” without any authority."),
    ]
    out = check_quotes(spark.createDataFrame(memos, "doc_id long, text string"), spark.createDataFrame(PROVISIONS, "id string, text string")).collect()
    assert {r["doc_id"]: r["status"] for r in out} == {1: "quote_exact", 2: "quote_close", 3: "wrong_pinpoint", 4: "misattributed", 5: "quote_not_found", 8: "misattributed"}
    assert {r["doc_id"]: r["p_id"] for r in out}[4] == "/us/usc/t26/s61"


def test_names():
    assert names_match("Welch v. Helvering", "WELCH v. HELVERING, Commissioner of Internal Revenue")[0]
    assert names_match("Comm'r v. Groetzinger", "Commissioner v. Robert P. Groetzinger")[0]
    assert not names_match("Welch v. Helvering", "Smith v. Jones")[0]
    assert names_match(None, "Smith v. Jones") == (True, 1.0)


def test_stream_of_documents_and_windows(spark, tmp_path):
    prov = spark.createDataFrame([("/us/usc/t26/s162", "Trade", "active")], "id string, heading string, status string")
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    for k, text in enumerate(("see § 162", "see § 9999")):
        spark.createDataFrame([(k, text)], "doc_id long, text string").write.mode("append").parquet(src)
        verify_stream(spark, src, prov, out, cp).awaitTermination(120)
    assert {r["doc_id"]: r["status"] for r in spark.read.parquet(out).collect()} == {0: "verified", 1: "not_found"}
    events = table(spark, "/root/testdata/sf0.001", "events")
    batch = {(r["start"], r["event_type"]): r["n"] for r in windowed_counts(events, "ts", "event_type", "value").collect()}
    assert sum(batch.values()) == events.where("ts is not null").count()
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/event*.parquet")
    q = windowed_counts(stream, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()} == batch
