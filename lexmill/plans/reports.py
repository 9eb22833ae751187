"""Reports: what was found in a document, as rows, counts, and one file a document.

Findings are rows; a document's lines are laid together by one shuffle and a sort, so a report is written as its lines come and no document's
findings are collected. Files go through a data source whose tasks write aside and whose commit moves them to their place: until all
tasks have ended there is no report of the run, and of a run that fails there is none.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lexmill.plans.verify import SEVERITIES
from lexmill.session import ship
from lexmill.sources.registers import markdown_row

NAME = "lexmill_reports"
# How serious each outcome of a quotation is.
QUOTES = {"quote_exact": "ok", "quote_close": "info", "wrong_pinpoint": "warning", "misattributed": "error", "quote_not_found": "error"}
VERDICTS = {
    "ok": "Every citation and quotation is in order.", "info": "No errors; some citations could not be checked.", "warning": "Some citations or quotations need a look.",
    "error": "Some citations or quotations are wrong.",
}
#: How a report's file ends, by format.
ENDINGS = {"json": ".json", "markdown": ".md", "github": ".txt"}


def findings(results: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, kind, name, status, severity, note, orphan): citations as ``verify`` resolves them, quotations as ``check_quotes`` judges them.

    A quotation without a citation is an orphan. ``results``: doc_id, start, end, display, status, severity, and suggestion if it is known.
    """
    note = F.col("suggestion") if "suggestion" in results.columns else F.lit(None).cast("string")
    out = results.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit("citation").alias("kind"), F.col("display").alias("name"), "status", "severity",
        note.alias("note"), F.lit(False).alias("orphan"),
    )
    if quotes is None:
        return out
    severity = F.coalesce(*[F.when(F.col("status") == s, v) for s, v in QUOTES.items()], F.lit("error"))
    return out.unionByName(
        quotes.select(
            "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit("quotation").alias("kind"), F.col("quote").alias("name"), "status",
            severity.alias("severity"), F.when(F.col("status").isin("wrong_pinpoint", "misattributed"), F.concat(F.lit("the words stand in "), "p_id")).alias("note"), F.col("cited").isNull().alias("orphan"),
        )
    )


def worst(severity: Column) -> Column:
    """The most serious of a group's severities."""
    return F.max_by(severity, F.array_position(F.array(*map(F.lit, SEVERITIES)), severity))


def counts(found: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_findings, n_ok ... n_error, n_orphans, worst, by_status): one row a document, zeros and ``ok`` for one without findings."""
    by_status = found.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES], F.count_if("orphan").alias("n_orphans"), worst(F.col("severity")).alias("w"))
    total = by_status.groupBy("doc_id").agg(
        F.sum("n").alias("n_findings"), *[F.sum(f"n_{s}").alias(f"n_{s}") for s in SEVERITIES], F.sum("n_orphans").alias("n_orphans"), worst(F.col("w")).alias("worst"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"),  # one entry a status
    )
    each = docs.select(F.col(id_col).alias("d")).distinct()
    rows = each.join(total, F.col("d").eqNullSafe(F.col("doc_id")), "left").drop("doc_id").withColumnRenamed("d", "doc_id")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_findings", *[f"n_{s}" for s in SEVERITIES], "n_orphans")]
    return rows.select("doc_id", *zero, F.coalesce("worst", F.lit("ok")).alias("worst"), F.coalesce("by_status", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("by_status"))


def located(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """With the 1-based ``line`` of each finding, counted on the text's line ends in order; ids are those of single documents."""
    ends = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), ""), lambda c, i: F.when(c == "\n", i)), lambda i: i.isNotNull())
    where = docs.select(F.col(id_col).alias("d"), ends.alias("ends"))
    rows = found.join(where, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return rows.withColumn("line", F.size(F.filter(F.coalesce("ends", F.array().cast("array<int>")), lambda e: e < F.col("start"))) + 1).drop("d", "ends")


def lines(found: DataFrame, summary: DataFrame, form: str = "json") -> DataFrame:
    """(doc_id, pos, line): the lines of every document's report in order of ``pos``, from ``located`` findings and ``counts``.

    Formats: json (one object a document), markdown (a verdict and a table) and github (annotations of warnings and errors; a document without
    has an empty file).
    """
    if form not in ENDINGS:
        raise ValueError(f"no format {form!r}")
    place = F.struct("start", "end", "kind", "name", "status")
    at = lambda k, what=None: F.struct(F.lit(k).alias("k"), (what if what is not None else F.lit(None).cast("struct<start:bigint,end:bigint,kind:string,name:string,status:string>")).alias("of")).alias("pos")
    of = lambda k, line: summary.select("doc_id", at(k), line.alias("line"))
    if form == "github":
        level = F.when(F.col("severity").isin("warning", "error"), F.col("severity"))
        message = F.concat_ws(": ", "status", F.coalesce("note", "name"))
        escaped = F.replace(F.replace(F.replace(message, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        note = F.concat(F.lit("::"), level, F.lit(" file="), F.col("doc_id").cast("string"), F.lit(",line="), "line", F.lit("::"), escaped)
        return found.where(level.isNotNull()).select("doc_id", at(1, place), note.alias("line")).unionByName(of(0, F.lit(None).cast("string")))
    numbers = ("n_findings", *[f"n_{s}" for s in SEVERITIES], "n_orphans")
    if form == "json":
        head = F.concat(F.lit('{"document": '), F.to_json(F.struct("doc_id", *numbers, "worst", "by_status")), F.lit(', "findings": ['))
        body = F.to_json(F.struct("kind", "name", "start", "end", "line", "status", "severity", "note", "orphan"))
        # a comma belongs before every finding but the first: the writer puts it between lines of one rank
        return of(0, head).unionByName(found.select("doc_id", at(1, place), body.alias("line"))).unionByName(of(2, F.lit("]}")))
    verdict = F.coalesce(*[F.when(F.col("worst") == s, v) for s, v in VERDICTS.items()])
    head = F.concat_ws("\n", F.lit("# Verification report"), F.lit(""), F.concat(F.lit("**"), verdict, F.lit("**")), F.lit(""), F.concat_ws(", ", *[F.concat(F.col(f"n_{s}").cast("string"), F.lit(f" {s}")) for s in SEVERITIES]), F.lit(""))
    table = F.when(F.col("n_findings") == 0, F.lit("Nothing is cited or quoted.")).otherwise(F.concat_ws("\n", F.lit("| Line | Kind | Citation | Status | Note |"), F.lit("|---:|---|---|---|---|")))
    row = F.regexp_replace(markdown_row(F.col("line"), F.col("kind"), F.col("name"), F.concat_ws(" ", "severity", "status"), F.coalesce("note", F.lit(""))), r"[\r\n]+", " ")
    return of(0, F.concat_ws("\n", head, table)).unionByName(found.select("doc_id", at(1, place), row.alias("line")))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def file_name(doc_id: str | None) -> str:
    """A file's name without its ending; ids with other characters than letters, digits, dots, dashes and underscores get a digest."""
    name = re.sub(r"[^\w.-]", "_", doc_id or "", flags=re.A)
    return name if name and name == doc_id and not name.startswith(".") and len(name) < 150 else f"{name[:100]}-{hashlib.sha256(repr(doc_id).encode()).hexdigest()[:16]}"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, ending: str) -> None:
        self.path, self.ending, self.job = path.rstrip("/"), ending, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One task's reports, in a folder of this attempt alone. Rows (doc, rank, line) come in order."""
        system, root = _open(self.path)
        folder, names, out, last, doc = f"{root}/_staged-{self.job}/{uuid.uuid4().hex}", [], None, None, object()
        for b in iterator:
            for d, rank, line in zip(*(b.column(c).to_pylist() for c in ("doc", "rank", "line")), strict=True):
                if d != doc:
                    if out:
                        out.close()
                    system.create_dir(folder, recursive=True)
                    names.append(file_name(d) + self.ending)
                    out, doc, last = system.open_output_stream(f"{folder}/{names[-1]}"), d, None
                if line is not None:
                    comma = "," if self.ending == ".json" and rank == 1 and last == 1 else ""
                    out.write(f"{comma}{line}\n".encode())
                last = rank
        if out:
            out.close()
        return Written(folder, names)

    def commit(self, messages: list[Any]) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m is not None:
                for name in m.names:
                    system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Any]) -> None:  # noqa: ARG002
        self._clear(*_open(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        folder = f"{root}/_staged-{self.job}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "doc string, rank int, line string"

    def writer(self, schema: Any, overwrite: bool) -> ReportWriter:  # noqa: ARG002
        return ReportWriter(self.options["path"], self.options["ending"])


def write_reports(rows: DataFrame, path: str, form: str = "json") -> None:
    """Write ``lines`` as one file a document into a folder; a document that has a report there gets the new one. Nulls among ids share a file."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(ReportSink)
    laid = rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos").select(F.col("doc_id").cast("string").alias("doc"), F.col("pos.k").alias("rank"), "line")
    laid.write.format(NAME).mode("append").option("ending", ENDINGS[form]).save(path)
