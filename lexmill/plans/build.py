"""From files to a corpus: parsed records split into tables by kind, and the tables that derive from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.cite import extract_citations
from lexmill.functions.definitions import definitions, relative_targets
from lexmill.functions.ids import section_of
from lexmill.operators.graph import closure, without_internal
from lexmill.operators.lookup import keep_first, truncate_words
from lexmill.session import ship
from lexmill.sources import markup

KINDS = ("provision", "ref", "note", "guidance", "relation", "corrupt")


def ingest(spark: SparkSession, path: str, parser: str, out: str, release: str) -> None:
    """Parse every file once and write its records as ``out``/records/release=…/source=…; a repeated run replaces that part alone."""
    rows = markup.read(spark, path, parser)
    rows.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/records/release={release}/parser={parser}")


def corpus(spark: SparkSession, out: str, kind: str, release: str) -> DataFrame:
    """One table of a release. Of provisions with one id the one with a heading stands."""
    rows = spark.read.option("basePath", f"{out}/records").parquet(f"{out}/records").where((F.col("release") == release) & (F.col("kind") == kind)).drop("kind", "release", "parser")
    if kind == "provision":
        return keep_first(rows, ["id"], [F.col("heading").isNull(), F.col("ordinal"), F.col("path_in")])
    return rows


def xrefs(provisions: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, kind, external, raw): references of the markup, those that the text cites, and relative ones; no self-edges."""
    ship(provisions.sparkSession)
    struct = pa.struct([("to_id", pa.string()), ("kind", pa.string()), ("raw", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for source, section, path, text in zip(*[b.column(c).to_pylist() for c in ("source", "section", "path", "text")], strict=True):
                edges = [{"to_id": c["canonical_id"], "kind": "implicit", "raw": c["raw"]} for c in extract_citations(text) if c["canonical_id"]]
                edges += [{"to_id": i, "kind": "relative", "raw": raw} for i, raw in relative_targets(source, section, path, text)]
                found.append(edges)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(struct))], ["from_id", "e"])

    rows = provisions.where("text is not null and text != ''").select("id", "source", "section", "path", "text")
    edges = rows.mapInArrow(scan, "from_id string, e array<struct<to_id:string,kind:string,raw:string>>").select("from_id", F.explode("e").alias("e")).select("from_id", "e.*")
    edges = edges.withColumn("external", F.lit(False))
    if explicit is not None:
        marked = explicit.select(F.col("id").alias("from_id"), "to_id", F.lit("explicit").alias("kind"), F.lit(None).cast("string").alias("raw"), "external")
        edges = edges.unionByName(marked)
    return keep_first(edges.where("from_id != to_id"), ["from_id", "to_id", "kind"], [F.col("raw")])


def commencements(notes: DataFrame) -> DataFrame:
    """(section_id, applies_after): each section's first effective-date note that has a date."""
    rows = notes.where("topic = 'effectiveDate' and applies_after is not null").select(section_of(F.col("id")).alias("section_id"), "ordinal", "applies_after")
    return keep_first(rows, ["section_id"], ["ordinal"]).select("section_id", "applies_after")


def temporary_sunsets(provisions: DataFrame, notes: DataFrame, today: str) -> DataFrame:
    """(id, issued, expires, expired, applies): temporary regulations expire three years after issue, those of before 21 November 1988 don't."""
    issued = notes.where("topic = 'sourceCredit'").select(F.col("id").alias("n_id"), F.array_min("dates").alias("issued"))
    rows = provisions.where(F.col("section").rlike(r"-\d+T$") & (F.size("path") == 0)).join(issued, F.col("id") == F.col("n_id"))
    expires = F.add_months("issued", 36)
    return rows.select("id", "issued", expires.alias("expires"), (expires < F.lit(today).cast("date")).alias("expired"), (F.col("issued") > F.lit("1988-11-20").cast("date")).alias("applies"))


def reading_list(seeds: DataFrame, provisions: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 25) -> DataFrame:
    """(seed, node, depth, heading, excerpt): what each seed's section leads to, nearest first, at most ``limit`` a seed (a report's length)."""
    hops = without_internal(edges.where("not external")).select("from_id", "to_id")
    found = closure(hops, seeds, depth).where("depth > 0")
    head, _ = truncate_words(F.regexp_replace("text", r"\s+", " "), 220)
    rows = found.join(provisions.select(F.col("id").alias("node"), "heading", head.alias("excerpt")), "node")
    # each task keeps its nearest of a seed before rows are shuffled; none is collected
    nearest = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))
    return rows.withColumn("r", nearest).where(F.col("r") <= limit).select("seed", "depth", "node", "heading", "excerpt")


def dictionary(provisions: DataFrame) -> DataFrame:
    return definitions(provisions.select("id", "text"))
