"""Large statute files as a splittable source: byte ranges as partitions, sections parsed one at a time.

A task reads from its range's first byte on and takes every section whose opening tag begins inside the range, to its closing tag, wherever that
lies; so each section belongs to one task, however the file is cut. A section inside another is one of its own as well, as it is
when a file is parsed whole. What is held is the section that is being read and a block of the file. Names of the
root's namespaces are taken from the head of the file.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize
from lexmill.session import ship
from lexmill.sources import markup

NAME = "lexmill_sections"
#: Bytes that are read at once, of an opening tag at most, and of a range if nothing else is asked for.
READ, TAG, SPLIT = 1 << 20, 1 << 16, 32 << 20
#: Records of an Arrow batch.
BATCH = 512
SCHEMA = f"{markup.SCHEMA}, at long, root_id string"
#: The same for Arrow; workers have no session that could parse it.
_TYPES = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "date": pa.date32(), "array<string>": pa.list_(pa.string()), "array<date>": pa.list_(pa.date32()),
}
ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (field.split(" ") for field in SCHEMA.split(", "))])

_OPEN = re.compile(rb"<(?:[\w.-]+:)?section(?=[\s>/])[^<>]*>")
_EDGE = re.compile(rb"<(/?)(?:[\w.-]+:)?section(?=[\s>/])[^<>]*>")
_IDENTIFIER = re.compile(rb"\sidentifier\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_NAMESPACE = re.compile(rb"\sxmlns(?::[\w.-]+)?\s*=\s*(?:\"[^\"]*\"|'[^']*')")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _wanted(tag: bytes) -> bool:
    """Whether an opening tag is that of a section with identifiers of its own."""
    m = _IDENTIFIER.search(tag)
    return bool(m) and markup.section_ids((m[1] or m[2] or b"").decode("utf-8", "replace")) != []


class _Bytes:
    """A file's bytes from a place on, a block at a time; ``drop`` lets go of what lies before a place."""

    def __init__(self, handle: Any, start: int) -> None:
        self.handle, self.base, self.data, self.over = handle, start, b"", False
        handle.seek(start)

    def more(self) -> bool:
        block = self.handle.read(READ)
        self.over = not block
        self.data += block
        return not self.over

    def drop(self, at: int) -> None:
        if at - self.base > READ:
            self.data, self.base = self.data[at - self.base :], at


def sections(handle: Any, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of every section with an identifier whose opening tag begins in [start, end)."""
    b = _Bytes(handle, start)
    waiting: list[tuple[int, int]] = []  # open sections: place, depth
    done: list[tuple[int, bytes]] = []
    depth, at = 0, start
    while True:
        m = _EDGE.search(b.data, at - b.base)
        if not m or (m.end() == len(b.data) and not b.over):
            # a tag may be cut by the block's end
            keep = b.data.rfind(b"<", max(at - b.base, len(b.data) - TAG))
            at = b.base + (keep if keep >= at - b.base else len(b.data)) if not m else at
            if not waiting and at >= end:
                return
            b.drop(waiting[0][0] if waiting else at)
            if not b.more():
                if m:
                    b.over = True
                    continue
                # what is still open has no end in the file
                yield from ((p, b.data[p - b.base :]) for p, _ in waiting)
                return
            continue
        place = b.base + m.start()
        at = b.base + m.end()
        if not waiting and place >= end:
            return
        if m[1]:
            depth -= 1
            if waiting and depth == waiting[-1][1]:
                p, _ = waiting.pop()
                done.append((p, b.data[p - b.base : m.end()]))
        elif m[0].endswith(b"/>"):
            if place < end and _wanted(m[0]):
                done.append((place, m[0]))
        else:
            if place < end and _wanted(m[0]):
                waiting.append((place, depth))
            depth += 1
        if done and not waiting:
            yield from sorted(done)  # an outer section comes before those inside it
            done = []
            depth = 0


def head_namespaces(handle: Any) -> bytes:
    """The namespaces that the file's root names."""
    handle.seek(0)
    head = handle.read(TAG)
    m = re.search(rb"<(?![?!])[^<>]*>", head)
    return b"".join(_NAMESPACE.findall(m[0])) if m else b""


class SectionReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        system, path = _open(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
        files = sorted((f for f in files if not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        prefix = self.path[: self.path.index(path)] if path in self.path else ""
        return [Range(prefix + f.path, s, min(s + self.split, f.size)) for f in files for s in range(0, f.size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, path = _open(partition.path)
        held: list[dict] = []
        with system.open_input_file(path) as handle:
            spaces = head_namespaces(handle)
            for at, data in sections(handle, partition.start, partition.end):
                try:
                    section = ET.fromstring(b"<r" + spaces + b">" + data + b"</r>")[0]
                    rows = [r | {"root_id": root} for root, group in markup.section_records(section) for r in group]
                except ET.ParseError as e:
                    rows = [markup.record("corrupt", text=str(e)) | {"root_id": None}]
                held += [r | {"path_in": partition.path, "at": at} for r in rows]
                if len(held) >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, ARROW)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)


class SectionSource(DataSource):
    """``spark.read.format("lexmill_sections").option("splitBytes", n).load(path)``: records of all sections below a path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> SectionReader:  # noqa: ARG002
        return SectionReader(self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT))))


def read_sections(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """The records that ``markup.read`` gives of statutes, read by ranges. Of sections of a file with one identifier the first stands.

    A section that can't be parsed gives one record of kind ``corrupt``; others of its file are read. Comments must hold no section tags. A folder
    without files, and files without sections, give no rows.
    """
    ship(spark)
    spark.dataSource.register(SectionSource)
    rows = materialize(spark.read.format(NAME).option("splitBytes", split_bytes).load(path), "sections")
    heads = rows.where("kind = 'provision' and id = root_id").select("path_in", F.col("root_id").alias("r"), "at").distinct()
    again = heads.groupBy("path_in", "r").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = broadcast_if_small(again.select(F.col("path_in").alias("p"), "r", "first"))
    rows = rows.join(again, (F.col("path_in") == F.col("p")) & (F.col("root_id") == F.col("r")), "left")
    return rows.where("first is null or at = first").select(*markup.FIELDS)
