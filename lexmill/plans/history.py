"""Interval-coded history of a keyed table: one row for each distinct content of a key, with the releases for which it holds.

A release is merged by content hash: only keys whose content is new are written, only contents that end are closed, so a release writes as
much as it changes. Rows lie by the release they came with (``since``), ends by the release that closed them (``until``), so reading the
table as of a release opens the folders up to it and no later one, and a comparison of two releases only those between them. The
catalogue's entry is written last: a release whose writing breaks off is not there, and is written anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans.scratch import materialize

_CATALOGUE = "seq int, release string, enacted date, n_rows long, n_written long, n_closed long"


@dataclass(frozen=True)
class History:
    """A stored history. ``schema``: the rows' columns (DDL); ``key``: the column that names a row."""

    spark: SparkSession
    path: str
    schema: str
    key: str

    def catalogue(self) -> DataFrame:
        """(seq, release, enacted, n_rows, n_written, n_closed), the newest first."""
        try:
            rows = self.spark.read.schema(_CATALOGUE).parquet(f"{self.path}/catalogue/*")
        except AnalysisException:  # no release yet
            rows = self.spark.createDataFrame([], _CATALOGUE)
        return rows.orderBy(F.desc("seq"))

    def last(self) -> int:
        """The number of the newest release, 0 before the first."""
        return self.catalogue().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def add(self, rows: DataFrame, release: str, enacted: str) -> int:
        """Merge a release's whole table; returns its number. Releases come in the order of their dates.

        Of rows with one key the one with the least content hash stands; rows without a key are left out. A release that is there is left as
        it is. Columns beyond the schema's are ignored.
        """
        known = [(r["release"], r["enacted"], r["seq"]) for r in self.catalogue().collect()]  # one row a release
        for name, _, seq in known:
            if name == release:
                return seq
        day = self.spark.range(1).select(F.lit(enacted).cast("date").alias("d")).first()["d"]
        if any(d is not None and d > day for _, d, _ in known):
            raise ValueError(f"{release} of {enacted} is older than a release that is there")
        seq = max((s for *_, s in known), default=0) + 1
        names = self.spark.createDataFrame([], self.schema).columns
        new = rows.select(*names).where(F.col(self.key).isNotNull())
        new = new.withColumn("hash", F.unhex(F.sha2(F.to_json(F.struct(*[c for c in names if c != self.key])), 256)))
        # the least hash first, on keys alone; rows are fetched for what is written
        heads = new.groupBy(self.key).agg(F.min("hash").alias("hash"))
        old = self._open(seq - 1).select(F.col(self.key).alias("k"), F.col("hash").alias("h"), "since")
        both = materialize(heads.join(old, (F.col(self.key) == F.col("k")) & (F.col("hash") == F.col("h")), "full_outer"), "merge")
        fresh = both.where("k is null").select(self.key, "hash")
        written = new.join(fresh, [self.key, "hash"], "left_semi").dropDuplicates([self.key])
        written.select(*names, "hash").write.mode("overwrite").parquet(f"{self.path}/rows/since={seq}")
        ended = both.where(F.col(self.key).isNull()).select(F.col("k").alias(self.key), F.col("since").alias("opened"))
        ended.write.mode("overwrite").parquet(f"{self.path}/ends/until={seq}")
        n = both.agg(F.count(self.key).alias("rows"), F.count_if(F.col("k").isNull()).alias("new"), F.count_if(F.col(self.key).isNull()).alias("ended")).first()
        entry = self.spark.range(1).select(
            F.lit(seq).alias("seq"), F.lit(release).alias("release"), F.lit(enacted).cast("date").alias("enacted"), F.lit(n["rows"]).cast("long").alias("n_rows"),
            F.lit(n["new"]).cast("long").alias("n_written"), F.lit(n["ended"]).cast("long").alias("n_closed"),
        )
        entry.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/catalogue/seq-{seq}")  # of two writers of one number the second fails
        return seq

    def _folders(self, kind: str, column: str, lo: int, hi: int) -> DataFrame:
        """What the releases after ``lo`` up to ``hi`` wrote; each lies in a folder of its own."""
        ddl = f"{self.schema}, hash binary" if kind == "rows" else f"{self._key_ddl()}, opened int"
        folders = [f"{self.path}/{kind}/{column}={s}" for s in range(lo + 1, hi + 1)]
        schema = f"{ddl}, {column} int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders)

    def _key_ddl(self) -> str:
        return f"{self.key} {dict(self.spark.createDataFrame([], self.schema).dtypes)[self.key]}"

    def _open(self, seq: int) -> DataFrame:
        """Rows that hold as of a release, with ``hash`` and ``since``."""
        ends = self._folders("ends", "until", 0, seq).select(F.col(self.key).alias("e_key"), "opened")
        rows = self._folders("rows", "since", 0, seq)
        return rows.join(ends, (F.col(self.key) == F.col("e_key")) & (F.col("since") == F.col("opened")), "left_anti")

    def as_of(self, seq: int) -> DataFrame:
        """The table as the release with this number had it."""
        if not 1 <= seq <= self.last():
            raise ValueError(f"there is no release {seq}")
        return self._open(seq).drop("hash", "since")

    def resolve(self, day: str) -> int:
        """The number of the last release enacted on or before a day; ValueError, with the earliest date there is, if none was."""
        rows = self.catalogue().where("enacted is not null")
        found = rows.where(F.col("enacted") <= F.lit(day).cast("date")).agg(F.max("seq")).first()[0]
        if found is None:
            first = rows.agg(F.min("enacted")).first()[0]
            raise ValueError(f"no release covers {day}; " + (f"the earliest is of {first}" if first else "none is there"))
        return found

    def open_as_of(self, day: str) -> DataFrame:
        return self.as_of(self.resolve(day))

    def intervals(self) -> DataFrame:
        """Every row with ``since`` and ``until``, the number of the first release that has it no more, or null."""
        hi = self.last()
        ends = self._folders("ends", "until", 0, hi).select(F.col(self.key).alias("e_key"), "opened", "until")
        rows = self._folders("rows", "since", 0, hi)
        return rows.join(ends, (F.col(self.key) == F.col("e_key")) & (F.col("since") == F.col("opened")), "left").drop("e_key", "opened", "hash")

    def changes(self, before: int, after: int) -> DataFrame:
        """(key, change, old, new): added, removed or changed keys between two releases, with the rows as structs.

        Keys that no release in between has touched are not read; of the others the contents at both ends are compared.
        """
        touched = self._folders("rows", "since", before, after).select(self.key).unionByName(self._folders("ends", "until", before, after).select(self.key)).distinct()
        touched = materialize(touched, "touched")
        names = self.spark.createDataFrame([], self.schema).columns
        side = lambda seq, name: self._open(seq).join(touched, self.key, "left_semi").select(
            F.col(self.key).alias(f"{name}_key"), F.col("hash").alias(f"{name}_hash"), F.struct(*names).alias(name)
        )
        both = side(before, "old").join(side(after, "new"), F.col("old_key") == F.col("new_key"), "full_outer")
        change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
        return both.select(F.coalesce("old_key", "new_key").alias(self.key), change.alias("change"), "old", "new").where("change is not null")

    def disk_usage(self) -> dict[str, int]:
        """Bytes that each release's rows and ends take, by its name."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        out = {}
        for r in self.catalogue().collect():  # one row a release
            out[r["release"]] = 0
            for folder in (f"{self.path}/rows/since={r['seq']}", f"{self.path}/ends/until={r['seq']}"):
                p = jvm.org.apache.hadoop.fs.Path(folder)
                out[r["release"]] += p.getFileSystem(conf).getContentSummary(p).getLength()
        return out
