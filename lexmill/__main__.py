"""Command line: ``python -m lexmill ingest|verify|quotes|diff|shift …``; every path is one that Spark reads."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.operators.models import owner_shift
from lexmill.operators.versions import compare_versions
from lexmill.plans import build, quotes, verify
from lexmill.sources.registers import read_register


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {
        "ingest": ("files", "parser", "corpus", "release"), "verify": ("documents", "corpus", "release", "out"), "quotes": ("documents", "corpus", "release", "out"),
        "diff": ("corpus", "before", "after", "out"), "shift": ("register", "out"),
    }.items():
        s = sub.add_parser(name)
        for o in options:
            s.add_argument(f"--{o}", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"lexmill {a.command}").getOrCreate()
    if a.command == "ingest":
        return build.ingest(spark, a.files, a.parser, a.corpus, a.release)
    if a.command == "diff":
        old, new = (build.corpus(spark, a.corpus, "provision", r) for r in (a.before, a.after))
        out = compare_versions(old, new, "id", "heading", "text")
    elif a.command == "shift":
        out = owner_shift(read_register(spark, a.register).withColumn("company", F.lit("register")), "company", "when", "holder", "percent")
    else:
        docs, provisions = spark.read.parquet(a.documents), build.corpus(spark, a.corpus, "provision", a.release)
        if a.command == "verify":
            out = verify.verify(docs, provisions)
        else:
            out = quotes.check_quotes(docs, provisions.select("id", F.col("full_text").alias("text")))
    return out.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
