"""Quotation checks for whole tables of documents.

Quotations, their citations and the association are found in one pass over each text. Scoring is by joins: the cited provision, then the
other provisions of its section, then every provision that the quotation's seeds don't rule out. Each step scores only what is still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexmill.functions.cite import extract_citations
from lexmill.functions.ids import section_of
from lexmill.functions.quote import CLOSE, ELSEWHERE, EXACT, associate, extract_quotes, score_quote
from lexmill.operators.altered import candidates
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize
from lexmill.session import ship


@F.pandas_udf(DoubleType())
def _score(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([score_quote(q, t) if q and t else 0.0 for q, t in zip(quote, text, strict=True)])


def extract_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, q, start, end, quote, kind, cited, citation): every quotation with its citation's id and display, null for orphans."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    struct = pa.struct([("q", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("quote", pa.string()), ("kind", pa.string()), ("cited", pa.string()), ("citation", pa.string())])

    def rows(text: str | None) -> list[dict]:
        quotes = extract_quotes(text)
        if not quotes:
            return []
        citations = extract_citations(text)
        to = associate(quotes, [(c["start"], c["end"]) for c in citations], text)
        out = []
        for k, q in enumerate(quotes):
            c = citations[to[k]] if to[k] is not None else {}
            out.append({"q": k, "start": q.start, "end": q.end, "quote": q.text, "kind": q.kind, "cited": c.get("canonical_id"), "citation": c.get("display")})
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rows(t) for t in b.column(1).to_pylist()], pa.list_(struct))], ["doc_id", "r"])

    texts = docs.where(F.col(text_col).rlike("[“\">]")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(scan, f"doc_id {kind}, r array<struct<q:int,start:int,end:int,quote:string,kind:string,cited:string,citation:string>>")
    return found.select("doc_id", F.explode("r").alias("r")).select("doc_id", "r.*")


def check_quotes(docs: DataFrame, provisions: DataFrame, **columns: str) -> DataFrame:
    """Quotations with status, score and the provision that matched. ``provisions``: id, text (the full text of each node).

    quote_exact and quote_close are matches in the cited provision, wrong_pinpoint elsewhere in its section, misattributed anywhere
    else; of several matches the best, then the shortest text, then the deepest counts.
    """
    found = materialize(extract_pairs(docs, **columns), "quotes")
    # A quotation that many documents make of one provision is checked once.
    pairs = materialize(found.select("quote", "cited").distinct().withColumn("ask", F.monotonically_increasing_id()), "asked")
    p = provisions.select(F.col("id").alias("p_id"), F.col("text").alias("p_text")).where("p_text is not null")
    key = ["ask"]
    best = Window.partitionBy(*key).orderBy(F.desc("score"), F.length("p_text"), F.desc(F.size(F.split("p_id", "/"))), "p_id")
    top = lambda rows: rows.withColumn("score", _score("quote", "p_text")).withColumn("r", F.row_number().over(best)).where("r = 1").select(*key, "p_id", "score")
    cited = materialize(top(pairs.join(p, F.col("cited") == F.col("p_id"))), "cited")
    done = cited.where(F.col("score") >= CLOSE).select(*key)
    left = pairs.join(done, key, "left_anti")
    near = left.where("cited is not null").withColumn("s", section_of(F.col("cited"))).join(p.withColumn("ps", section_of(F.col("p_id"))), F.col("s") == F.col("ps"))
    section = materialize(top(near.where("p_id != cited")).where(F.col("score") >= ELSEWHERE), "section")
    left = left.join(section.select(*key), key, "left_anti")
    shared = materialize(candidates(left.select("ask", "quote"), p.select(F.col("p_id").alias("id"), F.col("p_text").alias("text")), ELSEWHERE), "candidates")
    shared = shared.select("ask", F.col("id").alias("p_id")).distinct()
    corpus = top(left.join(shared, key).join(p, "p_id")).where(F.col("score") >= ELSEWHERE)
    steps = cited.select(*key, "p_id", "score", F.lit("cited").alias("step")).where(F.col("score") >= CLOSE)
    steps = steps.unionByName(section.withColumn("step", F.lit("section"))).unionByName(corpus.withColumn("step", F.lit("corpus")))
    status = (
        F.when((F.col("step") == "cited") & (F.col("score") >= EXACT), "quote_exact").when(F.col("step") == "cited", "quote_close")
        .when(F.col("step") == "section", "wrong_pinpoint").when(F.col("step") == "corpus", "misattributed").otherwise("quote_not_found")
    )
    asked = pairs.join(steps, key, "left").withColumn("status", status).drop("step", *key).withColumnsRenamed({"quote": "a_quote", "cited": "a_cited"})
    return found.join(asked, (F.col("quote") == F.col("a_quote")) & F.col("cited").eqNullSafe(F.col("a_cited"))).drop("a_quote", "a_cited")


def altered_quotes(quotes: DataFrame, texts: DataFrame, share: float = ELSEWHERE) -> DataFrame:
    """(ask, id, score): every text that holds a quotation by ``share`` or more, as scoring each text for each quotation would find.

    ``quotes``: ask, quote; ``texts``: id, text, of which ids may repeat: each row that matches counts.
    """
    t = materialize(texts.select("id", "text").withColumn("row", F.monotonically_increasing_id()), "texts")
    pairs = candidates(quotes, t.select(F.col("row").alias("id"), "text"), share).withColumnRenamed("id", "row")
    pairs = broadcast_if_small(materialize(pairs, "candidates"))
    scored = t.join(pairs, "row").join(broadcast_if_small(quotes.select("ask", "quote"), 100_000), "ask").withColumn("score", _score("quote", "text"))
    return scored.where(F.col("score") >= share).select("ask", "id", "score")
