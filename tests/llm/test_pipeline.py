import shutil
from collections import Counter

import pytest

import brute
import corpus_pipeline as cp
from lexmill.llm import quality_ranker, secrets
from lexmill.session import table
from test_operators import ROWS

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, gone long, doc string, body string, cuts int, c0 int"


def adversarial(spark):
    """Nulls, empty and long texts, ties, repeated rows, null ids, two texts under one id, copies without an id, clashing columns."""
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    rows = [r[:5] for r in ROWS]
    rows += [(1, "another text under the first id, which has nothing in common with any other one at all, so that it stays " * 2, "en", "src1", 5)]
    rows += [(None, item, "en", "src2", 9), (200, f"before {item} after", "en", "src2", 9), (3, item, None, None, None), (201, "q token=fedcba9876543210fedcba98 z", "en", "src0", 1)]
    return rows, spark.createDataFrame([(*r, 7, 8, "d", "b", 9, 1) for r in rows], SCHEMA).repartition(3)


def rows_of(df):
    assert tuple(df.columns) == cp.COLUMNS
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(cp.STAGES) - 1:
            assert tuple(docs.columns) == cp.COLUMNS
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert docs.select("doc_id").distinct().count() == seen[-1]
    shutil.rmtree(tmp_path)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, k):
    docs = table(spark, SF, "documents").limit(0)
    assert cp.STAGES[k][1](spark, docs, SF).count() == 0


def test_quality_judges_every_row_by_its_text(spark):
    rows, docs = adversarial(spark)
    got = rows_of(cp.quality(spark, docs, SF))
    ranker = quality_ranker.fit(docs, table(spark, SF, "labels"))
    texts = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string")
    good = {r["doc_id"] for r in quality_ranker.score(texts, ranker).collect() if r["score"] >= ranker.threshold}
    assert got == Counter(r for k, r in enumerate(rows) if k in good)


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rows, docs = adversarial(spark)
    got = rows_of(cp.near_duplicates(spark, docs, SF))
    component = brute.components([(k, r[1]) for k, r in enumerate(rows)], 5, 80)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(component[k], []).append(r)
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sum(got.values()) == len(groups)
    for group in groups.values():
        least = min(map(order, group))
        assert any(got[r] for r in group if order(r) == least)


def test_decontamination_judges_every_row_by_its_text(spark):
    rows, docs = adversarial(spark)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    hit = [brute.contamination(r[1], items)[1] > 0 for r in rows]
    assert rows_of(cp.decontamination(spark, docs, SF)) == Counter(r for r, h in zip(rows, hit, strict=True) if not h)
    assert sum(hit) >= 3 and not hit[0]


def test_secrets_are_masked_row_by_row(spark):
    rows, docs = adversarial(spark)
    got = rows_of(cp.secret_scan(spark, docs, SF))
    owners = {}
    for r in rows:
        for _, _, _, value in secrets.find(r[1] or ""):
            owners.setdefault(value, set()).add(r[3])
    expected = Counter()
    for r in rows:
        text, at = "", 0
        for kind, s, e, value in secrets.find(r[1] or ""):
            if len(owners[value]) >= 5 or not (kind in secrets.KINDS[:3] or secrets.live_looking(kind, value)) or s < at:
                continue
            text, at = text + r[1][at:s] + "[SECRET]", e
        text = None if r[1] is None else text + r[1][at:]
        expected[r[0], text, r[2], r[3], len(text or "")] += 1
    assert got == expected
