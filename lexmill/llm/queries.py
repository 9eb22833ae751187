"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, lm_score, mixing, near_dups, packing, periodic_runs, perspectives, quality_ranker, quality_rules, ranked_search, secrets
from lexmill.llm import sharding, substring_dedup, text
from lexmill.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def id_remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: what splits training from held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality_ranker.measure(docs)
    out = quality_ranker.score_measured(rows, quality_ranker.fit_measured(rows, labels.where(id_remainder(4) != 2)))
    return out.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op4_prefix_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.contiguous_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, matches=40)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op7_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0)


def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score_texts(table(spark, sf_dir, "documents"), id_remainder(7) != 2)
    return out.select("doc_id", (id_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_substrings(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    verdicts = lambda v: F.size(F.filter("spans", lambda x: x["verdict"] == v)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        verdicts("live").alias("n_live"), verdicts("example").alias("n_example"),
    )


def op11_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, most=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents of op12: where the id's crc32 ends in 0, the words from one on repeat with a period; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = lambda w: g % F.size(w)
    p = lambda w: 1 + F.floor((F.size(w) - a(w)) / (3 + g % 8))
    source = lambda w, i: F.when(i < a(w), i).otherwise(a(w) + (i - a(w)) % p(w)).cast("int")
    planted = lambda w: F.array_join(F.transform(w, lambda x, i: F.get(w, source(w, i))), " ")  # noqa: E731, ARG005
    # an array of one, so that the text is split once
    changed = F.transform(F.array(text.words(F.col("text"))), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))
    return docs.withColumn("text", F.when(h % 10 == 0, F.get(changed, F.lit(0))).otherwise(F.col("text")))


def op12_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_shard_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_ranker": op2_quality_ranker,
    "op3_perspectives": op3_perspectives,
    "op4_prefix_sharding": op4_prefix_sharding,
    "op5_coordinate_join": op5_coordinate_join,
    "op6_decontamination": op6_decontamination,
    "op7_config_packing": op7_config_packing,
    "op8_backoff_automaton": op8_backoff_automaton,
    "op9_bucket_refinement": op9_bucket_refinement,
    "op10_secret_ownership": op10_secret_ownership,
    "op11_fair_queueing": op11_fair_queueing,
    "op12_harmonic_runs": op12_harmonic_runs,
    "op13_shard_wand": op13_shard_wand,
}

_WORDS6 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op11_fair_queueing": mixing.ORACLE,
    "op12_harmonic_runs": r"""
WITH b AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) AS h
  FROM documents),
a AS (SELECT rid, doc_id, o, h, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a, 3 + (h // 10) % 8 AS parts FROM b),
d AS (
  SELECT rid, doc_id, CASE WHEN a IS NULL THEN o
    ELSE list_transform(range(len(o)), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % (1 + (len(o) - a) // parts) + 1] END) END AS w FROM a),
t AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
e AS (SELECT x.rid, x.i, y.i - x.i AS p FROM t x JOIN t y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
g AS (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM e),
s AS (SELECT rid, p, min(i) AS s, count(*) + p AS m FROM g GROUP BY rid, p, k HAVING count(*) + p >= greatest(12, 2 * p)),
r AS (SELECT rid, s, m, min(p) AS p FROM s GROUP BY rid, s, m),
f AS (
  SELECT rid, count(*) AS n_runs, max_by({'s': s, 'm': m, 'p': p}, [m, -s, -p]) AS b, string_agg(s || ',' || m || ',' || p || chr(10), '' ORDER BY s, p) AS txt
  FROM r GROUP BY rid),
z AS (SELECT DISTINCT rid, unnest(range(s + p, s + m)) AS i FROM r),
k AS (SELECT t.rid, string_agg(word, ' ' ORDER BY i) AS txt FROM t ANTI JOIN z USING (rid, i) GROUP BY t.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, b.s AS start, b.m AS length, b.p AS period,
  1000 * b.m // b.p AS exponent_milli, sha256(coalesce(f.txt, '')) AS runs_sha256, sha256(coalesce(k.txt, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (rid) LEFT JOIN k USING (rid)
""",
    "op13_shard_wand": ranked_search.ORACLE,
    "op3_perspectives": perspectives.ORACLE,
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS6} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS6} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
pos AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM d),
run AS (SELECT rid, s, list(word) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS r FROM pos),
occ AS (
  SELECT rid, s, n, item_id
  FROM (SELECT rid, s, r, k FROM run, (SELECT DISTINCT n AS k FROM wins) WHERE len(r) >= k) p
  JOIN wins ON wins.n = p.k AND array_to_string(r[1:k], ' ') = win
),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM occ GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
""",
    "op5_coordinate_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.rid, any_value(d.doc_id) AS doc_id, count(g) AS n FROM d LEFT JOIN g USING (rid) GROUP BY d.rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept FROM n LEFT JOIN m ON m.a = n.doc_id
""",
    "op9_bucket_refinement": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT rid, doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT rid, i FROM w JOIN f USING (g) WHERE m < doc_id),
mark AS (SELECT rid, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50, true) AS INTEGER) AS fresh FROM hit),
run AS (SELECT rid, min(i) AS s, max(i) + 50 AS e FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM mark) GROUP BY rid, k),
piece AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM run),
cut AS (SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM piece JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (rid)
""",
}
