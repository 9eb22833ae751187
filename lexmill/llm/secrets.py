"""Secret scans with corpus-wide ownership frequency.

One Arrow-batched scan finds candidate spans of every whole text. Each candidate's value is hashed; hashes are
aggregated over the corpus by distinct repository and owner. A value that ``example_owners`` or more owners share is a
widely copied example; one that at most ``live_owners`` owners have and that looks random is live-looking. The three
base kinds are always reported; the further kinds are added where their value looks random and is no example.

Aggregation runs on distinct (hash, repository, owner) with map-side combination, so a value in a third of all
rows reaches the reducers once a task. Only values that several owners or repositories have are joined back, the others have one.
Only spans are shuffled, never texts; ``redact`` shuffles the texts that have spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize
from lexmill.session import ship


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns.
KEYWORDS = ("password", "passwd", "secret", "token")
ASSIGN = re.compile(
    f"(?:{'|'.join(map(_any_case, KEYWORDS))}|{_any_case('api')}_?{_any_case('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order of the report; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "prefixed", "jwt", "random")
MORE = {
    "pem": re.compile(
        r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----(?:(?!-----)[\s\S])*?-----END \1-----"  # the whole block
        r"|-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[rn])*(?:(?:Proc-Type|DEK-Info|Version|Comment|Charset): [^\r\n]*|[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]*=))*"  # or, if it doesn't end, the header and what follows of the key
    ),
    "prefixed": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "random": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{28,}(?![A-Za-z0-9+/_=-])"),
}
#: Every span of the kinds other than ``assign`` and ``pem`` holds such a run.
LONG = re.compile("[!-~]{15}")
BITS = 3.0


def pem_body(block: str) -> str:
    """The key in a PEM block, by which copies are told: without the marks, headers and white space, escaped line ends too."""
    body = re.sub(r"-----(?:BEGIN|END)[^-]*-----", "", block.replace("\\r", "\r").replace("\\n", "\n"))
    return re.sub(r"\s+", "", re.sub(r"(?m)^[ \t]*(?:Proc-Type|DEK-Info|Version|Comment|Charset): .*$", "", body))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum((k := value.count(c)) / n * log2(k / n) for c in set(value)) if n else 0.0


def live_looking(kind: str, value: str) -> bool:
    """Random enough for a credential: high entropy, or for ``random`` also letters of both cases and digits."""
    if kind == "pem":
        return bool(value)
    bits = entropy(value)
    mixed = any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)
    return bits >= BITS and (kind != "random" or (mixed and bits >= 4.0))


class _Taken:
    """Ranges that earlier kinds hold, united and in order."""

    def __init__(self, ranges: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(ranges):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s), self.ends.append(e)

    def touches(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)  # ranges before k start below e; the last of them ends last
        return k > 0 and self.ends[k - 1] > s


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of every candidate, in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in (*KEYWORDS, "apikey", "api_key")):
        found += [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "-----BEGIN" in text:
        found += [("pem", m.start(), m.end(), pem_body(m[0])) for m in MORE["pem"].finditer(text)]
    if LONG.search(text):
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
        found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
        for kind, pattern in list(MORE.items())[1:]:
            if more := [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]:
                taken = _Taken([(s, e) for _, s, e, _ in found])
                found += [x for x in more if not taken.touches(x[1], x[2])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("h", pa.string()), ("live", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [
            [{"kind": k, "s": s, "e": e, "h": xxhash.xxh3_128_hexdigest(v.encode("utf-8", "surrogatepass")), "live": live_looking(k, v)} for k, s, e, v in find(t or "")]
            for t in b.column("body").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("repo"), b.column("owner"), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "repo", "owner", "spans"]
        )


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    owner_cols: tuple[str, ...] = ("source",),
    example_owners: int = 5,
    live_owners: int = 2,
) -> DataFrame:
    """One row per input row: doc_id and ``spans`` (array of kind, s, e, h, live, owners, repos, verdict).

    ``verdict`` is ``example``, ``live`` or ``unclear``; spans of the further kinds appear only if they look random and are no ``example``. Null and empty
    texts have no spans. Null repository or owner columns count as one unnamed repository or owner. Rows with equal
    or null ids are kept apart; an empty table gives no rows; extra columns are ignored.
    """
    name = lambda cols: F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), name(repo_cols).alias("repo"), name(owner_cols).alias("owner"))
    spans = "array<struct<kind:string,s:int,e:int,h:string,live:boolean>>"
    schema = rows.select("doc_id", "repo", "owner", F.lit(None).cast(spans).alias("spans")).schema
    rows = rows.mapInArrow(_scan, schema)
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "spans")
    each = rows.where(F.size("spans") > 0).select("rid", "repo", "owner", F.explode("spans").alias("x")).select("rid", "repo", "owner", "x.*")
    # From distinct (hash, owner, repository) down to one row a hash, combining in each task first.
    held = each.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"))
    held = held.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    shared = broadcast_if_small(materialize(held.where("repos > 1"), "shared"), 500_000)
    own = F.lit(1).cast("long")
    example = F.col("owners") >= example_owners
    live = F.col("live") & (F.col("owners") <= live_owners)
    verdict = F.when(example, F.lit("example")).when(live, F.lit("live")).otherwise(F.lit("unclear"))
    each = each.join(shared, "h", "left").withColumns({"owners": F.coalesce("owners", own), "repos": F.coalesce("repos", own)})
    judged = each.withColumn("verdict", verdict).where(F.col("kind").isin(*KINDS[:3]) | (F.col("live") & ~example))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = judged.groupBy(F.col("rid").alias("r")).agg(
        F.array_sort(F.collect_list(F.struct("s", rank.alias("rank"), "e", "kind", "h", "live", "owners", "repos", "verdict"))).alias("found")
    )
    none = F.array().cast(spans.schema["found"].dataType)
    some = rows.where(F.size("spans") > 0).select("rid", "doc_id").join(spans, F.col("rid") == F.col("r"), "left")
    return some.select("doc_id", F.coalesce("found", none).alias("spans")).unionByName(rows.where(F.size("spans") == 0).select("doc_id", none.alias("spans")))


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", **scan: object) -> DataFrame:
    """``docs`` with every reported span but widely copied examples replaced by ``mask``; all columns and rows stay.

    Null texts stay null and empty ones empty. Rows with equal or null ids are masked each by its own spans; an empty table
    gives no rows; extra columns, whatever their names, are returned as they are.
    """
    row, body, names = "doc", "body", [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = dict(zip(docs.columns, names, strict=True))
    scan = {k: tuple(at[c] for c in scan.get(k, v)) for k, v in (("repo_cols", ("source", "lang")), ("owner_cols", ("source",)))} | {k: v for k, v in scan.items() if not k.endswith("_cols")}
    found = scan_secrets(plain.withColumn(row, F.struct(*names)), id_col=row, text_col=at[text_col], **scan)
    cuts = F.filter("spans", lambda x: x["verdict"] != "example")
    joined = found.select("doc_id.*", cuts.alias("cuts")).withColumn(body, F.col(at[text_col]))
    cuts = F.col("cuts")
    text = F.col(body)
    # Left to right: kept so far and where the next piece starts; overlapping spans are masked once.
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mask))
        return F.struct(F.when(fresh, piece).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["e"]).alias("at"))

    masked = F.aggregate(cuts, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    masked = F.when(F.size(cuts) > 0, masked).otherwise(text)
    return joined.select(*[(masked if c == text_col else F.col(at[c])).alias(c) for c in docs.columns])
