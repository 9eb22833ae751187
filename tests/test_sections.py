"""Statute files read by ranges against the same files parsed whole."""

import io
import random
import tracemalloc
from collections import Counter

import pytest

from lexmill.sources import markup, sections

HEAD = b'<?xml version="1.0"?>\n<u:law xmlns:u="http://example.org/u" xmlns="http://example.org/d" xmlns:x=\'http://example.org/x\'><main><title><num>26</num>\n'
TAIL = b"</title></main></u:law>\n"


def section(k, r, extra=b""):
    words = lambda n: " ".join(r.choices(["tax", "income", "é§", "a < b".replace("<", "&lt;"), "shall", "not"], k=n))
    parts = "".join(f'<subsection identifier="/us/usc/t26/s{k}/{c}"><num value="{c}">({c})</num><content>{words(r.randint(1, 40))} <ref href="/us/usc/t26/s{r.randint(1, 9)}">x</ref></content></subsection>' for c in "abc"[: r.randint(0, 3)])
    note = f'<notes><note topic="effectiveDate"><heading>Date</heading><p>{words(5)} after January 1, 2001</p></note></notes>' if k % 3 == 0 else ""
    return f'<section x:style="s" identifier="/us/usc/t26/s{k}"\n ><num value="{k}">§ {k}</num><heading>H{k}</heading>{parts}<content>{words(8)}</content>{note}'.encode() + extra + b"</section>\n"


def law(n, seed=0):
    r = random.Random(seed)
    quoted = b'<quotedContent><section><num>9</num><content>quoted</content></section><section identifier="/us/usc/t26/s9000"><content>nested</content></section></quotedContent>'
    body = [section(k, r, quoted if k % 7 == 0 else b"") for k in range(1, n)]
    body += [b'<section identifier="/us/usc/t42/s1"><content>other law</content></section>', b'<section identifier="/us/usc/t26/s77 /us/usc/t26/s78A"><content>two</content></section>']
    body += [section(5, r), b'<section identifier="/us/usc/t26/s500"/>']
    return HEAD + b"".join(body) + TAIL


def plain(data):
    return Counter(str({k: v for k, v in r.items() if k != "path_in"}) for r in markup.parse("statute", data))


def by_ranges(data, size):
    out = []
    for s in range(0, len(data), size):
        out += list(sections.sections(io.BytesIO(data), s, min(s + size, len(data))))
    return out


@pytest.mark.parametrize("read", [1 << 20, 700])
def test_every_section_belongs_to_one_range(monkeypatch, read):
    monkeypatch.setattr(sections, "READ", read)
    data = law(40)
    whole = by_ranges(data, len(data))
    assert len(whole) == 39 + 5 + 1 + 1 + 1  # sections, nested ones, two, again, empty
    for size in (97, 1000, 5000):
        assert by_ranges(data, size) == whole
    assert by_ranges(b"", 10) == by_ranges(b"<a>no sections</a>", 5) == []


def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path):
    for name, data in (("a.xml", law(60, 1)), ("b.xml", law(9, 2)), ("c.xml", b"<a/>"), ("_skip.xml", law(3))):
        (tmp_path / name).write_bytes(data)
    expected = plain(law(60, 1)) + plain(law(9, 2))
    for split in (1 << 20, 1500):
        rows = sections.read_sections(spark, f"file://{tmp_path}", split)
        assert Counter(str({k: v for k, v in r.asDict().items() if k != "path_in"}) for r in rows.collect()) == expected
    assert {r["path_in"] for r in rows.select("path_in").distinct().collect()} == {f"file://{tmp_path}/a.xml", f"file://{tmp_path}/b.xml"}
    reader = sections.SectionReader(f"file://{tmp_path}/a.xml", 1500)
    assert len(reader.partitions()) > 10
    assert sections.read_sections(spark, str(tmp_path / "c.xml")).count() == 0


def test_a_broken_section_is_one_corrupt_record(spark, tmp_path):
    r = random.Random(3)
    data = HEAD + section(1, r) + b'<section identifier="/us/usc/t26/s2"><content>a & b</content></section>' + section(3, r) + b'<section identifier="/us/usc/t26/s4"><content>no end'
    (tmp_path / "x.xml").write_bytes(data)
    rows = sections.read_sections(spark, str(tmp_path)).collect()
    assert Counter(r["kind"] for r in rows if r["kind"] == "corrupt") == {"corrupt": 2}
    assert {r["section"] for r in rows if r["kind"] == "provision"} == {"1", "3"}


def test_memory_does_not_grow_with_the_file(tmp_path):
    r = random.Random(4)
    body = b"".join(section(k, r) for k in range(1, 400))
    path = tmp_path / "big.xml"
    with path.open("wb") as f:
        f.write(HEAD)
        for _ in range(50_000_000 // len(body) + 1):
            f.write(body)
        f.write(TAIL)
    assert path.stat().st_size > 50_000_000
    tracemalloc.start()
    with path.open("rb") as f:
        n = sum(1 for _ in sections.sections(f, 0, path.stat().st_size))
    assert n > 50_000 and tracemalloc.get_traced_memory()[1] < 12_000_000
    tracemalloc.stop()
