"""Identifiers of provisions: pure functions, and the same as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier prefixes by source, level names by depth, and token shapes by depth.
PREFIX = {"irc": "/us/usc/t26/s", "reg": "/us/cfr/t26/s"}
LEVELS = ("section", "subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem")
REG_LEVELS = ("section", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem")
SHAPES = (r"[a-z]{1,2}", r"\d+[A-Z]?", r"[A-Z]{1,2}", r"[ivxlcdm]+", r"[IVXLCDM]+", r"[a-z]{2}", r"[A-Z]{2}")
REG_SHAPES = (r"[a-z]{1,2}", r"\d+[A-Z]?", r"[ivxlcdm]+", r"[A-Z]{1,2}", r"\d+[A-Z]?", r"[ivxlcdm]+")
ROMAN = re.compile(r"(?=.)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", re.I)
DASHES = dict.fromkeys(map(ord, "–—−"), "-")


def canonical_id(source: str, section: str, path: list[str] | tuple[str, ...] = ()) -> str:
    return "/".join([PREFIX[source] + section.translate(DASHES), *path])


def split_id(identifier: str) -> tuple[str, str, list[str]]:
    """(source, section, path); ValueError for a foreign prefix."""
    for source, prefix in PREFIX.items():
        if identifier.startswith(prefix):
            section, *path = identifier[len(prefix) :].split("/")
            return source, section, path
    raise ValueError(f"not a provision's identifier: {identifier}")


def parent_id(identifier: str) -> str | None:
    source, section, path = split_id(identifier)
    return canonical_id(source, section, path[:-1]) if path else None


def section_id(identifier: str) -> str:
    source, section, _ = split_id(identifier)
    return canonical_id(source, section)


def display(source: str, section: str, path: list[str] | tuple[str, ...] = (), reg_kind: str | None = None) -> str:
    pinpoint = "".join(f"({t})" for t in path)
    if source == "irc":
        return f"§ {section}{pinpoint}"
    return {"temporary": "Temp. ", "proposed": "Prop. "}.get(reg_kind or "", "") + f"Treas. Reg. § {section}{pinpoint}"


def level_at(depth: int, reg: bool = False) -> str:
    names = REG_LEVELS if reg else LEVELS
    return names[min(depth, len(names) - 1)]


def is_roman(token: str) -> bool:
    return bool(token) and ROMAN.fullmatch(token) is not None


def roman_to_int(token: str) -> int:
    if not is_roman(token):
        raise ValueError(token)
    values = [dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)[c] for c in token.lower()]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def int_to_roman(value: int, upper: bool = False) -> str:
    out = ""
    for step, digits in ((1000, " m mm mmm"), (100, " c cc ccc cd d dc dcc dccc cm"), (10, " x xx xxx xl l lx lxx lxxx xc"), (1, " i ii iii iv v vi vii viii ix")):
        out += digits.split(" ")[value // step]
        value %= step
    return out.upper() if upper else out


#: Fixed value: the warning's words.
UNEXPECTED = "unexpected token '({})' at {} level"


def validate_path(path: list[str] | tuple[str, ...], reg: bool = False) -> list[str]:
    """A warning for each token that doesn't look like its depth; depths beyond the known shapes take anything."""
    steps = zip(REG_SHAPES if reg else SHAPES, path, strict=False)
    return [UNEXPECTED.format(token, level_at(n, reg)) for n, (shape, token) in enumerate(steps, 1) if not re.fullmatch(shape, token)]


def source_url(source: str, section: str | None, path: list[str] | tuple[str, ...] = ()) -> str | None:
    """Official page of a provision."""
    if not section:
        return None
    if source == "irc":
        return f"https://uscode.house.gov/view.xhtml?req=granuleid:USC-prelim-title26-section{section}&num=0&edition=prelim"
    if source == "reg":
        anchor = f"#p-{section}" + "".join(f"({t})" for t in path) if path else ""
        return f"https://www.ecfr.gov/current/title-26/section-{section}{anchor}"
    return None


# The same on columns, inside the JVM.


def id_col(section: Column, path: Column, source: str = "irc") -> Column:
    return F.concat_ws("/", F.concat(F.lit(PREFIX[source]), F.translate(section, "–—−", "---")), path)


def section_of(identifier: Column) -> Column:
    return F.substring_index(identifier, "/", 5)


def parent_of(identifier: Column) -> Column:
    parts = F.split(identifier, "/")
    return F.when(F.size(parts) > 5, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))


def prefixes_of(identifier: Column) -> Column:
    """Array of (id, depth): the section, then every longer prefix, the identifier itself last."""
    parts = F.split(identifier, "/")
    depths = F.sequence(F.lit(5), F.greatest(F.size(parts), F.lit(5)))
    return F.transform(depths, lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("id"), (n - 5).alias("depth")))


def range_items(a: Column, b: Column, most: int) -> Column:
    """Every step of a range of numbers, or of letters of one case, both ends included; null unless it rises, by less than ``most``."""
    number, letter = r"^[0-9]{1,9}$", "^(?:[a-z][a-z]|[A-Z][A-Z])$"
    both = F.when(a.rlike(number) & b.rlike(number), F.lit("number")).when(F.concat(a, b).rlike(letter) & (F.length(a) == 1), F.lit("letter"))
    lo = F.when(both == "number", a.try_cast("int")).when(both == "letter", F.ascii(a))
    hi = F.when(both == "number", b.try_cast("int")).when(both == "letter", F.ascii(b))
    steps = F.when((hi > lo) & (hi - lo < most), F.sequence(lo, hi))
    return F.transform(steps, lambda n: F.when(both == "letter", F.char(n)).otherwise(n.cast("string")))
