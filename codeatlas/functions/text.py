"""Scalar text functions as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_count(text: str | Column) -> Column:
    """Newlines, plus one for an unended last line; 0 for an empty or null text."""
    t = _col(text)
    ended = F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1)
    n = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + ended
    return F.when(t.isNull() | (t == ""), 0).otherwise(n).cast("long")


def byte_length(text: str | Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(_col(text)), F.lit(0)).cast("long")


def is_heading(line: str | Column) -> Column:
    """An ATX heading: at most three spaces, one to six #, then a space or tab."""
    return _col(line).rlike(r"^ {0,3}#{1,6}[ \t]")


def heading_label(line: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(line), r"^ *#*", ""), r"(?U)^\s+|\s+$", "")


def range_label(first: Column, end: Column) -> Column:
    """Lines first (0-based) to end (exclusive), as ``1-60`` with an en dash."""
    return F.concat((first + 1).cast("string"), F.lit("\u2013"), end.cast("string"))


def item_signature(text: str | Column) -> Column:
    """Up to the first { or ;, white space runs as one space."""
    return F.trim(F.regexp_replace(F.regexp_extract(_col(text), r"^[^{;]*", 0), r"(?U)\s+", " "))


def return_type(signature: str | Column, ext: str | Column) -> Column:
    """JavaScript family: after the last ``)`` and a colon; others: after ``->``. The first word,
    cut at a brace or an angle; null where there is none."""
    s = _col(signature)
    script = F.regexp_extract(s, r"(?s)^.*\)[^:]*:(?U:\s*)([^\s{<]*)", 1)
    other = F.regexp_extract(s, r"(?s)^.*? -> \s*([^\s{:<]*)", 1)
    return F.nullif(F.when(_col(ext).isin("ts", "tsx", "js", "jsx"), script).otherwise(other), F.lit(""))


def format_bytes(n: str | Column, largest: str = "GB") -> Column:
    """Steps of 1024 with one decimal, halves to even; from ``largest`` on sizes stay in that unit. Whole
    numbers only, so a size of any length is written in full and no half is lost to a double."""
    b = _col(n).cast("long")

    def step(unit: int, name: str) -> Column:
        part = F.pmod(b, F.lit(unit)) * 10
        tenth, rest = F.floor(part / unit), F.pmod(part, F.lit(unit)) * 2
        up = (rest > unit) | (rest == unit) & (tenth % 2 == 1)
        tenths = F.shiftright(b, unit.bit_length() - 1) * 10 + tenth + up.cast("long")
        return F.concat(F.floor(F.shiftright(tenths, 1) / 5).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(f" {name}"))

    units = ["KB", "MB", "GB"][: ["KB", "MB", "GB"].index(largest) + 1]
    out = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
    for i, name in enumerate(units[:-1], 1):
        out = out.when(b < 1024 ** (i + 1), step(1024**i, name))
    return out.otherwise(step(1024 ** len(units), units[-1]))


def fnv1a(text: str | Column) -> Column:
    """64-bit FNV-1a of a short text's bytes as 16 hexadecimal digits. The product is taken in
    decimal, modulo 2**64, since a bigint product would overflow."""
    b = F.transform(F.sequence(F.lit(1), F.octet_length(_col(text))), lambda i: F.conv(F.hex(F.substring(_col(text).cast("binary"), i, F.lit(1))), 16, 10).cast("bigint"))
    two64, two32 = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(20,0)")

    def step(acc: Column, byte: Column) -> Column:
        hi = F.floor(acc / two32).cast("bigint")
        lo = (acc - hi.cast("decimal(20,0)") * two32).cast("decimal(20,0)").cast("bigint").bitwiseXOR(byte)
        # acc * (2**40 + 435): the terms stay below 38 digits
        x = (hi.cast("decimal(20,0)") * two32 + lo.cast("decimal(20,0)")).cast("decimal(20,0)")
        return ((x * F.lit(1099511628211).cast("decimal(13,0)")).cast("decimal(38,0)") % two64).cast("decimal(20,0)")

    h = F.aggregate(F.when(F.octet_length(_col(text)) > 0, b).otherwise(F.array().cast("array<bigint>")), F.lit("14695981039346656037").cast("decimal(20,0)"), step)
    return F.lower(F.lpad(F.conv(h.cast("string"), 10, 16), 16, "0"))


def minimap_row(line: str | Column) -> tuple[Column, Column]:
    """(indent, visible length) of a line: leading spaces and tabs, characters without outer space."""
    s = _col(line)
    indent = F.length(F.regexp_extract(s, r"^[ \t]*", 0))
    return indent.cast("int"), F.length(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")).cast("int")


def lines(text: str | Column) -> Column:
    """Lines without their ends; an ended last line adds no empty one, an empty text has none."""
    s = F.split(F.regexp_replace(_col(text), r"\n\z", ""), "\n")
    clean = F.transform(s, lambda x: F.regexp_replace(x, r"\r+\z", ""))
    return F.when(_col(text).isNull() | (_col(text) == ""), F.array().cast("array<string>")).otherwise(clean)
