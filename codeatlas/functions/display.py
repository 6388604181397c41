"""What a view writes and paints: shortened and wrapped text, sizes, colours, cameras."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.functions import tables as t
from codeatlas.functions.geometry import ease_in_out
from codeatlas.functions.paths import file_part
from codeatlas.functions.text import _col

# -- text -----------------------------------------------------------------------------------


def char_budget(width: str | Column, font: str | Column | float) -> Column:
    """Characters that fit into a width; 0 where fewer than two do."""
    size = F.lit(font) if isinstance(font, (int, float)) else _col(font)
    n = F.floor((_col(width) - t.TEXT_MARGIN) / (size * t.CHAR_WIDTH) + 1e-6)
    return F.when(n < 2, 0).otherwise(n).cast("int")


def truncate(name: str | Column, width: str | Column, font: float) -> Column:
    """The name, or its beginning and an ellipsis; null where there is no room."""
    n, budget = _col(name), char_budget(width, font)
    return F.when(budget == 0, None).when(F.char_length(n) <= budget, n).otherwise(F.concat(F.substr(n, F.lit(1), budget - 1), F.lit("…")))


def wrap_rows(text: str, budget: int) -> list[str]:
    """Rows of at most ``budget`` characters, words kept whole where they fit. A text that fits
    as it is stays as it is; empty words between spaces go."""
    if budget <= 0:
        return []
    if len(text) <= budget:
        return [text]
    rows, line = [], ""
    for word in filter(None, text.split(" ")):
        if line and len(word) > budget:
            rows.append(line)
            line = ""
        while len(word) > budget:
            rows.append(word[:budget])
            word = word[budget:]
        if not word:
            continue
        if line and len(line) + 1 + len(word) > budget:
            rows.append(line)
            line = ""
        line = f"{line} {word}" if line else word
    return [*rows, line] if line else rows


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap(text: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else wrap_rows(x, int(b)) for x, b in zip(text, budget, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap_doc(text: pd.Series, budget: pd.Series) -> pd.Series:
    """Paragraphs (between blank lines) wrapped one by one, with single spaces."""
    said = [[] if x is None or b < 2 else [" ".join(p.split()) for p in x.split("\n\n")] for x, b in zip(text, budget, strict=True)]
    return pd.Series([[r for p in ps if p for r in wrap_rows(p, int(b))] for ps, b in zip(said, budget, strict=True)])


def card_meta(commits: str | Column, churn: str | Column, lines: str | Column) -> Column:
    return F.concat_ws(" · ", _col(commits).cast("string"), _percent(churn), F.concat(_col(lines).cast("string"), F.lit("L")))


def churn_readout(commits: str | Column, churn: str | Column, lines: str | Column) -> Column:
    return F.concat_ws(" · ", F.concat(_col(lines).cast("string"), F.lit("L")), F.concat(_col(commits).cast("string"), F.lit(" commits")), _percent(churn))


def _percent(share: str | Column) -> Column:
    """Halves to even."""
    return F.concat(F.lit("p"), F.bround(_col(share) * 100, 0).cast("long").cast("string"))


def plural(n: str | Column, word: str) -> Column:
    return F.concat(_col(n).cast("string"), F.lit(" " + word), F.when(_col(n) == 1, "").otherwise("s"))


# -- sizes ----------------------------------------------------------------------------------

_GIB = 1 << 30


def format_gibibytes(n: str | Column) -> Column:
    """Bytes as an exact decimal number of GiB: a GiB has 30 factors of two, so 30 digits do."""
    b = _col(n)
    fraction = (b % _GIB).cast("decimal(10,0)") * F.lit(Decimal(5**30)).cast("decimal(21,0)")
    digits = F.lpad(fraction.cast("decimal(31,0)").cast("string"), 30, "0")
    whole = F.floor(b / _GIB).cast("long").cast("string")
    return F.when(b % _GIB == 0, whole).otherwise(F.concat(whole, F.lit("."), F.regexp_replace(digits, "0+$", "")))


def parse_gibibytes(text: str | Column) -> Column:
    """(bytes, error) of a decimal number of GiB, rounded down to a byte."""
    s = F.trim(_col(text))
    whole, tail = F.substring_index(s, ".", 1), F.regexp_replace(F.regexp_extract(s, r"^\d+\.(\d+)$", 1), "0+$", "")
    k = F.length(tail)
    # tail / 10**k GiB = tail * 2**(30 - k) / 5**k bytes: within 38 digits for k up to 30
    twos = F.element_at(F.array(*(F.lit(1 << (30 - i)) for i in range(31))), F.least(k, F.lit(30)) + 1).cast("decimal(10,0)")
    fives = F.element_at(F.array(*(F.lit(Decimal(5**i)).cast("decimal(21,0)") for i in range(31))), F.least(k, F.lit(30)) + 1)
    scaled = (F.when(k == 0, F.lit("0")).otherwise(tail).cast("decimal(30,0)") * twos).cast("decimal(38,0)")
    part = ((scaled - scaled % fives) / fives).cast("decimal(38,0)").cast("long")
    big = whole.cast("decimal(38,0)") >= F.lit(Decimal((1 << 63) // _GIB))
    error = (
        F.when(~s.rlike(r"^\d+(\.\d+)?$"), "Disk cache must be a decimal number of GiB")
        .when((F.length(F.regexp_replace(whole, "^0+", "")) > 19) | big, "Disk cache size is too large")
        .when(k > 30, "Disk cache size is too precise")
    )
    size = F.when(error.isNull(), F.try_add(F.expr("cast(0 as bigint)") + whole.cast("decimal(38,0)").cast("long") * _GIB, part))
    error = F.coalesce(error, F.when(size == 0, "Disk cache must be greater than zero GiB"))
    return F.struct(F.when(error.isNull(), size).alias("bytes"), error.alias("error"))


# -- colours --------------------------------------------------------------------------------


def blend(a: Column, b: Column, share: Column) -> Column:
    """Each of three 8-bit channels, in single precision, rounded half away from zero."""
    s = share.cast("float")

    def channel(shift: int) -> Column:
        x, y = (F.shiftright(c.cast("int"), shift).bitwiseAND(F.lit(255)).cast("float") for c in (a, b))
        return F.floor((x + (y - x) * s).cast("double") + 0.5).cast("int").bitwiseAND(F.lit(255))

    return channel(16) * 65536 + channel(8) * 256 + channel(0)


def churn_heat(churn: str | Column) -> Column:
    return blend(F.lit(t.HEAT[0]), F.lit(t.HEAT[1]), F.least(F.greatest(_col(churn), F.lit(0.0)), F.lit(1.0)))


def depth_fill(level: str | Column) -> Column:
    return blend(F.lit(t.DEPTH_FILL[0]), F.lit(t.DEPTH_FILL[1]), F.least(_col(level), F.lit(8)).cast("float") / F.lit(8.0).cast("float"))


def file_fill(level: str | Column) -> Column:
    return blend(depth_fill(level), F.lit(t.FILE_TINT), F.lit(t.FILE_BLEND))


def box_kind(leaf: Column, kind: str | Column) -> Column:
    k = _col(kind)
    return F.when(leaf, "Leaf").when(k == "folder", "Folder").when(k == "item", "Item").otherwise("File")


def extension_tint(ext: str | Column) -> Column:
    out = None
    for colour, exts in t.EXTENSION_TINTS.items():
        hit = _col(ext).isin(exts.split())
        out = F.when(hit, colour) if out is None else out.when(hit, colour)
    return out.otherwise(t.OTHER_TINT)


def box_fill(box: str | Column, level: str | Column, path: str | Column, name: str | Column) -> Column:
    """Background by tier and depth, tinted by what a folder's name or a file's extension says."""
    b, base = _col(box), F.lit(t.CODE_FILL)
    fill = F.when(b == "Leaf", base).when(b == "Item", blend(base, file_fill(level), F.lit(0.45))).when(b == "File", file_fill(level)).otherwise(depth_fill(level))
    share = F.when(b == "Item", t.TYPE_BLEND["Item"]).when(b == "Leaf", t.TYPE_BLEND["Leaf"]).otherwise(t.TYPE_BLEND["File"])
    folder = F.when(_col(name).isin(t.DOC_FOLDERS), blend(fill, F.lit(t.DOC_TINT), F.lit(t.FOLDER_BLEND))).when(_col(name).isin(t.TEST_FOLDERS), blend(fill, F.lit(t.TEST_TINT), F.lit(t.FOLDER_BLEND))).otherwise(fill)
    tail = F.substring_index(file_part(path), ".", -1)
    return F.when(b == "Folder", folder).when(tail == file_part(path), fill).otherwise(blend(fill, extension_tint(tail), share))


def border(fill: str | Column) -> Column:
    return blend(_col(fill), F.lit(0xFFFFFF), F.lit(0.12))


def syntax_colour(kind: str | Column) -> Column:
    out = None
    for k, c in t.SYNTAX_COLOURS.items():
        out = F.when(_col(kind) == k, c) if out is None else out.when(_col(kind) == k, c)
    return out.otherwise(t.TEXT_COLOUR)


# -- keys -----------------------------------------------------------------------------------


def kind_key(kind: str | Column, label: str | Column) -> Column:
    return F.when(_col(kind) == "item", F.concat(F.lit("item:"), F.coalesce(_col(label), F.lit("")))).otherwise(_col(kind))


def _field(c: Column) -> Column:
    size = F.octet_length(c)
    return F.concat(_little(size.cast("long")), c)


def _little(n: Column) -> Column:
    """Eight bytes, the least first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8))))


def texture_key_bytes(path: Column, source: Column, kind: Column, label: Column, qualified: Column, ordinal: Column, schema: Column, theme: Column) -> Column:
    """What a texture's key hashes (FNV-1a): each field after its length in bytes. ``ordinal`` takes
    four bytes, the other numbers eight."""
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/")).cast("binary")
    short = F.unhex(F.substr(F.hex(_little(ordinal.cast("long"))), F.lit(1), F.lit(8)))
    rel = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./|/)+", "").cast("binary")
    return F.concat(*map(_field, (rel, _little(source), kind_key(kind, label).cast("binary"), slashes(qualified), short, _little(schema), _little(theme))))


# -- cameras --------------------------------------------------------------------------------


def world_to_screen(x: Column, y: Column, cx: Column, cy: Column, zoom: Column, vw: float, vh: float) -> tuple[Column, Column]:
    return (x - cx) * zoom + vw / 2, (y - cy) * zoom + vh / 2


def screen_to_world(x: Column, y: Column, cx: Column, cy: Column, zoom: Column, vw: float, vh: float) -> tuple[Column, Column]:
    return (x - vw / 2) / zoom + cx, (y - vh / 2) / zoom + cy


def zoom_about(x: Column, y: Column, cx: Column, cy: Column, zoom: Column, factor: Column, vw: float, vh: float, least: float, most: float) -> tuple[Column, Column, Column]:
    """The camera after a zoom that keeps the world point under (x, y) where it is."""
    wx, wy = screen_to_world(x, y, cx, cy, zoom, vw, vh)
    z = F.least(F.greatest(zoom * factor, F.lit(least)), F.lit(most))
    return wx - (x - vw / 2) / z, wy - (y - vh / 2) / z, z


def frame(x: Column, y: Column, w: Column, h: Column, vw: float, vh: float, share: float, least: float, most: float, page: bool = False) -> tuple[Column, Column, Column]:
    """The camera that shows a rectangle in a share of the view; a page never above its own size."""
    z = share * F.least(F.lit(vw) / w, F.lit(vh) / h)
    if page:
        z = F.least(z, F.lit(1.0))
    return x + w / 2, y + h / 2, F.least(F.greatest(z, F.lit(least)), F.lit(most))


def tween(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], at: Column, duration: float = 0.25) -> tuple[Column, ...]:
    """A camera on its way: centre eased, zoom geometric; the target from the duration on."""
    e = ease_in_out(F.greatest(at / duration, F.lit(0.0)))
    way = (a[0] + (b[0] - a[0]) * e, a[1] + (b[1] - a[1]) * e, a[2] * F.pow(b[2] / a[2], e))
    return tuple(F.when(at >= duration, goal).otherwise(x) for x, goal in zip(way, b, strict=True))


def ease_out(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return 1 - F.pow(1 - q, F.lit(3))


def focused_width(longest: str | Column) -> Column:
    """The width of a page that shows its longest line, between one and two pages."""
    need = _col(longest) * t.FONT_PX * t.CHAR_WIDTH + 2.0 * t.BODY_PAD
    return F.least(F.greatest(need, F.lit(t.PAGE_W)), F.lit(2.0 * t.PAGE_W))


def expanded_height(height: Column, extra_rows: Column) -> Column:
    return height + extra_rows * (t.FONT_PX * 1.3)


def side_columns(left: Column, right: Column, width: Column) -> tuple[Column, Column]:
    """Left edges of the columns of callers and callees beside a box."""
    return left - width - 12.0, right + 12.0

