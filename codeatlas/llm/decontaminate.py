"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are normalised (letters and digits, lower-cased, one space between
words). An item that occurs in a document within ``e`` edits, cut into ``e + 1`` pieces, has at
least one piece unchanged; so every document is scanned for all pieces at once, and each piece
hit is verified by Myers' bit-parallel edit distance over the stretch where the item can lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import batches, cut, free_name, lean, without

#: One edit for every so many characters of an item.
CHARS_PER_EDIT = 25
#: Items and bytes (UTF-8) of items that may be broadcast; more of them go in several passes.
MAX_ITEMS, MAX_ITEM_BYTES = 50_000, 32 << 20
_KEPT = regex.compile(r"[\p{L}\p{M}\p{N}]+")
# lower-cased ASCII: what isn't a letter or digit becomes a space
_ASCII = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}


def normalise(text: str) -> str:
    if text.isascii():
        return " ".join(text.translate(_ASCII).split())
    return " ".join(_KEPT.findall(text.lower()))


def budget(item: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(item) // chars_per_edit


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of like length."""
    cut = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    """Myers' match vectors: the positions of each character of the item, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """(least edits between the item and any substring of text, its end), or (limit + 1, -1)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, limit + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # the item may begin anywhere: no carry
        pv = (mh << 1 & full) | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """All pieces of all items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = 0):
        self.items = [(i, n, budget(n, chars_per_edit)) for i, t in items if len(n := normalise(t or "")) >= max(1, min_chars)]
        self.peq: dict[int, dict[str, int]] = {}  # made when an item's piece is first met
        by: dict[str, list[tuple[int, int]]] = {}
        for k, (_, n, e) in enumerate(self.items):
            for off, p in pieces(n, e):
                by.setdefault(p, []).append((k, off))
        self.find = ahocorasick.Automaton()
        for p, where in by.items():
            self.find.add_word(p, (len(p), where))
        if by:
            self.find.make_automaton()
        self.some = bool(by)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of the best place of each item that is in the normalised
        text within its budget; the first of equally good places."""
        if not self.some or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        # by item: the disjoint stretches of text where it can lie. A window holds its hit, and hits
        # come in order, so a window meets the last stretches or lies to the right of all
        near: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.find.iter(text):
            for k, off in where:
                if k in best:
                    continue
                _, n, e = self.items[k]
                at = last + 1 - size - off
                if at >= 0 and text.startswith(n, at):
                    if e or self._whole_words(text, at, at + len(n)):
                        best[k] = (0, at, at + len(n))
                elif e:
                    a, b = max(0, at - e), min(len(text), at + len(n) + e)
                    found = near.setdefault(k, [])
                    while found and found[-1][1] >= a:
                        x, y = found.pop()
                        a, b = min(a, x), max(b, y)
                    found.append((a, b))
        for k, found in near.items():
            if k in best:
                continue
            _, n, e = self.items[k]
            d, end = e + 1, -1
            peq = self.peq.get(k) or self.peq.setdefault(k, masks(n))
            for a, b in found:
                some, to = myers(peq, len(n), text[a:b], e)
                if some < d:
                    d, end = some, to + a
            if d <= e:  # the start, by the same distance backwards from the end
                rev = text[max(0, end - len(n) - e) : end][::-1]
                best[k] = (d, end - self._start(k, n, rev, d), end)
        return sorted((self.items[k][0], d, a, b) for k, (d, a, b) in best.items())

    @staticmethod
    def _whole_words(text: str, a: int, b: int) -> bool:
        return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")

    def _start(self, k: int, n: str, rev: str, d: int) -> int:
        """The least length of a prefix of rev at distance d from the reversed item."""
        prev = list(range(len(n) + 1))
        for j, c in enumerate(rev, 1):
            cur = [j]
            for i, x in enumerate(reversed(n), 1):
                cur.append(min(prev[i] + 1, cur[-1] + 1, prev[i - 1] + (x != c)))
            if cur[-1] <= d:
                return j
            prev = cur
        return min(len(n), len(rev))


_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _groups(items: DataFrame, max_items: int, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in groups within both bounds, read one at a time."""
    group, size = [], 0
    for r in items.select("item_id", "text").where("text is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        bytes_ = len(r["text"].encode("utf-8", "surrogatepass"))
        if group and (len(group) >= max_items or size + bytes_ > max_bytes):
            yield group
            group, size = [], 0
        group.append((r["item_id"], r["text"]))
        size += bytes_
    if group:
        yield group


def find(df: DataFrame, items: DataFrame, text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, max_items: int = MAX_ITEMS, max_bytes: int = MAX_ITEM_BYTES, matches: str = "matches", min_chars: int = 0) -> DataFrame:
    """Adds ``matches``: item_id, edits, start and end (in the normalised text) of each item that
    occurs in the whole text within one edit for every chars_per_edit of its characters, ordered by
    item_id and start; empty where none does, for null and empty texts. Items without a letter or
    digit match nothing; equal items count once; of one item_id with unlike texts each is sought.
    Items too short for an edit must be whole words of the text (``a`` isn't in ``cat``). Items of fewer
    normalised characters than min_chars (none by default) are not sought. A column of the input with that name gives way; repeated rows stay.

    Items are broadcast within the two bounds (one larger item alone). Where there are more, each
    group of them is a pass of its own over the texts that writes only what it finds, and is gone
    when the next one begins; what is found then joins the documents by hashes of their texts."""
    df = without(df, matches)
    spark, groups = df.sparkSession, _groups(items, max_items, max_bytes)
    group, after = next(groups, []), next(groups, None)
    if after is None:
        schema = T.StructType([*df.schema.fields, T.StructField(matches, _FOUND)])
        return df.mapInArrow(lean(_scan(spark.sparkContext.broadcast(group), text, chars_per_edit, matches, min_chars)), schema)

    keys = [free_name(df, "key_1"), free_name(df, "key_2")]
    hashed = [F.xxhash64(F.col(f"`{text}`")), F.xxhash64(F.col(f"`{text}`"), F.lit(1))]
    texts = df.select(*(h.alias(k) for h, k in zip(hashed, ("k1", "k2"), strict=True)), F.col(f"`{text}`").alias("text")).where("text is not null")
    schema = T.StructType([*texts.schema.fields, T.StructField("found", _FOUND)])
    parts = []
    while group is not None:
        shared = spark.sparkContext.broadcast(group)
        some = texts.mapInArrow(lean(_scan(shared, "text", chars_per_edit, "found", min_chars)), schema).where(F.size("found") > 0)
        parts.append(cut(some.select("k1", "k2", F.explode("found").alias("m")).distinct(), "matches"))
        shared.destroy()
        group, after = after, next(groups, None)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # at most an entry for each item; written, so that the join may split a text that is in very many rows
    found = cut(found.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("m")).alias("m")), "matches")
    found = found.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), F.col("m").alias(matches))
    out = df.select(*(f"`{c}`" for c in df.columns), *(h.alias(k) for h, k in zip(hashed, keys, strict=True))).join(found, keys, "left")
    return out.select(*(f"`{c}`" for c in df.columns), F.coalesce(F.col(matches), F.array().cast(_FOUND)).alias(matches))


def _scan(shared, text: str, chars_per_edit: int, matches: str, min_chars: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value, chars_per_edit, min_chars)
        for b in batches(8 << 20, text)(it):
            out = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                out.append([{"item_id": i, "edits": d, "start": a, "end": z} for i, d, a, z in m.matches(normalise(t or ""))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _FOUND_ARROW)], [*b.schema.names, matches])

    return run
