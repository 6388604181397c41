"""Fill-in-middle: a text is cut at two of its tokens' borders and written with its middle last.

A token is a run of ASCII letters or any other single code point. Where tokens begin is a vector of
bits over the bytes of a batch, packed in words of 64, with a directory of running popcounts for
each block of 512 bits. The number of a text's tokens is the rank at its end less that at its start,
a cut is one select, and lengths in code points are ranks in a second such vector: no list of tokens
is made, and the vectors take an eighth of the text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import batches, free_name, lean, utf8, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: texts below the first number are transformed, those below the second begin with their suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
BATCH_BYTES = 4 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_BLOCK = 8  # words of 64 bits
#: _NTH[b, r]: the place of the set bit of rank r in the byte b.
_NTH = np.zeros((256, 8), np.int64)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _NTH[_b, : len(_set)] = _set


class Bits:
    """A packed vector of bits with rank and select for many places at once."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        raw = np.zeros((len(packed) // (8 * _BLOCK) + 1) * 8 * _BLOCK, np.uint8)
        raw[: len(packed)] = packed
        self.raw, self.word = raw, raw.view("<u8")
        self.block = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of set bits before each place."""
        word, block = at >> 6, at >> 9
        inside = np.minimum(block[:, None] * _BLOCK + np.arange(_BLOCK), len(self.word) - 1)
        whole = np.bitwise_count(self.word[inside]) * (inside < word[:, None])
        rest = self.word[np.minimum(word, len(self.word) - 1)] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.block[np.minimum(block, len(self.block) - 1)] + whole.sum(axis=1, dtype=np.int64) + np.bitwise_count(rest)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The place of the set bit that has as many before it; every nth must be below the total."""
        block = np.searchsorted(self.block, nth, "right") - 1
        left = nth - self.block[block]
        byte = block * 8 * _BLOCK
        # down to the word of the block, then to the byte of the word
        for size, parts in ((8, self.word.reshape(-1, _BLOCK)[block]), (1, None)):
            parts = self.raw[byte[:, None] + np.arange(8)] if parts is None else parts
            before = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int64)
            i = (before <= left[:, None]).sum(axis=1)
            left = left - np.where(i > 0, np.take_along_axis(before, np.maximum(i - 1, 0)[:, None], axis=1)[:, 0], 0)
            byte = byte + i * size
        return byte * 8 + _NTH[self.raw[byte], left]


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[Bits, Bits]:
    """Where tokens begin, and where code points begin. No token crosses the border of two texts."""
    char = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    token = char.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    token[offsets[:-1][offsets[:-1] < len(data)]] = True
    return Bits(token), Bits(char)


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers that depend on the id alone (a null one counts as empty)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


_ADDED = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def transform(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (code
    points; null if plain) and ``output``: the text itself, or its parts behind their marks.

    Which form and which cuts is drawn from the id. Plain are also empty and null texts (output
    empty) and those that hold a mark, so that every output can be undone. Columns with these names
    give way; repeated rows stay, equal ones with equal output; an empty table gives an empty one."""
    df = without(df, *_ADDED)
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, t) for k, t in _ADDED.items())])
    wide, names = df, []
    for i, h in enumerate(draws(F.col(f"`{doc_id}`"))):
        names.append(free_name(wide, f"h{i}"))
        wide = wide.withColumn(names[-1], h)
    keep = len(df.columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(BATCH_BYTES, text)(it):
            col = b.column(b.schema.get_field_index(text))
            data, off, _ = utf8(col)
            token, char = vectors(data, off)
            total = token.rank(off)
            n = np.diff(total)
            h = [np.asarray(b.column(keep + i), np.int64) for i in range(4)]
            marked = np.zeros(len(n), bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= np.asarray(pc.fill_null(pc.match_substring(col, mark), False))
            plain = (n == 0) | marked | (h[2] % 100 >= TRANSFORMED)
            spm = h[3] % 100 < SUFFIX_FIRST
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            cut = []
            for c in (np.minimum(one, two), np.maximum(one, two)):
                inner = np.flatnonzero(c < n)
                at = off[1:].copy()
                at[inner] = token.select(total[inner] + c[inner])
                cut.append(at)
            chars = [char.rank(x) for x in (off[:-1], *cut)]
            said, raw = [], data.tobytes()
            for a, p, m, z, is_plain, is_spm in zip(off[:-1].tolist(), cut[0].tolist(), cut[1].tolist(), off[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
                if is_plain:
                    said.append(raw[a:z])
                elif is_spm:
                    said.append(b"".join((SUFFIX.encode(), raw[m:z], PREFIX.encode(), raw[a:p], MIDDLE.encode(), raw[p:m])))
                else:
                    said.append(b"".join((PREFIX.encode(), raw[a:p], SUFFIX.encode(), raw[m:z], MIDDLE.encode(), raw[p:m])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            more = [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(chars[1] - chars[0], mask=plain), pa.array(chars[2] - chars[1], mask=plain), pa.array(said, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], *more], schema.names)

    return wide.mapInArrow(lean(run), schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """Adds the text that ``transform`` made the output of, from the output and its form alone. No
    part holds a mark and marks don't overlap themselves or each other, so the first of each kind is the one
    written. Null stays null; a column with this name gives way."""
    df = without(df, restored) if restored.lower() not in (output.lower(), form.lower()) else df
    out, kind = F.col(f"`{output}`"), F.col(f"`{form}`")
    size = len(PREFIX)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(out, F.lit(size + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(one) + size + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.char_length(two) + size + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return df.withColumn(restored, F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out))
