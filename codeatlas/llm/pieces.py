"""Cuts texts into chunks on which a byte-level tokenizer can work apart, and caches the result.

The published pre-tokenizer pattern never matches across a single space that stands between two
characters other than white space, except that the space leads the second match. So a text cut
before each such space gives the same matches chunk by chunk, and a chunk is mostly a word with
its leading space: equal chunks need be encoded once. Texts with other white space around a
space are cut by a regular expression at those spaces only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space, as the tokenizers' regular expressions understand \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")


#: What a kept chunk takes besides its characters and ids: two objects and a place in a dictionary.
ENTRY_BYTES = 200
#: Longer chunks (a text without spaces is one chunk) are encoded each time, never kept.
LONGEST = 64


class ChunkCache:
    """Packed ids of chunks, kept for as long as the worker lives, within a number of bytes. The
    bound frees memory only: a chunk that is not kept is encoded again. When it is reached, after a
    batch, all go."""

    def __init__(self, encode, limit: int = 64 << 20):
        #: encode(list of strings) -> list of bytes, one for each string
        self.encode, self.limit, self.held = encode, limit, 0
        #: by chunk: with a space before it; at the start of a text; with a space before it, for
        #: chunks that have white space at a border (never in the first of the three)
        self.lead: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def _fill(self, known: dict[str, bytes], wanted: list[str], before: str) -> list[str]:
        """Encodes the wanted chunks that are not kept; returns what is new."""
        new = [c for c in wanted if c not in known]
        if new:
            known.update(zip(new, self.encode([before + c for c in new]), strict=True))
        return new

    def _trim(self, known: dict[str, bytes], new: list[str]) -> None:
        """After a batch: chunks too long to be kept go, the others count."""
        long = [c for c in new if len(c) > LONGEST]
        for c in long:
            del known[c]
        if long:
            new = [c for c in new if len(c) <= LONGEST]
        # two bytes a character: most have one, some four
        self.held += 2 * sum(map(len, new)) + sum(map(len, map(known.__getitem__, new))) + ENTRY_BYTES * len(new)

    def _bound(self) -> None:
        if self.held > self.limit:
            for known in (self.lead, self.first, self.odd):
                known.clear()
            self.held = 0

    def pack_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The packed ids of all texts, one after another, and where each text's begin (and the end).

        Texts are split and equal chunks are found by Arrow; Python sees each chunk of a batch once."""
        parts = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
        off = np.asarray(parts.offsets, np.int64)
        chunks = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        off = off - off[0]
        if not len(chunks):
            return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
        code, names = np.asarray(chunks.indices, np.int64), chunks.dictionary.to_pylist()
        # texts with a chunk that is empty or has white space at a border are cut with care
        bad = np.array([not c or c != c.strip() for c in names])
        late = np.flatnonzero(np.logical_or.reduceat(bad[code], off[:-1]))
        firsts, at = np.unique(code[off[:-1]], return_inverse=True)
        good = [c for c, b in zip(names, bad.tolist(), strict=True) if not b]
        heads = [names[i] for i in firsts if not bad[i]]
        new, new_heads = self._fill(self.lead, good, " "), self._fill(self.first, heads, "")
        lead, first = self.lead, self.first
        table = [lead.get(c, b"") for c in names] + [first.get(names[i], b"") for i in firsts]
        pick = code.copy()
        pick[off[:-1]] = len(names) + at
        self._trim(self.lead, new)
        self._trim(self.first, new_heads)
        if len(late):
            nothing = len(table)
            table.append(b"")
            text = texts.take(pa.array(late)).to_pylist()
            cut = [_CUT.split(t or "") for t in text]
            new = self._fill(self.odd, list({x for c in cut for x in c[1:]}), " ")
            for i, c, head in zip(late.tolist(), cut, self.encode([c[0] for c in cut]), strict=True):
                pick[off[i] : off[i + 1]] = nothing
                pick[off[i]] = len(table)
                table.append(head + b"".join([self.odd[x] for x in c[1:]]))
            self._trim(self.odd, new)
        self._bound()
        ids = pa.array(table, pa.large_binary()).take(pa.array(pick))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        data = np.frombuffer(ids.buffers()[2], np.uint8) if ids.buffers()[2] is not None else np.zeros(0, np.uint8)
        return data[ends[0] : ends[-1]], ends[off] - ends[0]

    def pack(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        data, off = self.pack_array(pa.array(texts, pa.large_string()))
        return [data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
