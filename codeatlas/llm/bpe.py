"""Byte-level BPE encoding and decoding in numpy.

Pieces (matches of the tokenizer's pattern) of like length share a padded matrix of ranks. In
every round each row finds its leftmost pair of least rank through a hashed pair table, merges
it, and the row's tail moves one place left; rows without a pair leave the matrix. Rows longer
than ``MATRIX_BYTES`` would need as many rounds as bytes, so they use a heap with the same rule.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeatlas.llm.common import batches, binaries, lean, utf8, without
from codeatlas.llm.pieces import WHITE, ChunkCache

MATRIX_BYTES = 256
MATRIX_CELLS = 1 << 18  # of a padded matrix; about ten arrays of its size are held
BATCH_BYTES = 1 << 20
CACHE_BYTES = 24 << 20  # of chunks that a worker keeps; workers outlive their tasks
_MARKS = frozenset(".,;:!?")


class ByteBPE:
    """A vocabulary of byte strings with ranks, and the pattern that cuts text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # the library's \s is Unicode's White_Space; say so outright
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        n = max(ranks.values()) + 1
        self.tokens = [b""] * n
        for t, r in ranks.items():
            self.tokens[r] = t
        self.token_len = np.array([len(t) for t in self.tokens], np.int64)
        self.token_off = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._pairs()

    def _pairs(self) -> None:
        """An open hash table of (left rank, right rank) -> rank of the joined bytes."""
        keys, values = [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        k = np.array(keys, np.int64)
        self.bits = max(4, int(len(k) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, self.NONE, np.int64)
        at, left = self._slot(k), np.arange(len(k))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == -1
            _, one = np.unique(at[left], return_index=True)
            won = np.zeros(len(left), bool)
            won[one] = True
            won &= free
            put = left[won]
            self.keys[at[put]], self.values[at[put]] = k[put], np.array(values, np.int64)[put]
            left = left[~won]
            at[left] = (at[left] + 1) & (size - 1)

    NONE = 1 << 40

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, NONE where there is none (also where a or b is padding)."""
        key = (a << 32) | b
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.values[at], self.NONE)
        todo = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1) & (a >= 0) & (b >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(a < 0) | (b < 0)] = self.NONE
        return out

    def _matrix(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows of ranks padded by -1 until no pair is left. Returns rows and lengths."""
        n, width = rows.shape
        done, sizes = np.full((n, width), -1, np.int64), lengths.copy()
        live = np.arange(n)
        cur, size = rows.copy(), lengths.copy()
        pr = self.pair_rank(cur[:, :-1].ravel(), cur[:, 1:].ravel()).reshape(n, -1) if width > 1 else np.full((n, 0), self.NONE)
        while len(live):
            if cur.shape[1] < 2:
                done[live, : cur.shape[1]], sizes[live] = cur, size
                break
            at = pr.argmin(axis=1)  # the leftmost of the least
            best = pr[np.arange(len(live)), at]
            stop = best == self.NONE
            if stop.any():
                done[live[stop], : cur.shape[1]], sizes[live[stop]] = cur[stop], size[stop]
                go = ~stop
                live, cur, pr, size, at, best = live[go], cur[go], pr[go], size[go], at[go], best[go]
                if not len(live):
                    break
            w = int(size.max())  # compaction: columns that hold padding only go
            cur, pr = cur[:, :w], pr[:, : w - 1]
            r = np.arange(len(live))
            col = np.arange(w - 1)[None, :]
            moved = np.where(col > at[:, None], cur[:, 1:], cur[:, :-1])
            moved[r, at] = best
            if w > 2:
                pr = np.where(np.arange(w - 2)[None, :] > at[:, None], pr[:, 1:], pr[:, :-1])
                left = np.flatnonzero(at > 0)
                pr[left, at[left] - 1] = self.pair_rank(moved[left, at[left] - 1], moved[left, at[left]])
                right = np.flatnonzero(at < w - 2)
                pr[right, at[right]] = self.pair_rank(moved[right, at[right]], moved[right, at[right] + 1])
            else:
                pr = pr[:, :0]
            cur, size = moved, size - 1
        return done, sizes

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece in n log n steps."""
        ids = [int(x) for x in self.byte_rank[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        prev, nxt, parts = list(range(-1, n - 1)), list(range(1, n + 1)), [piece[i : i + 1] for i in range(n)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if parts[i] is not None else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], ids[i], parts[j] = a + b, r, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                if x >= 0 and nxt[x] < n and (q := self.ranks.get(parts[x] + parts[nxt[x]])) is not None:
                    heapq.heappush(heap, (q, x, parts[x], parts[nxt[x]]))
        return [ids[i] for i in range(n) if parts[i] is not None]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece, packed."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        low = 1
        while low <= MATRIX_BYTES:  # buckets of 1, 2, 3-4, 5-8, ... bytes
            high = low if low < 3 else low * 2 - 2
            high = {1: 1, 2: 2}.get(low, 1 << (low - 1).bit_length())
            at = np.flatnonzero((lengths >= low) & (lengths <= high))
            step = max(1, MATRIX_CELLS // high)
            for s in range(0, len(at), step):
                some = at[s : s + step]
                size = lengths[some]
                rows = np.full((len(some), high), -1, np.int64)
                rows[np.arange(high)[None, :] < size[:, None]] = self.byte_rank[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
                ids, size = self._matrix(rows, size)
                packed = ids[np.arange(high)[None, :] < size[:, None]].astype("<u4").tobytes()
                end = np.cumsum(size * 4).tolist()
                for i, a, b in zip(some.tolist(), [0, *end], end, strict=False):
                    out[i] = packed[a:b]
            low = high + 1
        for i in np.flatnonzero(lengths > MATRIX_BYTES):
            out[i] = np.array(self._heap(pieces[i]), "<u4").tobytes()
        return out

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts."""
        cut = [self.pieces(t) for t in texts]
        ids = iter(self.encode_pieces([p.encode() for c in cut for p in c]))
        return [next(ids) if len(c) == 1 else b"".join([next(ids) for _ in c]) for c in cut]

    def pieces(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The pattern's matches. A word of letters with a space before it or not, and the mark
        after it, need no regular expression."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return (chunk,)
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return chunk[:-1], chunk[-1]
        return self.pattern.findall(chunk)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, as one array."""
        size = self.token_len[ids]
        end = np.cumsum(size)
        return self.token_bytes[np.arange(end[-1] if len(end) else 0) + np.repeat(self.token_off[ids] - (end - size), size)]


_loaded: dict[tuple[str, str], tuple[ByteBPE, ChunkCache]] = {}


def load(path: str, pattern: str) -> tuple[ByteBPE, ChunkCache]:
    """The vocabulary of a rank file (base64 token, space, rank on each line), once a worker."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        bpe = ByteBPE(ranks, pattern)
        _loaded[path, pattern] = bpe, ChunkCache(bpe.encode_chunks, CACHE_BYTES)
    return _loaded[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the text's token ids as packed little-endian unsigned 32-bit integers.

    ``path`` must be readable by the workers (it comes with an installed package). A null or
    empty text has no ids. A column of the input with that name gives way."""
    df = without(df, ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType(), False)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = load(path, pattern)
        for b in batches(BATCH_BYTES, text)(it):
            packed = binaries(*cache.pack_array(b.column(b.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*b.columns, packed], [*b.schema.names, ids])

    return df.mapInArrow(lean(run), schema)


def encode_checked(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", exact: str = "round_trip") -> DataFrame:
    """As encode, and ``exact``: whether decoding the ids gives the text's bytes. One pass, so one
    Python worker a core holds the vocabulary, where encode and decode in a row need two."""
    df = without(df, ids, exact)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType(), False), T.StructField(exact, T.BooleanType(), False)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = load(path, pattern)
        for b in batches(BATCH_BYTES, text)(it):
            column = b.column(b.schema.get_field_index(text))
            packed, off = cache.pack_array(column)
            tokens = packed.view("<u4").astype(np.int64)
            back, at = bpe.decode(tokens), np.concatenate([[0], np.cumsum(bpe.token_len[tokens])])[off // 4]
            data, want, _ = utf8(column)
            same = [back[x:v].tobytes() == data[y:w].tobytes() for x, v, y, w in zip(at[:-1], at[1:], want[:-1], want[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, binaries(packed, off), pa.array(same, pa.bool_())], [*b.schema.names, ids, exact])

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the bytes of packed ids; empty for null or no ids. A column of the
    input with that name gives way."""
    df = without(df, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType(), False)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = load(path, pattern)
        for b in batches(BATCH_BYTES, ids)(it):
            data, off, _ = utf8(b.column(b.schema.get_field_index(ids)))
            tokens = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(bpe.token_len[tokens])])
            yield pa.RecordBatch.from_arrays([*b.columns, binaries(bpe.decode(tokens), ends[off // 4])], [*b.schema.names, decoded])

    return df.mapInArrow(lean(run), schema)
