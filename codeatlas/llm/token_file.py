"""Token-id files: flat unsigned integers, and a file of 64-bit document offsets beside each.

Documents are dealt into ranges of doc_id. Each range is a shard ``shard-<part>``: ``.bin`` holds
the ids of its documents in ascending doc_id order (unsigned, little-endian, of the width that
the vocabulary needs), ``.idx`` one unsigned 64-bit number for each document, where its ids end
in the shard, and ``.ids`` the documents' doc_ids as signed 64-bit numbers. A shard's base, the
ids of all shards before it, is a prefix sum of the shards' lengths. A task writes under a name
of its own and renames at the end, so a repeated task leaves the same files.

The folder must be one that every worker can open as a file (a local or mounted path).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import batches, lean, shuffle_partitions
from codeatlas.llm.ordered import bounds, part_of
from codeatlas.llm.pieces import ChunkCache

BATCH_BYTES = 4 << 20
CACHE_BYTES = 300 << 20  # of chunks that a worker keeps
JOINED = 32  # chunks in one string for the library; longer strings take it more time a chunk
_SEPARATOR = "\n"


def local(path: str) -> str:
    """The path of a mounted folder: as it is, or without ``file:``."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped and need a mounted folder, not {path}")
    return unquote(u.path)


class _Library:
    """Ids of chunks from the tokenizers library, many chunks in one call.

    Chunks are joined by line ends; the library's pattern always cuts there. A chunk that has a
    line end itself goes alone."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their names in a text are ordinary text
        self.dtype = dtype
        self.end = np.array(self._ids([_SEPARATOR])[0])
        assert len(self.end) == 1, "a line end must be one token"

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if c[:1] == " " and c[1:].strip() == c[1:] != "" and _SEPARATOR not in c]
        rest = sorted(set(range(len(chunks))) - set(plain))
        parts = [plain[s : s + JOINED] for s in range(0, len(plain), JOINED)]
        for some, ids in zip(parts, self._ids([_SEPARATOR.join([chunks[i] for i in x]) for x in parts]), strict=True):
            ids = np.array(ids, self.dtype)
            cut = np.flatnonzero(ids == self.end[0])
            assert len(cut) == len(some) - 1
            packed, width = ids.tobytes(), ids.itemsize
            ends = [*(cut * width).tolist(), len(packed)]
            starts = [0, *((cut + 1) * width).tolist()]
            for i, a, b in zip(some, starts, ends, strict=True):
                out[i] = packed[a:b]
        for i, ids in zip(rest, self._ids([chunks[i] for i in rest]), strict=True):
            out[i] = np.array(ids, self.dtype).tobytes()
        return out


_caches: dict[tuple[str, str], ChunkCache] = {}


def _cache(path: str, dtype: str) -> ChunkCache:
    if (path, dtype) not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are shared out by Spark
        _caches[path, dtype] = ChunkCache(_Library(path, dtype).encode, CACHE_BYTES)
    return _caches[path, dtype]


_WRITTEN = "part int, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, dtype: str = "<u2") -> list[tuple[int, int, int]]:
    """Encodes (doc_id, text) and writes the shards. Returns (part, base, ids) of each shard, in
    order: a row for each partition.

    A null or empty text has only the end id. Rows of equal doc_id are ordered by text; a null
    doc_id comes first and is written as the least 64-bit number. No documents: no shards."""
    spark = docs.sparkSession
    top = local(folder)
    cuts = bounds(docs.select("doc_id"), "doc_id", shuffle_partitions(spark))
    dealt = docs.select(part_of("doc_id", cuts).alias("part"), "doc_id", "text").repartitionById(len(cuts) + 1, F.col("part"))
    dealt = dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.length("text"), "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, width = _cache(tokenizer, dtype), np.dtype(dtype).itemsize
        os.makedirs(top, exist_ok=True)
        part, n, total, names, files = None, 0, 0, [], []
        for b in batches(BATCH_BYTES)(it):
            if part is None:
                part = b.column(0)[0].as_py()  # one part a partition
                names = [f"{top}/shard-{part:06d}.{x}" for x in ("bin", "idx", "ids")]
                mark = f".{uuid.uuid4().hex}"
                files = [open(x + mark, "wb") for x in names]
            packed, off = cache.pack_array(b.column(2))
            cuts = off[1:] // width
            ids = np.insert(packed.view(dtype), cuts, end_id)  # the end id after each document
            ends = total + cuts + np.arange(1, len(cuts) + 1)
            files[0].write(ids.tobytes())
            files[1].write(ends.astype("<u8").tobytes())
            files[2].write(np.asarray(b.column(1).fill_null(np.iinfo(np.int64).min)).astype("<i8").tobytes())
            n, total = n + len(cuts), int(ends[-1])
        if part is not None:
            for f, x in zip(files, names, strict=True):
                f.close()
                os.replace(x + mark, x)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["part", "n_docs", "n_ids"])

    rows = sorted(tuple(r) for r in dealt.mapInArrow(lean(run), _WRITTEN).collect())
    sums = [0, *accumulate(r[2] for r in rows)]
    return [(part, base, n) for (part, _, n), base in zip(rows, sums[:-1], strict=True)]


def read(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]], dtype: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: start counts the ids of all documents
    before it, ids are packed little-endian unsigned 32-bit integers. Shards are memory-mapped."""
    top = local(folder)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = f"{top}/shard-{part:06d}"
                ids, ends, docs = np.memmap(f"{name}.bin", dtype, "r"), np.memmap(f"{name}.idx", "<u8", "r").astype(np.int64), np.memmap(f"{name}.ids", "<i8", "r")
                starts = np.concatenate([[0], ends[:-1]])
                for s in range(0, len(ends), 512):
                    at = slice(s, s + 512)
                    flat = ids[starts[s] : ends[at][-1]].astype("<u4").tobytes()
                    rel = ((starts[at] - starts[s]) * 4).tolist(), ((ends[at] - starts[s]) * 4).tolist()
                    none = docs[at] == np.iinfo(np.int64).min
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(docs[at], np.int64), mask=none), pa.array(base + starts[at]), pa.array(ends[at] - starts[at]), pa.array([flat[a:z] for a, z in zip(*rel, strict=True)], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    table = spark.createDataFrame([(p, b) for p, b, _ in shards], "part int, base long")
    # a task for each shard
    return table.repartitionById(max(1, max((p for p, _, _ in shards), default=0) + 1), F.col("part")).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")
