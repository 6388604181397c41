"""What the operators share: shared folders, Arrow helpers, and hashes of many words at once."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd multipliers of the 64-bit mixers (xxHash's published primes).
P1, P2, P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, one of our own if
    all runs in this process (as in tests); a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import os
    import tempfile

    made = "file://" + os.path.join(tempfile.gettempdir(), "codeatlas-shared")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_WHERE = "_codeatlas_path"


def cut(df: DataFrame, what: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again: short lineage that
    outlives any executor, and no second run of what made them."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _WHERE, path)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` returned, when all that is made of them is written. Shuffle files
    of jobs that have ended go when the driver collects garbage, so it is asked to."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(getattr(t, _WHERE))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows in an Arrow batch for the jobs run within, where a row can be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names, which Spark tells apart by letters, not by case."""
    gone = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in gone))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the table has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_libc = None


def release() -> None:
    """Gives freed memory back to the system: a worker outlives its tasks, and what one operator
    freed would else be counted against the next one's."""
    global _libc
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.malloc_trim  # noqa: B018
        except (OSError, AttributeError):  # another C library
            _libc = False
    if _libc:
        _libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves no freed memory with the worker."""

    def ran(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            release()

    return ran


def batches(max_bytes: int, column: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slices incoming batches so that each slice holds about max_bytes of the column (a single
    longer text makes a slice of its own): memory is bounded whatever the batch size set."""

    def sliced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows == 0:
                continue
            _, off, _ = utf8(b.column(b.schema.get_field_index(column)))
            start = 0
            while start < b.num_rows:
                end = int(np.searchsorted(off, off[start] + max_bytes, "right")) - 1
                end = min(max(end, start + 1), b.num_rows)
                yield b.slice(start, end - start)
                start = end

    return sliced


def utf8(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, int64 offsets into them (one more than rows) and validity of a string or binary
    array; a null has no bytes."""
    a = a.cast(pa.large_binary())
    valid = np.asarray(a.is_valid())
    if not valid.all():
        a = a.fill_null(b"")
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8) if off is not None else np.zeros(len(a) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0], valid


def binaries(data: bytes | np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A binary or string array of the bytes between 32-bit offsets."""
    off = np.ascontiguousarray(offsets, np.int32)
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> U64(33))
    h *= P2
    h ^= h >> U64(29)
    h *= P3
    h ^= h >> U64(32)
    return h


_BASE = 0x9E3779B97F4A7C15
_STEP = 1024


def _powers(base: int, n: int) -> np.ndarray:
    low, high = np.full(_STEP, base, U64), np.full(n // _STEP + 1, pow(base, _STEP, 1 << 64), U64)
    low[0] = high[0] = 1
    return (np.cumprod(high)[:, None] * np.cumprod(low)).ravel()[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the base and of its inverse modulo 2**64. Made anew for each batch: a table kept
    by a worker would stay as large as the longest text that it ever met."""
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def range_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of codes[start:end] for many ranges at once, in linear time."""
    p, inv = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * p[: len(codes)], out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(U64) * P1)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ASCII white space (or those of another table of
    256 flags), and the first word of each text (one entry more than texts). A word never crosses
    the border of two texts."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[data], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    begins, ends = change & inside[1:], change & inside[:-1]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]
    joined = border[inside[border] & inside[border + 1]]  # text i ends and text i + 1 begins within a run
    begins[joined] = ends[joined] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many ranges one after another, and the offsets between them."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return data[at], off


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]
