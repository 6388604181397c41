"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; in each window of ``w`` neighbouring runs the
rightmost least hash is kept with its position. Two texts that share a passage of at least
``w + k - 1`` code points keep a common hash at like places in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import U64, batches, lean, mix, powers, shuffle_partitions, without
from codeatlas.llm.ordered import bounds, part_of

K, W = 12, 24
_CHUNK = 1 << 19  # runs whose hashes are held at once; positions in it fit into POS bits
_POS = 20


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    p, inv = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * p[: len(codes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inv[: len(codes) - k + 1])


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (32 bits) and positions (code points), in order of position.

    A text shorter than k is one run; one with fewer runs than w is one window; an empty text
    keeps nothing."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, n)
    w = min(w, n - k + 1)
    found_h, found_p = [], []
    last = -1
    for start in range(0, n - k - w + 2, _CHUNK):
        part = codes[start : start + _CHUNK + w + k - 2]
        h = _gram_hashes(part, k) >> U64(_POS)
        # the low bits count down, so that of equal hashes the rightmost is the least
        key = (h << U64(_POS)) | (U64((1 << _POS) - 1) - np.arange(len(h), dtype=U64))
        best, span = key, 1
        while span * 2 <= w:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < w:
            best = np.minimum(best[: len(key) - w + 1], best[w - span : w - span + len(key) - w + 1])
        at = best[np.concatenate([[True], best[1:] != best[:-1]])]
        pos = (U64((1 << _POS) - 1) - (at & U64((1 << _POS) - 1))).astype(np.int64) + start
        keep = pos > last
        found_h.append((at[keep] >> U64(32)).astype(np.uint32))
        found_p.append(pos[keep])
        last = pos[-1]
    return np.concatenate(found_h), np.concatenate(found_p)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the distinct hashes; 1 for two empty fingerprints."""
    a, b = np.unique(a), np.unique(b)
    both = len(a) + len(b) - len(np.union1d(a, b)) if len(a) and len(b) else 0
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def fingerprint(df: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Adds ``hashes`` (array of long) and ``positions`` (array of int), empty for a null or empty
    text. Columns of the input with these names give way. Repeated rows stay."""
    df = without(df, "hashes", "positions")
    schema = T.StructType([*df.schema.fields, T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(8 << 20, text)(it):
            kept = [winnow(t or "", k, w) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([h.astype(np.int64) for h, _ in kept], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in kept], pa.list_(pa.int32()))], [*b.schema.names, "hashes", "positions"])

    return df.mapInArrow(lean(run), schema)


def with_next(docs: DataFrame) -> DataFrame:
    """(part, extra, doc_id, text) of (doc_id, text) dealt into ranges of doc_id. Each range that
    isn't last also holds, marked extra, the first document of the next range; the last one holds
    the first of all. So each row's successor is in its own part. Texts are shuffled once."""
    ids = docs.select("doc_id")
    n = shuffle_partitions(docs.sparkSession)
    cuts = bounds(ids, "doc_id", n)
    part = part_of("doc_id", cuts)
    firsts = ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none")).collect()  # a row for each part
    dealt = docs.select(part.alias("part"), F.lit(0).alias("extra"), "doc_id", "text")
    order = [(r["part"], None if r["none"] else r["first"]) for r in sorted(firsts, key=lambda r: r["part"])]
    if order:
        after = order[1:] + order[:1]
        table = [(p, f) for (p, _), (_, f) in zip(order, after, strict=True)]
        lead = docs.sparkSession.createDataFrame(table, "part int, first long")
        ends = [f for _, f in table if f is not None]
        some = docs.where(F.col("doc_id").isin(ends) | F.lit(any(f is None for _, f in table)) & F.col("doc_id").isNull())
        more = some.join(F.broadcast(lead), F.col("doc_id").eqNullSafe(F.col("first"))).select("part", F.lit(1).alias("extra"), "doc_id", "text")
        dealt = dealt.unionByName(more)
    return dealt.repartitionById(max(1, len(cuts) + 1), F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), F.length("text"), "text")


def with_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document against an edit of it and against its successor in ascending doc_id.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of
    the next document's text, or all of them; the first document follows the last. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal, eight digits a
    hash), near_edited and near_next. Null texts count as empty; rows of equal doc_id are ordered
    by text; a null doc_id is first; a single document follows itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, hashes) of the row whose successor comes next

        def done(row, nxt, h_next):
            doc, text, h = row
            n = len(text)
            edited = text[: n - n // 4] + nxt[: n // 4]
            e = winnow(edited, k, w)[0] if n // 4 else h
            return (doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), h.astype(">u4").tobytes().hex(), e.astype(">u4").tobytes().hex(), likeness(h, e), likeness(h, h_next))

        for b in batches(8 << 20)(it):
            out = []
            for extra, doc, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = text or ""
                h = winnow(text, k, w)[0]
                if held is not None:
                    out.append(done(held, text, h))
                held = None if extra else (doc, text, h)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _EDIT_TYPES)], _EDIT_NAMES) if out else _EMPTY
        # every part but an empty one ends with an extra row, after which none is held

    return with_next(docs.select("doc_id", "text")).mapInArrow(lean(run), ", ".join(f"{n} {t}" for n, t in zip(_EDIT_NAMES, ("long", "long", "string", "string", "string", "double", "double"))))


_EDIT_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_EDIT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_EMPTY = pa.RecordBatch.from_arrays([pa.array([], t) for t in _EDIT_TYPES], _EDIT_NAMES)
