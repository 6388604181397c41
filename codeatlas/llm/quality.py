"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

A document is a bag of hashed terms: its words, the words' shapes, and how words repeat. Terms
are weighted by log count and inverse document frequency and projected by a truncated singular
value decomposition. What is fitted (on a bounded sample of labelled rows) is broadcast: a
projection of TERMS x DIMS and at most MAX_TRAIN vectors, whatever the corpus's size. Every
document's cosine with every labelled vector is computed in blocks, and the nearest vote with
their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import U64, batches, lean, lower, range_hashes, utf8, without, words

TERMS, DIMS, NEIGHBOURS = 2048, 48, 15
#: Bound of the labelled sample, in rows.
MAX_TRAIN = 3000
THRESHOLD = 0.3
BATCH_BYTES = 1 << 19  # of text whose terms are counted at once
WORD_WEIGHT = 0.5  # how a text is written says more than its words
_WORDS, _SHAPES, _REPEATS = 1024, 960, 64  # ranges of term ids; together TERMS

# classes of bytes: letter a-z, A-Z, digit, beyond ASCII, then punctuation one by one
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
for _i, _c in enumerate(_PUNCT):
    _CLASS[_c] = 5 + _i


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each term in each text: float32 of texts x TERMS."""
    n = len(offsets) - 1
    start, end, first = words(data, offsets)
    if not len(start):
        return np.zeros((n, TERMS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(first))
    h = range_hashes(lower(data), start, end)
    is_upper = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91))])
    ups = is_upper[end] - is_upper[start]
    size = end - start
    # shape: first and last byte's class, how much is upper case, length
    case = np.where(ups == 0, 0, np.where(ups == 1, 1, np.where(ups * 2 > size, 2, 3)))
    key = ((_CLASS[data[start]] * 40 + _CLASS[data[end - 1]]) * 4 + case) * 8 + np.minimum(size // 3, 7)
    shape = (key.astype(U64) * U64(0x9E3779B185EBCA87) >> U64(40)).astype(np.int64) % _SHAPES
    word = (h >> U64(20)).astype(np.int64) % _WORDS
    # repeats: equal to the word one, two or three before
    repeat = np.full(len(h), 0)
    for back in (3, 2, 1):
        if len(h) > back:
            same = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
            repeat[back:][same] = back
    flat = [doc * TERMS + word, doc * TERMS + _WORDS + shape, (doc * TERMS + _WORDS + _SHAPES + repeat)[repeat > 0]]
    out = np.bincount(np.concatenate(flat), minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    # share of words that are new within their block of 64 words, in sixteenths; blocks make long
    # texts comparable with short ones
    block = (np.arange(len(h)) - first[doc]) // 64 + doc * (int(np.diff(first).max()) // 64 + 1)
    order = np.lexsort((h, block))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (block[order][1:] != block[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n)
    total = np.diff(first)
    some = np.flatnonzero(total)  # a text without words has no terms
    out[some, _WORDS + _SHAPES + 8 + np.minimum(distinct[some] * 16 // total[some], 16)] += total[some]
    return out


class Model:
    """What is broadcast: idf-weighted projection, labelled vectors, labels and the prior."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 5):
        rows = [np.zeros((0, TERMS), np.float32)]
        for s in range(0, len(texts), 64):
            data, off, _ = utf8(pa.array(texts[s : s + 64], pa.string()))
            rows.append(term_counts(data, off))
        self._learn(np.vstack(rows), labels, seed)

    @classmethod
    def of_counts(cls, counts: np.ndarray, labels: list[int], seed: int = 5) -> Model:
        """The same from counts of terms, a row for each labelled text."""
        model = cls.__new__(cls)
        model._learn(counts, labels, seed)
        return model

    def _learn(self, counts: np.ndarray, labels: list[int], seed: int) -> None:
        self.y = np.array(labels, np.float32)
        self.prior = float(self.y.mean()) if len(self.y) else 0.5
        if not len(self.y):
            self.project, self.v = np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32)
            return
        x = np.vstack([self._scale(counts[s : s + 256]) for s in range(0, len(counts), 256)])
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        x *= self.idf
        # randomised subspace iteration for the leading right singular vectors
        rng = np.random.default_rng(seed)
        q = rng.standard_normal((TERMS, min(DIMS + 16, TERMS))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
        keep = int(min(DIMS, (s > 1e-4 * max(s[0], 1e-9)).sum() or 1))
        self.project = np.ascontiguousarray(((q @ vt.T[:, :keep]).T * self.idf).T.astype(np.float32))
        self.v = self._unit((x / self.idf) @ self.project)

    @staticmethod
    def _scale(counts: np.ndarray) -> np.ndarray:
        """Log rates of terms (in 300 words), of unit length: a long text is like a short one."""
        x = np.log1p(counts * (300 / np.maximum(counts[:, :_WORDS].sum(axis=1, keepdims=True), 1)))
        x[:, :_WORDS] *= WORD_WEIGHT
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among each text's nearest labelled vectors (of
        equally near ones those that come first in the sample: by doc_id, then hash of the text); the prior
        for texts without words."""
        n = len(offsets) - 1
        if not len(self.v):
            return np.full(n, self.prior)
        counts = term_counts(data, offsets)
        sims = self._unit(self._scale(counts) @ self.project) @ self.v.T  # one exact block
        k = min(NEIGHBOURS, len(self.v))
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(sims, top, axis=1).min(axis=1)
        for r in np.flatnonzero((sims >= least[:, None]).sum(axis=1) > k):  # ties: those of first number
            top[r] = np.lexsort((np.arange(sims.shape[1]), -sims[r]))[:k]
        w = np.maximum(np.take_along_axis(sims, top, axis=1), 0) ** 2 + 1e-6
        out = (w * self.y[top]).sum(axis=1) / w.sum(axis=1)
        return np.where(counts.any(axis=1), np.clip(out, 0, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fits on at most max_train labelled rows for which ``allowed`` (a condition on doc_id)
    holds: those of least hash of doc_id. Their whole texts are counted on the executors; what
    comes to the driver is a row of at most TERMS counts for each, max_train rows in all. Null labels
    and texts are left out; of one doc_id with several labels the largest holds, with several rows
    the text of least hash."""
    marked = labels.where(allowed).where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "y", "text")
    least = rows.groupBy("doc_id").agg(F.min("h").alias("h"))  # as many rows as ``some`` at most
    rows = rows.join(F.broadcast(least), ["doc_id", "h"], "left_semi").select("doc_id", "h", "y", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(BATCH_BYTES)(it):
            data, off, _ = utf8(b.column(3))
            for s in range(0, b.num_rows, 256):
                e = min(s + 256, b.num_rows)
                x = term_counts(data[off[s] : off[e]], off[s : e + 1] - off[s])
                at = [np.flatnonzero(r) for r in x]
                packed = [pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([r[i].astype("<f4").tobytes() for r, i in zip(x, at, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(s, e - s) for c in b.columns[:3]), *packed], ["doc_id", "h", "y", "terms", "counts"])

    got = rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, y {rows.schema['y'].dataType.simpleString()}, terms binary, counts binary").dropDuplicates(["doc_id", "h"]).collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["h"]))[:max_train]
    counts = np.zeros((len(got), TERMS), np.float32)
    for x, r in zip(counts, got, strict=True):
        x[np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    return Model.of_counts(counts, [int(r["y"]) for r in got])


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from the threshold
    on), or columns of other names. A null text counts as empty, which gets the prior; columns with
    these names give way; repeated rows stay. Without labelled rows every score is 0.5."""
    df = without(df, score, predicted)
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(BATCH_BYTES, text)(it):
            i = b.schema.get_field_index(text)
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                data, off, _ = utf8(part.column(i))
                found = m.score(data, off).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], [*b.schema.names, score, predicted])

    return df.mapInArrow(lean(run), schema)
