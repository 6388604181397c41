"""Passages that occur more than once: a sparse suffix array over words.

In every run of neighbouring word k-grams the least hash selects a position; only suffixes at
selected positions are kept. A passage of L words holds L - k + 1 k-grams, and its least one
selects the same word in every copy. First the kept suffixes are sorted by their k-gram alone:
where no neighbour is equal, nothing of L words can repeat, and that is most of them. The others
are extended to the left by each possible number of words and to the right up to L words; these
stretches are sorted over all documents (range partitions by hash of the words, then document and
place) and each is compared with its neighbours in that order, those across a partition's border
included. Where a neighbour is equal, the stretch repeats; stretches that overlap join, which
extends a match left and right to its whole length. (Comparing only neighbours in the order of
whole suffixes would lose a passage whose neighbour goes on longer to the right but differs sooner
to the left: so each left extension has a place of its own in the order.)

Words are compared by two hashes of all L of them, 96 bits together: of 10**13 places less than one
pair in a thousand such corpora is taken for equal by mistake. Both are made of the single words'
64-bit hashes, so passages that differ only in two words of equal hash are taken for equal. A passage in a third of all documents is dealt
over many ranges, as document and place are part of the order; no task holds all its places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import P1, P2, P3, U64, batches, cut, drop, lean, lower, mix, powers, range_hashes, utf8, words

WORDS, GRAM = 50, 16
BATCH_BYTES = 2 << 20  # of text hashed at once
_NONE = np.iinfo(np.int64).min  # stands for a null doc_id
MARK_BITS = 25  # of a table that marks k-grams which repeat: 4 MB, whatever the corpus


def _sliding(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, over the texts' borders too."""
    p, inv = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inv[: max(len(h) - k + 1, 0)]) if len(h) >= k else np.zeros(0, U64)


def _windows(data: np.ndarray, offsets: np.ndarray, n_words: int, gram: int):
    """For each place where n_words words of one text begin: the text, the place, the two hashes
    of the words, the hash of the selected k-gram and where it is; and each word's start and end."""
    low = lower(data)
    start, end, first = words(low, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = range_hashes(low, start, end)
    at = np.flatnonzero(np.arange(len(h)) + n_words <= first[1:][doc])
    if not len(at):
        return doc, at, at.view(U64), at.astype(np.int32), at.view(U64), at, start, end, first
    grams = _sliding(h, gram)
    # least by hash, of equal ones the first: the low bits hold the place in the batch
    bits = U64(max(24, len(grams).bit_length()))
    best = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    span = 1
    w = n_words - gram + 1
    while span * 2 <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < w:
        m = len(grams) - w + 1
        best = np.minimum(best[:m], best[w - span : w - span + m])
    chosen = (best[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    more = (_sliding(mix(h ^ P3), n_words)[at] >> U64(32)).astype(np.uint32).view(np.int32)
    return doc, at, _sliding(h * P2, n_words)[at], more, grams[chosen], chosen, start, end, first


def neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's sorted rows (k, l, doc_id, place) those whose k and l are those of the row before or
    after, and the first and the last (border 1, 2, or 3 for both), whose other neighbour is in
    another partition. The last row of a batch is held until the next one comes."""
    part, held, before, first = TaskContext.get().partitionId(), None, False, True

    def told(b: pa.RecordBatch, k: np.ndarray, l: np.ndarray, prev: np.ndarray, nxt: np.ndarray, border: np.ndarray) -> pa.RecordBatch:
        keep = np.flatnonzero(prev | nxt | (border > 0))
        rows = b.take(pa.array(keep))
        inner = border[keep] == 0  # only at borders are the hashes looked at again
        key = [pa.array(k[keep], mask=inner), pa.array(l[keep], mask=inner)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), part, np.int32)), pa.array(border[keep]), *key, rows.column(2), rows.column(3), pa.array(prev[keep]), pa.array(nxt[keep])], _NEAR)

    for b in it:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        k, l = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int32)
        prev, border = np.zeros(len(k), bool), np.zeros(len(k), np.int32)
        prev[1:] = (k[1:] == k[:-1]) & (l[1:] == l[:-1])
        prev[0] = before
        border[0] = int(first)
        if len(k) > 1:
            yield told(b.slice(0, len(k) - 1), k[:-1], l[:-1], prev[:-1], prev[1:], border[:-1])
            first = False
        held, before = b.slice(len(k) - 1), bool(prev[-1])
    if held is not None:
        k, l = np.asarray(held.column(0), np.int64), np.asarray(held.column(1), np.int32)
        yield told(held, k, l, np.array([before]), np.array([False]), np.array([2 + first], np.int32))


_NEAR = ["part", "border", "k", "l", "doc_id", "place", "before", "after"]


def repeated(docs: DataFrame, n_words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_char, end_char, first) of each stretch of a text that is covered by
    overlapping runs of n_words words each of which occurs at another place too, in this document
    or another. first is true where none of them occurs in a document of lesser doc_id or sooner
    in this one.

    Words are runs other than ASCII white space, A-Z lower-cased. Characters are code points, end
    exclusive. Null, empty and short texts have none; documents without repeats have no row;
    repeated rows repeat each other. An empty table gives an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(BATCH_BYTES)(it):
            data, off, _ = utf8(b.column(0))
            _, at, _, _, best, chosen, *_ = _windows(data, off, n_words, gram)
            fresh = np.ones(len(at), bool)  # each selected position once
            fresh[1:] = chosen[1:] != chosen[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(mix(best[fresh] * P1).view(np.int64))], ["g"])

    # k-grams at two or more selected positions, as bits: rows by key, then one row for each word of bits
    twice = docs.select("text").mapInArrow(lean(kept), "g long").groupBy("g").count().where("count > 1")
    word, bit = F.shiftrightunsigned("g", 64 - MARK_BITS + 6), F.shiftrightunsigned("g", 64 - MARK_BITS).bitwiseAND(F.lit(63)).cast("int")
    marks = twice.select(word.cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (MARK_BITS - 6), np.int64)
    table[marks["w"].to_numpy()] = marks["b"].to_numpy()  # at most 2**19 rows
    shared = docs.sparkSession.sparkContext.broadcast(table.view(U64))

    def extended(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches(BATCH_BYTES)(it):
            data, off, _ = utf8(b.column(1))
            doc, at, full, more, best, _, start, end, _ = _windows(data, off, n_words, gram)
            i = mix(best * P1) >> U64(64 - MARK_BITS)  # mixed anew: the least hashes share their first bits
            some = (t[(i >> U64(6)).astype(np.int64)] >> (i & U64(63))) & U64(1) == 1
            at, full, more = at[some], full[some], more[some]
            of = doc[at]
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            begin = chars[start[at]]
            place = (begin - chars[off[of]]) << 32 | (chars[end[at + n_words - 1]] - begin)  # start and length
            yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(more), b.column(0).take(pa.array(of)), pa.array(place)], ["k", "l", "doc_id", "place"])

    found = cut(docs.mapInArrow(lean(extended), "k long, l int, doc_id long, place long"), "suffixes")
    shared.destroy()
    ordered = found.repartitionByRange("k", "l", "doc_id", "place").sortWithinPartitions("k", "l", "doc_id", "place")
    same = cut(ordered.mapInArrow(lean(neighbours), "part int, border int, k long, l int, doc_id long, place long, before boolean, after boolean"), "neighbours")
    drop(found)
    # what meets at the borders of partitions: two rows for each
    ends: dict[int, dict[int, tuple[int, int]]] = {}
    for r in same.where("border > 0").select("part", "border", "k", "l").collect():
        for side in (1, 2):
            if r["border"] & side:
                ends.setdefault(r["part"], {})[side] = (r["k"], r["l"])
    parts = sorted(ends)
    met = [q for p, q in zip(parts, parts[1:], strict=False) if ends[p][2] == ends[q][1]]  # q's first row equals the last one before it
    last = [p for p, q in zip(parts, parts[1:], strict=False) if ends[p][2] == ends[q][1]]
    at = lambda ps, side: (F.col("border").bitwiseAND(side) > 0) & F.col("part").isin(ps) if ps else F.lit(False)
    same = same.withColumn("before", F.col("before") | at(met, 1)).withColumn("after", F.col("after") | at(last, 2)).where("before or after")
    places = same.select("doc_id", "place", (~F.col("before")).cast("long").alias("c"))
    places = places.repartition("doc_id").sortWithinPartitions("doc_id", "place")

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the stretch that the next batch may go on with
        for b in it:
            doc = np.asarray(b.column(0).fill_null(_NONE))
            place, c = (np.asarray(b.column(i), np.int64) for i in (1, 2))
            begin = place >> 32
            rows = np.hstack([held, np.vstack([doc, begin, begin + (place & 0xFFFFFFFF), c])])
            if not rows.shape[1]:
                continue
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] >= rows[2, :-1])
            s = np.flatnonzero(new)
            e = np.append(s[1:], rows.shape[1]) - 1
            out = np.vstack([rows[0, s], rows[1, s], rows[2, e], np.minimum.reduceat(rows[3], s)])
            held = out[:, -1:]
            yield _spans(out[:, :-1])
        yield _spans(held)

    def _spans(x: np.ndarray) -> pa.RecordBatch:
        ids = pa.array(x[0], pa.int64(), mask=x[0] == _NONE)
        return pa.RecordBatch.from_arrays([ids, pa.array(x[1]), pa.array(x[2]), pa.array(x[3] == 1)], ["doc_id", "start_char", "end_char", "first"])

    return places.mapInArrow(lean(joined), "doc_id long, start_char long, end_char long, first boolean")
