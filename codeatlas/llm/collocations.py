"""Collocations: phrases of two to five words that occur far more often than their parts would by chance.

A shard (a few MB of text within a task) is read into a generalised suffix automaton over words, bounded
in depth. It is built as the tree of its suffix links, level by level in numpy: level k numbers the
k-word phrases by the word sequence that ends at each place, so a phrase's link leads to itself without
its first word, and its number of end positions (endpos) is a count of places. A phrase and a longer one
that ends with it share a state where their endpos counts are equal: a state is written as its longest
phrase and the lengths it stands for, and JVM-side each length becomes a row (phrase, count). Rows are
summed over all shards by phrase text, so counts are exact whatever the shards were.

Two passes keep the shuffle small and lose nothing. The first has depth two. The pairs that reach the
least count mark a table of bits of bounded size; the second pass cuts texts between words whose pair
isn't marked (no phrase over such a place can reach the least count) and counts three words and more in
what is left. A full table would cut less, never more.

A phrase in a longer one of equal count is also in one that is longer by one word, of equal count: so a
phrase is dropped where the link of a candidate, or the candidate without its last word, has the same
count. That is a join on (lang, phrase, count), without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import U64, arrow_rows, batches, binaries, cut, drop, lean, lower, mix, range_hashes, slices, utf8, words

LEAST, DEPTH, TOP = 100, 5, 2000
UND = "und"
BATCH_BYTES = 1 << 20  # of text in a shard
ROWS = 500  # of an Arrow batch of texts
#: Of the table of frequent pairs: at most 2**25 bits, 4 MB.
MARK_BITS = 25
SALTS = 16  # parts of a language that are ranked for themselves first

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_SPACE = _BREAK.copy()
_SPACE[[9, 32]] = True


class Shard:
    """The words of some texts, one after another with one space behind each, and their pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray):
        low = lower(data)
        start, end, first = words(low, offsets, _SPACE)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        broken = np.concatenate([[0], np.cumsum(_BREAK[low])])[start]
        self.fresh = np.ones(len(start), bool)  # where a piece begins
        self.fresh[1:] = (broken[1:] != broken[:-1]) | (doc[1:] != doc[:-1])
        self.lang = lang[doc] if len(doc) else doc
        # the byte after a word is a space, a break or the next text's: it is overwritten
        wide = np.append(low, np.uint8(32))
        size = end - start + 1
        self.data, self.off = slices(wide, start, end + 1)
        self.data[self.off[1:] - 1] = 32
        self.size = size
        self.id = np.asarray(binaries(self.data, self.off).dictionary_encode().indices, np.int64) if len(start) else start

    def pairs(self, lang_hash: np.ndarray) -> np.ndarray:
        """A hash of language and text of the two words that end at each place but the first."""
        n = len(self.id)
        return mix(range_hashes(self.data, self.off[: n - 1], self.off[2:] - 1) ^ lang_hash[self.lang[1:]]) if n > 1 else np.zeros(0, U64)

    def states(self, depth: int, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """The automaton's states by the length of their longest phrase: (last word's place of one
        occurrence, longest, shortest, endpos count). Within the pieces that begin at ``fresh``."""
        n = len(self.id)
        begin = np.flatnonzero(fresh)
        room = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n))) + 1  # words of the piece up to here
        at = np.arange(n)
        key = self.lang.astype(np.int64) << 32 | self.id
        # the level below: each place's node, and for each node a place, its count, the shortest length of its state
        node = place = count = low = None
        for k in range(1, depth + 1):
            if k > 1:
                some = room[at] >= k
                parent, at = node[some], at[some]
                key = parent << 32 | self.id[at - k + 1]
            _, first, up = np.unique(key, return_index=True, return_inverse=True)
            c = np.bincount(up, minlength=len(first))
            shortest = np.full(len(first), k)
            if k > 1:
                mine = parent[first]  # a node's suffix link
                same = c == count[mine]  # all its places are this one's: one state
                shortest[same] = low[mine[same]]
                merged = np.zeros(len(place), bool)
                merged[mine[same]] = True
                yield place[~merged], k - 1, low[~merged], count[~merged]
            node, place, count, low = up, at[first], c, shortest
            if not len(at):
                return
        yield place, depth, low, count


def _langs(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.cast(pa.string()).fill_null(UND).dictionary_encode()
    return np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()


def _hashes(values: list[str]) -> np.ndarray:
    data, off, _ = utf8(pa.array(values, pa.string()))
    return range_hashes(data, off[:-1], off[1:])


_STATES = "lang string, longest int, shortest int, phrase string, c long"


def _rows(shard: Shard, langs: list[str], depth: int, fresh: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    for place, longest, shortest, count in shard.states(depth, fresh):
        if longest < least or not len(place):
            continue
        data, off = slices(shard.data, shard.off[place - longest + 1], shard.off[place + 1] - 1)
        lang = pa.DictionaryArray.from_arrays(pa.array(shard.lang[place].astype(np.int32)), pa.array(langs, pa.string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(place), longest, np.int32)), pa.array(np.maximum(shortest, least).astype(np.int32)), binaries(data, off, pa.string()), pa.array(count)], ["lang", "longest", "shortest", "phrase", "c"])


def _shards(it: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[tuple[Shard, list[str]]]:
    for b in batches(batch_bytes)(it):
        lang, langs = _langs(b.column(0))
        data, off, _ = utf8(b.column(1))
        shard = Shard(data, off, lang)
        if len(shard.id):
            yield shard, langs


def _summed(states: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f) of phrases with f occurrences, at least so many, from the states' rows: each
    of a state's lengths is its longest phrase without some first words."""
    each = states.select("lang", "phrase", "c", "longest", F.explode(F.sequence("shortest", "longest")).alias("k"))
    tail = F.when(F.col("k") == F.col("longest"), F.col("phrase")).otherwise(F.substring_index("phrase", " ", -1))
    for k in range(2, DEPTH):  # substring_index takes a constant
        tail = F.when((F.col("k") == k) & (F.col("longest") > k), F.substring_index("phrase", " ", -k)).otherwise(tail)
    return each.select("lang", tail.alias("phrase"), "k", "c").groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.sum("c").alias("f")).where(F.col("f") >= least)


def phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to five words that occur ``least`` times or more in a language, as (lang, phrase,
    k words, f), and each language's number of words, as (lang, n). Two written tables."""
    docs = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("text is not null")
    spark = docs.sparkSession

    def short(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, langs in _shards(it, batch_bytes):
            yield from _rows(shard, langs, 2, shard.fresh, 1)
            n = np.bincount(shard.lang, minlength=len(langs))
            zero = pa.array(np.zeros(len(langs), np.int32))  # a row without a phrase: the number of words
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), zero, zero, pa.array([""] * len(langs), pa.string()), pa.array(n)], ["lang", "longest", "shortest", "phrase", "c"])

    with arrow_rows(spark, ROWS):
        few = cut(_summed(docs.mapInArrow(lean(short), _STATES), 1).where((F.col("f") >= least) | (F.col("k") == 0)), "phrases")
    totals = cut(few.where("k = 0").select("lang", F.col("f").alias("n")), "words")
    # the frequent pairs, as bits
    pairs = few.where("k = 2")
    m = pairs.count()
    bits = min(MARK_BITS, max(16, (32 * m).bit_length()))

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off, _ = utf8(b.column(1))
            code, langs = _langs(b.column(0))
            h = mix(range_hashes(data, off[:-1], off[1:]) ^ _hashes(langs)[code]) >> U64(64 - bits)
            word = (h >> U64(6)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((U64(1) << (h & U64(63))).view(np.int64))], ["w", "b"])

    marks = pairs.select("lang", "phrase").mapInArrow(lean(places), "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[marks["w"].to_numpy()] = marks["b"].to_numpy()  # at most 2**19 rows
    shared = spark.sparkContext.broadcast(table.view(U64))

    def long(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for shard, langs in _shards(it, batch_bytes):
            h = shard.pairs(_hashes(langs)) >> U64(64 - bits)
            fresh = shard.fresh.copy()
            fresh[1:] |= (t[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 0
            yield from _rows(shard, langs, DEPTH, fresh, 3)

    with arrow_rows(spark, ROWS):
        more = cut(_summed(docs.mapInArrow(lean(long), _STATES), least), "phrases")
    both = cut(few.where("k > 0").unionByName(more), "phrases")
    shared.destroy()
    drop(few, more)
    return both, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first ``top`` phrases by score, then
    a, descending, then phrase.

    A-Z are lower-cased, texts are cut at ``.,;:!?`` and line ends, words at spaces and tabs. a is a
    phrase's number of occurrences within pieces, n the language's number of words; l and r are those
    of the two parts at the cut of least score ``floor(1000 a n / (l r))`` (of equal ones the first).
    Phrases in a longer one (of up to five words) of equal count are left out. A null language is
    ``und``; null and empty texts have no words; repeated rows all count; tables without words give
    an empty table. Arithmetic is exact for counts below 10**15."""
    found, totals = phrases(docs, least, text, lang, batch_bytes)
    at = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    candidates = found.where("k >= 2").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    inner = candidates.where("k >= 3").select("lang", "a", F.explode(F.array(at(2, F.col("k") - 1), at(1, F.col("k") - 1))).alias("phrase")).distinct()
    kept = candidates.join(inner, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cuts = cuts.select("lang", "phrase", "a", "j", at(1, F.col("j")).alias("head"), at(F.col("j") + 1, F.col("k") - F.col("j")).alias("rest"))
    # the looked-up side has each phrase once and is a table: a frequent word's rows may be split
    sizes = found.select("lang", "phrase", "f")
    cuts = cuts.join(sizes.toDF("lang", "head", "l"), ["lang", "head"]).join(sizes.toDF("lang", "rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c: f"cast({c} as decimal(18,0))"
    score = F.expr(f"({exact('1000 * a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "j", "l", "r", "n")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.n", "x.score")
    # the first of each part of a language, then of these the first: no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
