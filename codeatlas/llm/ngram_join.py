"""Documents whose sets of word n-grams are alike: a grouped prefix join.

The n-grams of a set are put in one global order, rare ones first. Two sets of Jaccard similarity
t or more share one of their first n - ceil(t n) + 1. Documents with equal sets are one unit;
units with equal prefixes and sizes are one group and are indexed once. Units that are linked by
shared prefix n-grams form candidate clusters (most documents are in none); only for these are
whole sets made. In a cluster, group pairs are filtered by size and by how much of their prefixes
they share, and the pairs that are left expand into members that are verified exactly. A cluster
with more n-grams than a task should hold is cut into blocks, and each pair of blocks is a task.

Order: n-grams are counted in 2**16 buckets by hash, over all documents; the order is by the
bucket's count, then by hash. N-grams that then turn out to be in the prefixes of many groups go
to the end, and prefixes are made anew. Any order gives the right result; this one keeps frequent n-grams
out of prefixes. N-grams and sets are known by 64-bit hashes: collisions (of two n-grams in one pair
of sets, or of two sets in the corpus) are the only source of error.

Tables that a join meets with a hot key on one side (a set that many documents have, an n-gram
in many prefixes, a large cluster) are written first, so that Spark's skew join may split it: a
join above an aggregate of the same stage is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import P1, U64, arrow_rows, batches, cut, drop, lean, lower, mix, range_hashes, utf8, words
from codeatlas.llm.components import connected_components

BUCKET_BITS = 16
LATE, MAX_LATE = 16, 1 << 17  # n-grams in the prefixes of more than LATE sets go to the end of the order; so many of them are broadcast
COLD = 64  # n-grams in at most so many groups pair them one by one
BLOCK_GRAMS = 1_000_000
BATCH_BYTES = 1 << 20  # of text hashed at once; the arrays made of it take some hundred bytes a word
_NONE = -(1 << 63)  # stands for a null doc_id
MARK_WORDS = 1 << 16  # of 64 bits, of the mark that spares documents in no cluster


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's k-word sequences, ascending, and where each text's begin.
    A text with fewer words has its whole sequence as the only one."""
    low = lower(data)
    start, end, first = words(low, offsets)
    n = len(offsets) - 1
    h = range_hashes(low, start, end)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    grams, owner = [], []
    for size in range(1, k + 1):  # shorter sequences are of texts that have just so many words
        at = np.flatnonzero(np.arange(len(h)) <= (first[1:] - size)[doc]) if size == k else first[:-1][count == size]
        if len(at):
            g = h[at].copy()
            for j in range(1, size):
                g = mix(g * P1 + h[at + j])
            grams.append(g + U64(size))
            owner.append(doc[at])
    if not grams:
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    g, d = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
    g, d = g[fresh], d[fresh]
    return g, np.searchsorted(d, np.arange(n + 1))


def _counts(docs: DataFrame, k: int) -> np.ndarray:
    """N-grams in each bucket, over all documents. At most 2**16 rows a task and to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches(BATCH_BYTES)(it):
            data, off, _ = utf8(b.column(b.schema.get_field_index("text")))
            g, _ = gram_sets(data, off, k)
            total += np.bincount((g >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    with arrow_rows(docs.sparkSession, 1000):
        rows = docs.select("text").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def least_linked(num: int, den: int) -> int:
    """The size below which two different sets can't be so alike."""
    return -(-num // (den - num)) if num < den else 1 << 62


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n >= least_linked(num, den), n - -(-n * num // den) + 1, 0)


class Order:
    """The global order of n-grams: those known to be in many groups last, then by bucket and hash."""

    def __init__(self, rank: np.ndarray, late: np.ndarray):
        self.rank, self.late = rank, np.sort(late)

    def sorted(self, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Indices that put each owner's n-grams in order."""
        rank = self.rank[(grams >> U64(64 - BUCKET_BITS)).astype(np.int64)]
        if len(self.late):
            at = np.minimum(np.searchsorted(self.late, grams), len(self.late) - 1)
            rank = rank + (self.late[at] == grams) * np.int32(1 << BUCKET_BITS)
        return np.lexsort((grams, rank, owner))


def set_key(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    sums = []
    for m in (g * P1, g ^ U64(0x5851F42D4C957F2D)):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(m))])
        sums.append(total[first[1:]] - total[first[:-1]])
    return mix(sums[0] ^ mix(sums[1] + np.diff(first).astype(U64) * P1)).view(np.int64)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, first_of: Order) -> DataFrame:
    """(doc_id, h, n, w, prefix), written: h is the text's hash, w the set's."""
    shared = docs.sparkSession.sparkContext.broadcast(first_of)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches(BATCH_BYTES)(it):
            data, off, _ = utf8(b.column(2))
            g, first = gram_sets(data, off, k)
            n = np.diff(first)
            p = prefix_size(n, num, den)
            d = np.repeat(np.arange(len(n)), n)
            order = r.sorted(g, d)
            keep = np.arange(len(g)) - first[:-1][d] < p[d]
            flat = pa.array(g[order][keep].view(np.int64))
            ends = np.concatenate([[0], np.cumsum(p)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(set_key(g, first)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "h", "n", "w", "prefix"])

    made = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(run), "doc_id long, h long, n long, w long, prefix array<long>")
    with arrow_rows(docs.sparkSession, 1000):  # rows hold whole texts
        out = cut(made, "prefixes")
    shared.destroy()
    return out


def _near(token: DataFrame, num: int, den: int, cold: int = COLD) -> DataFrame:
    """(a, b) of groups that may hold a linked pair, from the rows (g, n, p, t) of their prefixes;
    each such pair is at least connected by these edges.

    N-grams in few groups (at most ``cold``) give pairs, which must be of like size and share enough: what both
    prefixes have in common (of n-grams in many groups no more than the fewer of the two have)
    and the sets' rests must reach the overlap that a link needs. N-grams in many groups connect
    each group with one of them."""
    count = cut(token.groupBy("t").agg(F.min("g").alias("v"), F.count("*").alias("c")).where("c > 1"), "counts")
    token = cut(token.join(count, "t"), "tokens")
    drop(count)
    hot = token.where(F.col("c") > cold)
    many = hot.groupBy("g").agg(F.count("*").alias("h"))
    few = token.where(F.col("c") <= cold).select("t", "g", "n", "p")
    # at most ``cold`` groups meet in a row; each group's partners are those after it, of like size
    met = few.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("g", "n", "p"))).alias("m")).select("m", F.posexplode("m").alias("i", "a"))
    like = lambda b: (F.col("a.n") * den >= b["n"] * num) & (b["n"] * den >= F.col("a.n") * num)
    met = met.select("a", F.explode(F.filter(F.slice("m", F.col("i") + 2, F.size("m")), like)).alias("b"))
    pairs = met.select(*(F.col(f"{x}.{c}").alias(f"{x}{c}") for x in "ab" for c in ("g", "n", "p")))
    pairs = pairs.groupBy("ag", "bg", "an", "bn", "ap", "bp").agg(F.count("*").alias("common"))
    pairs = pairs.join(many.select(F.col("g").alias("ag"), F.col("h").alias("ah")), "ag", "left").join(many.select(F.col("g").alias("bg"), F.col("h").alias("bh")), "bg", "left")
    pairs = pairs.where(f"(common + least(coalesce(ah, 0), coalesce(bh, 0)) + greatest(an - ap, bn - bp)) * {num + den} >= (an + bn) * {num}")
    return pairs.select(F.col("ag").alias("a"), F.col("bg").alias("b")).unionByName(hot.where("g <> v").select(F.col("g").alias("a"), F.col("v").alias("b")))


def _sets(docs: DataFrame, ids: DataFrame, k: int, first_of: Order, num: int, den: int) -> tuple[DataFrame, object]:
    """(w, grams, prefix) as packed 64-bit numbers, of the sets in ids (columns w, and u, a document
    that has it). A bit table of bounded size marks documents, so that other documents' sets aren't
    made; the join is exact. Also the broadcast to be freed when the rows are written."""
    word, bit = F.pmod(F.xxhash64("u"), F.lit(MARK_WORDS)), F.pmod(F.xxhash64("u", F.lit(7)), F.lit(64)).cast("int")
    mark = ids.select(word.alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("_w").agg(F.bit_or("b").alias("_b"))
    some = docs.select(F.coalesce("doc_id", F.lit(_NONE)).alias("u"), "text").withColumn("_w", word).join(F.broadcast(mark), "_w").where(F.call_function("getbit", "_b", bit) == 1).select("u", "text")
    shared = docs.sparkSession.sparkContext.broadcast(first_of)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches(BATCH_BYTES)(it):
            data, off, _ = utf8(b.column(1))
            g, first = gram_sets(data, off, k)
            n = np.diff(first)
            p = prefix_size(n, num, den)
            d = np.repeat(np.arange(len(n)), n)
            order = r.sorted(g, d)
            head = g[order]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(set_key(g, first)), pa.array([g[x:y].tobytes() for x, y in zip(first, first[1:])], pa.binary()), pa.array([head[x : x + q].tobytes() for x, q in zip(first, p)], pa.binary())], ["u", "w", "grams", "prefix"])

    # by both: the documents of a hot set are dealt apart, and only its chosen one is left
    made = some.mapInArrow(lean(run), "u long, w long, grams binary, prefix binary").join(ids, ["w", "u"], "left_semi")
    return made.dropDuplicates(["w", "u"]).drop("u"), shared


def join_block(n: np.ndarray, sets: list[np.ndarray], prefixes: list[bytes], weight: np.ndarray, side: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit of a block the least index it is linked with so far (a forest), and the
    weight of the units that it is linked with. side: 0 or 1; if given, only pairs of both sides."""
    m = len(n)
    root, links = np.arange(m), np.zeros(m, np.int64)
    sizes = np.array([len(s) for s in sets])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [dense[e - s : e] for s, e in zip(sizes, ends, strict=True)]
    flag = np.zeros(int(dense.max()) + 1, np.int8)
    # groups of equal size and prefix, smallest sizes first
    group: dict[tuple[int, bytes], list[int]] = {}
    for i in range(m):
        group.setdefault((int(n[i]), prefixes[i]), []).append(i)
    keys = sorted(group)
    members = [np.array(group[key]) for key in keys]
    gn = np.array([key[0] for key in keys])
    tokens = [np.frombuffer(key[1], U64) for key in keys]
    gp = np.array([len(t) for t in tokens])
    flat, post = np.concatenate(tokens), np.repeat(np.arange(len(keys)), gp)
    order = np.lexsort((post, flat))
    flat, post = flat[order], post[order]
    for g, t in enumerate(tokens):
        lo, hi = np.searchsorted(flat, t, "left"), np.searchsorted(flat, t, "right")
        near = np.concatenate([post[a:b] for a, b in zip(lo, hi, strict=True)])
        near = near[near <= g]
        other, common = np.unique(near, return_counts=True)
        # |x and y| den >= num |x or y|, so |x and y| >= num (|x| + |y|) / (num + den)
        need = -(-(gn[g] + gn[other]) * num // (num + den))
        rest = np.maximum(gn[g] - gp[g], gn[other] - gp[other])
        other = other[(gn[other] * den >= gn[g] * num) & (common + rest >= need)]
        pool = np.concatenate([members[o] for o in other])  # with the group itself
        before = np.concatenate([np.full(len(members[o]), o) for o in other]) < g
        for a in members[g]:
            b = pool[before | (pool < a)]
            if side is not None:
                b = b[side[b] != side[a]]
            if not len(b):
                continue
            flag[own[a]] = 1
            size = sizes[b]
            hit = flag[np.concatenate([own[x] for x in b])]
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
            flag[own[a]] = 0
            b = b[both * den >= num * (sizes[a] + size - both)]
            links[a] += weight[b].sum()
            links[b] += weight[a]
            for r in np.unique(root[b]):
                low, high = min(r, root[a]), max(r, root[a])
                if low != high:
                    root[root == high] = low
    return root, links


def _linked(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, links) of the rows (key, side, w, n, copies, grams, prefix) of each key; u and v are sets."""

    def done(part: list[tuple]) -> pa.RecordBatch:
        u = np.array([r[2] for r in part], np.int64)
        order = np.argsort(u, kind="stable")
        part, u = [part[i] for i in order], u[order]
        side = np.array([r[1] for r in part])
        root, links = join_block(np.array([r[3] for r in part]), [np.frombuffer(r[5], U64) for r in part], [r[6] for r in part], np.array([r[4] for r in part]), side if (side > 0).any() else None, num, den)
        some = (root != np.arange(len(u))) | (links > 0)
        return pa.RecordBatch.from_arrays([pa.array(u[some]), pa.array(u[root[some]]), pa.array(links[some])], ["u", "v", "links"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, []
        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != key:
                    if len(part) > 1:
                        yield done(part)
                    key, part = row[0], []
                part.append(row)
        if len(part) > 1:
            yield done(part)

    return rows.mapInArrow(lean(run), "u long, v long, links long")


def _classes(base: DataFrame) -> DataFrame:
    """(w, n, u, copies) of each set, written: u is the least document that has it."""
    return cut(base.where("n > 0").groupBy("w", "n").agg(F.min("doc_id").alias("u"), F.count("*").alias("copies")), "classes")


def _units(base: DataFrame, classes: DataFrame) -> DataFrame:
    """(p, n, w, prefix) of the sets that may link with others, once each."""
    chosen = classes.select("w", F.col("u").alias("doc_id"))
    # by both: the documents of a hot set are dealt apart
    same = (base["w"] == chosen["w"]) & base["doc_id"].eqNullSafe(chosen["doc_id"])
    units = base.where(F.size("prefix") > 0).join(chosen, same, "left_semi").dropDuplicates(["w", "doc_id"])
    return units.select(F.xxhash64("prefix").alias("p"), "n", "w", "prefix")


def similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, text_key, component_key) of (doc_id, text), a row for each.

    Two documents link when den * |x and y| >= num * |x or y| for their sets of k-word sequences
    (words: runs other than ASCII white space, A-Z lower-cased; a text of fewer words is one
    sequence). component_id is the least doc_id reachable by links, n_links the number of other
    documents linked with. text_key is xxhash64 of the text; component_key is the same for rows of
    one component and for no others, but for rows without a sequence, where it is null.

    Null and empty texts and such without words have no sequence and link with nothing. Equal texts
    are linked, each counts. Each row counts on its own: repeated rows are equal documents, and rows
    of one doc_id with unlike texts are two documents (text_key tells them apart). Where all rows of
    a component have a null doc_id, so is component_id. An empty table gives an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = _counts(docs, k)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    first_of = Order(rank, np.zeros(0, U64))
    base = _prefixes(docs, k, num, den, first_of)
    classes = _classes(base)
    many = _units(base, classes).select(F.explode("prefix").alias("t")).groupBy("t").count().where(F.col("count") > LATE)
    late = many.orderBy(F.desc("count"), "t").limit(MAX_LATE).toPandas()["t"].to_numpy(np.int64).view(U64)
    del many
    if len(late):  # any order is right; the better one needs the prefixes anew
        first_of = Order(rank, late)
        drop(base)
        base = _prefixes(docs, k, num, den, first_of)

    units = cut(_units(base, classes), "units")
    group = cut(units.groupBy("p", "n").agg(F.min("w").alias("g")), "groups")
    member = cut(units.join(group, ["p", "n"]), "members")  # g is the least set of the group
    drop(units, group)
    near = _near(member.where("w = g").select("g", "n", F.size("prefix").alias("p"), F.explode("prefix").alias("t")), num, den)
    cluster = connected_components(near.unionByName(member.where("w <> g").select(F.col("w").alias("a"), F.col("g").alias("b"))))
    cluster = cluster.unionByName(cluster.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "w")
    cluster = cut(cluster.join(classes, "w"), "clusters")

    size = cut(cluster.groupBy("root").agg(F.sum("n").alias("grams")), "sizes")
    cluster = cluster.join(size, "root").withColumn("blocks", F.ceil(F.col("grams") / block_grams).cast("int"))
    cluster = cluster.withColumn("block", F.pmod(F.xxhash64("w"), F.col("blocks")).cast("int")).drop("grams")
    sets, shared = _sets(docs, cluster.select("w", F.coalesce("u", F.lit(_NONE)).alias("u")), k, first_of, num, den)
    # block i is in the tasks (i, j) for all j of its cluster; most clusters are one block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = sets.join(cluster.drop("u"), "w").select("*", other.alias("j")).select(
        F.xxhash64("root", F.least("block", "j"), F.greatest("block", "j")).alias("key"),
        F.when(F.col("block") == F.col("j"), 0).when(F.col("block") < F.col("j"), 1).otherwise(2).alias("side"),
        "w", "n", "copies", "grams", "prefix",
    )
    with arrow_rows(docs.sparkSession, 128):  # rows hold whole sets
        found = cut(_linked(cells.repartition("key").sortWithinPartitions("key"), num, den), "links")
    shared.destroy()
    drop(member, size)
    comp = connected_components(found.select(F.col("u").alias("a"), F.col("v").alias("b")))
    comp = cut(comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "w").join(classes.select("w", "u"), "w"), "components")
    least = cut(comp.groupBy("root").agg(F.min("u").alias("least")), "least")
    comp = comp.join(least, "root").select("w", "root", "least")
    links = found.groupBy("u").agg(F.sum("links").alias("near")).withColumnRenamed("u", "w")
    classes = cut(classes.join(comp, "w", "left").join(links, "w", "left").select("w", F.coalesce("least", "u").alias("component_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "w").alias("component_key")), "result")

    out = base.where("n > 0").select("doc_id", "n", "w", "h").join(classes, "w").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", F.col("h").alias("text_key"), "component_key")
    none = base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("h").alias("text_key"), F.lit(None).cast("long").alias("component_key"))
    return out.unionByName(none)
