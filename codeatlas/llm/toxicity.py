"""Toxicity of disguised text: a noisy channel restores words, then the restored text is scored.

Words written with digits and signs for letters (``1d10t``), with letters repeated (``stuuupid``) or with
letters set apart (``l o s e r``, ``l.o.s.e.r``) become lattices. A step of a lattice is a run of one sign;
its choices are what may have been meant: a letter, a doubled one, the sign itself, the end of a word.
Viterbi picks the way through it that a character language model (trigrams counted over all texts of the
corpus, on the executors) and the channel's costs make likeliest. Every other word stays as it is.

Restored texts are scored by terms, words and beginnings of words, that tell labels apart. A term's support is the number of distinct
contexts (word before and word after) of its first places in documents, so neither one long document nor
a family of near copies counts more than once. Terms whose share of toxic
contexts is above one half for certain make a lexicon of at most MAX_WORDS; a logistic curve, fitted on the
labelled sample, turns the sum of a text's lexicon weights (one for each distinct word) into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import U64, batches, binaries, cut, drop, lean, lower, mix, range_hashes, slices, utf8, without, words

#: Bounds of the labelled sample, in rows, of the terms that may tell, and of the lexicon.
MAX_TRAIN, MAX_CANDIDATES, MAX_WORDS = 8000, 50_000, 2000
#: A word's terms are itself and its beginnings of so many bytes.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.7
BATCH_BYTES = 1 << 20
SURE = 3.0  # standard errors by which a word's toxic share must be above one half

# -- symbols of the language model: 0 border, 1 to 26 letters, 27 any byte beyond ASCII -----------
N = 28
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
_APART = [ord(c) for c in "._*-"]  # set letters apart within a word
#: Channel costs, in nats: a sign for a letter, a run of three signs or more for one, a digit, a dollar or at
#: sign and other punctuation as itself, a double letter made single, a longer run made single or double.
FOR_LETTER, RUN_FOR_LETTER, DIGIT, MONEY, MARK, COLLAPSE_TWO, COLLAPSE = 0.7, 8.0, 6.0, 4.0, 1.0, 2.5, 0.5
K = 6  # choices of a step at most
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[ord(c) for c in LEET]] = True
_IN_WORD = _IS_LETTER.copy()
_IN_WORD[128:] = True
_OUT_OF_WORD = ~_IN_WORD
_OUT_OF_WORD[65:91] = False
_APART_TABLE = np.zeros(256, bool)
_APART_TABLE[_APART] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?)"]] = True


def _choices() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second symbol (-1: none) and cost of each byte's choices, by the run's length (one, two,
    more), byte and choice. A cost of infinity: no such choice."""
    a, b = np.full((3, 256, K), 0, np.int64), np.full((3, 256, K), -1, np.int64)
    cost = np.full((3, 256, K), np.inf, np.float32)

    def put(run: int, byte: int, i: int, first: int, second: int, c: float) -> None:
        a[run, byte, i], b[run, byte, i], cost[run, byte, i] = first, second, c

    for byte in range(256):
        s, sign = int(_SYMBOL[byte]), LEET.get(chr(byte), "")
        for run in range(3):
            if sign:
                put(run, byte, K - 1, 0, 0, DIGIT if chr(byte).isdigit() else MONEY if chr(byte) in "$@" else MARK)
                meant = sign[:1] if run and len(sign) > 2 else sign  # a run of stars is no run of vowels
                meant = "" if run and chr(byte) == "*" else meant
                for i, c in enumerate(meant):
                    one = (FOR_LETTER, FOR_LETTER + COLLAPSE, RUN_FOR_LETTER)[run]
                    put(run, byte, i, ord(c) - 96, -1, one)
                    if run:
                        put(run, byte, len(meant) + i, ord(c) - 96, ord(c) - 96, (0, FOR_LETTER, RUN_FOR_LETTER)[run])
            elif 1 <= s <= 26:
                put(run, byte, 0, s, -1, (0, COLLAPSE_TWO, COLLAPSE)[run])
                if run:
                    put(run, byte, 1, s, s, (0, 0, COLLAPSE)[run])
            elif s:
                put(run, byte, 0, s, -1, 0)
            else:
                put(run, byte, 0, 0, 0, 0)
    return a, b, cost


_A, _B, _COST = _choices()


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each three symbols in a row, words set between two borders: N**3 numbers."""
    start, end, _ = words(data, offsets, _OUT_OF_WORD)
    if not len(start):
        return np.zeros(N**3, np.int64)
    # two borders before each word and two at the end
    raw, off = slices(np.concatenate([[0, 0], _SYMBOL[data]]), start, end + 2)
    at = off[:-1]
    raw[at] = raw[at + 1] = 0
    raw = np.append(raw, [0, 0])
    return np.bincount((raw[:-2] * N + raw[1:-1]) * N + raw[2:], minlength=N**3)


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Minus log probabilities [first, second, third] of symbols, from all texts. At most N**3 rows
    reach the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for b in batches(BATCH_BYTES)(it):
            data, off, _ = utf8(b.column(0))
            total += trigrams(data, off)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["i", "c"])

    got = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(lean(run), "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()
    c = np.zeros(N**3)
    for r in got:
        c[r["i"]] = r["c"]
    return model_of(c.reshape(N, N, N))


def model_of(c: np.ndarray) -> np.ndarray:
    """Interpolated: mostly trigrams, then pairs, single symbols and one share for all."""
    share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-9)
    p = 0.9 * share(c) + 0.08 * share(c.sum(axis=0))[None] + 0.015 * share(c.sum(axis=(0, 1)))[None, None] + 0.005 / N
    p[:, 0, 0] = 1  # a border is two
    return -np.log(p).astype(np.float32)


def decode(lm: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The best choice at each step of lattices of equal length: (rows, steps, choices) to (rows, steps)."""
    rows, steps, k = a.shape
    flat, r = lm.ravel(), np.arange(rows)
    last = np.where(b >= 0, b, a)
    word_end = np.zeros((rows, k), np.int64)

    def after(t: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Cost of each choice at t after the symbols u, v: (rows, before, choice)."""
        shape = (rows, *(1,) * (u.ndim - 1), k)
        u, v, one, two = u[..., None], v[..., None], a[:, t].reshape(shape), b[:, t].reshape(shape)
        return flat[(u * N + v) * N + one] + np.where(two >= 0, flat[(v * N + one) * N + np.maximum(two, 0)], 0)

    zero = np.zeros((rows, 1), np.int64)
    first = after(0, zero, zero)[:, 0] + cost[:, 0]
    if steps == 1:
        u, v = np.where(b[:, 0] >= 0, a[:, 0], 0), last[:, 0]
        return (first + flat[(u * N + v) * N]).argmin(axis=1)[:, None]
    # score[row, i, j]: choice i at the step before, j at this one
    u, v = np.where(b[:, 0] >= 0, a[:, 0], word_end), last[:, 0]
    score = first[:, :, None] + after(1, u, v) + cost[:, 1][:, None, :]
    back = np.zeros((rows, steps, k, k), np.int8)
    for t in range(2, steps + 1):
        # symbols before step t, for each pair of choices
        u = np.where((b[:, t - 1] >= 0)[:, None, :], a[:, t - 1][:, None, :], last[:, t - 2][:, :, None])
        v = np.broadcast_to(last[:, t - 1][:, None, :], u.shape)
        if t == steps:
            score = score + flat[(u * N + v) * N]
            break
        total = score[..., None] + after(t, u, v)
        back[:, t] = total.argmin(axis=1)
        score = total.min(axis=1) + cost[:, t][:, None, :]
    best = score.reshape(rows, -1).argmin(axis=1)
    out = np.zeros((rows, steps), np.int64)
    out[:, -1], out[:, -2] = best % k, best // k
    for t in range(steps - 1, 1, -1):
        out[:, t - 2] = back[r, t, out[:, t - 1], out[:, t]]
    return out


def _restored(lm: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, apart: np.ndarray) -> list[bytes]:
    """What each range of bytes (lower-cased, no spaces) was meant to say; ``apart``: its letters stood
    apart, and a word may end behind each."""
    raw, off = slices(data, start, end)
    n = len(start)
    new = np.ones(len(raw), bool)
    new[1:] = (raw[1:] != raw[:-1]) | (raw[1:] >= 128)
    new[off[:-1]] = True
    new |= np.repeat(apart, np.diff(off))
    at = np.flatnonzero(new)
    first = np.searchsorted(at, off)
    size = np.diff(np.append(at, len(raw)))
    run = np.minimum(size, 3) - 1
    byte = raw[at]
    wide = _COST[run, byte][:, 2:].min(axis=1) < np.inf
    owner = np.repeat(np.arange(n), np.diff(first))
    steps = np.diff(first)
    needs = np.zeros(n, bool)
    needs[owner[wide]] = True
    needs |= apart
    out: list[bytes] = [b""] * n
    group = steps * 2 + needs
    order = np.argsort(group, kind="stable")
    borders = np.flatnonzero(np.diff(group[order])) + 1
    for same in np.split(order, borders):
        t, k = int(steps[same[0]]), K if needs[same[0]] else 2
        block = max(1, min(4096, (1 << 20) // (t * k * k)))
        for s in range(0, len(same), block):
            some = same[s : s + block]
            i = first[some][:, None] + np.arange(t)
            r, y = run[i], byte[i]
            a, b, cost = _A[r, y, :k], _B[r, y, :k], _COST[r, y, :k]
            if needs[some[0]] and apart[some].any():
                # the letter, with the end of a word behind it, is one choice more
                letter = apart[some][:, None] & _IS_LETTER[y] & (np.arange(t) < t - 1)
                a, b, cost = a.copy(), b.copy(), cost.copy()
                a[..., 1] = np.where(letter, a[..., 0], a[..., 1])
                b[..., 1] = np.where(letter, 0, b[..., 1])
                cost[..., 1] = np.where(letter, 1.0, cost[..., 1])
            best = decode(lm, a, b, cost)
            pick = lambda x: np.take_along_axis(x, best[..., None], axis=2)[..., 0]
            one, two = pick(a), pick(b)
            for row, x, z in zip(some.tolist(), one.tolist(), two.tolist(), strict=True):
                said = bytearray()
                for p, c, d in zip(range(first[row], first[row] + t), x, z, strict=True):
                    if 1 <= c <= 26:
                        said.append(c + 96)
                        if d > 0:
                            said.append(d + 96)
                        elif d == 0:
                            said.append(32)
                    else:  # a byte beyond ASCII, or a sign as itself
                        said += raw[at[p] : at[p] + size[p]].tobytes()
                out[row] = bytes(said)
    return out


def restore_batch(lm: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with disguised words restored: their bytes and offsets. Words that change are lower-cased."""
    low = lower(data)
    start, end, first = words(low, offsets)
    if not len(start):
        return data, offsets
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    # signs at a word's ends are punctuation, unless a letter follows or they are dollars and the like
    letter, sign = _IS_LETTER[low], _IS_SIGN[low]
    beside = np.zeros(len(low) + 1, bool)
    beside[1:-1] = (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    twin = np.zeros(len(low) + 1, bool)
    twin[1:-1] = letter[1:] & (low[1:] == low[:-1])
    inner = lambda mask: (lambda c: c[end] - c[start + 1])(total(mask[:-1]))
    size = end - start
    mixed, doubled = inner(beside), inner(twin)
    tail = end.copy()  # without punctuation behind
    for _ in range(3):
        tail -= (tail - start > 1) & _PUNCT[low[tail - 1]]
    within = lambda mask: (lambda c: c[tail] - c[start])(total(mask))
    signs, letters = within(_APART_TABLE[low]), within(letter | sign & ~_APART_TABLE[low])
    dotted = (signs >= 3) & (tail - start == 2 * signs + 1) & (letters == signs + 1) & (letter | sign)[start]
    odd = (mixed > 0) | (doubled > 0) | dotted
    # four or more words of one letter or sign each, near one another
    single = (size == 1) & (letter | sign)[start]
    near = np.zeros(len(start), bool)
    near[1:] = single[1:] & single[:-1] & (start[1:] - end[:-1] == 1) & (doc[1:] == doc[:-1])
    begin = np.flatnonzero(single & ~near)
    group = np.cumsum(single & ~near) - 1
    count = np.bincount(group[single], minlength=len(begin)) if single.any() else np.zeros(0, np.int64)
    spaced = begin[count >= 4]
    odd &= ~single
    at = np.flatnonzero(odd)
    if not len(at) and not len(spaced):
        return data, offsets
    # one lattice for each distinct word
    ranges = [(start[at], np.where(dotted, tail, end)[at])]
    s_end = end[spaced + count[count >= 4] - 1] if len(spaced) else spaced
    ranges.append((start[spaced], s_end))
    a, z = np.concatenate([r[0] for r in ranges]), np.concatenate([r[1] for r in ranges])
    apart = np.concatenate([dotted[at], np.ones(len(spaced), bool)])
    _, one, back = np.unique(mix(range_hashes(low, a, z) ^ apart.astype(U64)), return_index=True, return_inverse=True)
    # letters that stand apart are read without what is between them
    raw, off = slices(low, a[one], z[one])
    keep = ~(np.repeat(apart[one], np.diff(off)) & (_APART_TABLE[raw] | (raw <= 32)))
    kept = np.concatenate([[0], np.cumsum(keep)])
    said = _restored(lm, raw[keep], kept[off[:-1]], kept[off[1:]], apart[one])
    was = [raw[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    changed = np.array([x != y for x, y in zip(said, was, strict=True)])[back]
    if not changed.any():
        return data, offsets
    order = np.flatnonzero(changed)
    order = order[np.argsort(a[order], kind="stable")]
    source, parts, last, grown = data.tobytes(), [], 0, np.zeros(len(offsets), np.int64)
    where = np.searchsorted(offsets, a[order], "right") - 1
    for i, x, y in zip(back[order].tolist(), a[order].tolist(), z[order].tolist(), strict=True):
        parts += [source[last:x], said[i]]
        last = y
    parts.append(source[last:])
    gain = np.array([len(said[i]) for i in back[order].tolist()]) - (z[order] - a[order])
    np.add.at(grown, where + 1, gain)
    return np.frombuffer(b"".join(parts), np.uint8), offsets + np.cumsum(grown)


def restore(df: DataFrame, lm: np.ndarray, text: str = "text", restored: str = "restored") -> DataFrame:
    """Adds ``restored``: the text with disguised words as they were meant. Null stays null; a column with
    this name gives way; repeated rows stay."""
    df = without(df, restored) if restored != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(restored, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(lm)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(BATCH_BYTES, text)(it):
            col = b.column(b.schema.get_field_index(text))
            data, off, valid = utf8(col)
            data, off = restore_batch(shared.value, data, off)
            said = binaries(data, off, pa.string())
            if not valid.all():
                said = pa.compute.if_else(pa.array(valid), said, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, said], schema.names)

    return df.mapInArrow(lean(run), schema)


# -- scores ---------------------------------------------------------------------------------


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's terms (itself, then its first bytes where it is longer; 0 for none) and its text."""
    low = lower(data)
    start, end, first = words(low, offsets, _OUT_OF_WORD)
    cols = [range_hashes(low, start, end)]
    for n in BEGINNINGS:
        some = end - start > n
        cols.append(np.where(some, mix(range_hashes(low, start, np.where(some, start + n, start)) + U64(n)), U64(0)))
    return np.stack(cols, axis=1), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


class Model:
    """What is broadcast: the language model, the lexicon (sorted hashes and weights), the curve."""

    def __init__(self, lm: np.ndarray, lexicon: dict[int, float], prior: float):
        self.lm, self.prior = lm, prior
        items = sorted((np.uint64(h & (1 << 64) - 1), w) for h, w in lexicon.items())
        self.key, self.weight = np.array([h for h, _ in items], U64), np.array([w for _, w in items])
        self.curve = (float(np.log(prior / (1 - prior))), 0.0)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The sum over the distinct words of each (restored) text of their largest lexicon weight."""
        n = len(offsets) - 1
        out = np.zeros(n)
        if not len(self.key) or not len(data):
            return out
        terms, doc = _terms(data, offsets)
        i = np.minimum(np.searchsorted(self.key, terms), len(self.key) - 1)
        weight = np.where(self.key[i] == terms, self.weight[i], 0).max(axis=1, initial=0)
        hit = np.flatnonzero(weight)
        pair = np.stack([doc[hit].astype(U64), terms[hit, 0]], axis=1)
        _, one = np.unique(pair, axis=0, return_index=True)
        np.add.at(out, doc[hit][one], weight[hit][one])
        return out

    def fit_curve(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
        """Logistic regression of labels on evidence by Newton's method, with a weak prior."""
        m = np.stack([np.ones(len(x)), x], axis=1)
        b = np.array([self.curve[0], 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
            grad = m.T @ (y - p) - 1e-2 * b
            b = b + np.clip(np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2), grad), -2, 2)
        self.curve = (float(b[0]), float(max(b[1], 0)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.evidence(*restore_batch(self.lm, data, offsets)), -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, allowed, label: str, max_train: int) -> DataFrame:
    """(h, y, text) of at most max_train labelled rows: ids of least hash, and of all their rows those of
    least hash, equal ones once, so one id in very many rows can't go beyond the bound."""
    marked = labels.where(allowed).where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), F.col("y").cast("int").alias("y"), "text")
    least = rows.select("h", "y").distinct().orderBy("h", "y").limit(max_train)
    return rows.join(F.broadcast(least), ["h", "y"], "left_semi").dropDuplicates(["h", "y"]).select("y", "text")


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> Model:
    """The language model from all texts of ``docs``; lexicon and curve from at most max_train labelled
    rows for which ``allowed`` (a condition on doc_id) holds, by least hash. Null labels and texts are left
    out; of one doc_id with several labels the largest holds; equal rows count once."""
    lm = language_model(docs)
    sample = cut(restore(_sample(docs, labels, allowed, label, max_train), lm).select("y", "restored"), "labelled")
    spark = sample.sparkSession

    def contexts(known: np.ndarray | None):
        """(w, c): each term of a text with the words around its first place; of known terms only."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(BATCH_BYTES, "restored")(it):
                data, off, _ = utf8(b.column(0))
                terms, doc = _terms(data, off)
                around = np.zeros(len(terms) + 2, U64)
                around[1:-1] = terms[:, 0]
                c = np.repeat(mix(around[:-2] ^ mix(around[2:] + U64(1))), terms.shape[1])
                w, doc = terms.ravel(), np.repeat(doc, terms.shape[1])
                some = np.flatnonzero((w != 0) & (np.isin(w, known) if known is not None else True))
                _, first = np.unique(mix(w[some] ^ mix(doc[some].astype(U64))), return_index=True)
                at = some[first]
                yield pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), pa.array(c[at].view(np.int64))], ["w", "c"])

        return lean(run)

    count = lambda rows, known, n: rows.select("restored").mapInArrow(contexts(known), "w long, c long").distinct().groupBy("w").agg(F.count("*").alias(n))
    # first the terms of toxic texts alone; only those with enough contexts are looked for in the others
    marked = {r["w"]: r["n1"] for r in count(sample.where("y = 1"), None, "n1").where(F.col("n1") >= SURE**2).orderBy(F.desc("n1"), "w").limit(MAX_CANDIDATES).collect()}
    clean = {r["w"]: r["n0"] for r in count(sample.where("y <> 1"), np.array(sorted(marked), np.int64).view(U64), "n0").collect()} if marked else {}
    lexicon = []
    for w, n1 in marked.items():
        n, k = n1 + clean.get(w, 0), SURE**2
        p = n1 / n
        low = (p + k / (2 * n) - SURE * np.sqrt(p * (1 - p) / n + k / (4 * n * n))) / (1 + k / n)
        if low > 0.5:
            lexicon.append((-low, w, float(np.log((n1 + 0.5) / (n - n1 + 0.5)))))
    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")).first()
    model = Model(lm, {w: x for _, w, x in sorted(lexicon)[:max_words]}, (size["k"] + 1) / (size["n"] + 2))
    given = spark.sparkContext.broadcast(model)

    def evidence(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(BATCH_BYTES, "restored")(it):
            data, off, _ = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(given.value.evidence(data, off))], ["y", "x"])

    got = sorted((r["x"], r["y"]) for r in sample.mapInArrow(lean(evidence), "y int, x double").collect())  # at most max_train rows of two numbers
    if got:
        model.fit_curve(np.array([x for x, _ in got]), np.array([y for _, y in got], float))
    drop(sample)
    return model


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from the threshold on). A null
    text counts as empty and has no evidence; columns with these names give way; repeated rows stay, equal
    texts score equally; without labelled rows every score is 0.5."""
    df = without(df, score, predicted)
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(BATCH_BYTES, text)(it):
            data, off, _ = utf8(b.column(b.schema.get_field_index(text)))
            found = shared.value.score(data, off)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], schema.names)

    return df.mapInArrow(lean(run), schema)
