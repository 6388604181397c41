"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every position, and a document's
probabilities are the mean over all its positions with a letter near. It is trained in numpy by
backpropagation through time on windows of a bounded sample. Gates use the rational sigmoid
(1 + x / (1 + |x|)) / 2 and states x / (1 + |x|): the same shapes, a fraction of the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import P1, U64, batches, lean, mix, utf8, without

HIDDEN, WINDOW = 8, 64
#: Bound of the training sample: documents, and windows of each.
MAX_TRAIN, MAX_WINDOWS = 1200, 8
#: Bound of the label layer; a corpus with more values in lang is refused, never cut.
MAX_LANGS = 1000
UND = "und"
_LETTER = regex.compile(r"\p{L}")

#: Bytes as symbols: case and digits fold together, punctuation is one symbol, 0 is padding.
_SYMBOL = np.ones(256, np.uint8)
_SYMBOL[97:123] = np.arange(2, 28)
_SYMBOL[65:91] = np.arange(2, 28)
_SYMBOL[128:256] = np.arange(28, 156)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 156
N_SYMBOLS = 157


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all bytes in rows of ``width`` (rows of texts one after another), the text of
    each row and the bytes in it."""
    size = np.diff(offsets)
    rows = -(-size // width)
    doc = np.repeat(np.arange(len(size)), rows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
    start = offsets[doc] + nth * width
    count = np.minimum(width, offsets[doc + 1] - start)
    col = np.arange(width)
    at = np.minimum(start[:, None] + col, max(len(data) - 1, 0))
    return np.where(col < count[:, None], _SYMBOL[data[at]], 0).astype(np.uint8), doc, count


def _soft(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    x /= d
    return x


class _Direction:
    """One direction's parameters: input tables, recurrent weights, biases (in the tables)."""

    def __init__(self, rng: np.random.Generator, h: int):
        self.e = (rng.standard_normal((N_SYMBOLS, 3 * h)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((h, 2 * h)) / np.sqrt(h)).astype(np.float32)  # update, reset
        self.c = (rng.standard_normal((h, h)) / np.sqrt(h)).astype(np.float32)  # candidate

    def params(self) -> list[np.ndarray]:
        return [self.e, self.u, self.c]

    def run(self, x: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
        """States after each step of x (steps, rows)."""
        h = self.c.shape[0]
        s = np.zeros((x.shape[1], h), np.float32)
        out = []
        for t in range(len(x)):
            i = self.e[x[t]]
            g = _soft(i[:, : 2 * h] + s @ self.u)
            g += 1
            g *= 0.5
            z, r = g[:, :h], g[:, h:]
            c = _soft(i[:, 2 * h :] + (r * s) @ self.c)
            new = s + z * (c - s)
            if keep is not None:
                keep.append((s, z, r, c))
            s = new
            out.append(s)
        return out

    def back(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, from those of the states."""
        h = self.c.shape[0]
        ge, gu, gc = (np.zeros_like(p) for p in self.params())
        ds = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            s, z, r, c = keep[t]
            ds = ds + d_out[t]
            dc = ds * z * (1 - np.abs(c)) ** 2
            drs = dc @ self.c.T
            gc += (r * s).T @ dc
            dz = ds * (c - s)
            dr = drs * s
            gates = np.hstack([z, r]) * 2 - 1
            dg = np.hstack([dz, dr]) * 0.5 * (1 - np.abs(gates)) ** 2
            gu += s.T @ dg
            np.add.at(ge, x[t], np.hstack([dg, dc]))
            ds = ds * (1 - z) + drs * r + dg @ self.u.T
        return [ge, gu, gc]


class Network:
    """Two directions and a linear label layer over both states of a position."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.f, self.b = _Direction(rng, hidden), _Direction(rng, hidden)
        self.w = (rng.standard_normal((2 * hidden, len(langs))) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def positions(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """Label scores of each position of x (rows, steps): (steps, rows, labels)."""
        xt = np.ascontiguousarray(x.T)
        f = self.f.run(xt, keep[0] if keep else None)
        b = self.b.run(xt[::-1], keep[1] if keep else None)[::-1]
        h = self.w.shape[0] // 2
        return np.stack([p @ self.w[:h] + q @ self.w[h:] + self.bias for p, q in zip(f, b, strict=True)])

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 280, batch: int = 256, rate: float = 0.01, seed: int = 1) -> Network:
        """Adam on the mean cross-entropy of all positions; as many steps for any sample."""
        epochs = -(-steps // -(-len(x) // batch))
        rng = np.random.default_rng(seed)
        params = [*self.f.params(), *self.b.params(), self.w, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        h = self.w.shape[0] // 2
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                at = order[s : s + batch]
                xb, keep = x[at], ([], [])
                scores = self.positions(xb, keep)
                p = np.exp(scores - scores.max(axis=2, keepdims=True))
                p /= p.sum(axis=2, keepdims=True)
                p[:, np.arange(len(at)), y[at]] -= 1
                live = (xb.T > 0)[:, :, None]
                d = (p * live / max(live.sum(), 1)).astype(np.float32) * 30
                fs = np.stack([a[0] + a[1] * (a[3] - a[0]) for a in keep[0]])
                bs = np.stack([a[0] + a[1] * (a[3] - a[0]) for a in keep[1]])[::-1]
                gw = np.vstack([np.tensordot(fs, d, ((0, 1), (0, 1))), np.tensordot(bs, d, ((0, 1), (0, 1)))])
                xt = np.ascontiguousarray(xb.T)
                grads = [*self.f.back(xt, keep[0], d @ self.w[:h].T), *self.b.back(xt[::-1], keep[1], (d @ self.w[h:].T)[::-1]), gw, d.sum(axis=(0, 1))]
                step += 1
                lr = rate * min(1.0, 2.0 * (1 - step / (epochs * -(-len(x) // batch) + 1)))
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def documents(self, data: np.ndarray, offsets: np.ndarray, block: int = 4096) -> np.ndarray:
        """Mean label probabilities over all positions of each text; zeros for an empty one."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        x, doc, _ = windows(data, offsets)
        for s in range(0, len(x), block):
            xb = x[s : s + block]
            scores = self.positions(xb)
            scores -= scores.max(axis=2, keepdims=True)
            p = np.exp(scores, out=scores)
            # positions of padding, spaces and signs tell nothing of their own
            weight = ((xb.T > 1) & (xb.T < N_SYMBOLS - 1)) / p.sum(axis=2)
            rows = np.einsum("trk,tr->rk", p, weight)
            np.add.at(out, doc[s : s + block], rows)
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def _sample(known: DataFrame, max_train: int) -> list[tuple]:
    """(doc_id, lang): of each language about the same number of documents, those of least hash of
    doc_id. A count of ids by language, then a threshold for the hash that lets twice as many through as
    are wanted, so the rows that reach the driver don't grow with the corpus."""
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if len(count) > MAX_LANGS:
        raise ValueError(f"{len(count)} languages in lang; the network labels {MAX_LANGS} at most")
    if not count:
        return []
    each = max(1, max_train // len(count))
    rule = known.sparkSession.createDataFrame([(k, min(1 << 32, -(-(2 * each + 20) * (1 << 32) // max(n, 1)))) for k, n in count.items()], "lang string, most long")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    some = known.select("doc_id", "lang", spread.alias("h")).join(F.broadcast(rule), "lang").where("h < most").select("doc_id", "lang", "h")
    # an id counts once, however many rows it has; the limit is far above what the thresholds let through
    rows = some.distinct().orderBy("h", "doc_id", "lang").limit(4 * max_train + 40 * len(count)).collect()
    found, taken = [], {}
    for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"] is None, r["doc_id"])):
        if taken.setdefault(r["lang"], 0) < each:
            taken[r["lang"]] += 1
            found.append((r["doc_id"], r["lang"]))
    return found


def fit(docs: DataFrame, allowed, max_train: int = MAX_TRAIN, max_windows: int = MAX_WINDOWS) -> Network | None:
    """Trains on documents for which ``allowed`` holds and neither lang, text nor doc_id is null:
    for each language at most max_train / languages of least hash of doc_id, and of each max_windows
    windows from all over its text, chosen by hash on the executors. (Predictions always read whole
    texts.) Of an id in several rows the text of least hash is read. So the driver gets at most
    max_train * max_windows windows. None where there are no such documents. More than MAX_LANGS languages are an error."""
    known = docs.where(allowed).where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    ids = _sample(known, max_train)
    if not ids:
        return None
    langs = sorted({lang for _, lang in ids})
    some = known.sparkSession.createDataFrame(sorted(set(ids)), known.select("doc_id", "lang").schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(2 << 20)(it):
            data, off, _ = utf8(b.column(2))
            x, doc, count = windows(data, off)
            # a short last window tells little, unless it is all that there is
            good = (count >= 16) | (np.diff(off)[doc] < 16)
            x, doc, nth = x[good], doc[good], (np.arange(len(doc)) - np.searchsorted(doc, doc))[good]
            spread = mix(nth.astype(U64) * P1 + np.asarray(b.column(3), np.int64).view(U64)[doc])
            order = np.lexsort((spread, doc))
            keep = order[np.arange(len(doc)) - np.searchsorted(doc, doc[order]) < max_windows] if len(doc) else order
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(doc[keep])), b.column(3).take(pa.array(doc[keep])), pa.array([r.tobytes() for r in x[keep]], pa.binary())], ["lang", "h", "x"])

    rows = known.join(F.broadcast(some), ["doc_id", "lang"]).select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    least = rows.groupBy("doc_id", "lang").agg(F.min("h").alias("h"))  # as many rows as ``some`` at most
    one = rows.join(F.broadcast(least), ["doc_id", "lang", "h"], "left_semi").select("doc_id", "lang", "text", "h")
    got = sorted(one.mapInArrow(lean(run), "lang string, h long, x binary").distinct().collect(), key=lambda r: (r["h"], r["x"]))
    if not got:
        return Network(langs)
    x = np.stack([np.frombuffer(r["x"], np.uint8) for r in got])
    return Network(langs).fit(x, np.array([langs.index(r["lang"]) for r in got]))


def identify(df: DataFrame, model: Network | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the mean probability of that language over the whole
    text. ``und`` with score 0 for a null text or one without a letter, or without a model.
    Columns with these names give way; repeated rows stay; ties go to the first language."""
    df = without(df, "lang_pred", "score")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(2 << 20, text)(it):
            col = b.column(b.schema.get_field_index(text))
            data, off, _ = utf8(col)
            p = m.documents(data, off) if m else np.zeros((b.num_rows, 1))
            best = p.argmax(axis=1)
            named = np.array([m is not None and bool(t) and _LETTER.search(t) is not None for t in col.to_pylist()])
            langs = [m.langs[i] if ok else UND for i, ok in zip(best.tolist(), named.tolist(), strict=True)] if m else [UND] * b.num_rows
            score = np.where(named, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(lean(run), schema)
