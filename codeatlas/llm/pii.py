"""Personal data in text: patterns with checks, and a linear-chain conditional random field.

The field labels words (runs without ASCII white space) by features of their shapes and of their
neighbours' shapes: classes of characters, runs of them, lengths, counts, first characters, and
hashed words. It knows no pattern of any kind; all weights are learned, by gradient ascent on the
likelihood of a small labelled table that is generated from a rule, and it is decoded by Viterbi in
numpy over padded batches. A word is outside for certain where that beats every other label by more
than the transitions around it can regain; so texts fall into short stretches between such words and
only those are decoded. The result is that of decoding whole texts.

Time is linear in a text's length, whatever it holds: patterns never scan a run twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeatlas.llm.common import P1, P2, U64, batches, lean, lower, mix, range_hashes, utf8, without, words

KINDS = ("email", "ip", "card", "phone")
#: What the field labels, besides O (outside).
LABELS = ("O", "email", "ip", "card", "phone", "ssn", "secret")

_RUN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# possessive: a run of digits is taken once, never given back
_RUN_IP = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_RUN_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_RUN_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @: a match can only begin at the start of
    the run of local-part characters before an @, or where the last match ended."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _RUN_EMAIL.match(text, start)):
            yield m.span()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four numbers between dots, found run by run: a match begins at a run's first
    number and takes whole numbers, so it is every four in a row. Parts are at most 255."""
    for m in _RUN_IP.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, at + size
            at += size + 1


def is_card(text: str) -> bool:
    d = text.replace(" ", "").replace("-", "")
    return 13 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, without those that fail the kind's check."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", a, b) for a, b in ips(text)]
        found += [("card", *m.span()) for m in _RUN_CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            found += [("phone", *m.span()) for m in _RUN_PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


_DIGIT = re.compile("[0-9]")
# -- features -------------------------------------------------------------------------------

# classes of bytes: a-z, A-Z, 0-9, beyond ASCII, then every other byte a class of its own
_CLASS = np.arange(256, dtype=np.int64) + 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_ALNUM = _CLASS < 5
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103), *range(65, 71)]] = True
#: What a word's features are, and how many values each has; values beyond come from hashes.
_FIELDS = {"shape": 2048, "runs": 1024, "length": 32, "made of": 1024, "digits": 24, "marks": 128, "hex": 64, "begins": 1024, "word": 4096, "first": 256, "last": 256, "changes": 8, "name": 4096, "lead": 48}
_BASE = dict(zip(_FIELDS, np.cumsum([0, *_FIELDS.values()]).tolist(), strict=False))
N_FEATURES = sum(_FIELDS.values())
#: Features of a neighbour that count.
_BESIDE = [list(_FIELDS).index(x) for x in ("runs", "length", "made of", "word", "first", "last")]


def _hashed(h: np.ndarray, size: int) -> np.ndarray:
    return (mix(h * P2) >> U64(33)).astype(np.int64) % size


def _assigned(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, alnum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the bytes of the name that it is a value of: what stands before a = or : within
    the word, or else the word before, where that ends in one, or the one before a lone = or : or :=.
    An empty range where there is none. a and b: the words' cores."""
    lo, hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    if not len(start) or not len(alnum):
        return lo, hi
    ties = np.flatnonzero((data == 61) | (data == 58))
    nth = np.searchsorted(ties, a)
    cut = ties[np.minimum(nth, len(ties) - 1)] if len(ties) else np.full(len(a), len(data))
    own = (nth < len(ties)) & (a < cut) & (cut < b)
    lo[own], hi[own] = a[own], alnum[np.maximum(np.searchsorted(alnum, cut[own]) - 1, 0)] + 1
    doc = np.searchsorted(first, np.arange(len(start)), "right")
    last = data[end - 1]
    tied = (last == 61) | (last == 58)
    bare = tied & (a == b) & (end - start <= 2)
    here = np.arange(len(start))
    one, two = np.maximum(here - 1, 0), np.maximum(here - 2, 0)
    one_ok, two_ok = (here > 0) & (doc == doc[one]) & tied[one], (here > 1) & (doc == doc[two])
    for use, at in ((~own & one_ok & ~bare[one], one), (~own & one_ok & bare[one] & two_ok, two)):
        lo[use], hi[use] = a[at[use]], b[at[use]]
    return lo, hi


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(words, fields) of feature numbers; first: the first word of each text, and the number of
    words. A word's core is it without signs at its ends."""
    cls = _CLASS[data]
    alnum = np.flatnonzero(_ALNUM[data])
    lo, hi = np.searchsorted(alnum, start), np.searchsorted(alnum, end)
    some = lo < hi
    a = np.where(some, alnum[np.minimum(lo, max(len(alnum) - 1, 0))], start) if len(alnum) else start
    b = np.where(some, alnum[np.maximum(hi - 1, 0)] + 1, start) if len(alnum) else start
    size = b - a

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[b] - total[a]

    kinds = [count(cls == k) for k in (1, 2, 3, 4)]
    marks = {c: count(data == ord(c)) for c in "@.-_=:/+"}
    other = size - sum(kinds) - sum(marks.values())
    length = np.select([size < 16, size < 20, size < 24, size < 32, size < 40, size < 64], [size, 16 + (size > 16), 18 + (size > 20), 20 + (size - 24) // 4, 22 + (size - 32) // 4, 24 + (size > 40)], 26 + (size > 256))
    made = sum((x > 0).astype(np.int64) << i for i, x in enumerate([*kinds, *(marks[c] for c in "@.-_="), other + marks[":"] + marks["/"] + marks["+"]]))
    change = np.zeros(len(data), bool)
    change[1:] = cls[1:] != cls[:-1]
    inner = np.concatenate([[0], np.cumsum(change)])
    changes = np.maximum(inner[b] - inner[np.minimum(a + 1, len(data))], 0) * some
    # runs: the first byte of each run of one class, hashed in order
    keep = change.copy()
    keep[a[some]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    runs = range_hashes(cls[keep], at[a], at[b])
    low = lower(data)
    n4 = np.minimum(size, 4)
    begins = range_hashes(data, a, a + n4) + np.minimum(size // 8, 4).astype(U64) * P1
    plain = (kinds[2] == 0) & (size <= 24) & (size > 0)
    word = np.where(plain, _hashed(range_hashes(low, a, b), _FIELDS["word"] - 1) + 1, 0)
    n0, n1 = _assigned(data, start, end, first, a, b, alnum)
    name = np.where(n0 < n1, _hashed(range_hashes(low, n0, n1), _FIELDS["name"] - 1) + 1, 0)
    lead = data[np.minimum(a, max(len(data) - 1, 0))].astype(np.int64) - 48
    lead = np.where((lead >= 0) & (lead < 10), 1 + lead + 10 * np.minimum(marks["-"], 3), 0)
    hexes = (count(_HEX[data]) == size) & (size > 0)
    raw = np.maximum(end - 1, 0)
    cols = [
        _hashed(range_hashes(cls, a, b), _FIELDS["shape"]), _hashed(runs, _FIELDS["runs"]), length, made, np.minimum(kinds[2], 23),
        np.minimum(marks["."], 3) * 32 + np.minimum(marks["-"], 3) * 8 + np.minimum(marks["@"], 1) * 4 + np.minimum(marks["_"], 1) * 2 + np.minimum(marks["="], 1),
        np.where(hexes, 1 + length + 28 * ((kinds[2] > 0) & (kinds[0] + kinds[1] > 0)), 0), _hashed(begins, _FIELDS["begins"]), word,
        np.minimum(cls[start], 255), np.minimum(cls[raw], 255), np.digitize(changes, [1, 2, 3, 5, 9, 17, 33]), name, lead,
    ]
    return np.stack([c + off for c, off in zip(cols, _BASE.values(), strict=True)], axis=1)


class CRF:
    """Scores of a word's own features and of both neighbours', for each label, and of label pairs."""

    def __init__(self, n_labels: int = len(LABELS)):
        # the last row is for the text's border
        self.own, self.left, self.right = (np.zeros((N_FEATURES + 1, n_labels), np.float32) for _ in range(3))
        self.step = np.zeros((n_labels, n_labels), np.float32)

    def emissions(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of each word's labels; first: the first word of each text, and the number of words."""
        n = len(f)
        out = np.zeros((n, self.step.shape[0]), np.float32)
        if not n:
            return out
        for j in range(f.shape[1]):
            out += self.own[f[:, j]]
        is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
        begin = first[:-1][np.diff(first) > 0]
        is_first[begin] = True
        is_last[first[1:][np.diff(first) > 0] - 1] = True
        for j in _BESIDE:
            out[1:] += self.left[np.where(is_first[1:], N_FEATURES, f[:-1, j])]
            out[:-1] += self.right[np.where(is_last[:-1], N_FEATURES, f[1:, j])]
        out[0] += len(_BESIDE) * self.left[N_FEATURES]
        out[-1] += len(_BESIDE) * self.right[N_FEATURES]
        return out

    def fit(self, texts: list[list[tuple[str, str]]], rounds: int = 240, parts: int = 4, rate: float = 0.3, decay: float = 3e-4) -> CRF:
        """Adaptive gradient ascent on the mean log-likelihood of one of ``parts`` of the sentences
        after another. texts: words with their labels."""
        made = [self._prepared(texts[i::parts]) for i in range(parts) if texts[i::parts]]
        params = (self.own, self.left, self.right, self.step)
        seen = [np.full_like(v, 1e-6) for v in params]
        for i in range(rounds):
            n, grads = self._gradients(*made[i % len(made)])
            for v, grad, s in zip(params, grads, seen, strict=True):
                g = grad / n - decay * v
                s += g * g
                v += (rate * g / np.sqrt(s)).astype(np.float32)
        return self

    def _prepared(self, texts: list[list[tuple[str, str]]]) -> tuple:
        """Features of sentences, their places in a padded matrix, their labels and label pairs, and
        for each table its words in the order of their features and where each feature begins."""
        data, off, _ = utf8(pa.array([" ".join(w for w, _ in t) for t in texts], pa.string()))
        start, end, first = words(data, off)
        f, k = features(data, start, end, first), self.step.shape[0]
        size = np.diff(first)
        row, col = np.repeat(np.arange(len(texts)), size), np.arange(len(f)) - np.repeat(first[:-1], size)
        live = np.zeros((len(texts), int(size.max())), bool)
        live[row, col] = True
        y = np.zeros(live.shape, int)
        y[row, col] = [LABELS.index(label) for t in texts for _, label in t]
        truth = np.zeros((k, k))
        np.add.at(truth, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
        before = np.where((col == 0)[:, None], N_FEATURES, f[np.maximum(np.arange(len(f)) - 1, 0)][:, _BESIDE])
        after = np.where((col == size[row] - 1)[:, None], N_FEATURES, f[np.minimum(np.arange(len(f)) + 1, len(f) - 1)][:, _BESIDE])
        sums = []
        for at in (f, before, after):
            order = np.argsort(at.ravel(), kind="stable")
            some, begins = np.unique(at.ravel()[order], return_index=True)
            sums.append((order // at.shape[1], begins, some))
        return f, first, row, col, live, y, truth, sums

    def _gradients(self, f, first, row, col, live, y, truth, sums) -> tuple[int, list[np.ndarray]]:
        """Gradients of the summed log-likelihood, by scaled forward and backward sums over all
        sentences at once: each word's scores are taken from its best one and each step is scaled
        to one, so nothing vanishes."""
        (n, w), k = live.shape, self.step.shape[0]
        e = np.zeros((n, w, k))
        e[row, col] = self.emissions(f, first)
        e = np.exp(e - e.max(axis=2, keepdims=True))
        go = np.exp(self.step.astype(np.float64))
        fw, bw, scale = np.zeros((n, w, k)), np.ones((n, w, k)), np.ones((n, w, 1))
        fw[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, w):
            x = (fw[:, t - 1] @ go) * e[:, t]
            scale[:, t] = x.sum(axis=1, keepdims=True)
            fw[:, t] = np.where(live[:, t, None], x / scale[:, t], fw[:, t - 1])
        for t in range(w - 2, -1, -1):
            bw[:, t] = np.where(live[:, t + 1, None], (e[:, t + 1] * bw[:, t + 1] / scale[:, t + 1]) @ go.T, 1)
        d = -fw * bw
        d[np.arange(n)[:, None], np.arange(w)[None, :], y] += 1
        d = d[row, col]
        grads = []
        for order, begins, some in sums:
            grad = np.zeros((N_FEATURES + 1, k))
            grad[some] = np.add.reduceat(d[order], begins)
            grads.append(grad)
        ahead = np.where(live[:, 1:, None], e[:, 1:] * bw[:, 1:] / scale[:, 1:], 0)
        return n, [*grads, truth - go * np.tensordot(fw[:, :-1], ahead, axes=((0, 1), (0, 1)))]

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of padded rows (rows, steps, labels); padding gets label 0."""
        n, t_max, k = e.shape
        score, back = e[:, 0], np.zeros((n, t_max, k), np.int8)
        for t in range(1, t_max):
            total = score[:, :, None] + self.step[None]
            back[:, t] = total.argmax(axis=1)
            new = total.max(axis=1) + e[:, t]
            score = np.where((t < lengths)[:, None], new, score)
        y, out = score.argmax(axis=1), np.zeros((n, t_max), np.int8)
        for t in range(t_max - 1, -1, -1):
            live = t < lengths
            out[live, t] = y[live]
            if t:
                y = np.where(live, back[np.arange(n), t, y], y)
        return out

    def open_words(self, e: np.ndarray) -> np.ndarray:
        """Where a word may be other than outside: changing its label to outside loses no more
        than the two transitions around it can give."""
        gain = np.maximum((self.step - self.step[:, :1]).max(axis=0), 0) + np.maximum((self.step - self.step[:1]).max(axis=1), 0)
        return (e[:, 1:] + gain[1:] >= e[:, :1]).any(axis=1)

    def label(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of texts one after another: those of whole decoding of each."""
        n = len(e)
        out = np.zeros(n, np.int8)
        open_ = self.open_words(e)
        if not open_.any():
            return out
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        # stretches of open words of one text, with the fixed word on either side
        at = np.flatnonzero(open_)
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)])
        starts = np.maximum(at[new] - 1, first[:-1][doc[at[new]]])
        last = at[np.concatenate([new[1:], [True]])]
        ends = np.minimum(last + 2, first[1:][doc[last]])
        size = ends - starts
        order = np.argsort(size, kind="stable")
        s = 0
        while s < len(order):  # of like length, and so many that a batch stays small
            some = order[s : s + max(1, min(1024, (1 << 17) // int(size[order[s]])))]
            some = some[size[some] <= max(16, 2 * size[order[s]])]
            s += len(some)
            w = int(size[some].max())
            index = np.minimum(starts[some][:, None] + np.arange(w)[None, :], n - 1)
            y = self.viterbi(e[index], size[some])
            live = np.arange(w)[None, :] < size[some][:, None]
            out[index[live]] = y[live]
        return out


def training_table(seed: int = 7, rows: int = 3500) -> list[list[tuple[str, str]]]:
    """A small labelled table, made from a rule: sentences of plain words in some languages, with
    one or two items of personal data, secrets, or of harmless things that look like them among
    them: assignments of code and markup, dates, times, hashes, ids, book numbers, ranges."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "an ber co de ent fi gra ha il jo ka lu mo ne or pe qui re sa tion un ver wie ze ñe öl êt ße".split()
    common = "the of and to in la de le un der und die el los que est for with our my on at by from as is was they".split()
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    of = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    hexes, low, up, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def plain() -> str:
        w = pick(common) if rng.random() < 0.4 else "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
        return pick([w, w, w, w.capitalize(), w.upper()])

    def number() -> str:
        n = int(rng.integers(1, 4))
        return pick([d(n), d(n), f"{d(1)}.{d(1)}", f"{d(4)}", f"{d(2)}%", f"${d(2)}.{d(2)}", f"{d(2)}:{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(3)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(5)}", f"{d(1)},{d(3)},{d(3)}", f"x{d(1)}", f"{d(1)}rd", f"#{d(3)}", f"{d(6)}", f"{d(1)}.{d(1)}.{d(2)}"])

    host = lambda: ".".join([pick(["mail", "post", "mx", "corp", "inbox", "web"]) + pick(["", d(1), d(2)]), *([pick(["example", "acme", "site"])] if rng.random() < 0.7 else []), pick(["com", "org", "net", "de", "io"])])
    user = lambda: pick([plain().lower(), plain().lower() + "." + plain().lower(), plain().lower() + "." + d(2), plain().lower() + d(3), of(low, 1) + "_" + plain().lower()])
    names = ["password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_token", "auth_token", "client_secret", "secret_key", "private_key", "db_password"]
    harmless = "name class id sort order type lang page size href src style width height x y value q user mode path version build rev commit sha sha1 sha256 md5 etag checksum digest hash uuid date time isbn isbn-13 isbn-10 issn doi".split()
    secret = lambda: pick([of(hexes, 32), of(hexes, 40), of(hexes, 24), of(mixed, 20), of(mixed, 36), of("abcdef", 24), of(low, 20)])
    key = lambda: pick([pick(["AKIA", "ASIA"]) + of(up + "234567", 16), pick(["AKIA", "ASIA"]) + of(up, 16), "ghp_" + of(mixed, int(rng.integers(14, 37))), "ghp_" + of(low, 16), "sk-" + of(mixed, int(rng.integers(16, 41))), "sk-" + of(low, 16), jwt()])
    jwt = lambda: pick(["eyJhbGciOi", "eyJ0eXAiOi", "eyJraWQiOi"]) + of(mixed, int(rng.integers(10, 30))) + ".eyJ" + of(mixed, int(rng.integers(10, 60))) + "." + of(mixed + "_-", int(rng.integers(20, 44)))
    called = lambda: pick([pick(harmless), pick(harmless), plain().lower(), of(low, int(rng.integers(1, 4))), plain().lower() + pick("_-") + plain().lower()])
    digest = lambda: of(hexes, pick([7, 8, 10, 12, 16, 32, 32, 40, 40, 40, 56, 64, 64, 128]))
    uuid = lambda: "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12))
    day = lambda: f"{pick(['19', '20'])}{d(2)}-{pick(['0' + d(1), '10', '11', '12'])}-{pick('0123')}{d(1)}"
    clock = lambda: pick([f"{pick('012')}{d(1)}:{pick('012345')}{d(1)}", f"{pick('012')}{d(1)}:{pick('012345')}{d(1)}:{pick('012345')}{d(1)}"])
    moment = lambda: day() + pick("T_") + clock() + pick(["", "Z", "Z", "." + d(3) + "Z", "+0" + d(1) + ":00"])
    book = lambda: pick([f"{pick(['978', '979'])}{d(10)}", f"{pick(['978', '979'])}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)}-{d(3)}-{d(5)}-{pick([d(1), 'X'])}", f"{d(9)}X", f"{d(4)}-{d(4)}"])
    value = lambda: pick([plain().lower(), plain().lower(), of(low, int(rng.integers(2, 14))), plain().lower() + "-" + plain().lower(), plain() + "_" + plain(), d(int(rng.integers(1, 7))), plain().lower() + d(int(rng.integers(1, 4))), digest(), uuid(), day(), f"{d(3)}px", "#" + of(hexes, 6), f"/{plain()}/{plain()}.png", f"{plain()}()", of(mixed, int(rng.integers(4, 12)))])
    code = lambda: pick([of(low, int(rng.integers(2, 8))) + d(int(rng.integers(1, 4))) + pick(["", of(low, 1), of(up, 1), "!"]), of(mixed[:26] + mixed[52:], int(rng.integers(6, 11)))])
    quoted = lambda w: pick(['"%s"', "'%s'", "%s"]) % w
    said = lambda: pick([str.lower, str.upper, str.capitalize])(pick(names))
    items = [
        lambda: [(f"{user()}@{host()}", "email")],
        lambda: [(".".join(str(x) for x in rng.integers(0, 256, 4)), "ip")],
        lambda: [(d(int(rng.integers(13, 20))), "card")],
        lambda: [(d(16), "card")],
        lambda: [("-".join(d(4) for _ in range(4)), "card")],
        lambda: [(d(4), "card") for _ in range(4)],
        lambda: [("+" + d(int(rng.integers(1, 3))), "phone"), (f"({d(3)})", "phone"), (f"{d(3)}-{d(4)}", "phone")],
        lambda: [("+" + d(2), "phone"), (d(3), "phone"), (d(3), "phone"), (d(4), "phone")],
        lambda: [(f"({d(3)})", "phone"), (f"{d(3)}-{d(4)}", "phone")],
        lambda: [(f"{pick('23456789')}{d(2)}-{d(3)}-{d(4)}", "phone")],
        lambda: [("+" + d(int(rng.integers(9, 15))), "phone")],
        lambda: [(f"{d(3)}-{d(2)}-{d(4)}", "ssn")],
        lambda: [(key(), "secret")],
        lambda: [(f"{said()}={pick([secret(), of(low, int(rng.integers(3, 20))), of(mixed, int(rng.integers(4, 20))), plain().lower() + plain().lower()])}", "secret")],
        lambda: [(said(), "O"), (pick(["=", ":", ":="]), "O"), (pick(['"%s"', "'%s'"]) % secret(), "secret")],
        lambda: [(said(), "O"), ("=", "O"), (pick(['"%s"', "'%s'"]) % of("abcdef", int(rng.integers(20, 33))), "secret")],
        lambda: [(pick([pick(["AKIA", "ASIA"]) + of(up, 16), "ghp_" + of(low, 16), "sk-" + of(low, int(rng.integers(14, 24)))]), "secret")],
        lambda: [(f"{said()}={of(low, int(rng.integers(2, 12)))}", "secret")],
        lambda: [(said(), "O"), (pick(["=", "=", ":", ":="]), "O"), (pick(['"%s"', "'%s'"]) % of(hexes, pick([32, 40, 40, 64])), "secret")],
        lambda: [(said(), "O"), (pick(["=", "=", ":", ":="]), "O"), (pick(['"%s"', "'%s'"]) % of(hexes, pick([32, 40, 40, 64])), "secret")],
        lambda: [(said() + ":", "O"), (secret()[:24] + d(2), "secret")],
        lambda: [(said() + ":", "O"), (pick([code(), code().capitalize(), pick(up) + code(), of(mixed, 8) + d(1), digest()]), "secret")],
        lambda: [(f"{said()}={quoted(pick([code(), code().capitalize(), secret(), jwt()]))}", "secret")],
        lambda: [(f"{said()}={pick([code(), code(), of(mixed, int(rng.integers(5, 16))), plain().lower() + d(2)])}", "secret")],
        lambda: [(f"{said()}={code()}", "secret")],
        lambda: [(said() + ":", "O"), (code(), "secret")],
        lambda: [(f'"{said()}":', "O"), (f'"{pick([secret(), code(), code().capitalize()])}"', "secret")],
        lambda: [(pick(["Bearer", "bearer", "Authorization:", plain()]), "O"), (jwt(), "secret")],
        lambda: [(f"{called()}={quoted(value())}", "O")],
        lambda: [(f"{called()}={quoted(value())}", "O") for _ in range(3)],
        lambda: [(f"{called()}={quoted(value())}", "O"), (pick(["class", "id", "name"]) + f'="{value()}">', "O")],
        lambda: [(called(), "O"), (pick(["=", ":", ":=", "=="]), "O"), (quoted(value()), "O")],
        lambda: [(f"{called()}:", "O"), (quoted(value()), "O")],
        lambda: [(f'"{called()}":', "O"), (f'"{value()}",', "O")],
        lambda: [(quoted(digest()), "O")],
        lambda: [(pick(["commit", "sha256:", "md5:", "SHA1", "revision", "merge", "index", "object", plain()]), "O"), (digest(), "O")],
        lambda: [(pick(["commit ", "sha256:", "md5:", "sha1-", "rev=", "@"]).strip() + digest(), "O")],
        lambda: [(called(), "O"), ("=", "O"), (f'"{digest()}"', "O")],
        lambda: [(uuid(), "O")],
        lambda: [(moment(), "O")],
        lambda: [(day(), "O"), (clock(), "O")],
        lambda: [(pick(["ISBN", "ISBN-13:", "ISBN-10:", "ISBN:", "ISSN", "EAN", "isbn"]), "O"), (book(), "O")],
        lambda: [(pick(["ISBN-13:", "ISBN-10:", "ISBN:", "ISSN:", "isbn="]) + book(), "O")],
        lambda: [(f"{pick('01')}{d(2)}-{d(3)}-{d(4)}", "O")],
        lambda: [(pick(["pp.", "pages", "lines", plain()]), "O"), (pick([f"{d(2)}-{d(2)}", f"{d(3)}-{d(3)}", f"{d(4)}-{d(4)}", f"19{d(2)}-20{d(2)}"]), "O")],
        lambda: [(pick(["section", plain()]), "O"), (pick([f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}-{plain().lower()}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(7)}", f"{d(8)}", f"{d(10)}", f"{d(12)}"]), "O")],
        lambda: [(pick([plain().lower() + plain().capitalize() + plain().capitalize(), plain().upper() + "_" + plain().upper() + "_" + d(2), of(up, 3) + "-" + d(4), plain().lower() + "_" + plain().lower() + "()", f"{plain().lower()}.{plain().lower()}({plain().lower()})"]), "O")],
        lambda: [(number(), "O")],
        lambda: [(number(), "O"), (pick(["-", "to", "|", "/", "and"]), "O"), (number(), "O")],
        lambda: [(x, "O") for x in (plain().capitalize(), pick(["BY-NC", "GPL", "MIT", "ISO", "Version", "page", "No."]), number() + ".")],
        lambda: [(plain() + pick(["!!", "***", "%%%", "&&&", "###", "$$$", "|", "...", "…", '"', ")"]), "O") for _ in range(3)],
        lambda: [(pick(["=", "|", "--", "***", "###", "+", "•", "@", "&", "#", "!!"]), "O"), (plain(), "O")],
        lambda: [(x, "O") for x in pick([("a", "=", "b"), ("x=y",), (plain() + "=" + plain(),), ("password:", plain()), (pick(names), plain()), ("token", plain()), ("ghp_",), ("AKIA",), ("ASIAN",), ("sk-" + plain().lower()[:9],), ("sk-" + of(low, int(rng.integers(4, 11))), plain()), ("secret", "="), ("foo_bar",), (plain() + "-" + plain(),)])],
        lambda: [("http://" + host() + "/" + plain().lower(), "O")],
        lambda: [(plain() + "." + pick(["txt", "py", "md"]), "O")],
        lambda: [(plain() + pick([".", ",", ";", ":", "?", "!"]), "O"), (plain(), "O")],
        lambda: [("".join(plain() for _ in range(4)), "O")],
        lambda: [(pick(["x", "ab", "日本語", "é"]) * int(rng.integers(1, 9)), "O")],
    ]
    noise = ["", "", "", "", ".", ",", "!!", "***", "%%%", "&&&", "###", "$$$", ";"]

    def sentence() -> list[tuple[str, str]]:
        item = [(w, y) for w, y in pick(items)()]
        if rng.random() < 0.5:
            item[-1] = (item[-1][0] + pick(noise), item[-1][1])
        around = lambda: [(plain() + pick(noise), "O") for _ in range(rng.integers(0, 5))]
        return [*around(), *item, *around()] or [(plain(), "O")]

    return [sentence() for _ in range(rows)]


@lru_cache(maxsize=1)
def trained() -> CRF:
    """The field, trained once a process; the same in each."""
    return CRF().fit(training_table())


# -- whole texts ----------------------------------------------------------------------------

_RANK = {k: i for i, k in enumerate((*KINDS, "ssn", "secret"))}


def field_spans(data: np.ndarray, offsets: np.ndarray, model: CRF) -> list[list[tuple[str, int, int]]]:
    """For each text the spans (code points) that the field labels: neighbouring words of one label
    join, without the signs at their ends. An address or a card must pass the same check as a
    pattern's match."""
    n = len(offsets) - 1
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
    start, end, first = words(data, offsets)
    if not len(start):
        return found
    y = model.label(model.emissions(features(data, start, end, first), first), first)
    at = np.flatnonzero(y)
    if not len(at):
        return found
    doc = np.searchsorted(first, at, "right") - 1
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc) > 0) | (np.diff(y[at]) != 0)])
    begin, stop = at[new], at[np.concatenate([new[1:], [True]])]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for i, j, d in zip(begin.tolist(), stop.tolist(), doc[new].tolist(), strict=True):
        kind = LABELS[y[i]]
        # a run of a kind that is one word is one span for each word
        for a, b in [(start[i], end[j])] if kind in ("phone", "card") else [(start[x], end[x]) for x in range(i, j + 1)]:
            core = np.flatnonzero(_ALNUM[data[a:b]])
            if not len(core):
                continue
            lead = int(a + core[0])
            if kind == "phone" and lead > a and data[lead - 1] in b"(+":
                lead -= 1
            a, b = lead, int(a + core[-1] + 1)
            if kind in ("card", "ip"):
                said = data[a:b].tobytes().decode("utf-8", "replace")
                if not (is_card(said) if kind == "card" and re.fullmatch(r"[0-9 -]+", said) else kind == "ip" and next(ips(said), None) == (0, len(said))):
                    continue
            found[d].append((kind, int(chars[a] - chars[offsets[d]]), int(chars[b] - chars[offsets[d]])))
    return found


def _merged(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans, and of the others those that overlap none of them, by kind and start."""
    if base and more:
        taken = sorted((a, b) for _, a, b in base)
        begins = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken])  # the furthest end so far
        last = np.searchsorted(begins, [s[2] for s in more]) - 1  # of those that begin before a span's end
        more = [s for s, i in zip(more, last.tolist(), strict=True) if i < 0 or reach[i] <= s[1]]
    return sorted(base + more, key=lambda s: (_RANK[s[0]], s[1], s[2]))


def all_spans(text: str, model: CRF) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those with the field's spans that overlap none of them."""
    data, off, _ = utf8(pa.array([text], pa.string()))
    base = base_spans(text)
    return base, _merged(base, field_spans(data, off, model)[0])


def batch_spans(texts: pa.Array, model: CRF) -> Iterator[tuple[str | None, list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Each text with what all_spans has for it."""
    data, off, _ = utf8(texts)
    for t, more in zip(texts.to_pylist(), field_spans(data, off, model), strict=True):
        base = base_spans(t or "")
        yield t, base, _merged(base, more)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
BATCH_BYTES = 1 << 18  # of text; the arrays made of it take some hundred bytes a word


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: kind, start and end (code points, end exclusive) and whether a pattern
    found it, ordered by kind and start. Null and empty texts have none. A column of the input
    with that name gives way; repeated rows stay."""
    df = without(df, "spans")
    schema = T.StructType([*df.schema.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])))])
    model = trained()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(BATCH_BYTES, text)(it):
            out = []
            for _, base, spans in batch_spans(b.column(b.schema.get_field_index(text)), model):
                known = set(base)
                out.append([{"kind": k, "start": a, "end": z, "base": (k, a, z) in known} for k, a, z in spans])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _SPANS)], [*b.schema.names, "spans"])

    return df.mapInArrow(lean(run), schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``text`` with each span replaced by ``<kind>``; null stays null."""
    model = trained()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(BATCH_BYTES, text)(it):
            i = b.schema.get_field_index(text)
            out = []
            for t, _, spans in batch_spans(b.column(i), model):
                if spans:
                    parts, last = [], 0
                    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if z <= last:
                            continue
                        parts += [t[last : max(a, last)], f"<{kind}>" if a >= last else ""]
                        last = z
                    t = "".join(parts) + t[last:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, b.schema.field(i).type) if j == i else c for j, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(lean(run), df.schema)
