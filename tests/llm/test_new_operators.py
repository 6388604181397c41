"""Collocations, toxicity and fill-in-middle against brute force, models and odd tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm import collocations, decontaminate, infill, langid, quality, queries, toxicity, url_filter
from codeatlas.llm.common import utf8

from test_oracles import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", ["op11_collocations", "op13_fill_in_middle"])
def test_sql(name, spark, sf, duck):  # noqa: F811
    assert plain(queries.QUERIES[name](spark, sf).toPandas()) == plain(duck.sql(queries.ORACLES[name]).df())


# -- collocations ---------------------------------------------------------------------------


def brute_collocations(docs, least, top):
    lower = {i: i + 32 for i in range(65, 91)}
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][" ".join(w[i : i + k])] += 1
    out = []
    for lang in n:
        c = f[lang]
        candidates = {p: a for p, a in c.items() if a >= least and " " in p}
        gone = set()
        for p, a in candidates.items():
            w = p.split(" ")
            gone |= {q for k in range(2, len(w)) for i in range(len(w) - k + 1) if c[q := " ".join(w[i : i + k])] <= a}
        found = []
        for p in candidates.keys() - gone:
            w, a = p.split(" "), candidates[p]
            score, k = min((1000 * a * n[lang] // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w)))
            found.append((-score, -a, p.encode(), p, c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(lang, i + 1, p, -a, x, y, n[lang], -s) for i, (s, a, _, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed,least,top,batch", [(1, 2, 30, 1 << 20), (2, 3, 2000, 200), (3, 2, 7, 1)])
def test_collocations(spark, seed, least, top, batch):
    """Few words, so that phrases of all lengths repeat; small shards, so that counts meet across them."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "der", "Öl", "x-y", "日本"]) if rng.random() < 0.8 else rng.choice(["one two three four five six", "a a a a a a"])
    sign = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"])
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(word() + sign() for _ in range(rng.randint(0, 60)))) for _ in range(40)]
    docs += [("en", None), ("fr", ""), ("fr", " .\n"), ("en", docs[0][1]), ("en", docs[0][1])]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = collocations.collocations(df, least, top, batch_bytes=batch)
    assert sorted(map(tuple, got.collect())) == brute_collocations(docs, least, top)


def test_collocations_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []
    named = spark.createDataFrame([("x y " * 300, "en", 1, 2, "p", 3)], "text string, lang string, k int, f int, phrase string, n int")
    assert [r["phrase"] for r in collocations.collocations(named).collect()] == [r[2] for r in brute_collocations([("en", "x y " * 300)], 100, 2000)]


def test_automaton_states():
    """Every substring of up to five words belongs to one state, with its number of places."""
    rng = random.Random(5)
    for _ in range(20):
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(4)]
        data, off, _ = utf8(pa.array(texts))
        shard = collocations.Shard(data, off, np.zeros(4, np.int64))
        want = collections.Counter(tuple(w[i : i + k]) for t in texts for w in [t.split()] for k in range(1, 6) for i in range(len(w) - k + 1))
        text, got = shard.data.tobytes().decode().split(), {}
        for place, longest, shortest, count in shard.states(5, shard.fresh):
            for p, low, c in zip(place, shortest, count, strict=True):
                for k in range(low, longest + 1):
                    key = tuple(text[p - k + 1 : p + 1])
                    assert key not in got
                    got[key] = c
        assert got == want


# -- fill-in-middle -------------------------------------------------------------------------


def brute_infill(doc_id, text):
    text = text or ""
    t = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, s = "".join(t[:i]), "".join(t[i:j]), "".join(t[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark):
    rng = random.Random(3)
    odd = ["", None, "a", "<P>", "<", "<S", ">" * 5, "x<M>y", "<<S", "ab\ncd é 日本語 \U0001f600 z", "\r\n\t", "word" * 5000, "é" * 3000, "a b" * 20000]
    texts = odd + ["".join(rng.choice(["ab", "Z", " ", "<", "S>", "é", "日", "\n", "\U0001f600", "7"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "<P>"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, OUTPUT string, h0 int")
    got = infill.restore(infill.transform(df))
    assert got.columns == ["doc_id", "text", "h0", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    said = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got.collect()), key=repr)
    assert said == sorted(((i, t, *brute_infill(i, t)) for i, t in rows), key=repr)
    assert got.where("restored <> coalesce(text, '')").count() == 0
    assert infill.restore(infill.transform(df.limit(0))).collect() == []


@given(st.lists(st.booleans(), max_size=2000))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(flags):
    bits = infill.Bits(np.array(flags, bool))
    total = np.concatenate([[0], np.cumsum(flags)]).astype(int)
    assert bits.rank(np.arange(len(flags) + 1)).tolist() == total.tolist()
    assert bits.select(np.arange(total[-1])).tolist() == np.flatnonzero(flags).tolist()


# -- toxicity -------------------------------------------------------------------------------

ENGLISH = "the stupid man said that the idiot was a loser and the clown is trash in this town of stone and salt with clean water and other things that people like to read about each other every day".split()


def model_of(texts):
    return toxicity.model_of(toxicity.trigrams(*utf8(pa.array(texts))[:2]).reshape((toxicity.N,) * 3).astype(float))


def test_trigrams():
    texts = ["Ab é.c", "", "x"]
    want = collections.Counter()
    symbol = lambda b: 27 if b >= 128 else ord(chr(b).lower()) - 96
    seq = [0, 0]
    for word in ("Ab", "é", "c", "x"):
        seq += [*map(symbol, word.encode()), 0, 0]
    for i in range(len(seq) - 2):
        want[tuple(seq[i : i + 3])] += 1
    got = toxicity.trigrams(*utf8(pa.array(texts))[:2]).reshape((toxicity.N,) * 3)
    assert {k: int(got[k]) for k in zip(*np.nonzero(got), strict=True)} == {k: v for k, v in want.items()}


def test_decode_is_the_best_way():
    """Viterbi against all ways through small lattices."""
    import itertools

    rng = np.random.default_rng(4)
    lm = model_of([" ".join(ENGLISH)])
    for steps in (1, 2, 3, 4):
        a, b = rng.integers(1, 27, (5, steps, 3)), rng.integers(-1, 27, (5, steps, 3))
        cost = rng.random((5, steps, 3)).astype(np.float32)
        cost[rng.random(cost.shape) < 0.2] = np.inf
        cost[:, :, 0] = 1
        got = toxicity.decode(lm, a, b, cost)
        for r in range(5):

            def price(way, r=r):
                seq = [0, 0] + [s for t, k in enumerate(way) for s in (a[r, t, k], b[r, t, k]) if s >= 0] + [0]
                return sum(lm[seq[i - 2], seq[i - 1], seq[i]] for i in range(2, len(seq))) + sum(cost[r, t, k] for t, k in enumerate(way))

            assert price(got[r]) == pytest.approx(min(map(price, itertools.product(range(3), repeat=steps))), rel=1e-5)


def test_restore(spark):
    lm = model_of([" ".join(ENGLISH) + " "] * 3)
    cases = {
        "you 1d10t": "you idiot", "STUUUPID man": "stupid man", "a l o s e r": "a l o s e r".replace("a l o s e r", "aloser"), "x l.o.s.e.r!": "x loser!", "the tr@sh": "the trash",
        "cl0wn, st0ne": "clown, stone", "the idiot": "the idiot", "": "", "plain words": "plain words", "日本 1diot": "日本 idiot", "12 34": "12 34", "wait!!!": "wait!!!",
    }
    df = spark.createDataFrame([(k, "gone") for k in cases] + [(None, "gone")], "text string, restored string")
    got = {r["text"]: r["restored"] for r in toxicity.restore(df, lm).collect()}
    assert got.pop(None) is None
    assert got["you 1d10t"] == "you idiot" and got["STUUUPID man"] == "stupid man" and got["x l.o.s.e.r!"].startswith("x loser")
    for same in ("the idiot", "", "plain words", "12 34", "the tr@sh", "cl0wn, st0ne", "日本 1diot"):
        assert got[same] == cases[same]


def test_restore_whatever_the_batch():
    """A text's restoration doesn't depend on its neighbours, and long texts end."""
    lm = model_of([" ".join(ENGLISH)])
    rng = random.Random(8)
    texts = ["".join(rng.choice(["1d10t ", "stone ", "l o s e r ", "a.b.c.d.e ", "$$$ ", "x", "0", "\n", "é", "zzzz", " "]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["a1" * 3000, "a " * 5000, "." * 5000, "aaaa" * 4000, "a.b." * 500]
    data, off = toxicity.restore_batch(lm, *utf8(pa.array(texts))[:2])
    together = [data[off[i] : off[i + 1]].tobytes() for i in range(len(texts))]
    for t, x in zip(texts, together, strict=True):
        d, o = toxicity.restore_batch(lm, *utf8(pa.array([t]))[:2])
        assert d[o[0] : o[1]].tobytes() == x


def toxic_tables(spark, n=400):
    rng = random.Random(9)
    bad = ["idiot", "loser", "trash", "stupid"]
    clean = [w for w in ENGLISH if w not in bad]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(40)]
        y = i % 5 == 0
        if y:
            for _ in range(3):
                w.insert(rng.randrange(40), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 2 == 0)
    new = spark.createDataFrame([(1, "the 1di0t was a l o s e r"), (2, "the town of stone"), (3, ""), (4, None), (5, "trash"), (6, "TRAAASH"), (6, "TRAAASH"), (7, "one trash and one idiot " * 20000)], "doc_id long, text string")
    wide = new.withColumn("score", F.lit("x")).withColumn("PREDICTED", F.lit(3)).withColumn("restored", F.lit(1)).withColumn("y", F.lit(1))
    got = toxicity.classify(wide, model)
    assert got.columns == ["doc_id", "text", "restored", "y", "score", "predicted"]
    said = {r["doc_id"]: (r["score"], r["predicted"]) for r in got.collect()}
    assert {i for i, (_, p) in said.items() if p} == {1, 5, 6, 7} and got.count() == 8
    assert said[3] == said[4] == said[2]
    held = toxicity.classify(docs, model).join(labels, "doc_id").where("doc_id % 2 = 1")
    assert held.where("predicted = toxic").count() / held.count() > 0.98


def test_toxicity_odd_tables(spark):
    docs, labels = toxic_tables(spark, 60)
    none = toxicity.fit(docs, labels, F.lit(False))
    assert {r["score"] for r in toxicity.classify(docs, none).collect()} == {0.5}
    empty = toxicity.fit(docs.limit(0), labels, F.lit(True))
    assert toxicity.classify(docs.limit(0), empty).collect() == []
    # one id in many rows stays within the bound
    many = docs.crossJoin(spark.range(50)).select("doc_id", F.concat("text", F.col("id").cast("string")).alias("text"))
    assert toxicity._sample(many, labels, F.lit(True), "toxic", 30).count() == 30
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (0, 0)], "doc_id long, toxic int"))
    assert toxicity.classify(docs, toxicity.fit(docs.unionByName(docs), odd, F.lit(True))).count() == 60


def test_toxicity_held_out(spark, sf):
    got = queries.op12_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() / got.count() > 0.92


# -- bounds and clashes of earlier operators ------------------------------------------------


@pytest.mark.parametrize("name", ["_key", "_hard", "_maybe", "_listed", "key", "hard", "block", "maybe", "listed", *(f"w{i}" for i in range(8)), "W3", "host", "Path", "rule", "VERDICT", "a.b", "url2"])
def test_url_filter_clashes(spark, name):
    urls = [("http://a.io/x", "mine"), ("http://b.io/y", "mine"), ("http://x.com/en/1", "mine"), (None, "mine")]
    d = spark.createDataFrame(urls, ["url", name])
    out = url_filter.filter_urls(d, spark.createDataFrame([("http://a.io/x",)], "url string"))
    assert sorted((r["url"] or "", r["verdict"]) for r in out.collect()) == [("", "allow"), ("http://a.io/x", "block"), ("http://b.io/y", "allow"), ("http://x.com/en/1", "block")]
    if name.lower() not in ("host", "path", "rule", "verdict"):
        assert {r[name] for r in out.collect()} == {"mine"}


CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_rules_are_the_contracts(spark):
    """Each rule's word, and the verdict of a page that it fits and that isn't listed."""
    want = [(r.split()[1], r.split()[0]) for r in CONTRACT.split(", ")]
    assert [(h + p, "block" if b else "allow") for h, p, b in url_filter.RULES] == want
    urls = [("http://x.com/en/1", "com/en/"), ("http://example.com/en/7", "example.com/en/7"), ("http://example.net/de/1", "net/de/"), ("http://example.net/de/8", "example.net/de/8"), ("http://a.org/es/1", "org/es/")]
    for listed in (0, len(urls)):  # a rule that fits outweighs the list
        d = spark.createDataFrame(urls, "url string, want string")
        out = url_filter.filter_urls(d, d.select("url").limit(listed)).collect()
        assert {(r["want"], r["rule"], r["verdict"]) for r in out} == {(n, n, w) for n, w in want}


def test_one_id_in_many_rows(spark):
    """What a fit brings to the driver is bounded by ids, not rows."""
    got = []
    collect = DataFrame.collect

    def counted(self):
        rows = collect(self)
        got.append(len(rows))
        return rows

    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("der Hund und die Katze gehen in das alte Haus "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(1, "the dog and the cat go home to the old house", "en")] * 3, "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(7, 1), (1, 0)], "doc_id long, quality int")
    DataFrame.collect = counted
    kind = type(docs)
    before = kind.collect
    kind.collect = counted if kind is DataFrame else (lambda self, f=before: (got.append(len(x := f(self))), x)[1])
    try:
        net = langid.fit(docs, F.lit(True))
        model = quality.fit(docs, labels, F.lit(True))
    finally:
        kind.collect, DataFrame.collect = before, collect
    assert net.langs == ["de", "en"] and len(model.y) == 2
    assert got and max(got) <= 16


def test_quality_ties():
    """Of equally near neighbours those that come first vote."""
    texts = ["alpha beta gamma"] * 40 + ["one two, three!"] * 5
    model = quality.Model(texts, [1] * 15 + [0] * 25 + [0] * 5)
    data, off, _ = utf8(pa.array(["alpha beta gamma"]))
    assert model.score(data, off)[0] == pytest.approx(1.0)
    model = quality.Model(texts, [0] * 15 + [1] * 25 + [0] * 5)
    assert model.score(data, off)[0] == pytest.approx(0.0)


def test_short_benchmark_items(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a cat"), (3, "concatenate a"), (4, "CAT!"), (5, "x y z"), (6, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "cat"), (3, "cat sat"), (4, "y z")], "item_id long, text string")
    got = {r["doc_id"]: [(m["item_id"], m["start"], m["end"]) for m in r["matches"]] for r in decontaminate.find(docs, items).collect()}
    assert got == {1: [(2, 4, 7), (3, 4, 11)], 2: [(1, 0, 1), (2, 2, 5)], 3: [(1, 12, 13)], 4: [(2, 0, 3)], 5: [(4, 2, 5)], 6: []}
    assert {m["item_id"] for r in decontaminate.find(docs, items, min_chars=7).collect() for m in r["matches"]} == {3}
