"""Queries and stages against brute force, and their behaviour on odd tables."""

import base64
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeatlas.llm import common, decontaminate, fingerprint, langid, ngram_join, quality, queries

from .test_text_operators import brute_winnow, distance


@pytest.fixture(scope="module")
def texts(spark, sf):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


# -- models ---------------------------------------------------------------------------------


def test_network_forward():
    """The network's states and document probabilities, one step and one unit at a time."""
    net = langid.Network(["a", "b", "c"], hidden=3)
    soft = lambda x: x / (1 + abs(x))
    gate = lambda x: (1 + soft(x)) / 2

    def states(d, symbols):
        s, out = [0.0] * 3, []
        for x in symbols:
            z = [gate(d.e[x][j] + sum(s[i] * d.u[i][j] for i in range(3))) for j in range(3)]
            r = [gate(d.e[x][3 + j] + sum(s[i] * d.u[i][3 + j] for i in range(3))) for j in range(3)]
            c = [soft(d.e[x][6 + j] + sum(r[i] * s[i] * d.c[i][j] for i in range(3))) for j in range(3)]
            s = [s[j] + z[j] * (c[j] - s[j]) for j in range(3)]
            out.append(s)
        return out

    for text in ("Haus und Hof", "é" * 50 + " der " * 20, "x"):
        data, off, _ = common.utf8(pa.array([text], pa.string()))
        total = np.zeros(3)
        for start in range(0, len(data), langid.WINDOW):
            window = [int(langid._SYMBOL[b]) for b in data[start : start + langid.WINDOW]]
            padded = window + [0] * (langid.WINDOW - len(window))
            f, b = states(net.f, padded), states(net.b, padded[::-1])[::-1]
            for t, x in enumerate(window):
                if 1 < x < langid.N_SYMBOLS - 1:
                    p = np.exp(np.array(f[t] + b[t]) @ net.w.astype(float) + net.bias)
                    total += p / p.sum()
        want = total / max(total.sum(), 1e-30)
        assert np.allclose(net.documents(data, off)[0], want, atol=1e-4)


def test_exact_neighbours(texts):
    """Every cosine with every labelled vector, one by one."""
    some = [t for _, t in texts if t][:90]
    labels = [i % 2 for i in range(60)]
    model = quality.Model(some[:60], labels)
    data, off, _ = common.utf8(pa.array(some, pa.string()))
    got = model.score(data, off)
    counts = quality.term_counts(data, off)
    for i in range(len(some)):
        v = model._scale(counts[i : i + 1])[0].astype(float) @ model.project.astype(float)
        v /= max(np.sqrt((v * v).sum()), 1e-9)
        sims = sorted(((float(sum(a * b for a, b in zip(v, w, strict=True))), y) for w, y in zip(model.v.astype(float), labels, strict=True)), reverse=True)
        near = [(max(s, 0) ** 2 + 1e-6, y) for s, y in sims[: quality.NEIGHBOURS]]
        # equal texts tie at the last place: any of them may be taken
        if abs(sims[quality.NEIGHBOURS - 1][0] - sims[quality.NEIGHBOURS][0]) > 1e-4:
            assert abs(got[i] - sum(w * y for w, y in near) / sum(w for w, _ in near)) < 1e-3


def test_whole_texts_are_learned_from(spark):
    """Neither model looks at a prefix only."""
    lead = "Shared licence line in one language only. " * 600
    tails = {"aa": "kala muna tiko ", "bb": "strength through growth "}
    rows = [(i, lead + tails[g] * 900, g, int(g == "aa")) for i, g in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    model = langid.fit(docs, F.lit(True))
    new = spark.createDataFrame([(1, tails["aa"] * 5), (2, tails["bb"] * 5)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(new, model).orderBy("doc_id").collect()] == ["aa", "bb"]
    m = quality.fit(docs.select("doc_id", "text"), docs.select("doc_id", F.col("y").alias("quality")), F.lit(True))
    got = [r["score"] for r in quality.classify(docs.select("doc_id", "text"), m).orderBy("doc_id").collect()]
    assert min(got[::2]) > 0.9 and max(got[1::2]) < 0.1


# -- queries --------------------------------------------------------------------------------


def test_winnowing_query(spark, sf, texts):
    got = {r["doc_id"]: r for r in queries.op2_winnowing(spark, sf).collect()}
    assert len(got) == len(texts)
    mark = lambda t: [h for h, _ in brute_winnow(t, fingerprint.K, fingerprint.W)]
    said = lambda hs: "".join(f"{h:08x}" for h in hs)
    for i, (doc, t) in enumerate(texts):
        if len(t) > 4000:
            continue
        nxt = texts[(i + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, r = mark(t), mark(edited), got[doc]
        alike = len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (said(a), said(b)) and abs(r["near_edited"] - alike) < 1e-9
        if len(nxt) <= 4000:
            c = mark(nxt)
            assert abs(r["near_next"] - (len({*a} & {*c}) / len({*a} | {*c}) if a or c else 1.0)) < 1e-9


def test_bpe_query(spark, sf, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in queries.op3_byte_bpe(spark, sf).collect()}
    for doc, t in texts:
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_token_file_query(spark, sf, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got, at = {r["doc_id"]: r for r in queries.op6_token_files(spark, sf).collect()}, 0
    for doc, t in texts:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_decontamination_query(spark, sf, texts):
    items = {r["item_id"]: decontaminate.normalise(r["text"] or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op9_decontamination(spark, sf).collect()}
    want = {}
    for doc, t in texts:
        n = decontaminate.normalise(t)
        if len(n) <= 6000:
            for item, x in items.items():
                if x:
                    d, _ = decontaminate.myers(decontaminate.masks(x), len(x), n, decontaminate.budget(x))
                    if d <= decontaminate.budget(x):
                        want[doc, item] = d
    short = {doc for doc, t in texts if len(decontaminate.normalise(t)) <= 6000}
    assert want and {k: v for k, v in got.items() if k[0] in short} == want


def test_myers_is_edit_distance():
    rng = random.Random(8)
    for _ in range(300):
        n, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 70))) for _ in range(2))
        assert decontaminate.myers(decontaminate.masks(n), len(n), t, len(n))[0] == min(distance(n, t), len(n) + 1)


def test_periodic_items():
    """Repetitive items, where one item's pieces are equal: none missed, distances the least."""
    rng = random.Random(3)
    for _ in range(1500):
        unit = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 3)))
        n = decontaminate.normalise((unit * 40)[: rng.randint(12, 40)] + "".join(rng.choice("ab c") for _ in range(6)))
        if len(n) < 8:
            continue
        t = list(n)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("abx")
        text = decontaminate.normalise("zz " * rng.randint(0, 3) + "".join(t) + rng.choice(["", " ww", " " + n[:9]]))
        d, got = distance(n, text), decontaminate.Matcher([(1, n)], 8).matches(text)
        assert [m[1] for m in got] == ([d] if d <= len(n) // 8 else [])


def test_items_in_passes(spark, sf):
    """More items than may be broadcast give the same as all at once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(40)).unionByName(spark.createDataFrame([(None, None), (5, "")], "doc_id long, text string"))
    docs = docs.withColumn("KEY_1", F.lit("mine")).withColumn("Matches", F.lit(1))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    items = items.unionByName(items.limit(3)).unionByName(spark.createDataFrame([(1, None), (2, "!")], "item_id long, text string"))
    seen = lambda df: sorted((r["doc_id"] or -1, zlib.crc32((r["text"] or "").encode()), r["KEY_1"], tuple((m["item_id"], m["edits"], m["start"], m["end"]) for m in r["matches"])) for r in df.collect())
    whole = decontaminate.find(docs, items)
    parts = decontaminate.find(docs, items, max_items=max(1, items.count() // 4))
    small = decontaminate.find(docs, items, max_bytes=1500)
    assert whole.columns == parts.columns == ["doc_id", "text", "KEY_1", "matches"]
    assert seen(whole) == seen(parts) == seen(small) and any(r[3] for r in seen(whole))


# -- joins ----------------------------------------------------------------------------------


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (3, b + " z"), (None, a), (None, None), (4, "")]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {}
    for r in got.collect():
        by.setdefault(r["component_key"], []).append((r["doc_id"], r["component_id"], r["n_links"]))
    parts = sorted(sorted(v, key=repr) for k, v in by.items() if k is not None)
    assert parts == [[(1, 1, 2), (2, 1, 2), (None, 1, 2)], [(1, 1, 2), (3, 1, 2), (3, 1, 2)]] or parts == [[(1, 1, 2), (3, 1, 2), (3, 1, 2)], [(1, 1, 2), (2, 1, 2), (None, 1, 2)]]
    assert sorted(by[None], key=repr) == [(4, 4, 0), (None, None, 0)]


def test_hot_set_is_split(spark):
    """A set that most documents have is dealt over tasks by the skew join."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one and the same text that many have").otherwise(F.concat(F.lit("w x y z v "), F.col("id"))).alias("text")).repartition(8)
        out = ngram_join.similar(docs)
        assert out.where("component_id = 1").count() == 8000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


# -- stages ---------------------------------------------------------------------------------

ODD = "doc_id long, text string, lang string, source string, n_chars long, Score double, predicted int, Matches string, spans string, text_key string, _key string"


@pytest.fixture(scope="module")
def odd(spark, sf):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(i, t, None, None, None, 9.5, 7, "m", "s", "t", "k") for i, t in [(None, None), (None, "plain words without an id"), (1, ""), (1, ""), (2, "   \n"), (3, long), (4, long), (5, "same id, one text of it"), (5, "same id, quite another text"), (6, "y" * 5000), (7, "mail a.b@mail.example.com now")]]
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(30).select("doc_id", "text").collect()
    rows += [(100 + r["doc_id"], r["text"], "en", "web", len(r["text"] or ""), 9.5, 7, "m", "s", "t", "k") for r in real]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_tables(spark, sf, odd, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out, none = f(spark, odd, sf), f(spark, odd.limit(0), sf)
    assert none.count() == 0
    if stage == len(corpus_pipeline.STAGES) - 1:
        assert out.count() == odd.count() and out.where("not round_trip").count() == 0
        return
    assert out.columns == none.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
    got = out.collect()
    assert got and all((r["Score"], r["predicted"], r["Matches"], r["spans"], r["text_key"], r["_key"]) == (9.5, 7, "m", "s", "t", "k") for r in got)
    ids = [r["doc_id"] for r in got]
    if name == "near copies":  # equal rows once, the copy of greater doc_id gone, unlike texts of one id both there
        assert (ids.count(1), ids.count(3), ids.count(4), ids.count(5), ids.count(None)) == (1, 1, 0, 2, 2)
    if name == "personal data":
        assert len(got) == odd.count() and next(r["text"] for r in got if r["doc_id"] == 7) == "mail <email> now"
        assert all(r["n_chars"] == len(r["text"] or "") for r in got)
    if name == "decontamination":
        assert {1, 2, 3, 5, None} <= {*ids}
