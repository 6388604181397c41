"""Operators over the whole corpus, against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from codeatlas.llm import components, ngram_join, queries, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_join(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root, links, inv = list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in inv[g]).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            inv[g].append(i)
    comp = defaultdict(list)
    for i, r in enumerate(rows):
        comp[find(i)].append(r[0])
    return {r[0]: (len(sets[i]), min(comp[find(i)]), links[i]) for i, r in enumerate(rows)}


def families(seed=5):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [rng.choice([f"x{rng.randint(0, 300)}", "the", "of", "and"]) for _ in range(rng.choice([1, 2, 3, 8, 12, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            p = rng.choice([0, 0.005, 0.02, 0.03])
            rows.append((len(rows) * 3 + 1, " ".join(rng.choice("abcdefgh") * 2 if rng.random() < p else w for w in base)))
    return rows + [(10**6 + i, t) for i, t in enumerate([None, "", "  \n", "A b", "a B", "é É c"])]


@pytest.mark.parametrize("k, num, grams, cold", [(3, 90, 2000, 4), (5, 80, 10**6, 64)])
def test_join(spark, monkeypatch, k, num, grams, cold):
    monkeypatch.setattr(ngram_join._near, "__defaults__", (cold,))
    rows = families()
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100, grams)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got.collect()} == brute_join(rows, k, num, 100)


def test_join_edges(spark):
    empty = ngram_join.similar(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    twice = ngram_join.similar(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "z")], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in twice.collect()) == [(0, 0), (1, 1), (1, 1)]


def test_contract_join(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in queries.op1_ngram_join(spark, sf).collect()}
    assert got == brute_join(rows, 3, 90, 100)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61))
    root = {i: i for e in edges if None not in e for i in e}
    for _ in range(80):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if i != r}


def brute_repeats(rows, n):
    count, ws = Counter(), []
    for _, t in rows:
        w = list(WORD.finditer(low(t)))
        ws.append(w)
        count.update(tuple(x.group() for x in w[j : j + n]) for j in range(len(w) - n + 1))
    out = set()
    for (i, _), w in zip(rows, ws, strict=True):
        hit = [j for j in range(len(w) - n + 1) if count[tuple(x.group() for x in w[j : j + n])] > 1]
        s = 0
        while s < len(hit):
            e = s
            while e + 1 < len(hit) and hit[e + 1] < hit[e] + n:
                e += 1
            out.add((i, w[hit[s]].start(), w[hit[e] + n - 1].end()))
            s = e + 1
    return out


@pytest.mark.parametrize("n, gram", [(11, 4), (12, 12), (20, 5)])
def test_repeats(spark, n, gram):
    rng = random.Random(3)
    text = lambda m: " ".join(rng.choice("é ab cd Ef gh ij".split()) + str(rng.randint(0, 200)) for _ in range(m))
    shared = [text(rng.choice([10, 11, 12, 15, 40])) for _ in range(12)]
    rows = [(i * 2, "\n".join([text(rng.randint(0, 30)), rng.choice(shared), text(rng.randint(0, 5)), rng.choice(shared), text(20)][: rng.randint(0, 5)])) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "z z z " * 20)]
    got = {tuple(r)[:3] for r in repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string"), n, gram).collect()}
    assert got == brute_repeats(rows, n)


def test_repeats_contract(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r)[:3] for r in queries.op7_repeats(spark, sf).collect()} == brute_repeats(rows, 50)
    assert repeats.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.keep_quality(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    one = {r["doc_id"] for r in p.drop_near_copies(spark, docs, sf).collect()}
    assert one == {i for i, (_, c, _) in brute_join(rows, 5, 80, 100).items() if i == c}
    clean = p.drop_contaminated(spark, docs, sf)
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in clean.collect()]
    assert clean.count() < docs.count() and not any(i in t for t in left for i in items)
    red = p.redact_personal_data(spark, docs, sf)
    assert red.count() == docs.count() and red.where("text rlike '@mail[0-9]'").count() == 0 and red.where("n_chars <> length(text)").count() == 0
    out = p.run(spark, sf)
    assert out.where("not round_trip").count() == 0 and out.count() > 0 and out.dropDuplicates(["doc_id"]).count() == out.count()
