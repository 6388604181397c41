"""The queries of this subpackage over the driver's tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from codeatlas.llm import bpe, collocations, decontaminate, fingerprint, infill, langid, ngram_join, pii, quality, repeats, token_file, toxicity, url_filter
from codeatlas.llm.common import fresh_path


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules and, as the list, the URLs of pages whose id is
    divisible by 100."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.filter_urls(pages, pages.where("page_id % 100 = 0").select("url")).drop("url")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and the bytes that they decode to, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe.encode(docs, path, pattern).select("doc_id", "ids")
    back = bpe.decode(coded, path, pattern)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of documents linked by 3-word sequences, at 0.9."""
    found = ngram_join.similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of an edit of it, and their likeness."""
    return fingerprint.with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, and a digest of the ids read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = fresh_path(spark, "token-files")
    shards = token_file.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read(spark, folder, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the patterns' spans, and all spans."""
    found = pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _left_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~_left_out(4, 2))
    return langid.identify(docs.drop("lang"), model).select("doc_id", _left_out(4, 2).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and where: a row for each document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("matches") > 0)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.edits", F.col("m.start").alias("start_char"), F.col("m.end").alias("end_char"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur again in the documents: a row for each place."""
    return repeats.repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels outside one fifth of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~_left_out(5, 0))
    return quality.classify(docs, model).select("doc_id", _left_out(5, 0).alias("held_out"), "score", "predicted")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language the 2,000 phrases that stand out most from what their parts would give."""
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels of two thirds of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~_left_out(3, 1))
    return toxicity.classify(docs, model).select("doc_id", _left_out(3, 1).alias("held_out"), "score", "predicted")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, and digests of the output and of the text restored from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = infill.restore(infill.transform(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_winnowing": op2_winnowing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language": op4_language,
    "op5_pii": op5_pii,
    "op6_token_files": op6_token_files,
    "op7_repeats": op7_repeats,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
}

# words as in the contract: A-Z lower-cased, runs other than the six ASCII white spaces
_LOW = "translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"

ORACLES = {
    "op1_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split({_LOW}, ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
t AS (SELECT doc_id, unnest(g) AS g FROM s), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(k.k, 0) AS n_links FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) k ON k.a = n.doc_id""",
    "op7_repeats": f"""
WITH p AS (SELECT doc_id, unnest(string_split({_LOW}, ' ')) AS word, generate_subscripts(string_split({_LOW}, ' '), 1) AS i FROM documents),
q AS (SELECT doc_id, word, i, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(word) - 1 AS a FROM p),
w AS (SELECT doc_id, a, a + length(word) AS b, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM q WHERE word <> ''),
g AS (SELECT doc_id, a, k, n, last_value(b) OVER f AS b, string_agg(word, ' ') OVER f AS words FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
h AS (SELECT doc_id, a, b, md5(words) AS m FROM g WHERE k + 49 <= n),
d AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY m ORDER BY doc_id, a) = 1 AS first, count(*) OVER (PARTITION BY m) AS c FROM h),
s AS (SELECT *, a >= lag(b, 1, -1) OVER (PARTITION BY doc_id ORDER BY a) AS fresh FROM d WHERE c > 1),
z AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY a) AS part FROM s)
SELECT doc_id, CAST(min(a) AS BIGINT) AS start_char, CAST(max(b) AS BIGINT) AS end_char, bool_and(first) AS first FROM z GROUP BY doc_id, part""",
    "op10_url_filter": r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
k AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') AS key
  FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM k)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/en/', 'net/de/', 'example.net/de/8', 'org/es/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN key <> '' AND key IN (SELECT key FROM k WHERE page_id % 100 = 0) THEN 'block'
  ELSE 'allow' END AS verdict
FROM r""",
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM p),
q AS (SELECT lang, ws, unnest(range(1, 6)) AS k FROM w),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM q WHERE len(ws) >= k),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100),
d AS (SELECT DISTINCT lang, a, unnest([array_to_string(ws[2:], ' '), array_to_string(ws[:k - 1], ' ')]) AS phrase FROM c WHERE k >= 3),
e AS (SELECT c.* FROM c ANTI JOIN d USING (lang, phrase, a)),
j AS (SELECT lang, phrase, a, k, ws, unnest(range(1, k)) AS j FROM e),
s AS (SELECT j.lang, j.phrase, j.a, j.j, x.f AS l, y.f AS r, n.n, CAST(CAST(1000 AS HUGEINT) * a * n.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM j JOIN f x ON x.lang = j.lang AND x.phrase = array_to_string(ws[:j], ' ') JOIN f y ON y.lang = j.lang AND y.phrase = array_to_string(ws[j + 1:], ' ') JOIN n ON n.lang = j.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE best = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000""",
    "op13_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS ts, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, ts, CAST(len(ts) AS BIGINT) AS n, [CAST('0x' || substr(x, 1 + 8 * i, 8) AS BIGINT) for i in range(4)] AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
k AS (SELECT *, array_to_string(ts[1:i], '') AS p, array_to_string(ts[i + 1:j], '') AS m, array_to_string(ts[j + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM k""",
}
