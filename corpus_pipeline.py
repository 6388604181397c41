"""From raw documents to training tokens, in five stages.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm import bpe, decontaminate, ngram_join, pii, quality
from codeatlas.llm.common import cut, free_name


def _same(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    return _same(docs, quality.classify(docs, model, score=score, predicted=predicted).where(F.col(predicted) == 1))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word sequences at 0.8 the one of least doc_id (then of least hash
    of its text). Rows of equal doc_id and text are one document, rows of one doc_id with unlike
    texts are two. Documents without a doc_id stay."""
    found = ngram_join.similar(docs).where("doc_id is not null")
    linked = found.where("component_key is not null").groupBy("component_key").agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
    key = free_name(docs, "text_key")
    keep = linked.select("k.doc_id", "k.text_key").unionByName(found.where("component_key is null").select("doc_id", "text_key"))
    keep = keep.withColumnRenamed("text_key", key)
    # the join's partitioning serves dropDuplicates as well: texts move once
    one = docs.where("doc_id is not null").withColumn(key, F.xxhash64("text")).join(keep, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return _same(docs, one).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. An item too short for one edit (a word or two)
    is in clean texts too: it is no sign of a leak."""
    matches = free_name(docs, "matches")
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), matches=matches, min_chars=decontaminate.CHARS_PER_EDIT)
    return _same(docs, found.where(F.size(matches) == 0))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return _same(docs, pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids (packed little-endian unsigned 32-bit integers), and whether they
    decode to its text."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode_checked(docs, path, pattern)
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("tokens", tokenise),
]

#: The classifier, the random field and BPE can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs, "pipeline"), sf_dir)
    return docs
