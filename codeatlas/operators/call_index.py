"""Callers and callees of one function without the edges of all others: an inverted index.

Three tables in buckets. ``calls`` lies by caller, ``postings`` (the same rows) by the called simple name,
``named`` (functions) by name. A lookup reads the buckets of its centres from the first, and with the names
that it finds there the buckets of those names from the other two; Spark prunes the rest of the files
before any join. A name that very many functions call is spread over several files of its bucket.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.operators.calls import matches, simple_name
from codeatlas.plans.lineage import delete, shared_dir

#: Files of a bucket at most: a hot name's rows are dealt over as many tasks.
SPREAD = 8
#: Names that may prune buckets as a list; a function that calls more is joined without pruning.
MAX_NAMES = 1000


@dataclass(frozen=True)
class CallIndex:
    spark: SparkSession
    name: str
    folder: str

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def drop(self) -> None:
        """Deletes the index's tables and their files."""
        for part in ("calls", "postings", "named"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
        delete(self.spark, self.folder)


def _write(rows: DataFrame, index: CallIndex, part: str, by: str, spread: Column, buckets: int) -> None:
    # the bucket of Spark's own hash, so that each task writes few files
    dealt = rows.repartition(F.pmod(F.hash(by), F.lit(buckets)), F.pmod(spread, F.lit(SPREAD)))
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by).option("path", f"{index.folder}/{part}").saveAsTable(f"{index.name}_{part}")


def build(calls: DataFrame, functions: DataFrame, bindings: DataFrame | None = None, buckets: int = 64, folder: str | None = None) -> CallIndex:
    """Writes the index of calls (caller, name, site, receiver), functions (path, name) and receivers'
    classes (caller, receiver, class) as tables of the session's catalogue, in a new folder (of the shared
    one, unless ``folder`` names another). ``opened`` finds them again in another session."""
    spark = calls.sparkSession
    name = f"call_index_{uuid.uuid4().hex}"
    index = CallIndex(spark, name, folder or f"{shared_dir(spark)}/{name}")
    rows = calls.join(bindings, ["caller", "receiver"], "left") if bindings is not None else calls.withColumn("class", F.lit(None).cast("string"))
    rows = rows.select("caller", "name", simple_name(F.col("name")).alias("simple"), F.col("site").cast("long").alias("site"), "class")
    _write(rows, index, "calls", "caller", F.hash("simple"), buckets)
    postings = rows.select("simple", "caller").distinct()
    _write(postings, index, "postings", "simple", F.hash("caller"), buckets)
    _write(functions.select(F.col("name").alias("simple"), "path"), index, "named", "simple", F.hash("path"), buckets)
    return index


def opened(spark: SparkSession, folder: str, buckets: int = 64) -> CallIndex:
    """An index that another session has built in a folder, with as many buckets."""
    index = CallIndex(spark, f"call_index_{uuid.uuid4().hex}", folder)
    columns = {"calls": ("caller", "caller string, name string, simple string, site bigint, class string"), "postings": ("simple", "simple string, caller string"), "named": ("simple", "simple string, path string")}
    for part, (by, schema) in columns.items():
        spark.sql(f"CREATE TABLE {index.name}_{part} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{folder}/{part}'")
    return index


def _some(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows with one of the values: a condition that prunes buckets."""
    return rows.where(F.col(column).isin(values)) if values else rows.limit(0)


def callees(index: CallIndex, centers: list[str]) -> DataFrame:
    """(center, target, raw_name, site): the first call of each target by each of the centres."""
    made = _some(index.table("calls"), "caller", centers)
    names = [r["simple"] for r in made.select("simple").distinct().limit(MAX_NAMES + 1).collect()]
    named = index.table("named")
    f = (_some(named, "simple", names) if len(names) <= MAX_NAMES else named).withColumnRenamed("path", "target")
    j = made.join(f, "simple").where((F.col("target") != F.col("caller")) & matches(F.col("name"), F.col("target")))
    j = j.where(F.col("class").isNull() | F.col("target").contains(F.concat(F.lit("::"), F.col("class"), F.lit("::"))))
    return j.groupBy(F.col("caller").alias("center"), "target").agg(F.min_by("name", "site").alias("raw_name"), F.min("site").alias("site"))


def callers(index: CallIndex, centers: dict[str, str]) -> DataFrame:
    """(center, target): the functions that call a name of the centres (path to name), save itself."""
    wanted = index.spark.createDataFrame(sorted(centers.items()), "center string, simple string")
    hit = _some(index.table("postings"), "simple", sorted(set(centers.values()))).withColumnRenamed("caller", "target")
    return hit.join(F.broadcast(wanted), "simple").where("center <> target").select("center", "target")


def lookup(index: CallIndex, centers: dict[str, str]) -> DataFrame:
    """(center, direction, target, raw_name, site): both directions of some functions (path to simple
    name), the rows that ``calls.edges`` has for them."""
    out = callees(index, sorted(centers)).select("center", F.lit("callee").alias("direction"), "target", "raw_name", "site")
    none = F.lit(None)
    back = callers(index, centers).select("center", F.lit("caller").alias("direction"), "target", none.cast("string").alias("raw_name"), none.cast("long").alias("site"))
    return out.unionByName(back)
