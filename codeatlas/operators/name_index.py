"""Search by name without reading all names: an index by length with character signatures.

Results are ranked by length first, so names lie in one folder for each byte length. A search reads
lengths from the shortest that can match on, a few folders at a time (twice as many each time), and stops
when it has enough: longer names come later in any case. Within a folder a 64-bit mask of the characters
of each name turns away most names before the pattern is tried on the rest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.paths import fuzzy_match
from codeatlas.functions.tables import SEARCH_LIMIT
from codeatlas.plans.lineage import delete, shared_dir

#: Names of so many bytes or more share the last folder.
LONGEST = 255


@dataclass(frozen=True)
class NameIndex:
    spark: SparkSession
    folder: str
    lengths: tuple[int, ...]
    schema: str

    def names(self, lengths: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder).where(F.col("length").isin(lengths))

    def drop(self) -> None:
        """Deletes the index's files."""
        delete(self.spark, self.folder)


def signature(name: Column) -> Column:
    """Which characters a name holds, in lower case: a bit for each remainder of a code point by 64."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))
    return F.aggregate(F.split(F.lower(name), ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.when(c == "", F.lit(0).cast("long")).otherwise(bit(c))))


def build(nodes: DataFrame, name: str = "name", order: str = "pre", folder: str | None = None) -> NameIndex:
    """Writes the names of nodes with ``order`` (which breaks ties) to a new folder, of the shared one unless
    another is named. Null names are left out. At most LONGEST lengths reach the driver."""
    spark = nodes.sparkSession
    folder = folder or f"{shared_dir(spark)}/names-{uuid.uuid4().hex}"
    n = F.col(f"`{name}`")
    rows = nodes.where(n.isNotNull()).select(n.alias("name"), F.col(f"`{order}`").alias("order"), signature(n).alias("signature"), F.least(F.octet_length(n), F.lit(LONGEST)).alias("length"))
    # a length in very many names is written by several tasks
    rows.repartition("length", F.pmod(F.xxhash64("name", "order"), F.lit(8))).sortWithinPartitions("length", "name").write.partitionBy("length").parquet(folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    lengths = spark.read.schema(schema).parquet(folder).select("length").distinct().collect() if rows.take(1) else []
    return NameIndex(spark, folder, tuple(sorted(r[0] for r in lengths)), schema)


def search(index: NameIndex, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(name, order): the first names that hold the query's characters in order, whatever their case, by
    length, name and order. An empty query takes all names."""
    spark = index.spark
    none = spark.createDataFrame([], ", ".join(index.schema.split(", ")[:2]))
    need = spark.range(1).select(signature(F.lit(query))).first()[0]
    # a name has at least a byte for each of the query's characters
    left = [x for x in index.lengths if x >= min(len(query), LONGEST)]
    found, step = [], 1
    while left and len(found) < limit:
        some, left = left[:step], left[step:]
        step *= 2
        hit = index.names(some).where(F.col("signature").bitwiseAND(F.lit(need)) == need).where(fuzzy_match(query, "name"))
        found += hit.orderBy(F.octet_length("name"), "name", "order").select("name", "order").limit(limit - len(found)).collect()
    return spark.createDataFrame(found, none.schema) if found else none
