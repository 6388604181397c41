"""A tree as nested JSON of any size and depth: rows of text in the order of a walk.

Each node opens on one line and closes on another, at its place in the walk; the lines of a top folder, one
below another, are one JSON document. So no row, task or machine holds more than the lines of its range,
however large the tree, and nesting takes no loop over levels. Reading is the other way round: lines that open hold a
node's own fields, and a node's parent is the innermost one around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.operators.intervals import parents


def write(nodes: DataFrame, folder: str) -> None:
    """Writes nodes (id, parent_id, depth, anc, pre and others, one root) below ``folder``: ``top=NAME`` has the
    lines of each top folder in parts by name, ``top=`` those of a root. Null fields are left out of the JSON."""
    below = nodes.select(F.explode("anc").alias("id")).groupBy("id").agg(F.count("*").alias("below"))
    n = nodes.join(below, "id", "left").withColumn("below", F.coalesce("below", F.lit(0)).cast("long"))
    siblings = nodes.groupBy("parent_id").agg(F.min("pre").alias("first"))
    n = n.join(siblings, n["parent_id"].eqNullSafe(siblings["parent_id"]), "left").drop(siblings["parent_id"])
    top = F.coalesce(F.get("anc", F.lit(1)), F.when(F.col("depth") == 1, F.col("id")), F.lit(""))
    own = F.to_json(F.struct(*(F.col(f"`{c}`") for c in nodes.columns if c not in ("parent_id", "anc")), "below"))
    # the first child follows no comma; a top folder begins its own document
    comma = F.when((F.col("pre") == F.col("first")) | (F.col("depth") <= 1), "").otherwise(",")
    opened = F.concat(comma, F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"children":['))
    n = n.withColumn("j", own).withColumn("top", top)
    # places in the walk: two for each node before, less one for each that is still open
    at = 2 * F.col("pre") - F.col("depth")
    lines = n.select("top", at.alias("at"), opened.alias("line")).unionByName(n.select("top", (at + 2 * F.col("below") + 1).alias("at"), F.lit("]}").alias("line")))
    lines.repartitionByRange("top", "at").sortWithinPartitions("top", "at").select("top", "line").write.partitionBy("top").text(folder)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(top, part, text) in order: the parts whose texts, one behind another, are the JSON of each top folder."""
    raw = spark.read.option("wholetext", True).option("basePath", folder).text(folder)
    return raw.select(F.col("top").cast("string").alias("top"), F.input_file_name().alias("part"), F.col("value").alias("text"))


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The nodes with the fields of ``schema`` (id, depth and pre among them) and parent_id."""
    lines = spark.read.text(folder).select("value").where("value <> ']}'")
    text = F.concat(F.regexp_replace(F.regexp_replace("value", r"^,", ""), r',"children":\[$', ""), F.lit("}"))
    n = lines.select(F.from_json(text, schema + ", below long").alias("j")).select("j.*")
    # a node's place and those below it, as an interval: the one around it is its parent
    span = n.select(F.lit(0).alias("key"), "id", F.col("pre").cast("long").alias("start"), (F.col("pre") + F.col("below") + 1).cast("long").alias("end"))
    return n.drop("below").join(parents(span).select("id", F.col("parent").alias("parent_id")), "id")
