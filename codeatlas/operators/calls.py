"""Call edges by name: equi-joins on the simple name with a residual predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simple_name(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def matches(name: Column, path: Column) -> Column:
    """Residual of a join on the simple name: two parts must both stand in the path."""
    parts = F.size(F.split(name, "::"))
    return F.when(parts == 2, path.contains(F.concat(F.lit("::"), name))).otherwise(F.lit(True))


def distinct_calls(calls: DataFrame) -> DataFrame:
    """The first call of each name in a function."""
    w = Window.partitionBy("caller", "name").orderBy("site")
    return calls.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def callees(calls: DataFrame, functions: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """(caller, target, name, site): calls (caller, name, site, receiver) against functions (path,
    name), without self; where the receiver's class is known (bindings: caller, receiver, class)
    the target must be in it; the first call wins for each target."""
    c = calls.withColumn("_simple", simple_name(F.col("name")))
    if bindings is not None:
        c = c.join(bindings, ["caller", "receiver"], "left")
    else:
        c = c.withColumn("class", F.lit(None).cast("string"))
    f = functions.select(F.col("path").alias("target"), F.col("name").alias("_simple"))
    j = c.join(f, "_simple").where((F.col("target") != F.col("caller")) & matches(F.col("name"), F.col("target")))
    j = j.where(F.col("class").isNull() | F.col("target").contains(F.concat(F.lit("::"), F.col("class"), F.lit("::"))))
    return j.groupBy("caller", "target").agg(F.min_by("name", "site").alias("name"), F.min("site").alias("site"))


def callers(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(target, caller): every function whose calls hold the target's simple name, without self;
    for all targets in one join."""
    f = functions.select(F.col("path").alias("target"), F.col("name").alias("_simple"))
    c = calls.select("caller", simple_name(F.col("name")).alias("_simple")).distinct()
    return c.join(f, "_simple").where("caller <> target").select("target", "caller").distinct()


def edges(calls: DataFrame, functions: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """Both directions of every centre: (center, direction, target, raw_name, site)."""
    return both(callees(calls, functions, bindings), callers(calls, functions))


def both(out: DataFrame, back: DataFrame) -> DataFrame:
    """Callees and callers in one table."""
    out = out.select(F.col("caller").alias("center"), F.lit("callee").alias("direction"), "target", F.col("name").alias("raw_name"), "site")
    back = back.select(F.col("target").alias("center"), F.lit("caller").alias("direction"), F.col("caller").alias("target"), F.lit(None).cast("string").alias("raw_name"), F.lit(None).cast("long").alias("site"))
    return out.unionByName(back)


def first_bindings(bindings: DataFrame) -> DataFrame:
    """(caller, receiver, class): of the bindings (caller, receiver, class, seq) the first."""
    return bindings.groupBy("caller", "receiver").agg(F.min_by("class", "seq").alias("class"))


def group_edges(found: DataFrame) -> DataFrame:
    """Targets by raw name, in the order first seen."""
    g = found.groupBy("center", "raw_name").agg(F.min("site").alias("first"), F.sort_array(F.collect_list(F.struct("site", "target"))).alias("t"))
    return g.select("center", "raw_name", "first", F.col("t.target").alias("targets"))


def last_return_type(functions: DataFrame) -> DataFrame:
    """Name to return type; of functions of one name the last in preorder."""
    return functions.where("ret is not null").groupBy("name").agg(F.max_by("ret", "pre").alias("ret"))
