"""Trees as flat rows. A path's ancestors are exploded and grouped: one shuffle for any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.paths import folder_prefixes
from codeatlas.operators.ordered import rank, sum_in_order
from codeatlas.plans.lineage import saved


def rollup(files: DataFrame, path: str, *aggs: Column, root: bool = True) -> DataFrame:
    """Aggregates of all files below each folder: (folder, ...). The root is ""."""
    folders = folder_prefixes(path)
    if root:
        folders = F.concat(F.array(F.lit("")), folders)
    return files.withColumn("folder", F.explode(folders)).groupBy("folder").agg(*aggs)


#: Rows of one folder that one task adds up at once; larger folders are added up range by range.
ORDERED_ROWS = 1 << 17


def rollup_rounded(files: DataFrame, path: str | Column, value: str, order: list[str], *aggs: Column, out: str = "measure", most: int | None = None, held: int = ORDERED_ROWS) -> DataFrame:
    """The rollup with the sum of doubles below each folder, as a whole number (long). Doubles sum to
    other last digits in another order, so a sum near a half could go up or down with the plan. Where
    the order may tell, the values are added in the order of the columns ``order`` (the last as
    ``sum_in_order`` has it), as one scan of a table does. ``path`` may be an array of folders, the root
    among them. With ``most``, folders of more values that are so near take their sum in decimals."""
    n, total = F.col("_n"), F.col("_total")
    folders = path if isinstance(path, Column) else F.concat(F.array(F.lit("")), folder_prefixes(path))
    rows = files.withColumn("folder", F.explode(folders))
    exact = [] if most is None else [F.sum(F.col(value).cast("decimal(28,8)")).alias("_exact")]
    sums = rows.groupBy("folder").agg(*aggs, F.count(value).alias("_n"), F.sum(value).alias("_total"), F.sum(F.abs(value)).alias("_size"), *exact)
    off = n * F.col("_size") * 2.0**-52  # no two orders differ by more
    sums = saved(sums.withColumn("_near", F.round(total - off) != F.round(total + off)))
    near = F.col("_near") if most is None else F.col("_near") & (n <= most)
    small, large = sums.where(near & (n <= held)).select(F.col("folder").alias("_folder")), sums.where(n > held).select(F.col("folder").alias("_folder"), near.alias("_near"))
    rows = rows.where(F.col(value).isNotNull()).select("folder", *order, F.col(value).alias("v"))
    same = F.col("folder").eqNullSafe(F.col("_folder"))
    added = F.aggregate(F.sort_array(F.collect_list(F.struct(*order, "v"))), F.lit(0.0), lambda sofar, r: sofar + r["v"])
    # without the large ones, of which there are few, no folder fills a task
    ordered = rows.join(F.broadcast(large), same, "left_anti").join(small, same, "left_semi").groupBy("folder").agg(added.alias("_ordered"))
    ordered = ordered.union(sum_in_order(rows.join(F.broadcast(large.where("_near")), same, "left_semi"), "folder", order, "v")).withColumnRenamed("folder", "_folder")
    whole = F.when(~F.col("_near"), F.round(total).cast("long")).otherwise(F.coalesce(F.round("_ordered").cast("long"), *([F.round("_exact").cast("long")] if exact else [])))
    return sums.join(ordered, same, "left").withColumn(out, whole).drop("_folder", "_n", "_total", "_size", "_exact", "_near", "_ordered")


def sibling_ordinals(nodes: DataFrame, parent: str, name: str, order: str, out: str = "ordinal") -> DataFrame:
    """0-based index among siblings of the same name, in source order."""
    return nodes.withColumn(out, (F.row_number().over(Window.partitionBy(parent, name).orderBy(order)) - 1).cast("int"))


def dedupe_ids(nodes: DataFrame, keys: list[str], ordinal: str, pre: str, out: str = "new_ordinal") -> DataFrame:
    """Ordinals made unique among rows of equal keys, in preorder: each row takes its own or the
    next free one. In closed form: rank + running maximum of (ordinal - rank)."""
    w = Window.partitionBy(*keys).orderBy(pre)
    rank = F.row_number().over(w)
    ranked = nodes.withColumn("_rank", rank)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, (F.col("_rank") + F.max(F.col(ordinal) - F.col("_rank")).over(run)).cast("int")).drop("_rank")


def percentile(rows: DataFrame, value: str, *by: str, out: str = "percentile") -> DataFrame:
    """Share of other rows that are strictly less; 0 for a single row."""
    w = Window.partitionBy(*by).orderBy(value) if by else Window.orderBy(value)
    return rows.withColumn(out, F.percent_rank().over(w))


def percentile_by_counts(rows: DataFrame, value: str, out: str = "percentile") -> DataFrame:
    """The same over one group of any size: ranks of distinct values, joined back. The window
    runs over distinct values only, after partial aggregation."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_c"))
    below = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_below", F.coalesce(F.sum("_c").over(below), F.lit(0)))
    total = counts.agg(F.sum("_c").alias("_n"))  # one row
    ranks = ranks.join(F.broadcast(total)).select(value, F.when(F.col("_n") <= 1, 0.0).otherwise(F.col("_below") / (F.col("_n") - 1)).alias(out))
    return rows.join(ranks, value)


def preorder(nodes: DataFrame, positions: str = "positions", out: str = "pre") -> DataFrame:
    """Preorder numbers (long) from each node's array of sibling positions."""
    return rank(nodes, F.col(positions), out=out)


def topmost(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path has no ancestor among the rows: an anti-join on exploded prefixes."""
    up = paths.select(F.col(path).alias("_p"), F.explode(folder_prefixes(path)).alias("_a"))
    covered = up.join(paths.select(F.col(path).alias("_a")).distinct(), "_a").select(F.col("_p").alias(path)).distinct()
    return paths.join(covered, path, "left_anti")


def nearest_strong(paths: DataFrame, strong: DataFrame) -> DataFrame:
    """(path, role) of each path: its own role if strong, else that of the nearest strong
    ancestor, else Source. ``strong`` has (path, role)."""
    up = paths.select("path", F.explode(F.concat(F.array(F.lit("")), folder_prefixes("path"), F.array("path"))).alias("a"))
    found = up.join(strong.select(F.col("path").alias("a"), "role"), "a").groupBy("path").agg(F.max_by("role", F.length("a")).alias("role"))
    return paths.join(found, "path", "left").withColumn("role", F.coalesce("role", F.lit("Source")))


def dominant_role(files: DataFrame, path: str = "path", role: str = "role") -> DataFrame:
    """(folder, role, strong): the first role in precedence, Source apart, that 70 % of the files
    below have; else Source, weak."""
    from codeatlas.functions.tables import ROLE_PRECEDENCE

    counts = rollup(files, path, F.count("*").alias("total"), *(F.count_if(F.col(role) == r).alias(r) for r in ROLE_PRECEDENCE[:-1]))
    out = None
    for r in ROLE_PRECEDENCE[:-1]:
        hit = (F.col("total") > 0) & (F.col(r) * 10 >= F.col("total") * 7)
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return counts.select("folder", F.coalesce(out, F.lit("Source")).alias("role"), out.isNotNull().alias("strong"), "total")
