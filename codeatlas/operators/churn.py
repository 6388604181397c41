"""Change frequency from a version-control log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.paths import file_part
from codeatlas.operators.hierarchy import percentile_by_counts, rollup


def counts_from_log(log: DataFrame, line: str = "line") -> DataFrame:
    """(path, commits) from numstat lines ``added TAB deleted TAB path``; other lines don't count."""
    p = F.split(F.col(line), "\t", 3)
    ok = (F.size(p) == 3) & F.get(p, 0).rlike(r"^(\d+|-)$") & F.get(p, 1).rlike(r"^(\d+|-)$")
    return log.select(ok.alias("ok"), F.get(p, 2).alias("path")).where("ok").groupBy("path").agg(F.count("*").alias("commits"))


def annotate(files: DataFrame, churn: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files with commits (0 if none) and percentile, and folders with sums and percentile."""
    counted = files.join(churn.withColumnRenamed("path", path), path, "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    folders = rollup(counted, path, F.sum("commits").alias("commits"))
    # by the distinct counts: no window over all files or folders
    return percentile_by_counts(counted, "commits", out="churn"), percentile_by_counts(folders, "commits", out="churn")


def inherit(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items and chunks take the churn of the file that their qualified path begins with."""
    return items.withColumn("file", file_part("path")).join(files.select(F.col("path").alias("file"), "commits", "churn"), "file", "left").fillna(0, ["commits"]).fillna(0.0, ["churn"])
