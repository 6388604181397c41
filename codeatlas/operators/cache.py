"""Cache decisions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.operators.ordered import running_sum


def lru_keep(entries: DataFrame, budget: float, size: str, clock: str, key: str, *by: str) -> DataFrame:
    """What stays when the oldest entries go until the rest fits: the longest recent run that fits.
    With ``by``, a budget for each group. An entry of unknown size takes nothing."""
    taken, latest = F.coalesce(F.col(size), F.lit(0)), [F.desc(clock), F.desc(key)]
    if not by:
        return running_sum(entries, taken, *latest, out="used").where(F.col("used") <= budget)
    w = Window.partitionBy(*by).orderBy(*latest).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum(taken).over(w)).where(F.col("used") <= budget)


def top_priority(requests: DataFrame, area: str, key: str, n: int = 4) -> DataFrame:
    return requests.orderBy(F.desc(area), key).limit(n)


def next_loads(waiting: DataFrame, inflight: DataFrame, area: str, key: str, n: int = 4) -> DataFrame:
    """The requests of most area that are not on their way."""
    return waiting.join(inflight.select(key).distinct(), key, "left_anti").orderBy(F.desc(area), key).limit(n)


def grouped_requests(requests: DataFrame, area: str, key: str, group: str, n: int = 4, *by: str) -> DataFrame:
    """The n requests to do next, with their place: the one of most area, then those of its group
    (of areas over 0), then the next one and its group, and so on. With ``by``, n of each.

    Groups follow each other by their best request; within one, requests of no area wait like
    groups of their own, as do those without a group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rank = requests.withColumn("_r", F.row_number().over(w.orderBy(F.desc(area), key)))
    own = F.col(group).isNull() | (F.col(area) <= 0)
    leader = rank.withColumn("_g", F.when(own, F.col("_r")).otherwise(F.min("_r").over(Window.partitionBy(*by, group, own))))
    # one without area may be a group's first, but then others of the group have none either
    place = leader.withColumn("place", F.row_number().over(w.orderBy("_g", "_r")))
    return place.where(F.col("place") <= n).drop("_r", "_g")


def disk_keys(nodes: DataFrame, fingerprints: DataFrame, path: str = "file") -> DataFrame:
    """Nodes with their file's fingerprint; those of files without one can't be cached."""
    return nodes.join(fingerprints.withColumnRenamed("path", path), path)


def held_bytes(entries: DataFrame, size: str, *by: str) -> DataFrame:
    """Bytes that a cache holds."""
    return entries.groupBy(*by).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("entries"))
