"""Folder totals that follow changes: stored rollups into which the deltas of changed files are merged.

A store is a folder of tables cut in buckets by hash: files (path, lines, commits), folders (folder,
n_files, lines, commits) and values (commits, n_files), from which percentiles follow. A change set
touches the buckets of its files and of their folders; those are written anew, all others stay where they
are. A manifest names the folder of each bucket; it is replaced as a whole, so a reader sees one version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeatlas.functions.paths import folder_prefixes
from codeatlas.plans.lineage import saved

_TABLES = {
    "files": ("path", "path string, lines long, commits long"),
    "folders": ("folder", "folder string, n_files long, lines long, commits long"),
    "values": ("commits", "commits long, n_files long"),
}


class Store:
    """Rollups in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = int(self._manifest().get("buckets", buckets))

    # -- the manifest -----------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self) -> dict:
        """The newest whole manifest; its number is its version."""
        fs, at = self._fs(f"{self.folder}/manifests")
        if not fs.exists(at):
            return {"version": 0, "batch": -1, "at": {t: {} for t in _TABLES}}
        newest = max((f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")), default=None)
        if newest is None:
            return {"version": 0, "batch": -1, "at": {t: {} for t in _TABLES}}
        text = self.spark.read.text(f"{self.folder}/manifests/{newest}", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        name = f"{self.folder}/manifests/{manifest['version']:012d}"
        fs, part = self._fs(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, self._fs(f"{name}.json")[1]):  # fails where another writer was first
            fs.delete(part, False)
            raise RuntimeError(f"version {manifest['version']} of {self.folder} was written by another")

    # -- tables -----------------------------------------------------------------------------

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, some: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        at = (manifest or self._manifest())["at"][table]
        schema = _TABLES[table][1]
        paths = sorted({p for b, p in at.items() if some is None or int(b) in some})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, table: str, touched: list[int], manifest: dict) -> None:
        """Rows of the touched buckets, a folder for each bucket; one task writes a bucket."""
        key = _TABLES[table][0]
        root = f"{self.folder}/{table}/{manifest['version']:012d}-{uuid.uuid4().hex}"
        rows.withColumn("b", self._bucket(F.col(key))).repartition("b").write.partitionBy("b").parquet(root)
        fs, at = self._fs(root)
        there = {f.getPath().getName().removeprefix("b=") for f in fs.listStatus(at) if f.isDirectory()}
        for b in map(str, touched):
            if b in there:
                manifest["at"][table][b] = f"{root}/b={b}"
            else:
                manifest["at"][table].pop(b, None)

    def files(self) -> DataFrame:
        return self._read("files")

    def folders(self) -> DataFrame:
        """(folder, n_files, lines, commits) of every folder with files below it; the root is ""."""
        return self._read("folders")

    def percentiles(self) -> DataFrame:
        """(path, percentile): the share of other files with fewer commits; 0 for a single file. From the
        stored counts of distinct values, without sorting files."""
        v = self._read("values")
        below = F.coalesce(F.sum("n_files").over(Window.orderBy("commits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        n = v.agg(F.sum("n_files").alias("_n"))  # one row
        ranks = v.withColumn("_below", below).join(F.broadcast(n)).select("commits", F.when(F.col("_n") <= 1, 0.0).otherwise(F.col("_below") / (F.col("_n") - 1)).alias("percentile"))
        return self.files().join(ranks, "commits").select("path", "percentile")

    # -- changes ----------------------------------------------------------------------------

    def apply(self, changes: DataFrame, batch: int | None = None) -> int:
        """Merges changed files (path, lines, commits; both null for a file that is gone) and returns the
        version. One row for each path; of several the largest holds. A batch that was merged before is left out, so a stream
        that starts again merges each once. Unchanged buckets are neither read nor written."""
        manifest = self._manifest()
        if batch is not None and batch <= manifest["batch"]:
            return manifest["version"]
        manifest = {**manifest, "version": manifest["version"] + 1, "buckets": self.buckets, "batch": manifest["batch"] if batch is None else batch}
        c = F.col
        new = changes.where("path is not null").groupBy("path").agg(F.max(F.struct("lines", "commits")).alias("v")).select("path", c("v.lines").cast("long").alias("lines"), c("v.commits").cast("long").alias("commits"))
        new = saved(new)
        of = lambda df, key: [r[0] for r in df.select(self._bucket(c(key))).distinct().collect()]  # at most as many as buckets
        touched = of(new, "path")
        if not touched:
            return manifest["version"] - 1
        kept = self._read("files", touched, manifest)
        both = saved(kept.select("path", c("lines").alias("ol"), c("commits").alias("oc")).join(new.withColumn("said", F.lit(True)), "path", "full_outer"))
        after = both.select("path", F.when(c("said"), c("lines")).otherwise(c("ol")).alias("lines"), F.when(c("said"), c("commits")).otherwise(c("oc")).alias("commits"))
        zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
        there, gone = c("lines").isNotNull().cast("long"), c("ol").isNotNull().cast("long")
        moved = both.where("said").select("path", (there - gone).alias("n_files"), (zero(c("lines")) - zero(c("ol"))).alias("lines"), (zero(c("commits")) - zero(c("oc"))).alias("commits"), c("oc").alias("was"), F.when(c("lines").isNotNull(), zero(c("commits"))).alias("now"))
        sums = ("n_files", "lines", "commits")
        up = moved.withColumn("folder", F.explode(F.concat(F.array(F.lit("")), folder_prefixes("path")))).groupBy("folder").agg(*(F.sum(x).alias(x) for x in sums))
        counts = moved.where("was is not null").select(c("was").alias("commits"), F.lit(-1).cast("long").alias("n_files")).unionByName(moved.where("now is not null").select(c("now").alias("commits"), F.lit(1).cast("long").alias("n_files")))
        counts = counts.groupBy("commits").agg(F.sum("n_files").alias("n_files"))
        self._write(after.where("lines is not null").withColumn("commits", zero(c("commits"))), "files", touched, manifest)
        for table, delta, key, cols in (("folders", up, "folder", sums), ("values", counts, "commits", ("n_files",))):
            delta = saved(delta)
            some = of(delta, key)
            merged = self._read(table, some, manifest).unionByName(delta).groupBy(key).agg(*(F.sum(x).alias(x) for x in cols)).where("n_files <> 0")
            self._write(merged, table, some, manifest)
        self._publish(manifest)
        return manifest["version"]

    def follow(self, changes: DataFrame, checkpoint: str):
        """A running query that merges each batch of a stream of changes."""
        return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(df, n) and None).start()
