"""Source trees as tables of files, with the caps and gates of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetstone.functions.paths import excluded, ignored

PRUNED = (".git", "node_modules", "target", ".venv")
MOST_BYTES = 8 * 1024 * 1024


#: Files of a tree that are looked at, at most.
MOST_FILES = 1_000_000


def tree(spark: SparkSession, root: str, exclude: list[str] | None = None, ignore: list[str] | None = None, most: int = MOST_BYTES, files: int = MOST_FILES) -> DataFrame:
    """(path, name, text, length) of every readable file under a root: relative POSIX paths, pruned directories,
    excludes, ignore rules, a size cap, and only valid UTF-8. All but the last are decided on a listing; only the files
    that are left are opened, `files` of them at most, which is an error beyond."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*?" + base.replace(".", "\\.") + "/+", "").alias("path")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("at"), rel, "length")
    rows = found.where(F.col("length") <= most).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, PRUNED))))
    rows = rows.where(~excluded(F.col("path"), exclude or [])).where(~ignored(F.col("path"), ignore or []))
    kept = [r.at for r in rows.select("at").limit(files + 1).collect()]  # bounded by `files`
    if len(kept) > files:
        raise ValueError(f"over {files} files under {root}")
    if not kept:
        return spark.createDataFrame([], "path string, name string, text string, length long")
    read = spark.read.format("binaryFile").load(kept).where(F.is_valid_utf8("content"))
    return read.select(rel, "content", "length").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "utf-8").alias("text"), "length")


def history(blobs: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Versions of files that are in no current tree: one row for each blob, at its first path. blobs: oid, path, text,
    size, in_index. With a cap, blobs in order of (oid, path) up to that many bytes."""
    first = blobs.groupBy("oid").agg(F.bool_or("in_index").alias("known"), F.min_by(F.struct("path", "text", "size"), "path").alias("b"))
    rows = first.where(~F.col("known")).select("oid", "b.*")
    if most_bytes is None:
        return rows
    # the running total comes from totals of buckets of oids, then within a bucket: no window over all rows
    rows = rows.withColumn("bucket", F.substring("oid", 1, 2))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket").agg(F.sum("size").alias("s")).select("bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))  # 256 rows
    running = F.sum("size").over(Window.partitionBy("bucket").orderBy("oid", "path"))
    return rows.withColumn("r", running).join(F.broadcast(sums), "bucket").where(F.col("r") + F.col("base") <= most_bytes).drop("bucket", "r", "base")
