"""A derived table that is rebuilt only as far as its source files changed.

Layout below ``path``: ``rows/bucket=<n>/`` with the derived rows, and ``manifest/<n>/``, one for each refresh that
ended, with path, length, time and bucket of every source file. The newest finished manifest says what the rows were
built from. A refresh that breaks off leaves the old manifest, so the next one finds the same changes and repeats them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from prosegauge.session import checkpointed

c = F.col
#: Partitions of the derived table; files are dealt to them by the hash of their path.
BUCKETS = 64
#: Changed files that one read names. More are read in several steps, so that the driver never holds a longer list.
FILES = 10_000


@dataclass
class Refresh:
    """What a refresh did: the table, and how many files were new or changed, gone, and unchanged."""

    rows: DataFrame
    built: int
    gone: int
    kept: int
    buckets: int


def list_files(spark: SparkSession, source: str, pattern: str = "*.csv") -> DataFrame:
    """path, length and time of all source files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(source).select(
        "path", c("length").cast("long").alias("length"), c("modificationTime").alias("time"))


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, path: str) -> int:
    """Number of the newest finished manifest; 0: there is none."""
    where, files = _file_system(spark, f"{path}/manifest")
    if not files.exists(where):
        return 0
    done = [int(s.getPath().getName()) for s in files.listStatus(where)
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=0)


def refresh(spark: SparkSession, source: str, path: str, read: Callable[[SparkSession, list[str]], DataFrame],
            build: Callable[[DataFrame], DataFrame], *, buckets: int = BUCKETS, pattern: str = "*.csv") -> Refresh:
    """Bring the table at ``path`` up to date with the files below ``source``.

    ``read`` makes rows of some files, ``build`` the derived rows of these; a derived row must come from one file alone
    and name it in ``source_file`` (the file's name). Only files that are new, changed in length or time, or gone are
    looked into. The rows of a bucket with such a file are written anew, without the old rows of these files; other
    buckets are not touched. Files of one name in two folders are an error, as their rows could not be told apart.
    """
    number = _newest(spark, path)
    now = checkpointed(list_files(spark, source, pattern).withColumn("file", F.element_at(F.split("path", "/"), -1)).withColumn(
        "bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int")))
    twice = now.groupBy("file").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two source files are named {twice[0]['file']}")
    schema = "file string, path string, length long, time timestamp, bucket int"
    before = spark.read.schema(schema).parquet(f"{path}/manifest/{number}") if number else spark.createDataFrame([], schema)
    if number and before.agg(F.max("bucket")).first()[0] is not None and before.filter(
            c("bucket") != F.pmod(F.xxhash64("file"), F.lit(buckets))).limit(1).collect():
        raise ValueError("the table was built with another number of buckets")
    both = now.alias("n").join(before.alias("b"), c("n.file") == c("b.file"), "full")
    same = (c("n.path") == c("b.path")) & (c("n.length") == c("b.length")) & (c("n.time") == c("b.time"))
    state = checkpointed(both.select(
        F.coalesce("n.file", "b.file").alias("file"), c("n.path").alias("path"), F.coalesce("n.bucket", "b.bucket").alias("bucket"),
        F.when(c("n.path").isNull(), "gone").when(same, "kept").otherwise("built").alias("what")))
    counts = {r["what"]: r["count"] for r in state.groupBy("what").count().collect()}
    touched = [r["bucket"] for r in state.filter("what != 'kept'").select("bucket").distinct().collect()]
    target = f"{path}/rows"
    if touched:
        paths = state.filter("what = 'built'").select("path").orderBy("path")
        fresh = None
        batch: list[str] = []
        for row in [*paths.toLocalIterator(), None]:
            if row is not None:
                batch.append(row["path"])
            if batch and (row is None or len(batch) == FILES):
                made = checkpointed(build(read(spark, batch)).withColumn(
                    "bucket", F.pmod(F.xxhash64("source_file"), F.lit(buckets)).cast("int")))
                fresh = made if fresh is None else fresh.unionByName(made)
                batch = []
        rows = fresh
        if number:
            changed = state.filter("what != 'kept'").select(c("file").alias("source_file"))
            old = spark.read.parquet(target).filter(c("bucket").isin(touched)).join(changed, "source_file", "left_anti")
            # the rows that stay are fixed before their files are replaced
            old = checkpointed(old)
            rows = old if fresh is None else fresh.unionByName(old)
        filled = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        for bucket in set(touched) - set(filled):  # nothing is left there, and nothing was written over it
            where, files = _file_system(spark, f"{target}/bucket={bucket}")
            files.delete(where, True)
    if touched or not number:
        now.select("file", "path", "length", "time", "bucket").write.mode("overwrite").parquet(f"{path}/manifest/{number + 1}")
    if not counts:
        raise ValueError(f"no source files below {source}")
    return Refresh(spark.read.parquet(target).drop("bucket"), counts.get("built", 0), counts.get("gone", 0), counts.get("kept", 0), len(touched))
