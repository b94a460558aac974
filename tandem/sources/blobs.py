"""Files as rows: a folder of blobs whose keys are their paths, read, and deleted by prefix.

A key's path is session_id=.../bucket=.../file_id=.../part-*.txt. The bucket is a
hash of the file_id, so that no folder's listing has all keys of a session. Spark's
driver holds the paths of all that it writes or lists at once, some KB for each;
so files are written and read in passes of a bounded number of keys.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.sources.nested import LISTING
from tandem.sources.tables import shared_dir

#: Keys of a page of a listing.
PAGE = 1_000

#: Buckets of a session. A folder is made for each, so more cost small sessions time.
BUCKETS = 64

#: Keys that are written, or listed and read, at once.
KEYS_OF_PASS = 20_000

#: Bytes of listings that Spark's driver keeps after they were used.
LISTINGS_KEPT = "spark.sql.hive.filesourcePartitionFileCacheSize"


def _folder(spark: SparkSession, path: str) -> tuple:
    """A folder's file system and path."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def write_texts(rows: DataFrame, root: str) -> None:
    """Writes one file for each of ``rows`` (session_id, file_id, text without null): session_id=.../bucket=.../file_id=.../part-*.txt.

    A file has the text's bytes and a line feed. Keys of another call stay; a key
    that comes again is overwritten. The rows of several passes are dealt to them
    in an intermediate table, once.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(F.col("file_id").cast("string")), F.lit(BUCKETS)).alias("bucket")
    files = rows.select("session_id", bucket, "file_id", F.coalesce("text", F.lit("")).alias("value"))
    passes = -(-rows.count() // KEYS_OF_PASS)
    if passes <= 1:
        _write(files, root)
        return
    path = shared_dir(spark, "texts")
    number = F.pmod(F.xxhash64("session_id", "file_id"), F.lit(passes))
    files.withColumn("pass", number).repartition(passes, "pass").write.partitionBy("pass").parquet(path)
    for k in range(passes):
        system, folder = _folder(spark, f"{path}/pass={k}")
        if system.exists(folder):
            _write(spark.read.schema(files.schema).parquet(folder.toString()), root)


def _write(files: DataFrame, root: str) -> None:
    # The number is given: files cost the time, not bytes, by which Spark would put a pass of short texts in one task.
    dealt = files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "session_id", "file_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "bucket", "file_id").text(root)


def _passes(spark: SparkSession, root: str) -> Iterator[list[str]]:
    """The sessions' buckets below ``root``, as many at a time as have the keys of a pass (one at least)."""
    system, folder = _folder(spark, root)
    held, n = [], 0
    for session in system.listStatus(folder):
        for bucket in system.listStatus(session.getPath()) if session.isDirectory() else ():
            keys = len(system.listStatus(bucket.getPath()))
            if held and n + keys > KEYS_OF_PASS:
                yield held
                held, n = [], 0
            held.append(bucket.getPath().toString())
            n += keys
    if held:
        yield held


def _listed(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The files below some folders, listed some folders to a task; the listing goes when the frame does."""
    before = {k: spark.conf.get(k) for k in (LISTING, LISTINGS_KEPT)}
    spark.conf.set(LISTING, str(min(int(before[LISTING]), 4 * spark.sparkContext.defaultParallelism)))
    spark.conf.set(LISTINGS_KEPT, "0")
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folders)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_blobs(spark: SparkSession, root: str, *columns: str | Column) -> DataFrame:
    """session_id, file_id, length, content of all files below ``root``, or ``columns`` made of these: the keys from paths, without the last line feed.

    What several passes read is written, with no more than ``columns``, and read
    again; what one pass reads is not.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    part = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]*)/", 1))
    content = F.substring("content", F.lit(1), (F.col("length") - 1).cast("int"))

    def blobs(files: DataFrame) -> DataFrame:
        return files.select(part("session_id").alias("session_id"), part("file_id").alias("file_id"), (F.col("length") - 1).alias("length"), content.alias("content")).select(*columns or ["*"]).coalesce(tasks)

    passes = _passes(spark, root)
    first, second = next(passes, None), next(passes, None)
    if first is None:
        return blobs(spark.createDataFrame([], "path string, length long, content binary"))
    if second is None:
        return blobs(_listed(spark, first))
    path = shared_dir(spark, "blobs-read")
    for folders in itertools.chain((first, second), passes):
        read = blobs(_listed(spark, folders))
        read.write.mode("append").parquet(path)
    return spark.read.schema(read.schema).parquet(path)


def keys_below(spark: SparkSession, folder: str, after: str | None, most: int = PAGE) -> list[str]:
    """The next paths below a folder behind ``after``, in order: a page of keys, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).select("path")
    page = files if after is None else files.filter(F.col("path") > after)
    return [r.path for r in page.orderBy("path").limit(most).collect()]


def delete_prefix(spark: SparkSession, root: str, session_id: object, most: int = PAGE) -> int:
    """Deletes all files of a session; how many there were. Others stay.

    The file system counts the files and deletes the folder itself, each in a call
    for as many keys as it takes at once; no list of keys comes here. ``most`` was
    the size of a page of keys and has no effect now.
    """
    system, folder = _folder(spark, f"{root}/session_id={session_id}")
    if not system.exists(folder):
        return 0
    deleted = system.getContentSummary(folder).getFileCount()
    system.delete(folder, True)
    return deleted
