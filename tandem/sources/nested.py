"""Nested records as indented JSON files, each a list over many lines, and their flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that a record holds at most; a session with more has several.
MOST_LINES = 100

#: In how many tasks folders are listed at most.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

SCHEMA = "session_id long, part long, placed string, lines array<struct<number:long,quantity:double,label:string>>, _corrupt_record string"


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` (file, session_id, number, quantity, label; dealt by file) with the part of its session's record that each is in."""
    order = Window.partitionBy("file", "session_id").orderBy("number", "quantity", "label")
    return lines.withColumn("part", F.floor((F.row_number().over(order) - 1) / MOST_LINES))


def records(lines: DataFrame) -> DataFrame:
    """One record for each session and part of rows (session_id, part, placed, number, quantity, label); rows with a ``file`` keep it, and stay dealt by it."""
    line = F.struct("number", "quantity", "label")
    return lines.groupBy(*[c for c in ("file", "session_id", "part") if c in lines.columns]).agg(F.max("placed").alias("placed"), F.sort_array(F.collect_list(line)).alias("lines"))


def indented(record) -> object:
    """A record (struct) as JSON text over several lines."""
    flat = F.to_json(record, {"ignoreNullFields": "false"})
    return F.regexp_replace(flat, r'\{(?="number")', "\n    {")


def lists(rows: DataFrame, file_of, cut=None) -> DataFrame:
    """file, value: the records ``rows`` of each file as a JSON list; where ``cut``, one that breaks off.

    If they come dealt by the column ``file_of``, they are not dealt again.
    """
    one = rows.select(file_of.alias("file"), F.struct("session_id", "part", indented(F.struct("session_id", "part", "placed", "lines")).alias("text")).alias("r"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: F.concat(F.lit("  "), r["text"])), ",\n")
    whole = one.groupBy("file").agg(F.concat(F.lit("[\n"), text, F.lit("\n]")).alias("value"))
    if cut is not None:
        whole = whole.withColumn("value", F.when(cut, F.expr("left(value, length(value) - 12)")).otherwise(F.col("value")))
    return whole


def write_lists(rows: DataFrame, path: str, file_of, cut=None) -> None:
    """Writes the ``lists`` of the records ``rows``, one file each."""
    lists(rows, file_of, cut).write.mode("overwrite").partitionBy("file").text(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files, and one row with ``_corrupt_record`` for a file that is no list of them.

    Folders are listed some to a task, not one each; the session's option is set back after that.
    """
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    finally:
        spark.conf.set(LISTING, before)


def flat(read: DataFrame) -> DataFrame:
    """session_id, placed, number, quantity, label of all lines of whole records."""
    return read.filter("_corrupt_record is null").select("session_id", "placed", F.explode("lines").alias("line")).select("session_id", "placed", "line.*")
