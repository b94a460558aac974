"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the session's ``spark.checkpoint.dir``, which driver and executors share.

    Only in local mode, where there are no other machines, may that be unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/tandem/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, with no lineage to repeat when an executor is lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether joins by further columns deal rows anew that are dealt by one of them already. Spark's default is true.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


#: Rows that a part has about, where rows are dealt by a key once and then stay so.
ROWS_OF_PART = 100_000


def parts_of(spark: SparkSession, rows: int) -> int | None:
    """In how many parts to deal so many rows; None if as many as shuffles have will do.

    What is dealt once is not dealt again, so no later step can make the parts
    smaller, and sorts of large ones spill.
    """
    parts = -(-rows // ROWS_OF_PART)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt_by(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``df`` dealt by ``key`` into so many parts (``parts_of``)."""
    return df.repartition(parts, key) if parts else df.repartition(key)


def by_key(df: DataFrame, name: str, key: str = "session_id", parts: int | None = None) -> DataFrame:
    """``df``, which must be dealt by ``key`` (or small), written in so many buckets of it, or as many as shuffles have partitions, and read again.

    What is read stays dealt: windows, groups and joins by the key and further
    columns, with other rows that are dealt by it, need no shuffle; for joins the
    session's option ALL_KEYS is turned off, which changes plans, not results. Joins
    with it are not broadcast: its files are small for their rows, and Spark would
    send millions of them through the driver. The table's entry in the catalog is
    dropped at once; its files stay.
    """
    spark = df.sparkSession
    spark.conf.set(ALL_KEYS, "false")
    table = f"tandem_{uuid.uuid4().hex}"
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).format("parquet").option("path", shared_dir(spark, name)).saveAsTable(table)
    read = spark.table(table)
    read.schema  # resolved, before the entry goes
    spark.sql(f"DROP TABLE {table}")
    return read.hint("merge")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
