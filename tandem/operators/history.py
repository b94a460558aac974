"""Saved results of owners: upsert, retention, paging and statistics."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT, DAYS, PAGE = 20, 7, 6


def upserted(entries: DataFrame) -> DataFrame:
    """One row per session: first creation, latest save and its percent."""
    return entries.groupBy("owner", "session_id").agg(F.min("saved_at").alias("created_at"), F.max("saved_at").alias("last_saved"), F.max_by("percent", "saved_at").alias("percent"))


def newest(entries: DataFrame, most: int = KEPT) -> DataFrame:
    """The newest entries of each owner, with their place."""
    w = Window.partitionBy("owner").orderBy(F.desc("saved_at"), "session_id")
    return entries.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= most)


def within(entries: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    """Entries saved less than ``days`` before ``as_of``."""
    return entries.filter(F.col("saved_at") > F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))


def page(entries: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """Page ``number`` (from 1, clamped to the last) of each owner's kept entries, with how many pages there are."""
    rows = newest(entries).withColumn("n", F.count("*").over(Window.partitionBy("owner"))).withColumn("pages", F.ceil(F.col("n") / size))
    at = F.least(F.lit(number), F.col("pages"))
    return rows.filter(F.ceil(F.col("place") / size) == at).select("owner", "session_id", "place", "pages")


def statistics(entries: DataFrame) -> DataFrame:
    """Entries, mean and best percent (rounded half up) of each owner."""
    return entries.groupBy("owner").agg(F.count("*").alias("n"), F.floor((2 * F.sum("percent") + F.count("*")) / (2 * F.count("*"))).alias("mean_percent"), F.max("percent").alias("best_percent"))


def showing(entries: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """owner and what page ``number`` (clamped to the last) shows, as ``Showing a–b of n exams``; null where one page holds all."""
    kept = newest(entries).groupBy("owner").agg(F.count("*").alias("n"))
    at = F.least(F.lit(number), F.ceil(F.col("n") / size)).cast("long")
    text = F.format_string("Showing %d–%d of %d exams", (at - 1) * size + 1, F.least(at * size, F.col("n")), F.col("n"))
    return kept.select("owner", F.when(F.col("n") > size, text).alias("showing"))
