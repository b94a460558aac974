"""Point lookups with fallbacks: a page's image, else the original file, else what the session's snapshot says.

Stores are partitioned by a hash of the session. A step reads only the partitions
of keys that are still open, and nothing if there are none.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.snapshots import STORE, bucket
from tandem.sources.tables import written

# Kinds of documents, and what the outcomes are called.
KINDS = ("questionPaper", "answerSheet")
BAD_KIND, BAD_PAGE, NOT_FOUND = "Invalid document kind.", "Invalid page number.", "Page image not found."

PAGES = "session_id long, kind string, page long, url string, bucket int"
SESSIONS = "session_id long, kind string, stored_path string, bucket int"


def stored(rows: DataFrame, path: str) -> None:
    """Writes a store of rows with session_id, partitioned by its hash."""
    rows.withColumn("bucket", bucket(F.col("session_id"))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def of_open(spark: SparkSession, path: str, schema: str, open_keys: DataFrame) -> DataFrame:
    """The partitions of a store that keys (with session_id) can be in."""
    touched = [r.bucket for r in open_keys.select(bucket(F.col("session_id")).alias("bucket")).distinct().collect()]  # at most BUCKETS
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(F.col("bucket").isin(touched)) if touched else rows.limit(0)


def page_number(text: Column) -> Column:
    """A page number as a request has it: a whole number from 1 on in any way of writing a number, null for others."""
    bare = F.trim(text)
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    hexed = F.when(bare.rlike(r"^0[xX][0-9a-fA-F]{1,12}$"), F.conv(F.substring(bare, 3, 14), 16, 10).cast("double"))
    found = F.coalesce(number, hexed)
    return F.when((found >= 1) & (found == F.floor(found)) & (found < 2.0**53), found.cast("long"))


def found_pages(requests: DataFrame, pages_path: str, sessions_path: str, snapshots_path: str) -> DataFrame:
    """``requests`` (request_id, session_id, kind, page as text) with status (302, 400 or 404) and location or error.

    Stores: pages (PAGES), sessions that are in memory (SESSIONS, a row for each
    session and kind, stored_path null where nothing was uploaded), and snapshots
    (of ``snapshots``: a column for each kind with JSON that has ``storedPath``). A
    session in memory is not looked up in the snapshots, even where it has no file.
    """
    spark = requests.sparkSession
    asked = requests.select("request_id", "session_id", "kind", "page", page_number(F.col("page")).alias("number"))
    error = F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), BAD_KIND).when(F.col("number").isNull(), BAD_PAGE)
    judged = written(asked.withColumn("error", error), "requests")
    keys = judged.filter("error is null").select("session_id", "kind", "number").distinct()

    pages = of_open(spark, pages_path, PAGES, keys).select("session_id", "kind", F.col("page").alias("number"), F.col("url").alias("location"))
    first = written(keys.join(pages.groupBy("session_id", "kind", "number").agg(F.min("location").alias("location")), ["session_id", "kind", "number"], "left"), "images")
    open_ = first.filter("location is null").select("session_id", "kind").distinct()

    sessions = of_open(spark, sessions_path, SESSIONS, open_).groupBy("session_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("stored_path"))).alias(k) for k in KINDS])
    own = F.when(F.col("kind") == KINDS[0], F.col(KINDS[0])).otherwise(F.col(KINDS[1]))
    known = open_.join(sessions.withColumn("here", F.lit(True)), "session_id", "left").select("session_id", "kind", own.alias("stored_path"), F.col("here").isNotNull().alias("here"))
    second = written(known, "originals")
    lost = second.filter("not here").select("session_id", "kind")

    store = of_open(spark, snapshots_path, STORE, lost).select("session_id", F.col("field").alias("kind"), F.get_json_object("value", "$.storedPath").alias("recovered"))
    third = lost.join(store.filter(F.col("kind").isin(*KINDS)), ["session_id", "kind"])
    fallback = second.join(third, ["session_id", "kind"], "left").select("session_id", "kind", F.coalesce("stored_path", "recovered").alias("file"))
    told = first.join(fallback, ["session_id", "kind"], "left").select("session_id", "kind", "number", F.coalesce("location", "file").alias("location"))
    out = judged.alias("j").join(told.alias("t"), (F.col("j.session_id") == F.col("t.session_id")) & (F.col("j.kind") == F.col("t.kind")) & (F.col("j.number") == F.col("t.number")), "left")
    error = F.coalesce(F.col("j.error"), F.when(F.col("t.location").isNull() | (F.col("t.location") == ""), NOT_FOUND))
    status = F.when(F.col("j.error").isNotNull(), 400).when(error.isNotNull(), 404).otherwise(302)
    return out.select("j.request_id", "j.session_id", "j.kind", "j.page", status.alias("status"), F.when(error.isNull(), F.col("t.location")).alias("location"), error.alias("error"))
