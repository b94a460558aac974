"""Sessions' snapshots as a store that patches are applied to, batch by batch.

A patch names the columns that it sets; a column that it names with null is set to
null, one that it does not name stays. The store has a row for each session and
column with the value last given and when, and a row with an empty column name for
the session's first patch. Newer values win whatever order batches come in, so a
batch that is applied again changes nothing. Rows lie in partitions by a hash of
the session; only partitions that a batch touches are rewritten.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.sources.tables import exists, written

#: Partitions of a store.
BUCKETS = 32
STORE = "session_id long, field string, value string, at timestamp_ntz, seq long, bucket int"


def bucket(session_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def entries(patches: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the store for ``patches`` (session_id, at, seq, patch as JSON text): their latest value of each column.

    A patch that is no JSON object, or is null, sets nothing, but the session is
    there from then on. Values are JSON texts of objects and lists, others as
    plain text. Of patches with equal at and seq the larger value stays. Rows
    without session_id are left out.
    """
    given = F.coalesce(F.from_json("patch", "map<string,string>"), F.create_map().cast("map<string,string>"))
    made = F.map_from_arrays(F.array(F.lit("")), F.array(F.lit(None).cast("string")))
    both = F.map_concat(F.map_filter(given, lambda k, _: k != ""), made)
    rows = patches.filter("session_id is not null").select("session_id", "at", "seq", F.explode(both).alias("field", "value"))
    return _folded(rows.withColumn("bucket", bucket(F.col("session_id"), buckets)))


def _folded(rows: DataFrame) -> DataFrame:
    """One row of each session and column: the latest value, and the first time of the session."""
    when = F.struct("at", "seq", "value")
    one = rows.groupBy("session_id", "field", "bucket").agg(F.max(when).alias("last"), F.min(when).alias("first"))
    kept = F.when(F.col("field") == "", F.col("first")).otherwise(F.col("last"))
    return one.select("session_id", "field", kept["value"].alias("value"), kept["at"].alias("at"), kept["seq"].alias("seq"), "bucket")


def apply(patches: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Adds a batch of patches to the store at ``path``, which is made if it is not there.

    The new state of the touched partitions is written aside first, then put in
    their place; others are not read and keep their files.
    """
    spark = patches.sparkSession
    new = written(entries(patches, buckets), "entries")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    state = new
    if exists(spark, path):
        state = _folded(read(spark, path).filter(F.col("bucket").isin(touched)).unionByName(new))
    ready = written(state, "state")
    ready.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def snapshots(store: DataFrame, fields: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """One row per session: session_id, created_at and the named fields in their types; ``defaults`` where none was ever given."""
    defaults = defaults or {}
    value = {f: F.max(F.when(F.col("field") == f, F.struct("value"))) for f in fields}
    wide = store.groupBy("session_id").agg(F.min(F.when(F.col("field") == "", F.col("at"))).alias(" made"), *[v.alias(f" {f}") for f, v in value.items()])
    typed = [F.when(F.col(f" {f}").isNull(), F.lit(defaults.get(f)).cast(kind)).otherwise(F.col(f" {f}")["value"].try_cast(kind)).alias(f) for f, kind in fields.items()]
    return wide.select("session_id", F.col(" made").alias("created_at"), *typed)
