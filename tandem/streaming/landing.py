"""Landing of uploads: files of a folder, each read once, accepted ones apart from refused ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.formats import MOST_BYTES, mime_type, upload_error
from tandem.streaming.sink import started

# Endings of stored files by type, and the kinds of an upload.
ENDINGS = {"application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg"}
KINDS = ("questionPaper", "answerSheet")

UPLOADS = "session_id string, kind string, name string, declared string, content binary"
#: What became of an upload; the content of refused ones is not kept.
LANDED = "session_id string, kind string, name string, error string, mime string, size long, file_id string, stored_path string, content binary, batch long, accepted boolean"


def judged(uploads: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """LANDED but batch, of UPLOADS rows.

    Checked in order: a session and a known kind, the type, too large, empty. A
    null content is empty. The file's id is a digest of name and content, so an
    upload that comes again gets the path that it had.
    """
    size = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    known = F.coalesce(F.col("kind").isin(*KINDS) & (F.length("session_id") > 0), F.lit(False))
    error = F.when(~known, "request").otherwise(upload_error(F.col("declared"), F.coalesce("name", F.lit("")), size, most))
    mime = mime_type(F.col("declared"), F.coalesce("name", F.lit("")))
    ending = F.coalesce(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])[mime], F.lit("bin"))
    file_id = F.left(F.sha2(F.concat_ws("\n", F.coalesce("name", F.lit("")), F.sha2(F.coalesce("content", F.lit(b"")), 256)), 256), F.lit(10))
    rows = uploads.select("session_id", "kind", "name", error.alias("error"), mime.alias("mime"), size.alias("size"), file_id.alias("file_id"), "content", ending.alias("ending"))
    fine = F.col("error").isNull()
    return rows.select(
        "session_id", "kind", "name", "error", "mime", "size", F.when(fine, F.col("file_id")).alias("file_id"),
        F.when(fine, F.concat_ws("/", "session_id", "kind", F.concat("file_id", F.lit("."), "ending"))).alias("stored_path"), F.when(fine, F.col("content")).alias("content"), fine.alias("accepted"),
    )


def land(spark: SparkSession, inbox: str, store: str, checkpoint: str, files_per_batch: int = 1_000, most: int = MOST_BYTES) -> None:
    """Lands all files (Parquet of UPLOADS) that are in ``inbox`` and were not landed before, and returns.

    Below ``store`` each batch has a folder, with one folder for accepted and one
    for refused rows. Files that come later are landed by the next call with this
    checkpoint; a batch that fails is done again and replaces what it left.
    """
    uploads = spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)

    def sink(batch: DataFrame, number: int) -> None:
        judged(batch, most).write.mode("overwrite").partitionBy("accepted").parquet(f"{store}/batch={number}")

    started(uploads, store, checkpoint, sink=sink).awaitTermination()


def landed(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(LANDED).option("basePath", store).parquet(store)
