"""Records from what a page's reader returned: JSON of questions or answers, one document for each call.

Documents: session_id, page, doc (order of documents of a page), raw. What is no
JSON of that shape gives no records. Records that lack a field have null there,
flags are false.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.labels import canonical, sort_key
from tandem.operators.linkage import per_label
from tandem.sources.tables import written

BOX = "struct<x:double,y:double,width:double,height:double>"
QUESTIONS = f"struct<questions:array<struct<questionNumber:string,questionText:string,totalMarks:double,boundingBox:{BOX},lowConfidence:boolean>>,warnings:array<string>>"
ANSWERS = f"struct<answers:array<struct<detectedQuestionNumber:string,detectedNumberRawText:string,answerText:string,pageNumber:long,boundingBox:{BOX},containsDiagram:boolean,containsTable:boolean,crossedOut:boolean,lowConfidence:boolean>>,warnings:array<string>>"


def _records(documents: DataFrame, schema: str, of: str) -> DataFrame:
    """session_id, page, doc, pos, r (a record) of all documents, in their order within documents."""
    # Outer, and nulls left out after it: a plain one is preceded by a filter that parses every document twice more.
    parsed = documents.select("session_id", "page", "doc", F.from_json("raw", schema)[of].alias("all"))
    return parsed.select("session_id", "page", "doc", F.posexplode_outer("all").alias("pos", "r")).filter("r is not null")


def _placed_on(page: Column, box: Column) -> Column:
    """A box with its page; null without one."""
    return F.when(box.isNotNull(), F.struct(page.cast("long").alias("page"), box["x"].alias("x"), box["y"].alias("y"), box["width"].alias("width"), box["height"].alias("height")))


def _id(letter: str) -> Column:
    return F.concat_ws("-", F.col("session_id").cast("string"), F.concat(F.lit(letter), F.col("page").cast("string")), F.col("doc").cast("string"), F.col("pos").cast("string"))


def _flag(name: str) -> Column:
    return F.coalesce(F.col("r")[name], F.lit(False))


def questions_of(documents: DataFrame) -> DataFrame:
    """Questions: session_id, question_id, place (from 1, by number, as they came where it is the same), order, label, text, page, marks, region, low_confidence."""
    rows = _records(documents, QUESTIONS, "questions")
    label = F.col("r")["questionNumber"]
    out = rows.select(
        "session_id", _id("q").alias("question_id"), "page", "doc", "pos", label.alias("label"), sort_key(label).alias("order"), F.col("r")["questionText"].alias("text"),
        F.col("r")["totalMarks"].alias("marks"), _placed_on(F.col("page"), F.col("r")["boundingBox"]).alias("region"), _flag("lowConfidence").alias("low_confidence"),
    )
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("order", "page", "doc", "pos"))
    return out.withColumn("place", place.cast("long")).drop("doc", "pos")


def answers_of(documents: DataFrame) -> DataFrame:
    """Answers: session_id, answer_id, sequence_index (from 0, over all pages), canonical, raw_label, text, page, boxes, and flags.

    A record's own page, if it has one, goes before its document's.
    """
    rows = written(_records(documents, ANSWERS, "answers"), "records")
    page = F.coalesce(F.col("r")["pageNumber"], F.col("page"))
    out = rows.select(
        "session_id", _id("a").alias("answer_id"), "page", "doc", "pos", F.col("r")["detectedQuestionNumber"].alias("number"), F.col("r")["detectedNumberRawText"].alias("raw_label"), F.col("r")["answerText"].alias("text"), page.cast("long").alias("own_page"),
        F.array_compact(F.array(_placed_on(page, F.col("r")["boundingBox"]))).alias("boxes"), _flag("containsDiagram").alias("contains_diagram"), _flag("containsTable").alias("contains_table"), _flag("crossedOut").alias("crossed_out"), _flag("lowConfidence").alias("low_confidence"),
    )
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("page", "doc", "pos")) - 1
    numbered = per_label(out.withColumn("sequence_index", at.cast("long")), "number", canonical=canonical)
    return numbered.drop("doc", "pos", "number", "page").withColumnRenamed("own_page", "page")
