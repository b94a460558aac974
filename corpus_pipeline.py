"""A corpus pipeline of four stages: toxicity, language, near duplicates, packing.

Every stage takes (spark, docs, sf_dir), with the columns of ``documents``, and
works on all that its predecessor kept; all but the last return those columns.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm import jaccard_join, language_id, packing, toxicity
from tandem.llm._shared import unused, written

#: A document stays if its language is told with at least this score.
LEAST_LANGUAGE_SCORE = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the machine is fitted on the labelled ones."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score = unused(docs, "toxicity")
    return toxicity.score_documents(docs, machine, score).filter(F.col(score) < 0.5).drop(score)


def keep_told_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; undetermined ones and uncertain ones go."""
    models = language_id.train(docs, F.lit(True), public_tokenizers.path("piece_bpe_32k.model"))
    language = unused(docs, "language")
    found = language_id.predict_documents(docs, models, language)
    told = (F.col(language)["lang"] != language_id.UNDETERMINED) & (F.col(language)["score"] >= LEAST_LANGUAGE_SCORE)
    return found.filter(told).drop(language)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, 80 percent), of the smallest id.

    Documents without a word, or without an id, are in no group and stay. Rows
    are told apart by id and text: of a group's rows that share the smallest id
    one stays, and a text of another group stays whatever ids it shares.
    """
    rows = jaccard_join.grouped_rows(docs, words=5, threshold=80).filter("group_id is not null")
    rows = written(rows.select("doc_id", "text_hash", "component_id", "group_id"), "grouped")
    first = rows.filter("doc_id = component_id")
    repeated = first.groupBy("doc_id", "group_id").agg(F.min("text_hash").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    repeated = written(repeated.select("doc_id", "group_id", "kept"), "repeated")
    key = ["doc_id", "text_hash"]
    others = rows.filter("doc_id > component_id").select(key).union(first.join(repeated, ["doc_id", "group_id"]).filter("text_hash <> kept").select(key)).distinct()
    text_hash, place = unused(docs, "text_hash"), unused(docs, "place")
    key = ["doc_id", text_hash]
    stay = docs.withColumn(text_hash, jaccard_join.text_hash()).join(others.toDF(*key), key, "left_anti")
    if repeated.isEmpty():
        return stay.select(docs.columns)
    # The same text under the same id more than once: the first of the rows, in the order of their JSON text.
    again = repeated.select("doc_id", F.col("kept").alias(text_hash))
    order = Window.partitionBy(key).orderBy(F.to_json(F.struct(*docs.columns)))
    one = stay.join(again, key, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return stay.join(again, key, "left_anti").select(docs.columns).union(one.select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("language", keep_told_languages), ("near_duplicates", one_of_each_group), ("packing", pack)]

#: Trained scores and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
