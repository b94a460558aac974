"""Records of page readers: what is missing, broken or of another shape."""

from pyspark.sql import functions as F

from tandem.operators import extraction, geometry, scoring

DOCUMENTS = "session_id long, page long, doc long, raw string"


def test_questions(spark):
    raw = '{"questions": [{"questionNumber": "Q2", "questionText": "b", "boundingBox": {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}, "lowConfidence": true}, {"questionNumber": "1(b)", "questionText": "a", "totalMarks": 2.5}, null, {}]}'
    docs = spark.createDataFrame([(1, 3, 0, raw), (1, 1, 0, "{"), (1, 2, 0, None), (2, 1, 0, "[1]"), (3, 1, 0, '{"questions": null}')], DOCUMENTS)
    got = [(r.place, r.label, r.order, r.marks, r.region and tuple(r.region), r.low_confidence, r.question_id) for r in extraction.questions_of(docs).orderBy("place").collect()]
    last = 9007199254740991
    assert got == [(1, "1(b)", 102, 2.5, None, False, "1-q3-0-1"), (2, "Q2", 200, None, (3, 0.1, 0.2, 0.3, 0.4), True, "1-q3-0-0"), (3, None, last, None, None, False, "1-q3-0-3")]


def test_answers(spark):
    one = '{"answers": [{"detectedQuestionNumber": "Ans 4a", "detectedNumberRawText": "Ans 4a", "answerText": "x", "pageNumber": 5, "boundingBox": {"x": 0, "y": 0, "width": 1, "height": 1}}, {"answerText": "y", "crossedOut": true}]}'
    docs = spark.createDataFrame([(1, 2, 0, one), (1, 1, 1, '{"answers": [{"answerText": "first"}]}'), (1, 1, 0, "x")], DOCUMENTS)
    got = [(r.sequence_index, r.canonical, r.text, r.page, [b.page for b in r.boxes], r.crossed_out) for r in extraction.answers_of(docs).orderBy("sequence_index").collect()]
    assert got == [(0, None, "first", 1, [], False), (1, "4(a)", "x", 5, [5], False), (2, None, "y", 2, [], True)]


def test_guards(spark):
    rows = [(0.0, 0.5), (2.0, 1.5), (3.0, -0.1), (1.5, float("nan")), (-1.0, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "i double, c double")
    got = [tuple(r) for r in df.select(scoring.guarded_index(F.col("i"), F.lit(3)), scoring.clamp01(F.col("c"))).collect()]
    assert got == [(0, 0.5), (2, 1.0), (None, 0.0), (None, 0.0), (None, 0.0), (None, 1.0)]


def test_page_counts(spark):
    answers = spark.createDataFrame([(1, 4), (1, 2), (2, 1), (4, 0)], "session_id long, page long")
    files = spark.createDataFrame([(1, 3), (2, 5), (3, None)], "session_id long, page_count long")
    assert {tuple(r) for r in geometry.page_counts(answers, files).collect()} == {(1, 4), (2, 5), (3, 1), (4, 1)}


def test_documents_are_parsed_once(spark, capsys):
    """No filter on what a document holds parses it again; documents without records give none."""
    docs = spark.createDataFrame([(1, 1, 0, '{"answers": [{"answerText": "x"}, null]}'), (1, 1, 1, '{"answers": []}'), (1, 1, 2, "no JSON"), (1, 1, 3, None)], "session_id long, page long, doc long, raw string")
    rows = extraction._records(docs, extraction.ANSWERS, "answers")
    rows.explain(True)
    assert capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("from_json") == 1
    assert [(r.doc, r.pos, r.r.answerText) for r in rows.collect()] == [(0, 0, "x")]
