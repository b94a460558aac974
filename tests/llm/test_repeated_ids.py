import corpus_pipeline as P
from tandem.llm import jaccard_join as J

A = " ".join(f"a{i}" for i in range(60))
NEAR_A = A.replace("a59", "z")
B, C, D = (" ".join(f"{x}{i}" for i in range(40)) for x in "bcd")
SCHEMA = "doc_id long, text string, lang string"


def test_one_row_of_each_group_stays(spark):
    rows = [(1, A, "y"), (1, A, "x"), (1, A, "y"), (3, A, "x"), (4, NEAR_A, "x")]  # a group whose smallest id is repeated
    rows += [(3, B, "x"), (3, B, "x")]  # another text of an id that goes, repeated
    rows += [(5, C, "x"), (5, D, "x"), (6, D, "x"), (7, C.upper(), "x")]  # one id, smallest of two groups
    rows += [(8, "e f g h i j", "x"), (8, "E f g h i j", "x")]  # the same set, written in two ways
    rows += [(9, None, "x"), (9, "", "x"), (9, "", "x"), (None, A, "x"), (None, A, "x")]
    got = P.one_of_each_group(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    words = sorted(((r.doc_id, r.text, r.lang) for r in got if r.doc_id is not None and r.text), key=str)
    eighth = [x for x in words if x[0] == 8]
    assert len(eighth) == 1 and [x for x in words if x[0] != 8] == [(1, A, "x"), (3, B, "x"), (5, C, "x"), (5, D, "x")]
    assert len([r for r in got if not r.text]) == 3 and len([r for r in got if r.doc_id is None]) == 2 and len(got) == 10


def test_every_text_of_an_id_is_linked(spark, monkeypatch):
    monkeypatch.setattr(J, "MOST_BROADCAST", 0)
    rows = [(2, B, "x"), (5, "short text of five words", "x"), (5, A, "x"), (9, NEAR_A, "x"), (7, B, "x"), (7, C, "x"), (7, C, "x")]
    got = J.grouped_rows(spark.createDataFrame(rows, SCHEMA), 4, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted([(2, 37, 2), (5, 2, 5), (5, 57, 5), (9, 57, 5), (7, 37, 2), (7, 37, 7), (7, 37, 7)])
    assert len({r.group_id for r in got}) == 4
