"""Embedded labels anywhere in a text, against brute force and SQL."""

import re

import duckdb

from tandem.plans import catalog, oracles

# Fixed value: the pattern of a reference to another label.
REFERENCE = re.compile(r"\b(?:diagram|figure|table|chart)?\s*(?:for\s+)?(?:ans(?:wer)?|q(?:uestion)?)\.?\s*(\d+[a-zA-Z]?)\s*[:.\-]?\s*", re.I | re.A)


def brute_force(doc_id, text):
    n, more = doc_id % 9 + 1, (f" Diagram for Answer {doc_id % 9 + 2}: fig", f" Q{doc_id % 9 + 1}. again", "")[doc_id % 3]
    label, body, diagram = f"Ans {n}.", " " + text.replace("\n", " ") + more, doc_id % 2 == 0
    m = REFERENCE.search(body)
    ref = re.sub("[^0-9]", "", m[1]) if m else ""
    if not m or not m.start() or ref == str(n):
        return [(doc_id, 0, label, str(n), label + body, diagram)]
    return [(doc_id, 0, label, str(n), f"{label} {body[: m.start()].strip()}", False), (doc_id, 1, m[0].strip(), ref, body[m.start() :].strip(), diagram)]


def test_labels_after_the_first_200_characters(spark, tmp_path):
    long = "plain words\n" * 400
    texts = [long + "figure for ans 77: " + long, long, "short", "x" * 200 + " Question 5b - rest", long + "Q 1. own label", "see q3 first " + long + "ans 8"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["split_labels"](spark, str(tmp_path))
    columns = ["block_id", "part", "raw_label", "number", "body_text", "has_diagram"]
    got = sorted(map(tuple, got.select(columns).collect()))
    assert got == sorted(x for r in rows for x in brute_force(*r))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES['split_labels']})").fetchall()) == got


def test_whole_texts_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    columns = ["block_id", "part", "raw_label", "number", "body_text", "has_diagram"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES['split_labels']})").fetchall()
    got = catalog.QUERIES["split_labels"](spark, sf).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(len(r.body_text) for r in got) > 10_000
