import pytest
from pyspark.sql import functions as F

from tandem.functions import json_repair as J

CASES = [
    ('{"k": [true, null]}', '{"k":[true,null]}'),
    ('```JSON\n{"score": 7.5}\n```  ', '{"score":7.5}'),
    ('```json\n{"said": "he said “hi”"}\n```', '{"said":"he said “hi”"}'),  # parses before quotes are touched
    ('```\n{"t": "it’s"}\n```', '{"t":"it’s"}'),
    ("{“key”: ‘x’}", None),
    ("{“key”: 3,}", '{"key":3}'),
    ('[3, 4, ]', "[3,4]"),
    ('The result is [5, {"u": "“q”"}] as wished', '[5,{"u":"“q”"}]'),  # the span of the unchanged text
    ('[{"p":"a,b"},{"p":"c', '[{"p":"a,b"}]'),
    ('{"rows": [[1, 2], [3, ', '{"rows":[[1,2],[3]]}'),
    ('{"p": "back\\\\", "q": "cut \\" here', '{"p":"back\\\\"}'),
    ('{"p": NaN}', None),
    ('[1, Infinity, 2', None),
    ("words } only {", None),
    ("{", None),
    ('{"a": "b, {"}', '{"a":"b, {"}'),
    ('x [1, 2] ] y', None),
    ("", None),
    (None, None),
    # Half a pair of code units, numbers beyond doubles, and white space of any kind.
    ('{"a": "\\ud800", "b": "\\ud83d\\ude00"}', '{"a":"\\ud800","b":"😀"}'),
    ('{"a": 1e400, "b": [-1e999, 2.5]}', '{"a":null,"b":[null,2.5]}'),
    (f'[{"9" * 400}, 12]', "[null,12]"),
    ("\ufeff\u00a0[1,\u2003]\u3000", "[1]"),
    ("```json\u00a0[1]\u00a0```\u00a0", "[1]"),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i long, raw string")
    got = {r.i: r.v for r in df.select("i", J.repaired(F.col("raw")).alias("v")).collect()}
    assert [got[i] for i in range(len(CASES))] == [b for _, b in CASES]


@pytest.mark.parametrize(
    "text, want",
    [("[7, [8, 9", "[7, [8]]"), ('{"a": "x', '{"a": "x'), ('{"a": 1, "b": "x, y', '{"a": 1}'), ("[1, 2]", "[1, 2]"), ("1, 2", "1, 2"), ("] [1, 2", "] [1]"), ('"open, [', '"open, ['), ('[1, "a\\', "[1]")],
)
def test_closed(text, want):
    assert J.closed(text) == want
