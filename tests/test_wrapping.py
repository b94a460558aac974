"""Line breaking against a loop."""

import random

from pyspark.sql import functions as F

from tandem.functions.wrapping import wrapped


def looped(text, width):
    lines, line = [], ""
    for word in text.split():
        longer = f"{line} {word}".strip()
        if len(longer) <= width:
            line = longer
        else:
            if line:
                lines.append(line)
            line = word
    return lines + [line] if line else lines


def test_equals_a_loop(spark):
    rnd = random.Random(1)
    texts = ["", " \n\t", "one", "x" * 50, f"{'x' * 50} a {'y' * 9}", "a " * 40, "é😀 " * 30, "a b c\u0085d\x1ce", " lead and trail "]
    texts += ["".join(rnd.choice(["a", "bb", "ccc", "dddddddddddddd", " ", " ", "\n", " ", "é"]) for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    texts += [" ".join("w" * rnd.randint(1, 12) for _ in range(5_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for width in (1, 10, 13):
        got = {r.i: r.lines for r in df.select("i", wrapped(F.col("t"), width).alias("lines")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == looped(t, width), (width, t[:200])


def test_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(wrapped(F.col("t")).alias("x")).first().x is None
