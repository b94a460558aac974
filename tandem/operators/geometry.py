"""Regions on pages: clipping, padding, spacing. Boxes: session_id, page, answer_id, seq, x, y, w, h."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.fixed import SPACE
from tandem.functions.labels import trimmed
from tandem.sources.tables import by_key, written

# Horizontal and vertical padding, least gap and page height in pixels.
PAD_X, PAD_Y, LEAST_GAP, PAGE_PIXELS = 0.01, 0.012, 50.0, 2000.0



def _page():
    return Window.partitionBy("session_id", "page")


def clipped(boxes: DataFrame) -> DataFrame:
    """Boxes cut where they overlap the next box of another answer on the page."""
    down = _page().orderBy("y", "seq")
    rows = boxes.withColumn("next_y", F.lead("y").over(down)).withColumn("next_id", F.lead("answer_id").over(down))
    overlaps = (F.col("next_id") != F.col("answer_id")) & (F.col("y") + F.col("h") > F.col("next_y")) & (F.col("next_y") > F.col("y"))
    return rows.withColumn("h", F.when(overlaps, F.col("next_y") - F.col("y")).otherwise(F.col("h"))).drop("next_y", "next_id")


def padded(boxes: DataFrame) -> DataFrame:
    """Boxes with padding, at most half the gap to the nearest box above and below on the page.

    The nearest bottom above is a running maximum over bottoms, the nearest top
    below the next larger top: sorted windows over edges instead of a self join.
    Boxes without height, whose own edges would be the nearest, are compared with
    the other boxes of their page.
    """
    edges = boxes.select("*", F.explode(F.array(F.struct((F.col("y") + F.col("h")).alias("at"), F.lit(1).alias("kind")), F.struct(F.col("y").alias("at"), F.lit(0).alias("kind")))).alias("e")).select("*", "e.*").drop("e")
    by_edge = _page().orderBy("at")
    upto = by_edge.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_edge.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    is_bottom, is_top = F.col("kind") == 1, F.col("kind") == 0
    seen = edges.select(
        "*",
        F.max(F.when(is_bottom, F.col("at"))).over(upto).alias("bottom_above"),
        F.min(F.when(is_top, F.col("at"))).over(onward).alias("top_below"),
    )
    keys = ["session_id", "page", "answer_id", "seq", "x", "y", "w", "h"]
    wide = seen.filter("h > 0").groupBy(*keys).agg(F.max(F.when(is_top, F.col("bottom_above"))).alias("above"), F.max(F.when(is_bottom, F.col("top_below"))).alias("below"))
    others = boxes.select("session_id", "page", F.col("answer_id").alias("o_id"), F.col("seq").alias("o_seq"), F.col("y").alias("o_top"), (F.col("y") + F.col("h")).alias("o_bottom"))
    flat = boxes.select(keys).filter("h <= 0").join(others, ["session_id", "page"], "left")
    other = (F.col("o_id") != F.col("answer_id")) | (F.col("o_seq") != F.col("seq"))
    flat = flat.groupBy(*keys).agg(F.max(F.when(other & (F.col("o_bottom") <= F.col("y")), F.col("o_bottom"))).alias("above"), F.min(F.when(other & (F.col("o_top") >= F.col("y") + F.col("h")), F.col("o_top"))).alias("below"))
    wide = wide.unionByName(flat)
    top = F.least(F.lit(PAD_Y), F.coalesce((F.col("y") - F.col("above")) / 2, F.lit(PAD_Y)))
    bottom = F.least(F.lit(PAD_Y), F.coalesce((F.col("below") - (F.col("y") + F.col("h"))) / 2, F.lit(PAD_Y)))
    return wide.select(
        *keys[:4], F.greatest(F.lit(0.0), F.col("x") - PAD_X).alias("left"), F.least(F.lit(1.0), F.col("x") + F.col("w") + PAD_X).alias("right"),
        F.greatest(F.lit(0.0), F.col("y") - top).alias("top"), F.least(F.lit(1.0), F.col("y") + F.col("h") + bottom).alias("bottom"),
    )


def extents(boxes: DataFrame) -> DataFrame:
    """Top and bottom of every answer on each page."""
    return boxes.groupBy("session_id", "page", "answer_id").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))


def gap_insertions(boxes: DataFrame, pixels: float = PAGE_PIXELS) -> DataFrame:
    """Blank space (pixels) to insert below an answer so that the next one starts at least LEAST_GAP lower."""
    w = _page().orderBy("top", "answer_id")
    rows = extents(boxes).select("session_id", "page", "answer_id", (F.col("top") * pixels).alias("top"), (F.col("bottom") * pixels).alias("bottom")).withColumn("next_top", F.lead("top").over(w))
    return rows.withColumn("amount", LEAST_GAP - (F.col("next_top") - F.col("bottom"))).filter("amount > 0").select("session_id", "page", "answer_id", F.col("bottom").alias("at_y"), "amount")


def answer_spans(boxes: DataFrame) -> DataFrame:
    """Distinct pages of every answer label's boxes, in order."""
    return boxes.groupBy("session_id", "canonical").agg(F.array_join(F.sort_array(F.collect_set("page")), ",").alias("pages"), (F.count_distinct("page") > 1).alias("several"))


def shifts(boxes: DataFrame, insertions: DataFrame, pixels: float = PAGE_PIXELS) -> DataFrame:
    """How far (in thousandths of a pixel) each box moves down: the sum of all insertions at or above its top.

    A running sum over box tops and insertions in one order, not a range join.
    """
    tops = boxes.select("session_id", "page", "answer_id", (F.col("y") * pixels).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("e3"))
    cuts = insertions.select("session_id", "page", F.lit(None).cast("string").alias("answer_id"), F.col("at_y").alias("at"), F.lit(0).alias("kind"), F.floor(F.col("amount") * 1000 + 0.5).alias("e3"))
    upto = _page().orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return tops.unionByName(cuts).withColumn("shift_e3", F.sum("e3").over(upto)).filter("kind = 1").select("session_id", "page", "answer_id", "shift_e3")


def run_label(text):
    """A run's text or a label as they are compared: trimmed, lower-cased, white space folded."""
    return F.regexp_replace(F.lower(trimmed(text)), f"{SPACE}+", " ")


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Runs with text, numbered (``place``, from 0) by page and top within their session."""
    w = Window.partitionBy("session_id").orderBy("page", "y", "run")
    return runs.filter(trimmed(F.col("text")) != "").withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def anchors(blocks: DataFrame, placed_runs: DataFrame, dealt: bool = False) -> DataFrame:
    """session_id, answer_id, place: each block's run, the next unclaimed one that begins with its label.

    Runs meet labels in their beginnings of the labels' lengths. Where every run of
    a session begins with one label at most, labels do not compete, and the n-th
    block of a label has its n-th run. In other sessions, as with ``ans 1`` and
    ``ans 10``, blocks claim one after the other in order of ``seq``; only those
    sessions' matching runs go through Python, a session (one document) at a time.
    ``dealt`` says that both sides come dealt by session; they stay so.
    """
    keep = by_key if dealt else written
    labels = keep(blocks.select("session_id", "answer_id", "seq", run_label(F.col("label")).alias("label")).filter("label <> ''"), "labels")
    texts = placed_runs.select("session_id", "place", run_label(F.col("text")).alias("text"))
    lengths = labels.select("session_id", F.length("label").alias("n")).distinct()
    begun = texts.join(lengths, "session_id").filter(F.length("text") >= F.col("n")).select("session_id", "place", "text", F.left("text", F.col("n")).alias("label"))
    met = keep(begun.join(labels.select("session_id", "label").distinct(), ["session_id", "label"]), "met")
    competing = met.groupBy("session_id", "place").agg(F.count("*").alias("labels")).filter("labels > 1").select("session_id").distinct()
    nth = lambda order: F.row_number().over(Window.partitionBy("session_id", "label").orderBy(order))
    free = met.join(competing, "session_id", "left_anti").withColumn("r", nth("place"))
    asking = labels.join(competing, "session_id", "left_anti").withColumn("r", nth("seq"))
    alone = asking.join(free, ["session_id", "label", "r"]).select("session_id", "answer_id", "place")
    return alone.unionByName(_claimed(labels.join(competing, "session_id", "left_semi"), met.join(competing, "session_id", "left_semi").select("session_id", "place", "text").distinct()))


def _claimed(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """session_id, answer_id, place: labels claim the first free run that begins with them, one after the other."""

    def claims(key, labels, texts):
        texts = texts.sort_values("place")
        free, found = dict(zip(texts.place.tolist(), texts.text.tolist())), []
        for answer_id, label in labels.sort_values("seq")[["answer_id", "label"]].itertuples(index=False):
            place = next((p for p, text in free.items() if text.startswith(label)), None)
            if place is not None:
                del free[place]
                found.append((key[0], answer_id, place))
        return pd.DataFrame(found, columns=["session_id", "answer_id", "place"])

    return labels.groupBy("session_id").cogroup(texts.groupBy("session_id")).applyInPandas(claims, "session_id long, answer_id string, place long")


def anchored_boxes(blocks: DataFrame, runs: DataFrame, dealt: bool = False) -> DataFrame:
    """Boxes (page, left, right, top, bottom) of blocks from the text runs between their anchor and the next one on its page.

    A block with a diagram reaches down to the next anchor, or to the end of the
    page, and as wide as its rough box on that page. No box reaches below the
    rough top of the first later block on its page, if that lies below its own
    top. Blocks without an anchor have none. ``dealt`` as in ``anchors``.
    """
    placed = (by_key if dealt else written)(ordered_runs(runs), "runs")
    owned = placed.join(anchors(blocks, placed, dealt), ["session_id", "place"], "left")
    upto = Window.partitionBy("session_id", "page").orderBy("place")
    later = upto.rowsBetween(1, Window.unboundedFollowing)
    owned = owned.withColumn("below", F.first(F.when(F.col("answer_id").isNotNull(), F.col("y")), ignorenulls=True).over(later))
    owned = owned.withColumn("below", F.when(F.col("answer_id").isNotNull(), F.col("below"))).withColumn("answer_id", F.last("answer_id", ignorenulls=True).over(upto)).filter("answer_id is not null")
    extent = owned.groupBy("session_id", "answer_id").agg(F.first("page").alias("page"), F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.max("below").alias("below"))
    seen = extent.join(blocks.drop("label"), ["session_id", "answer_id"])
    wide = F.col("has_diagram") & (F.col("rough_page") == F.col("page"))
    tight = seen.select(
        "session_id", "answer_id", "seq", "page", F.when(wide, F.least("left", "rough_x")).otherwise(F.col("left")).alias("left"), F.when(wide, F.greatest("right", F.col("rough_x") + F.col("rough_w"))).otherwise(F.col("right")).alias("right"),
        "top", F.when(F.col("has_diagram"), F.coalesce("below", F.lit(1.0))).otherwise(F.col("bottom")).alias("bottom"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("rough_y"),
    )
    none = F.lit(None).cast("double")
    rough = blocks.filter("rough_page is not null").select("session_id", "answer_id", "seq", F.col("rough_page").alias("page"), none.alias("left"), none.alias("right"), none.alias("top"), none.alias("bottom"), F.lit(0).alias("kind"), "rough_y")
    after = Window.partitionBy("session_id", "page").orderBy("seq", "kind").rowsBetween(1, Window.unboundedFollowing)
    both = tight.unionByName(rough).withColumn("ceiling", F.first("rough_y", ignorenulls=True).over(after)).filter("kind = 1")
    bottom = F.when(F.col("ceiling") > F.col("top"), F.least("bottom", "ceiling")).otherwise(F.col("bottom"))
    return both.select("session_id", "answer_id", "page", "left", "right", "top", bottom.alias("bottom"))


# Resolution, points in an inch, longest edge of a page; least edge of an image, and to what it is scaled.
DPI, POINTS, LONGEST, LEAST_EDGE, SCALED_EDGE = 200.0, 72.0, 2200.0, 900, 1200.0


def page_pixels(width, height):
    """Pixels (struct of width and height) of a page of so many points, at most LONGEST on its longer side."""
    scale = F.lit(DPI / POINTS)
    fit = F.when(F.greatest(width, height) * scale > LONGEST, scale * (LONGEST / (F.greatest(width, height) * scale))).otherwise(scale)
    return F.struct(F.ceil(width * fit).cast("long").alias("width"), F.ceil(height * fit).cast("long").alias("height"))


def image_pixels(width, height):
    """Width of an image after small ones are scaled up so that their shorter side is SCALED_EDGE."""
    short = F.least(width, height)
    return F.when(short < LEAST_EDGE, F.floor(width * (SCALED_EDGE / short) + 0.5)).otherwise(width).cast("long")


# How far a glyph reaches above and below its baseline, in font heights.
ASCENT, DESCENT = 0.82, 0.28


def run_fractions(runs: DataFrame) -> DataFrame:
    """Text runs in page units as fractions of their page, from the top left: x, y_top, y_bottom, width; blank ones are left out.

    runs: a, b, c, d, e, f (the matrix that places the run, from the bottom left),
    run_width (null: as wide as so many letters of the matrix), text, page_width,
    page_height, and others, which stay.
    """
    wide = F.hypot("a", "b")
    upright = F.hypot("c", "d")
    height = F.when(upright > 0, upright).otherwise(wide)
    own = F.coalesce(F.col("run_width"), wide * F.length("text"))
    down = lambda y: (F.col("page_height") - y) / F.col("page_height")
    kept = runs.filter(trimmed(F.col("text")) != "")
    placed = kept.select("*", (F.col("e") / F.col("page_width")).alias("x"), down(F.col("f") + height * ASCENT).alias("y_top"), down(F.col("f") - height * DESCENT).alias("y_bottom"), (own / F.col("page_width")).alias("width"))
    return placed.drop("a", "b", "c", "d", "e", "f", "run_width", "page_width", "page_height")


def word_fractions(words: DataFrame) -> DataFrame:
    """Boxes of words in pixels (x0, y0, x1, y1 of an image of image_width by image_height) as fractions: x, y, width, height."""
    w, h = F.col("image_width"), F.col("image_height")
    placed = words.select("*", (F.col("x0") / w).alias("x"), (F.col("y0") / h).alias("y"), ((F.col("x1") - F.col("x0")) / w).alias("width"), ((F.col("y1") - F.col("y0")) / h).alias("height"))
    return placed.drop("x0", "y0", "x1", "y1", "image_width", "image_height")


def css(x, y, w, h) -> list:
    """left, top, width and height of a box in percent of its page, as style sheets have them."""
    return [F.concat((c * 100).cast("string"), F.lit("%")).alias(n) for c, n in ((x, "left"), (y, "top"), (w, "width"), (h, "height"))]


def page_counts(answers: DataFrame, files: DataFrame) -> DataFrame:
    """session_id, pages: the file's own count (files: session_id, page_count), but no less than the highest page with an answer, and 1."""
    seen = answers.groupBy("session_id").agg(F.max("page").alias("highest"))
    return seen.join(files, "session_id", "full").select("session_id", F.greatest(F.coalesce("page_count", F.lit(1)), F.coalesce("highest", F.lit(1)), F.lit(1)).cast("long").alias("pages"))
