"""Text functions as Column expressions and row generators."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.fixed import SPACE
from tandem.functions.labels import digits, trimmed

# Stop words of the overlap score.
STOP_WORDS = ("the", "a", "an", "of", "to", "and", "in", "is", "for", "on", "with")
# Fixed value: how a line starts that begins a numbered item.
NUMBERING = rf"^{SPACE}*(\d{{1,2}}{SPACE}*\.?{SPACE}*\(?[a-d]?\)?){SPACE}*[.).:-]?{SPACE}+"
# Fixed value: a reference to another label inside a block; the boundary counts ASCII word characters only.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
REFERENCE = rf"(?:diagram|figure|table|chart)?{SPACE}*(?:for{SPACE}+)?(?:ans(?:wer)?|q(?:uestion)?)\.?{SPACE}*(\d+[a-zA-Z]?){SPACE}*[:.\-]?{SPACE}*"


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or digits and more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def overlap_ratio(asked: Column, given: Column) -> Column:
    """Share of the first token set that the second one has."""
    return F.size(F.array_intersect(asked, given)) / F.greatest(F.size(asked), F.lit(1)).cast("double")


def split_embedded(blocks: DataFrame) -> DataFrame:
    """Blocks cut in two where another label is referred to inside.

    Columns: block_id, raw_label, number, body_text, has_diagram; result: the
    same with ``part`` (0, or 0 and 1). The first part keeps the own label and
    loses the diagram, the second has the referred label and keeps it.
    """
    own = F.coalesce(trimmed(F.col("raw_label")), F.lit(""))
    body = F.when((own != "") & F.startswith("body_text", own), F.substr("body_text", F.length(own) + 1)).otherwise(F.col("body_text"))
    rows = blocks.withColumn("own", own).withColumn("body", body)
    # The text is searched once; the reference that stands behind what comes before it is then read from where it begins.
    placed = rows.withColumn("before", F.regexp_extract("body", f"(?is)^(.*?){BOUNDARY}{REFERENCE}", 1))
    rest = placed.withColumn("rest", F.when(F.col("before") != "", F.substr("body", F.length("before") + 1)).otherwise(""))
    found = rest.withColumn("match", F.regexp_extract("rest", f"(?i)^{REFERENCE}", 0)).withColumn("ref", digits(F.regexp_extract("rest", f"(?i)^{REFERENCE}", 1)))
    cut = (F.col("match") != "") & (F.col("before") != "") & (F.col("ref") != "") & (F.col("ref") != digits(F.col("number")))
    first = F.concat(F.when(F.col("own") != "", F.concat("own", F.lit(" "))).otherwise(""), trimmed(F.col("before")))
    after = trimmed(F.col("rest"))
    part = lambda i, label, number, text, diagram: F.struct(F.lit(i).alias("part"), label.alias("raw_label"), number.alias("number"), text.alias("body_text"), diagram.alias("has_diagram"))
    left = part(0, F.col("raw_label"), F.col("number"), first, F.lit(False))
    right = part(1, trimmed(F.col("match")), F.col("ref"), after, F.col("has_diagram"))
    whole = part(0, F.col("raw_label"), F.col("number"), F.col("body_text"), F.col("has_diagram"))
    parts = F.when(cut, F.filter(F.array(left, right), lambda p: (p["part"] == 1) | (p["body_text"] != ""))).otherwise(F.array(whole))
    return found.select("block_id", F.explode(parts).alias("p")).select("block_id", "p.*")


def segment_lines(pages: DataFrame) -> DataFrame:
    """Numbered items of page texts: doc_id, item, label, body. A line that starts with a number begins an item, others go on with it."""
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", trimmed(F.col("line"))).filter("line <> ''")
    starts = lines.withColumn("starts", F.col("line").rlike(NUMBERING).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    placed = starts.withColumn("item", F.sum("starts").over(order)).filter("item > 0")
    bodies = placed.withColumn("piece", F.when(F.col("starts") == 1, trimmed(F.regexp_replace("line", NUMBERING, ""))).otherwise(F.col("line")))
    label = F.max(F.when(F.col("starts") == 1, F.regexp_replace(F.regexp_extract("line", NUMBERING, 1), f"{SPACE}+", "")))
    grouped = bodies.groupBy("doc_id", "item").agg(label.alias("label"), F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    return grouped.select("doc_id", F.col("item").cast("long").alias("item"), "label", F.array_join(F.transform("pieces", lambda p: p["piece"]), " ").alias("body"))
