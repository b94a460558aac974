"""Grades by length and their summary per session."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.labels import trimmed

# Fixed values of the method.
DEFAULT_MARKS, FULL_LENGTH, STRONG, WEAK = 5, 200, 0.75, 0.5


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp_marks(value: Column, most: Column) -> Column:
    """To the nearest half, between 0 and the most."""
    return F.greatest(F.lit(0.0), F.least(most.cast("double"), half_up(value * 2) / 2.0))


def grades(mappings: DataFrame) -> DataFrame:
    """Marks of every question, with its label: by the length of the linked text, none without one."""
    total = F.coalesce("marks", F.lit(DEFAULT_MARKS)).cast("double")
    ratio = F.least(F.length(trimmed(F.col("full_text"))) / float(FULL_LENGTH), F.lit(1.0))
    linked = F.col("answer_id").isNotNull()
    return mappings.select(
        "session_id", "question_id", "ordinal", "label", "answer_id", "confidence", total.alias("total_marks"),
        F.when(linked, half_up(ratio * total * 2) / 2.0).otherwise(0.0).alias("marks_awarded"),
        F.when(linked, 0.2).otherwise(1.0).alias("grade_confidence"), (~linked).alias("ungraded"),
    )


def summary(graded: DataFrame, orphan_counts: DataFrame) -> DataFrame:
    """One row per session; sums of halves and of ten-thousandths, so that means round alike everywhere."""
    linked = ~F.col("ungraded")
    sums = graded.groupBy("session_id").agg(
        F.sum("marks_awarded").alias("marks_awarded"), F.sum("total_marks").alias("marks_possible"), F.count("*").alias("total_questions"), F.count_if(linked).alias("attempted"),
        F.sum(F.when(linked, half_up(F.col("confidence") * 10000))).alias("c"),
    )
    mean = F.when(F.col("attempted") > 0, F.floor((2 * F.col("c") + 100 * F.col("attempted")) / (200 * F.col("attempted"))) / 100.0).otherwise(0.0)
    percent = F.when(F.col("marks_possible") > 0, half_up(F.col("marks_awarded") / F.col("marks_possible") * 1000) / 10.0).otherwise(0.0)
    return sums.join(orphan_counts.hint("merge"), "session_id", "left").select(
        "session_id", "marks_awarded", "marks_possible", percent.alias("percentage"), "attempted", (F.col("total_questions") - F.col("attempted")).alias("unanswered"),
        "total_questions", F.coalesce("orphans", F.lit(0)).cast("long").alias("orphans"), mean.alias("mean_confidence"),
    )


def areas(graded: DataFrame) -> DataFrame:
    """Labels of strong and weak questions of each session, in order."""
    ratio = F.col("marks_awarded") / F.col("total_marks")
    rows = graded.filter(~F.col("ungraded") & (F.col("total_marks") > 0)).withColumn("ratio", ratio)
    ordered = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "label", "ratio"))).alias("q"))
    named = lambda keep: F.array_join(F.transform(F.filter("q", keep), lambda q: F.concat(F.lit("Q"), q["label"])), ",")
    return ordered.select("session_id", named(lambda q: q["ratio"] >= STRONG).alias("strong"), named(lambda q: q["ratio"] < WEAK).alias("weak"))


def badge_tier(awarded: Column, total: Column) -> Column:
    ratio = F.when(total > 0, awarded / total).otherwise(0.0)
    return F.when(ratio >= 0.7, "success").when(ratio >= 0.3, "warning").otherwise("danger")


def history_tier(percent: Column) -> Column:
    return F.when(percent >= 80, "Excellent").when(percent >= 50, "Average").otherwise("Needs work")


def clamp01(value):
    """A confidence held between 0 and 1; null and NaN become 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(value, F.lit(0.0)), F.lit(0.0))))


def guarded_index(index, candidates):
    """A candidate's index (double) if it is whole and one of ``candidates`` many, else null."""
    return F.when((index == F.floor(index)) & (index >= 0) & (index < candidates), index.cast("long"))
