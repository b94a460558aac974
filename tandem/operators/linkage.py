"""Linking prompts to responses by label, by near label, by content, and by elimination.

All steps are keyed by session. Columns: questions (session_id, question_id,
ordinal, label, marks, low_confidence, text), answers (session_id, answer_id, seq,
raw_label, text, crossed_out, low_confidence, has_diagram).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.labels import canonical, closeness, compared, trimmed
from tandem.functions.text import tokens
from tandem.sources.tables import by_key, dealt_by, written

# Fixed values of the method.
EXACT_BASE, FUZZY_LEAST, CONTENT_LEAST, CONTENT_ACCEPT, RESIDUAL_BASE, REVIEW_BELOW, LARGEST_GAP = 0.95, 0.72, 0.08, 0.25, 0.35, 0.55, 3


#: Distinct labels up to which they are broadcast; more are shuffled.
MOST_LABELS = 50_000


def per_label(rows: DataFrame, label: str, **forms) -> DataFrame:
    """``rows`` with a column for each of ``forms``: what it makes of their ``label``, made once for each distinct label.

    ``rows`` are read twice, so they should be a table or cheap to make. Joins with
    the result are not broadcast, however small Spark takes it for.
    """
    spelled = rows.select(label).filter(F.col(label).isNotNull()).distinct()
    made = written(spelled.select(F.col(label).alias("spelled"), *[form(F.col(label)).alias(name) for name, form in forms.items()]), "labels")
    if made.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        made = F.broadcast(made)
    return rows.join(made, F.col(label) == F.col("spelled"), "left").drop("spelled").hint("merge")


def form(label: Column) -> Column:
    """What near labels are compared by: the canonical label, normalized once more."""
    return compared(canonical(label))


def labelled(answers: DataFrame) -> DataFrame:
    return per_label(answers, "raw_label", canonical=canonical, form=form).filter("canonical is not null")


def resolved(answers: DataFrame) -> DataFrame:
    """Answers with a label and their role in the label's group: primary, additional or duplicate."""
    group = Window.partitionBy("session_id", "canonical")
    by_seq = group.orderBy("seq")
    size = F.length(trimmed(F.col("text"))).cast("double")
    worth = size * F.when(F.col("crossed_out"), 0.3).otherwise(1.0) * F.when(F.col("low_confidence"), 0.7).otherwise(1.0)
    rows = labelled(answers).withColumn("gap", F.col("seq") - F.lag("seq").over(by_seq)).withColumn("worth", worth)
    rows = rows.withColumn("first", F.row_number().over(by_seq)).withColumn("best", F.row_number().over(group.orderBy(F.desc("worth"), "seq")))
    merged = F.bool_or("has_diagram").over(group) | (F.coalesce(F.max("gap").over(group), F.lit(0)) <= LARGEST_GAP)
    role = F.when(merged, F.when(F.col("first") == 1, "primary").otherwise("additional")).otherwise(F.when(F.col("best") == 1, "primary").otherwise("duplicate"))
    return rows.withColumn("role", role)


def groups(answers: DataFrame) -> DataFrame:
    """One row per session and label: the primary answer, what it merges, and the merged text."""
    r = resolved(answers)
    primary = F.col("role") == "primary"
    kept = F.sort_array(F.collect_list(F.when(F.col("role") != "duplicate", F.struct("seq", "answer_id", "text"))))
    g = r.groupBy("session_id", "canonical").agg(
        F.max("form").alias("form"),
        F.min("seq").alias("first_seq"),
        F.max(F.when(primary, F.col("answer_id"))).alias("answer_id"),
        F.bool_or(primary & F.col("crossed_out")).alias("a_crossed"),
        F.bool_or(primary & F.col("low_confidence")).alias("a_low"),
        F.max(F.when(primary, F.length(trimmed(F.col("text"))))).alias("a_length"),
        F.count_if(F.col("role") == "additional").alias("n_additional"),
        kept.alias("kept"),
    )
    return g.withColumn("full_text", F.array_join(F.transform("kept", lambda k: k["text"]), "\n\n")).withColumn("merged_ids", F.transform("kept", lambda k: k["answer_id"])).drop("kept")


def score(base: Column) -> Column:
    """Confidence of a pairing: the base less what speaks against it, between 0 and 1."""
    s = base - F.when(F.col("q_low"), 0.1).otherwise(0.0) - F.when(F.col("a_low"), 0.1).otherwise(0.0) - F.when(F.col("a_crossed"), 0.05).otherwise(0.0)
    s = s - F.when((F.col("marks") >= 3) & (F.col("a_length") < 15), 0.08).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def needs_review(confidence: Column, below: float = REVIEW_BELOW) -> Column:
    return confidence < below


def keyed(questions: DataFrame) -> DataFrame:
    return per_label(questions, "label", canonical=canonical, form=form).select("session_id", "question_id", "ordinal", "label", "marks", F.col("low_confidence").alias("q_low"), "canonical", "form", F.col("text").alias("q_text"))


#: What a question gets from its answer.
LINKED = ["answer_id", "method", "confidence", "n_additional", "full_text", "merged_ids"]


def exact(keyed_questions: DataFrame, g: DataFrame) -> DataFrame:
    """Every question with the group of its label, if there is one."""
    joined = keyed_questions.join(g.drop("form"), ["session_id", "canonical"], "left")
    return joined.withColumn("method", F.when(F.col("answer_id").isNotNull(), "number-exact")).withColumn("confidence", F.when(F.col("answer_id").isNotNull(), score(F.lit(EXACT_BASE))))


def nearest(keyed_questions: DataFrame, g: DataFrame) -> DataFrame:
    """session_id, question_id, near, similarity of questions without a group: the most similar label that no question has, if it is similar enough."""
    label = ["session_id", "canonical"]
    asked = keyed_questions.select("session_id", "question_id", "canonical", F.col("form").alias("x")).filter("canonical is not null")
    open_ = asked.join(g.select(label), label, "left_anti").drop("canonical").hint("merge")
    free = g.select(*label, F.col("form").alias("y"), "first_seq").join(asked.select(label), label, "left_anti").withColumnRenamed("canonical", "near")
    # An edit distance is at least the difference of the lengths of what is compared.
    near_length = F.abs(F.length("x") - F.length("y")) <= (1 - FUZZY_LEAST) * F.greatest(F.length("x"), F.length("y")) + 1e-9
    pairs = open_.join(free, "session_id").filter(near_length).withColumn("similarity", closeness(F.col("x"), F.col("y"))).filter(F.col("similarity") >= FUZZY_LEAST)
    best = Window.partitionBy("session_id", "question_id").orderBy(F.desc("similarity"), "first_seq")
    return pairs.withColumn("r", F.row_number().over(best)).filter("r = 1").select("session_id", "question_id", "near", "similarity")


def by_label(keyed_questions: DataFrame, g: DataFrame) -> DataFrame:
    """One row per question: matched by exact label, else by near label, else empty.

    Near labels are found first, on keys and labels alone; then each question
    meets one group, that of its own label or of the near one.
    """
    aimed = keyed_questions.join(nearest(keyed_questions, g), ["session_id", "question_id"], "left").withColumn("target", F.coalesce("near", "canonical"))
    met = aimed.join(g.drop("form").withColumnRenamed("canonical", "target"), ["session_id", "target"], "left")
    found = F.col("answer_id").isNotNull()
    near = F.col("near").isNotNull()
    linked = met.withColumn("method", F.when(found, F.when(near, "number-fuzzy").otherwise("number-exact")))
    linked = linked.withColumn("confidence", F.when(found, F.when(near, score(0.6 + 0.3 * F.col("similarity"))).otherwise(score(F.lit(EXACT_BASE)))))
    return linked.select("session_id", "question_id", "ordinal", "label", "marks", "canonical", "q_low", "q_text", *LINKED, "near", "similarity")


def candidates(questions: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs of a question and an answer of its session whose word overlap is large enough: session_id, question_id, ordinal, answer_id, seq, ratio.

    Pairs meet in their common words, which are counted; other pairs are never formed.
    """
    q = questions.select("session_id", "question_id", "ordinal", tokens(F.col("text")).alias("t"))
    asked = q.select("session_id", "question_id", "ordinal", F.size("t").alias("n"), F.explode("t").alias("token"))
    given = pool.select("session_id", "answer_id", "seq", F.explode(tokens(F.col("text"))).alias("token"))
    met = asked.join(given, ["session_id", "token"]).groupBy("session_id", "question_id", "ordinal", "answer_id", "seq").agg((F.count("*") / F.first("n").cast("double")).alias("ratio"))
    return met.filter((F.col("ratio") > CONTENT_LEAST) & (content_base(F.col("ratio")) > CONTENT_ACCEPT))


def content_base(ratio: Column) -> Column:
    return F.least(ratio * 1.5, F.lit(0.6))


def by_content(questions: DataFrame, pool: DataFrame) -> DataFrame:
    """Greedy assignment: questions in order take the free answer with the largest word overlap, if it is large enough.

    questions: session_id, question_id, ordinal, text; pool: session_id,
    answer_id, seq, text. Result: session_id, question_id, answer_id, ratio.

    Done in rounds for all sessions at once: a question takes its best free
    answer as soon as no earlier open question could take it. The first open
    question of a session always can, so rounds end; no session is gathered in
    one row.
    """
    best = Window.partitionBy("session_id", "question_id").orderBy(F.desc("ratio"), "seq", "answer_id")
    wanted = Window.partitionBy("session_id", "answer_id").orderBy("ordinal", "question_id")
    of_question, of_answer = Window.partitionBy("session_id", "question_id"), Window.partitionBy("session_id", "answer_id")
    left, picks = candidates(questions, pool), None
    while picks is None or not left.isEmpty():
        ranked = left.withColumn("place", F.row_number().over(best)).withColumn("turn", F.row_number().over(wanted)).withColumn("taken", (F.col("place") == 1) & (F.col("turn") == 1)).drop("place", "turn")
        round_ = written(ranked.withColumn("gone", F.bool_or("taken").over(of_answer) | F.bool_or("taken").over(of_question)), "candidates")
        taken = round_.filter("taken").select("session_id", "question_id", "answer_id", "ratio")
        picks = taken if picks is None else picks.union(taken)
        left = round_.filter("not gone").drop("taken", "gone")
    return picks


def residual(open_questions: DataFrame, free_answers: DataFrame) -> DataFrame:
    """Sessions with exactly one open question and one free answer: the pair."""
    q = open_questions.groupBy("session_id").agg(F.count("*").alias("nq"), F.max("question_id").alias("question_id")).filter("nq = 1").hint("merge")
    a = free_answers.groupBy("session_id").agg(F.count("*").alias("na"), F.max("answer_id").alias("answer_id")).filter("na = 1")
    return q.join(a, "session_id").select("session_id", "question_id", "answer_id")


def consumed(mappings: DataFrame) -> DataFrame:
    """session_id, answer_id of all answers that a mapping uses, each once."""
    return mappings.filter("answer_id is not null").select("session_id", F.explode("merged_ids").alias("answer_id")).distinct()


def link(questions: DataFrame, answers: DataFrame, dealt: bool = False, parts: int | None = None) -> DataFrame:
    """All four phases; one row per question.

    Columns: session_id, question_id, ordinal, label, marks, canonical, LINKED
    (null where nothing was found), near and similarity of a near label, ratio of
    shared words, needs_review.

    Both sides are dealt by session once, and all steps use that: ``dealt`` says
    that they come so (from a window, a repartition or ``by_key``), in ``parts`` parts
    (``parts_of``). Only what the labels linked is written whole, in buckets of
    sessions.
    """
    if not dealt:
        questions, answers = dealt_by(questions, "session_id", parts), dealt_by(answers, "session_id", parts)
    m = by_key(by_label(keyed(questions), groups(answers)), "by-label", "session_id", parts)
    used = m.filter("answer_id is not null").select("session_id", F.explode("merged_ids").alias("answer_id"))
    free = by_key(answers.join(used, ["session_id", "answer_id"], "left_anti"), "free", "session_id", parts)
    open_ = m.filter("answer_id is null").select("session_id", "question_id", "ordinal", F.col("q_text").alias("text"))
    picked = dealt_by(by_content(open_, free), "session_id", parts).hint("merge")
    # Whether just one question and one answer are left shows in counts; only of such sessions the rows are looked up.
    of = lambda rows, n: rows.groupBy("session_id").agg(F.count("*").alias(n))
    counts = of(open_, "nq").join(of(free, "na"), "session_id").join(of(picked, "np"), "session_id", "left").withColumn("np", F.coalesce("np", F.lit(0)))
    last = dealt_by(written(counts.filter("nq - np = 1 and na - np = 1").select("session_id"), "last"), "session_id", parts).hint("merge")
    still = open_.join(last, "session_id", "left_semi").join(picked, ["session_id", "question_id"], "left_anti")
    left = free.join(last, "session_id", "left_semi").join(picked, ["session_id", "answer_id"], "left_anti")
    pairs = picked.select("*", F.lit("semantic").alias("p_method"), content_base(F.col("ratio")).alias("base"))
    pairs = pairs.unionByName(residual(still, left).select("*", F.lit(None).cast("double").alias("ratio"), F.lit("sequence-fallback").alias("p_method"), F.lit(RESIDUAL_BASE).alias("base")))
    pairs = dealt_by(written(pairs, "pairs"), "session_id", parts).hint("merge")
    facts = free.select("session_id", F.col("answer_id").alias("p_id"), F.col("text").alias("p_text"), F.length(trimmed(F.col("text"))).alias("a_length"), F.col("crossed_out").alias("a_crossed"), F.col("low_confidence").alias("a_low"))
    more = pairs.withColumnRenamed("answer_id", "p_id").join(facts, ["session_id", "p_id"])
    out = m.join(more, ["session_id", "question_id"], "left").select(
        "session_id", "question_id", "ordinal", "label", "marks", "canonical", F.coalesce("answer_id", "p_id").alias("answer_id"), F.coalesce("method", "p_method").alias("method"),
        F.coalesce("confidence", F.when(F.col("p_id").isNotNull(), score(F.col("base"))), F.lit(0.0)).alias("confidence"), F.coalesce("n_additional", F.lit(0)).alias("n_additional"),
        F.coalesce("full_text", "p_text").alias("full_text"), F.coalesce("merged_ids", F.when(F.col("p_id").isNotNull(), F.array("p_id"))).alias("merged_ids"), "near", "similarity", "ratio",
    )
    review = F.when(F.col("method") == "sequence-fallback", True).when(F.col("answer_id").isNull(), False).otherwise(needs_review(F.col("confidence")))
    return out.withColumn("needs_review", review)


def orphans(mappings: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers that no mapping uses; duplicates of an exact match name their (first) question and its confidence."""
    free = answers.join(consumed(mappings), ["session_id", "answer_id"], "left_anti").select("session_id", "answer_id", "seq").hint("merge")
    first = Window.partitionBy("session_id", "canonical").orderBy("ordinal")
    claimed = mappings.filter("method = 'number-exact'").withColumn("r", F.row_number().over(first)).filter("r = 1").select("session_id", "canonical", "question_id", "confidence")
    dup = resolved(answers).filter("role = 'duplicate'").select("session_id", "answer_id", "canonical").join(claimed, ["session_id", "canonical"]).drop("canonical")
    return free.join(dup, ["session_id", "answer_id"], "left").select(
        "session_id", "answer_id", "seq", F.when(F.col("question_id").isNotNull(), "duplicate-of-mapped").otherwise("no-question-match").alias("reason"), F.col("question_id").alias("guess_question_id"), F.col("confidence").alias("guess_confidence")
    )


# The words that say why a question got its answer.
MERGED = " (merged %d additional page block(s) as a multi-page answer)"
NEAR_HEAD, NEAR_JOIN, NEAR_WRITTEN, NEAR_TAIL = "Matched by fuzzy label similarity (", '%) between "', '" and the student\'s written "', '", likely OCR or numbering noise.'
CONTENT = "No matching question number found on the answer sheet; matched by content similarity. "
CONTENT_WORDS = "Keyword-overlap fallback (Gemini unavailable): matched on shared vocabulary."
RESIDUAL = "Exactly one question and one answer block remained unmatched after number and semantic matching, so they were paired as a last resort. Please verify."
NOTHING = "No answer found for this question."


def reasoning() -> Column:
    """Why a question got its answer, in words."""
    merged = F.when(F.col("n_additional") > 0, F.format_string(MERGED, "n_additional")).otherwise("")
    percent = F.floor(F.col("similarity") * 100 + 0.5).cast("string")
    method = F.col("method")
    return (
        F.when(method == "number-exact", F.concat(F.lit('Matched by exact question-number label "'), "canonical", F.lit('"'), merged, F.lit(".")))
        .when(method == "number-fuzzy", F.concat(F.lit(NEAR_HEAD), percent, F.lit(NEAR_JOIN), "canonical", F.lit(NEAR_WRITTEN), "near", F.lit(NEAR_TAIL)))
        .when(method == "semantic", F.lit(CONTENT + CONTENT_WORDS))
        .when(method == "sequence-fallback", F.lit(RESIDUAL))
        .otherwise(F.lit(NOTHING))
    )


def captions(orphaned: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """session_id, answer_id, caption of orphans: their page, and the question they repeat, or the label they bear, or that they have none."""
    of = orphaned.join(answers.select("session_id", "answer_id", "page", "raw_label"), ["session_id", "answer_id"])
    named = of.join(questions.select("session_id", F.col("question_id").alias("guess_question_id"), "label"), ["session_id", "guess_question_id"], "left")
    repeated = (F.col("reason") == "duplicate-of-mapped") & F.col("label").isNotNull()
    why = F.when(repeated, F.concat(F.lit("Looks like a duplicate/extra attempt at Q"), "label")).when(F.length("raw_label") > 0, F.concat(F.lit('Student wrote "'), "raw_label", F.lit('" but no matching question was found')))
    return named.select("session_id", "answer_id", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" • "), F.coalesce(why, F.lit("No question number could be identified"))).alias("caption"))
