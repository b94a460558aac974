"""The catalogue of queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import formats as O
from tandem.functions import json_repair as J
from tandem.functions import labels as L
from tandem.functions import text as X
from tandem.operators import geometry as G
from tandem.operators import history as H
from tandem.operators import linkage as K
from tandem.operators import scoring as S
from tandem.plans import flows
from tandem.sources import fixtures as D
from tandem.sources.tables import by_key
from tandem.streaming import progress as P


def _answers(spark, d) -> DataFrame:
    """The answers, written in buckets of sessions: their writing order is a window over all lines."""
    parts = D.parts(spark, d)
    return by_key(D.answers(spark, d, parts), "answers", parts=parts)


def _mappings(spark, d, answers=None) -> DataFrame:
    parts = D.parts(spark, d)
    return K.link(D.questions(spark, d, parts), answers or _answers(spark, d), dealt=True, parts=parts)


def _grades(spark, d) -> DataFrame:
    return S.grades(_mappings(spark, d))


def normalize_label(spark, d):
    a = D.answers(spark, d).select("answer_id", "raw_label", L.canonical(F.col("raw_label")).alias("canonical"))
    return a.withColumn("sort_key", L.order_of(F.col("canonical")))


def label_similarity(spark, d):
    q = D.questions(spark, d).select("session_id", F.col("label").alias("a"))
    r = D.answers(spark, d).select("session_id", F.col("raw_label").alias("b")).filter("b is not null")
    met = q.distinct().join(r.distinct(), "session_id").select("a", "b").distinct().withColumn("x", L.compared(F.col("a"))).withColumn("y", L.compared(F.col("b")))
    return met.select("a", "b", L.closeness(F.col("x"), F.col("y")).alias("similarity"))


def same_label(spark, d):
    return D.answers(spark, d).select("answer_id", L.same_label(F.col("raw_label"), F.lit("Q3")).alias("same"))


def question_order(spark, d):
    w = Window.partitionBy("session_id").orderBy("k", "ordinal")
    q = D.questions(spark, d).withColumn("c", L.canonical(F.col("label"))).withColumn("k", L.order_of(F.col("c")))
    return q.select("session_id", "question_id", F.row_number().over(w).cast("long").alias("place"))


def assign_sequence(spark, d):
    w = Window.partitionBy("session_id").orderBy("page", "seq")
    return D.answers(spark, d).select("session_id", "answer_id", "page", (F.row_number().over(w) - 1).cast("long").alias("sequence_index"))


def answer_groups(spark, d):
    g = K.labelled(D.answers(spark, d)).groupBy("session_id", "canonical").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("seq", "answer_id"))).alias("g"))
    return g.select("session_id", "canonical", "n", F.array_join(F.transform("g", lambda x: x["answer_id"]), ",").alias("answer_ids"))


def seq_gaps(spark, d):
    return K.resolved(D.answers(spark, d)).select("answer_id", "canonical", "gap")


def duplicate_rank(spark, d):
    return K.resolved(D.answers(spark, d)).select("answer_id", "canonical", "worth", F.col("best").cast("long").alias("place"))


def resolve_groups(spark, d):
    return K.resolved(D.answers(spark, d)).select("answer_id", "canonical", "role")


def map_exact(spark, d):
    e = K.exact(K.keyed(D.questions(spark, d)), K.groups(D.answers(spark, d)))
    return e.filter("answer_id is not null").select("session_id", "question_id", "answer_id", "confidence")


def map_fuzzy(spark, d):
    linked = K.by_label(K.keyed(D.questions(spark, d, D.parts(spark, d))), K.groups(_answers(spark, d)))
    return linked.filter("near is not null").select("session_id", "question_id", "answer_id", "near", "similarity", "confidence")


def score_mapping(spark, d):
    return _mappings(spark, d).filter("answer_id is not null").select("question_id", "method", S.half_up(F.col("confidence") * 10000).alias("confidence_e4"))


def needs_review(spark, d):
    return _mappings(spark, d).select("question_id", "needs_review")


def reasoning(spark, d):
    return _mappings(spark, d).select("question_id", K.reasoning().alias("reasoning"))


def consumed_ids(spark, d):
    return K.consumed(_mappings(spark, d))


def unanswered(spark, d):
    return _mappings(spark, d).filter("answer_id is null").select("session_id", "question_id")


def orphans(spark, d):
    a = _answers(spark, d)
    return K.orphans(_mappings(spark, d, a), a)


def method_counts(spark, d):
    return _mappings(spark, d).groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"))


def grade_length(spark, d):
    return _grades(spark, d).select("question_id", "total_marks", "marks_awarded")


def grade_lookup(spark, d):
    return _grades(spark, d).select("question_id", "answer_id", "marks_awarded", "grade_confidence", "ungraded")


def summary(spark, d):
    a = _answers(spark, d)
    m = _mappings(spark, d, a)
    free = a.join(K.consumed(m), ["session_id", "answer_id"], "left_anti").groupBy("session_id").agg(F.count("*").alias("orphans"))
    return S.summary(S.grades(m), free)


def strong_weak(spark, d):
    return S.areas(_grades(spark, d))


def badge_tiers(spark, d):
    return _grades(spark, d).select("question_id", S.badge_tier(F.col("marks_awarded"), F.col("total_marks")).alias("tier"))


def result_cards(spark, d):
    a = _answers(spark, d)
    g = S.grades(_mappings(spark, d, a)).join(a.select("session_id", "answer_id", F.col("seq").alias("answer_seq")), ["session_id", "answer_id"], "left")
    card = F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal")).cast("long")
    return g.select("session_id", "question_id", card.alias("card"), "label", "answer_id", "answer_seq", "marks_awarded", F.col("answer_id").isNull().alias("unanswered"))


def tokenize(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.sort_array(X.tokens(F.col("text"))), " ").alias("tokens"))


def keyword_overlap(spark, d):
    q = D.conversation_questions(spark, d).select("session_id", "question_id", X.tokens(F.col("text")).alias("qt"))
    a = D.conversation_answers(spark, d).select("session_id", "answer_id", X.tokens(F.col("text")).alias("at"))
    ratio = X.overlap_ratio(F.col("qt"), F.col("at"))
    return q.join(a, "session_id").select("question_id", "answer_id", ratio.alias("ratio"), F.least(ratio * 1.5, F.lit(0.6)).alias("confidence"))


def map_semantic(spark, d):
    return K.by_content(D.conversation_questions(spark, d), D.conversation_answers(spark, d)).select("session_id", "question_id", "answer_id", "ratio")


def map_residual(spark, d):
    q, a = D.conversation_questions(spark, d), D.conversation_answers(spark, d)
    picks = K.by_content(q, a)
    return K.residual(q.join(picks, ["session_id", "question_id"], "left_anti"), a.join(picks, ["session_id", "answer_id"], "left_anti"))


def merge_text(spark, d):
    t = D.table(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return t.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("merged"))


def clamp_marks(spark, d):
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", S.clamp_marks(F.col("l_quantity") / 7 - 1, F.col("l_linenumber")).alias("marks"))


def _embedded(spark, d, text) -> DataFrame:
    n = (F.col("doc_id") % 9 + 1).cast("string")
    more = F.get(F.array(F.concat(F.lit(" Diagram for Answer "), (F.col("doc_id") % 9 + 2).cast("string"), F.lit(": fig")), F.concat(F.lit(" Q"), n, F.lit(". again")), F.lit("")), (F.col("doc_id") % 3).cast("int"))
    label = F.concat(F.lit("Ans "), n, F.lit("."))
    body = F.concat(label, F.lit(" "), F.regexp_replace(text, "\n", " "), more)
    blocks = D.table(spark, d, "documents").select(F.col("doc_id").alias("block_id"), label.alias("raw_label"), n.alias("number"), body.alias("body_text"), (F.col("doc_id") % 2 == 0).alias("has_diagram"))
    return X.split_embedded(blocks)


def split_labels(spark, d):
    return _embedded(spark, d, F.col("text"))


def split_labels_whole(spark, d):
    """Turns of conversations, which bear their turn's number, cut where they refer to another one."""
    n = F.col("turn").cast("string")
    body = F.concat(F.lit("Q"), n, F.lit(": "), F.regexp_replace("text", "\n", " "), F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" figure for question "), (F.col("turn") - 1).cast("string"), F.lit("b"))).otherwise(""))
    blocks = D.table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), n).alias("block_id"), F.concat(F.lit("Q"), n, F.lit(":")).alias("raw_label"), n.alias("number"), body.alias("body_text"), (F.col("role") == "assistant").alias("has_diagram"))
    return X.split_embedded(blocks)


def segment_lines(spark, d):
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat((F.floor(i / 3) + 1).cast("string"), F.lit(". "), x)).otherwise(x))
    return X.segment_lines(D.table(spark, d, "documents").select("doc_id", F.array_join(numbered, "\n").alias("text")))


def box_clip(spark, d):
    return G.clipped(D.answers(spark, d)).select("session_id", "page", "answer_id", "y", "h")


def block_extent(spark, d):
    return G.extents(D.answers(spark, d))


def gap_insertions(spark, d):
    return G.gap_insertions(D.answers(spark, d)).select("session_id", "page", "answer_id", S.half_up(F.col("at_y") * 1000).alias("at_e3"), S.half_up(F.col("amount") * 1000).alias("amount_e3"))


def answer_span(spark, d):
    return G.answer_spans(K.labelled(D.answers(spark, d)))


def page_count(spark, d):
    return D.answers(spark, d).groupBy("session_id").agg(F.greatest(F.max("page"), F.lit(1)).alias("pages"))


def history_topk(spark, d):
    return H.newest(D.history(spark, d)).select("owner", "session_id", "percent", "place")


def history_window(spark, d):
    return H.within(D.history(spark, d), "1996-01-01 00:00:00").select("owner", "session_id", "percent")


def history_page(spark, d):
    return H.page(D.history(spark, d), 2)


def most_recent(spark, d):
    return H.newest(D.history(spark, d), 1).select("owner", "session_id", "percent")


def history_stats(spark, d):
    return H.statistics(D.history(spark, d))


def history_tiers(spark, d):
    return D.history(spark, d).select("session_id", "percent", S.history_tier(F.col("percent")).alias("tier"))


def history_upsert(spark, d):
    return H.upserted(D.saves(spark, d)).select("owner", "session_id", "percent", (F.col("created_at") == F.col("last_saved")).alias("saved_once"))


def progress_latest(spark, d):
    return P.latest(D.progress(spark, d))


def json_props(spark, d):
    return D.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def format_bytes(spark, d):
    n = F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("long")
    return D.table(spark, d, "lineitem").select(n.alias("n"), O.bytes_text(n).alias("shown")).distinct()


def format_marks(spark, d):
    x = F.floor(F.col("l_quantity") * 2) / 4.0
    return D.table(spark, d, "lineitem").select(x.alias("x"), O.marks_text(x).alias("shown")).distinct()


def _declared():
    return F.get(F.array(F.lit("image/jpg"), F.lit("text/plain"), F.lit(None).cast("string")), (F.col("page_id") % 3).cast("int"))


def upload_validation(spark, d):
    name = F.concat("url", F.get(F.array(F.lit(".pdf"), F.lit(".PNG"), F.lit(".jpeg"), F.lit("")), (F.col("page_id") % 4).cast("int")))
    size = F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.length("html") * F.when(F.col("page_id") % 5 == 0, 10_000).otherwise(1))
    return D.table(spark, d, "pages").select("page_id", O.upload_error(_declared(), name, size).alias("error"))


def mime_resolution(spark, d):
    name = F.concat("url", F.get(F.array(F.lit(".pdf"), F.lit(".PNG"), F.lit(".jpeg"), F.lit("")), (F.col("page_id") % 4).cast("int")))
    return D.table(spark, d, "pages").select("page_id", O.mime_type(_declared(), name).alias("mime"))


def box_pad(spark, d):
    return G.padded(D.answers(spark, d))


def page_growth(spark, d):
    g = G.gap_insertions(D.answers(spark, d)).groupBy("session_id", "page").agg(F.sum(S.half_up(F.col("amount") * 1000)).alias("e3"))
    return g.select("session_id", "page", F.ceil(2000 + F.col("e3") / 1000.0).alias("pixels"))


def gap_remap(spark, d):
    boxes = D.answers(spark, d)
    return G.shifts(boxes, G.gap_insertions(boxes))


def page_boxes(spark, d):
    return D.answers(spark, d).filter("page = 1").select("session_id", "answer_id", (F.col("y") * 100).alias("top_percent"), (F.col("h") * 100).alias("height_percent"))


def _broken(spark, d):
    kinds = F.array(F.col("props"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.regexp_replace("props", "}$", ",}"), F.concat(F.lit("Here it is: "), "props", F.lit(" as asked.")), F.concat(F.lit('{"items": ['), "props", F.lit(", "), "props", F.lit(", ")), F.concat(F.lit("{“note”: ”it‘s it’s“, “p”: ["), "props", F.lit(", ] }")), F.concat(F.lit('{"a": "\\ud800", "p": '), "props", F.lit("}")), F.concat(F.lit('\ufeff{"a": [1e400, -9], "p": '), "props", F.lit("}\u00a0")))
    return D.table(spark, d, "events").select("event_id", F.get(kinds, (F.col("event_id") % 8).cast("int")).alias("raw"))


def strip_fences(spark, d):
    return _broken(spark, d).select("event_id", J.without_fences(F.col("raw")).alias("clean"))


def fix_commas(spark, d):
    return _broken(spark, d).select("event_id", J.plain_quotes_no_trailing_commas(F.col("raw")).alias("clean"))


def json_repair(spark, d):
    return _broken(spark, d).select("event_id", J.repaired(F.col("raw")).alias("value"))


def progress_percent(spark, d):
    done, total = F.col("event_id") % 7, F.col("event_id") % 5 + 7
    return D.table(spark, d, "events").select("event_id", (5 + S.half_up(30 * done / total)).alias("questions_percent"), (35 + S.half_up(30 * done / total)).alias("answers_percent"))


def ttl_sweep(spark, d):
    p = D.progress(spark, d).groupBy("session_id").agg(F.min("ts").alias("created"), F.max("ts").alias("seen"))
    return p.select("session_id", (F.col("seen") - F.col("created") > F.expr("interval 120 minutes")).alias("expired"))


def session_latest(spark, d):
    p = D.progress(spark, d)
    done = F.col("stage") == "done"
    return p.groupBy("session_id").agg(F.max_by(F.when(done, F.col("percent")), F.when(done, F.struct("ts", "event_id"))).alias("done_percent"), F.count("*").alias("updates"))


def guard_index(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return D.table(spark, d, "events").select("event_id", F.when((k >= 0) & (k < 50), k).alias("index"))


def orphan_caption(spark, d):
    a = _answers(spark, d)
    return K.captions(K.orphans(_mappings(spark, d, a), a), a, D.questions(spark, d, D.parts(spark, d)))


def union_pages(spark, d):
    named = lambda t, key, name, nation: D.table(spark, d, t).select(F.lit(t).alias("source"), F.col(key).alias("key"), F.col(name).alias("name"), F.col(nation).alias("nation"))
    return named("customer", "c_custkey", "c_name", "c_nationkey").unionByName(named("supplier", "s_suppkey", "s_name", "s_nationkey"))


def merge_answers(spark, d):
    """The texts of a question's answers, looked up by the ids of its mapping, in order."""
    a = _answers(spark, d)
    ids = _mappings(spark, d, a).filter("answer_id is not null").select("session_id", "question_id", F.posexplode("merged_ids").alias("pos", "answer_id"))
    texts = ids.join(a.select("session_id", "answer_id", "text"), ["session_id", "answer_id"]).groupBy("session_id", "question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return texts.select("session_id", "question_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("merged"))


def anchor_runs(spark, d):
    placed = by_key(G.ordered_runs(D.text_runs(spark, d)), "runs")
    return G.anchors(D.blocks(spark, d), placed, dealt=True)


def run_spans(spark, d):
    return G.anchored_boxes(by_key(D.blocks(spark, d), "blocks"), D.text_runs(spark, d), dealt=True)


def render_dims(spark, d):
    w, h = F.col("p_size") * 30.0, F.col("p_retailprice")
    p = D.table(spark, d, "part").select("p_partkey", G.page_pixels(w, h).alias("p"), G.image_pixels(F.col("p_size") * 40, F.floor("p_retailprice").cast("long")).alias("image_width"))
    return p.select("p_partkey", "p.width", "p.height", "image_width")


def entry_formats(spark, d):
    h = H.upserted(D.saves(spark, d))
    return h.select(
        "session_id", O.entry_date(F.col("last_saved")).alias("saved"), O.opened_later(F.col("created_at"), F.col("last_saved")).alias("opened_later"), O.confidence_text(F.col("percent") / 101.0).alias("confidence"),
        O.score_text(F.when(F.col("percent") % 10 > 0, F.col("percent") / 2.0), F.lit(50.0)).alias("score"), O.ring_offset(F.col("percent") * 2 - 20).cast("long").alias("offset"),
    )


def display_labels(spark, d):
    a = _answers(spark, d)
    m = _mappings(spark, d, a)
    answered = m.filter("answer_id is not null").select("session_id", "question_id", "answer_id", "label")
    shown = a.join(answered, ["session_id", "answer_id"], "left")
    return shown.select("session_id", "answer_id", O.display_label(F.col("question_id").isNotNull(), F.col("label")).alias("shown"))


def warnings(spark, d):
    """Notes of a session's pages, in order of pages and lines."""
    a = D.answers(spark, d).select("session_id", "page", "seq", F.when(F.col("low_confidence"), F.concat(F.lit("low confidence: "), "answer_id")).alias("a"), F.when(F.col("crossed_out"), F.concat(F.lit("crossed out: "), "answer_id")).alias("b"))
    own = a.withColumn("notes", F.array_compact(F.array("a", "b"))).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("page", "seq", "notes"))).alias("n"))
    return own.select("session_id", F.array_join(F.flatten(F.transform("n", lambda x: x["notes"])), "; ").alias("warnings"))


def array_ops(spark, d):
    g = D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"))
    a = F.col("a")
    rest = F.array_join(F.slice(a, 2, 1_000_000), ",")
    return g.select("l_orderkey", F.size(F.array_distinct(a)).cast("long").alias("n_distinct"), F.forall(a, lambda x: x > 1).alias("all_above_1"), F.exists(a, lambda x: x == 3).alias("has_3"), rest.alias("rest"), F.array_position(a, 2).alias("at_2"))


def sse_parse(spark, d):
    e = D.progress(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "stage", "percent"))).alias("e"))
    frame = lambda x: F.concat(F.lit("data: "), F.to_json(F.struct(x["event_id"].alias("event_id"), x["stage"].alias("stage"), x["percent"].alias("percent"))), F.lit("\n\n"))
    return P.parse_frames(e.select("session_id", F.array_join(F.transform("e", frame), "").alias("chunk")))


def highlight_boxes(spark, d):
    a = _answers(spark, d)
    boxes = a.select("session_id", "answer_id", "page", "y", "h")
    m = _mappings(spark, d, a).filter("answer_id is not null").select("session_id", "question_id", F.posexplode("merged_ids").alias("pos", "answer_id"))
    return m.join(boxes, ["session_id", "answer_id"]).select("session_id", "question_id", F.col("pos").cast("long").alias("pos"), "answer_id", "page", "y", "h")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_label, label_similarity, same_label, question_order, assign_sequence, answer_groups, seq_gaps, duplicate_rank, resolve_groups, map_exact, map_fuzzy, score_mapping,
        needs_review, reasoning, consumed_ids, unanswered, orphans, method_counts, grade_length, grade_lookup, summary, strong_weak, badge_tiers, result_cards, tokenize,
        keyword_overlap, map_semantic, map_residual, merge_text, clamp_marks, split_labels, split_labels_whole, segment_lines,
        box_clip, block_extent, gap_insertions, answer_span, page_count, history_topk, history_window, history_page, most_recent, history_stats, history_tiers, history_upsert,
        sse_parse, highlight_boxes, box_pad, page_growth, gap_remap, page_boxes, strip_fences, fix_commas, json_repair, progress_percent, ttl_sweep, session_latest, guard_index, orphan_caption, union_pages, array_ops,
        merge_answers, anchor_runs, run_spans, render_dims, entry_formats, display_labels, warnings, progress_latest, json_props, format_bytes, format_marks, upload_validation, mime_resolution,
    )
}
QUERIES |= flows.QUERIES
