"""The driver's tables as sessions of labelled prompts (questions) and responses (answers)."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.sources.tables import dealt_by, parts_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """In how many parts sessions are dealt, by the number of lines."""
    return parts_of(spark, table(spark, sf_dir, "lineitem").count())


def answers(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Responses of a session (an order): its lines in writing order, dealt into so many parts."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    n = F.col("l_linenumber").cast("string")
    # Every fourth label has other white space than blanks, or nothing else.
    odd = F.col("l_suppkey") % 4 == 0
    either = lambda strange, plain: F.when(odd, strange).otherwise(F.lit(plain) if plain is not None else F.lit(None).cast("string"))
    labels = [
        F.concat(either("Ans\u00a0", "Ans "), n), F.concat(either("Q.\u2009", "Q."), n), F.concat(either("\ufeff", ""), n, F.lit(".")), F.concat(F.lit("Question "), n), F.concat(n, F.lit("(a)")), F.concat(n, F.lit("(o)")),
        either("\u00a0", None), F.concat(F.lit("Ans "), (F.col("l_linenumber") + 10).cast("string")),
    ]
    kind = (F.col("l_partkey") % 8).cast("int")
    lines = table(spark, sf_dir, "lineitem")
    rows = (dealt_by(lines, "l_orderkey", parts) if parts else lines).withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
    return rows.select(
        F.col("l_orderkey").alias("session_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-a"), F.col("seq").cast("string")).alias("answer_id"),
        "seq",
        F.get(F.array(*labels), kind).alias("raw_label"),
        F.concat(F.repeat(F.lit("x"), F.col("l_quantity").cast("int") * 5), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" about subject"), (F.col("l_suppkey") % 7).cast("string"))).otherwise("\u00a0")).alias("text"),
        (F.col("l_suppkey") % 3 + 1).alias("page"),
        (F.col("l_returnflag") == "R").alias("crossed_out"),
        ((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 5 == 0)).alias("low_confidence"),
        (F.col("l_suppkey") % 11 == 0).alias("has_diagram"),
        ((F.col("l_linenumber") - 1) / F.lit(8.0)).alias("y"),
        (F.col("l_quantity") / 200.0).alias("h"),
        F.col("l_tax").alias("x"),
        (F.col("l_discount") + 0.5).alias("w"),
    )


def questions(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Ten prompts per session, dealt into so many parts.

    Sessions are dealt before they become ten rows each, so that nothing keyed by
    session shuffles these. The hint is for all joins with them: Spark takes them
    for as small as the orders that it reads, and would broadcast them.
    """
    n = F.col("n")
    rest = (F.col("o_orderkey") + n) % 5
    rows = dealt_by(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", parts).select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("n")).select(
        F.col("o_orderkey").alias("session_id"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("-q"), n.cast("string")).alias("question_id"),
        n.cast("long").alias("ordinal"),
        F.when(n <= 7, F.concat(F.lit("Q"), n.cast("string"))).otherwise(F.concat((n - 7).cast("string"), F.lit("(a)"))).alias("label"),
        F.when(rest != 0, rest + 1).cast("long").alias("marks"),
        ((F.col("o_orderkey") + n) % 13 == 0).alias("low_confidence"),
        F.concat(F.lit("describe subject"), ((F.col("o_orderkey") + n) % 7).cast("string"), F.lit(" briefly")).alias("text"),
    )
    return rows.hint("merge")


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves of results (orders): every third session is saved again two days later, with another percent."""
    first = history(spark, sf_dir)
    again = first.filter("session_id % 3 = 0").withColumn("saved_at", F.col("saved_at") + F.expr("interval 2 days")).withColumn("percent", (F.col("percent") + 7) % 101)
    return first.unionByName(again)


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs on the pages of a session (an order): one per line, beginning with a label, and one below it."""
    a = answers(spark, sf_dir).select("session_id", "page", "x", "y", "w", (F.col("h") / 8).alias("h"), "seq", (F.col("seq") % 4 + 1).cast("string").alias("n"))
    head = F.struct("x", "y", F.concat(F.lit("Ans  "), "n", F.lit(". words")).alias("text"), (F.col("seq") * 2).alias("run"))
    body = F.struct((F.col("x") / 2).alias("x"), (F.col("y") + F.col("h")).alias("y"), F.lit("more words").alias("text"), (F.col("seq") * 2 + 1).alias("run"))
    both = a.select("session_id", "page", "w", "h", F.explode(F.array(head, body)).alias("r"))
    return both.select("session_id", "page", "r.x", "r.y", "w", "h", "r.text", "r.run")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer blocks in reading order with the labels they were seen with and rough boxes."""
    a = answers(spark, sf_dir)
    label = F.when(F.col("seq") % 5 != 4, F.concat(F.lit("ANS "), (F.col("seq") % 4 + 1).cast("string"), F.lit(".")))
    return a.select("session_id", "answer_id", "seq", label.alias("label"), "has_diagram", F.when(F.col("seq") % 3 != 2, F.col("page")).alias("rough_page"), F.col("x").alias("rough_x"), (F.col("y") + 0.01).alias("rough_y"), F.col("w").alias("rough_w"))


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return t.select(F.col("conv_id").alias("session_id"), F.concat(F.col("conv_id").cast("string"), F.lit("-q"), F.col("turn").cast("string")).alias("question_id"), F.col("turn").alias("ordinal"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("marks"), F.lit(False).alias("low_confidence"), "text")


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    false = F.lit(False)
    return t.select(F.col("conv_id").alias("session_id"), F.concat(F.col("conv_id").cast("string"), F.lit("-a"), F.col("turn").cast("string")).alias("answer_id"), F.col("turn").alias("seq"), F.lit(None).cast("string").alias("raw_label"), "text", false.alias("crossed_out"), false.alias("low_confidence"), false.alias("has_diagram"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved results of owners (customers): one per order."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("saved_at"), (F.floor("o_totalprice") % 101).cast("long").alias("percent"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events of sessions (users)."""
    stages = {"signup": "idle", "view": "extracting-questions", "click": "extracting-answers", "purchase": "done", "error": "error"}
    stage = F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", F.coalesce(stage, F.lit("error")).alias("stage"), F.get_json_object("props", "$.k").cast("long").alias("percent"), "props")


def epoch_ms(ts):
    """Milliseconds since 1970 of a time without zone."""
    days = F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("long")
    return days * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECONDS"), ts) * 1000).cast("long")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of users (events), in time that runs ten thousand times as fast, so that they crowd; errors and clicks fail, errors for too many calls."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), "event_id", F.floor(epoch_ms(F.col("ts")) / 10_000).cast("long").alias("at_ms"), F.col("event_type").isin("error", "click").alias("failed"), (F.col("event_type") == "error").alias("limited"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of users' snapshots (events) as JSON."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    patch = (
        F.when(kind == "signup", F.lit("{}"))
        .when(kind == "view", F.concat(F.lit('{"stage": "extracting-questions", "questions": '), k, F.lit("}")))
        .when(kind == "click", F.concat(F.lit('{"stage": "extracting-answers", "percent": null, "answers": '), k, F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"stage": "done", "error": null, "percent": '), k, F.lit("}")))
        .otherwise(F.concat(F.lit('{"stage": "error", "error": "e'), k, F.lit('"}')))
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), patch.alias("patch"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of subscribers (customers) on users' sessions: on, off five days later, some on again, some twice."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subscriber"), (F.col("c_custkey") * 7 % 100).alias("session_id"), (F.col("c_custkey") % 20).cast("int").alias("day"))
    steps = [(0, "subscribe", F.lit(True)), (2, "subscribe", F.col("subscriber") % 4 == 0), (5, "unsubscribe", F.lit(True)), (6, "unsubscribe", F.col("subscriber") % 5 == 0), (8, "subscribe", F.col("subscriber") % 3 == 0)]
    action = lambda n, step: F.when(step[2], F.struct(F.lit(step[0]).alias("later"), F.lit(step[1]).alias("action"), F.lit(n).cast("long").alias("seq")))
    rows = c.select("*", F.explode(F.array_compact(F.array(*[action(n, s) for n, s in enumerate(steps)]))).alias("a"))
    start = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    return rows.select("subscriber", "session_id", "a.action", (start + F.make_dt_interval(F.col("day") + F.col("a.later"))).alias("at"), "a.seq")


#: Largest upload of the pages, in bytes.
MOST_UPLOAD = 8_000


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads: names and declared types of all sorts, some of no known kind, some empty."""
    i = F.col("page_id")
    name = F.concat(i.cast("string"), F.lit("-"), "url", F.get(F.array(F.lit(".pdf"), F.lit(".PNG"), F.lit(".jpeg"), F.lit("")), (i % 4).cast("int")))
    declared = F.get(F.array(F.lit("image/jpg"), F.lit("text/plain"), F.lit(None).cast("string")), (i % 3).cast("int"))
    kind = F.when(i % 9 == 0, "cover").when(i % 2 == 0, "questionPaper").otherwise("answerSheet")
    content = F.when(i % 7 == 0, F.lit("")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("s"), (i % 50).cast("string")).alias("session_id"), kind.alias("kind"), name.alias("name"), declared.alias("declared"), F.encode(content, "UTF-8").alias("content"))


def page_stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages with images, sessions in memory, patches of snapshots (all from orders), and requests (lines)."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"))
    kinds = F.explode(F.array(F.lit("questionPaper"), F.lit("answerSheet"))).alias("kind")
    text, at = F.col("session_id").cast("string"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    images = s.filter("session_id % 3 = 0").select("session_id", kinds).select("*", F.expr("explode(sequence(1L, 2L))").alias("page"))
    images = images.select("*", F.concat_ws("/", F.lit("img"), text, "kind", F.col("page").cast("string")).alias("url"))
    memory = s.filter("session_id % 5 < 2").select("session_id", kinds)
    memory = memory.select("*", F.when((F.col("kind") == "answerSheet") | (F.col("session_id") % 5 == 0), F.concat(F.lit("mem/"), text)).alias("stored_path"))
    meta = lambda name: F.concat(F.lit(f'{{"storedPath": "{name}/'), text, F.lit('"}'))
    paper = F.when(F.col("session_id") % 4 == 0, F.lit("null")).otherwise(meta("paper"))
    kept = s.filter("session_id % 7 <> 0").select("session_id", at.alias("at"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit('{"answerSheet": '), meta("sheet"), F.lit(', "questionPaper": '), paper, F.lit("}")).alias("patch"))
    n, p = F.col("l_linenumber"), F.col("l_suppkey")
    kind = F.when(n % 4 == 0, "questionPaper").when(n % 4 == 3, "cover").otherwise("answerSheet")
    page = F.get(F.array(F.lit("1"), F.lit(" 2.0 "), F.lit("3"), F.lit("0"), F.lit("1.5"), F.lit("x")), (p % 6).cast("int"))
    asked = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("request_id"), F.col("l_orderkey").alias("session_id"), kind.alias("kind"), page.alias("page"))
    return images, memory, kept, asked


def question_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader returned for each session's (order's) page: ten questions as JSON, some without marks or box, some broken off."""
    s = F.col("o_orderkey")
    q = lambda n: F.struct(
        F.when(n <= 7, F.concat(F.lit("Q"), n.cast("string"))).otherwise(F.concat((n - 7).cast("string"), F.lit("(a)"))).alias("questionNumber"),
        F.concat(F.lit("describe "), n.cast("string")).alias("questionText"),
        F.when((s + n) % 5 != 0, (s + n) % 5 + 1).alias("totalMarks"),
        F.when((s + n) % 3 != 0, F.struct((n / F.lit(16.0)).alias("x"), (n / F.lit(32.0)).alias("y"), F.lit(0.5).alias("width"), F.lit(0.25).alias("height"))).alias("boundingBox"),
        F.when((s + n) % 4 != 0, (s + n) % 13 == 0).alias("lowConfidence"),
    )
    raw = F.to_json(F.struct(F.transform(F.sequence(F.lit(10), F.lit(1)), q).alias("questions")))
    return table(spark, sf_dir, "orders").select(s.alias("session_id"), (s % 3 + 1).alias("page"), F.lit(0).alias("doc"), F.when(s % 11 == 0, F.left(raw, F.lit(40))).otherwise(raw).alias("raw"))


def answer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader returned for each line's part of a page: its answer, and a second one where it has a diagram."""
    a = answers(spark, sf_dir)
    box = F.when(F.col("seq") % 4 != 3, F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height")))
    first = F.struct(F.col("raw_label").alias("detectedQuestionNumber"), F.col("raw_label").alias("detectedNumberRawText"), F.concat(F.lit("text "), F.col("seq").cast("string")).alias("answerText"), F.when(F.col("seq") % 5 == 0, F.col("seq") + 1).alias("pageNumber"), box.alias("boundingBox"), "has_diagram", F.col("crossed_out").alias("crossedOut"), F.col("low_confidence").alias("lowConfidence"))
    first = first.withField("containsDiagram", F.col("has_diagram")).dropFields("has_diagram")
    both = F.filter(F.array(first, first.withField("answerText", F.lit("drawn"))), lambda _, i: (i == 0) | F.col("has_diagram"))
    return a.select("session_id", "page", F.col("seq").alias("doc"), F.to_json(F.struct(both.alias("answers"))).alias("raw"))


def placed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs (lines) as a page's reader places them, on pages of 612 by 792."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    zero = F.lit(0.0)
    upright = s % 3 != 0
    matrix = [F.when(s % 5 == 0, F.lit(3.0)).otherwise(12.0).alias("a"), F.when(s % 5 == 0, F.lit(4.0)).otherwise(zero).alias("b"), zero.alias("c"), F.when(upright, 10.0 + s % 2).otherwise(zero).alias("d"), (n * 32.0).alias("e"), (n * 64.0).alias("f")]
    text = F.when(s % 7 == 0, "\u00a0 ").otherwise(F.concat(F.lit("Ans "), n.cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", *matrix, F.when(s % 4 != 0, F.col("l_quantity")).alias("run_width"), text.alias("text"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))
