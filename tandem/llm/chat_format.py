r"""Chat formatting with a checked grammar round trip, in DataFrame functions only.

A turn is rendered as ``### role: text </turn>`` and a line feed. The parser
cuts at ``### `` and at ``</turn>`` + line feed unless a backslash stands before
them, takes the role up to the first bare colon, and replaces each of
``\\ \# \< \:`` by its second character. Every turn is rendered as it is and
parsed; while the recovered turn differs from the source, the next step of
escaping is taken (a backslash before each ``\``, ``#`` and ``<``), after which
it is identical. Whole conversations are parsed again in the end; a turn or
conversation that is not recovered raises an error. Roles are always escaped,
colons too. The loss mask holds the spans (in code points) of the assistant's
texts.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm._shared import written

START, END = "### ", " </turn>\n"
#: Where the parser cuts.
BOUNDS = r"(?<!\\)### |(?<!\\)</turn>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\#<:])", r"\\$1")


#: What of a text is escaped, from step to step, until its turn is recovered.
STEPS = [lambda text: text, escaped]


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<:])", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escaped_role(role), F.lit(": "), text, F.lit(END))


def parsed(rendered: Column) -> Column:
    """Turns (array of role, text) of rendered text; other text than turns makes extra or empty turns."""
    pieces = F.split(rendered, BOUNDS)
    bodies = F.filter(pieces, lambda _, i: i % 2 == 1)
    body = r"(?s)\A([^\\:]*(?:\\.[^\\:]*)*): (.*) \z"
    turns = F.transform(bodies, lambda b: F.struct(unescaped(F.regexp_extract(b, body, 1)).alias("role"), unescaped(F.regexp_extract(b, body, 2)).alias("text")))
    # Nothing but empty strings stands between turns.
    between = F.forall(F.filter(pieces, lambda _, i: i % 2 == 0), lambda p: p == "")
    return F.when(between & (F.size(pieces) % 2 == 1), turns)


def recoverable(role: Column, text: Column) -> Column:
    """The text with as little escaped as its turn needs to be recovered."""
    found = F.raise_error(F.concat(F.lit("no escape recovers the turn: "), role, F.lit(": "), text)).cast("string")
    for step in reversed(STEPS):
        same = F.coalesce(parsed(rendered(role, step(text))) == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))
        found = F.when(same, step(text)).otherwise(found)
    return found


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (array of start, length) of rows conv_id, turn, role, text.

    Rows go by turn (null first), ties by role and text. A null text or role is
    empty; rows with a null conv_id are one conversation; other columns are
    ignored; an empty table has no conversations. A conversation that the parser
    does not recover raises an error.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shown = rows.withColumn("shown", recoverable(F.col("role"), F.col("text"))).withColumn("line", rendered(F.col("role"), F.col("shown")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("before", F.coalesce(F.sum(F.length("line")).over(order), F.lit(0)))
    start = F.col("before") + F.length("line") - F.length("shown") - len(END)
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(start.alias("start"), F.length("shown").cast("long").alias("length")))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("before", "turn", "role", "text", "line", span.alias("span")))).alias("turns"))
    made = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    exact = F.coalesce(parsed(F.col("formatted")) == F.col("source"), F.lit(False))
    checked = F.when(exact, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation not recovered: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string"))
    return made.withColumn("formatted", checked).drop("source")


def loss_texts(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order.

    Turns are walked once, so that long conversations take time in proportion:
    a span must end where a turn of the loss role does, and reach back to its
    text's start.
    """
    bodies = F.filter(F.split(formatted, BOUNDS), lambda _, i: i % 2 == 1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("k"), F.lit(True).alias("ok"))

    def walk(a, body):
        mine = F.startswith(body, F.lit(LOSS_ROLE + ": "))
        span = F.get(loss_spans, a["k"])
        begins = a["at"] + len(START) + len(LOSS_ROLE) + 2
        right = (span["start"] == begins) & (span["length"] == F.length(body) - len(LOSS_ROLE) - 3)
        return F.struct(
            (a["at"] + len(START) + F.length(body) + len(END) - 1).cast("long").alias("at"), F.when(mine, a["k"] + 1).otherwise(a["k"]).alias("k"), (a["ok"] & (~mine | F.coalesce(right, F.lit(False)))).alias("ok")
        )

    ends = F.aggregate(bodies, start, walk)
    own = F.filter(bodies, lambda b: F.startswith(b, F.lit(LOSS_ROLE + ": ")))
    texts = F.transform(own, lambda b, i: unescaped(F.substring(b, F.lit(len(LOSS_ROLE) + 3), F.get(loss_spans, i)["length"].cast("int"))))
    return F.when(ends["ok"] & (ends["k"] == F.size(loss_spans)), texts).otherwise(F.raise_error(F.lit("the loss mask does not fit the turns")).cast("array<string>"))


def op2_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one full of control strings, read back from the written output."""
    hard = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = written(formatted_conversations(rows.unionByName(more)), "conversations")
    read = out.withColumn("turns", parsed(F.col("formatted"))).withColumn("loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2 + 9 + length(
    CASE WHEN regexp_matches(text || ' ', '(^|[^\\])### ') OR regexp_matches(text, '(^|[^\\])</turn>\n') OR regexp_matches(text, '\\[\\#<:]')
      THEN regexp_replace(text, '([\\#<])', '\\\1', 'g') ELSE text END) AS chars
  FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""
