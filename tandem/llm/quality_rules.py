"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects documents whose rate (in thousandths) is above a cutoff. In each
stratum (a band of length) the cutoffs of all rules are chosen together, on
labelled rows that are parted by the checksum of their id:

1. On the first part all pairs of a rule and a cutoff are put in one order, the
   path, by what they cost: rejected good rows for each rejected bad one. A stricter
   cutoff of a rule never stands before a milder one. Walking along the path, a
   document is rejected from the first of its pairs on.
2. On the other part each place of the path is tested: it is certified while an
   exact binomial test rejects "more than RISK of the good documents are rejected
   by all rules together", that is while P(Binomial(good rows, RISK) <= rejected
   good rows) is at most CONFIDENCE / strata. The order is fixed before the test,
   so it needs no correction along the path and ends at the first place that
   fails; the division corrects for testing several strata.

So with probability 1 - CONFIDENCE all rules together reject at most RISK of the
good documents in every stratum. Of the certified places the one that rejects most
bad rows less good rows is taken, the first on ties; if none gains, all rules stay
off there. A place without a rejected good row needs 408 good rows in the second
part (RISK 0.01, CONFIDENCE 0.05, three strata); with fewer nothing can be certified.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm._shared import crc32_mod, written

RISK, CONFIDENCE = 0.01, 0.05
#: One of so many parts of the labelled rows is for the path, the others are for the tests.
PARTS = 3
SPACE = r"[\x20\x09-\x0D]+"
#: Rates, per thousand: rule -> (numerator, denominator). A zero denominator gives rate 0.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
#: Cutoffs that are tried, mildest first.
CUTOFFS = {
    "symbols": [800, 600, 500, 400, 300, 250, 200, 150, 100, 70, 50, 30, 20, 10],
    "capitals": [950, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100],
    "repeats": [1000, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 50],
    "dup_lines": [300, 200, 150, 100, 70, 50, 30, 20, 10, 5],
    "word_length": [100_000, 50_000, 30_000, 20_000, 15_000, 12_000, 11_000, 10_000, 9_000, 8_000],
}
STRATA = 3


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row (text null: none): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", text.alias("text")).withColumn("w", F.filter(F.split("text", SPACE), lambda x: x != ""))
    # Three-word windows by hash and place; equal hashes stand next to each other once sorted.
    w = F.col("w")
    window = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))
    sorted_ = words.withColumn("s", F.when(F.size(w) >= 3, F.sort_array(window)))
    s = F.col("s")
    met_again = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    twice = F.filter(s, lambda x, i: F.coalesce(met_again(x, i), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    placed = sorted_.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("at")
    # A window covers three words, less what the next one covers again.
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = placed.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    without = lambda kind: F.length("text") - F.length(F.regexp_replace("text", kind, ""))
    long = lambda c, name: c.cast("long").alias(name)
    return lines.select(
        "doc_id",
        long(F.size("w"), "n_words"),
        long(F.length(F.array_join("w", "")), "word_chars"),
        long(without("[#*$%&|<>]+"), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
        long(without("[A-Z]+"), "n_capitals"),
    )


def rate(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.floor(F.lit(1000) * F.col(part) / F.col(whole))).otherwise(0).cast("long")


def stratum() -> Column:
    return F.when(F.col("n_words") < 150, 0).when(F.col("n_words") < 600, 1).otherwise(2)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_factorial(n: Column) -> Column:
    """ln n!, exact products up to 20, Stirling's series above (error below 1e-13)."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), all terms from the largest one downwards; 1 where k is not below the mean (the test fails there anyway)."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.sequence(F.lit(0).cast("long"), k)
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a, t):
        j = (k - t).cast("double")
        return F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * j * (1 - p) / ((n - j + 1) * p)).alias("term"))

    return F.when(k < n * F.lit(p), F.exp(top) * F.aggregate(terms, zero, step, lambda a: a["sum"])).otherwise(1.0)


def choose_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """stratum, rule, cutoff of the rules that are switched on: at most len(RULES) * STRATA rows.

    Labelled rows: documents that pass the base rules and have one quality label
    (0 or 1; a doc_id labelled twice counts with its lower label).
    """
    labelled = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Of each rule the first step (from 0, mildest cutoff) that would reject the row; as many as there are cutoffs if none would.
    first = [F.struct(F.lit(r).alias("rule"), sum(((F.col(r) <= c).cast("int") for c in CUTOFFS[r]), F.lit(0)).alias("step")) for r in RULES]
    held = counted.filter(~base_failed()).join(labelled, "doc_id").select("doc_id", "quality", stratum().alias("stratum"), *[rate(r).alias(r) for r in RULES])
    held = held.select("quality", "stratum", (crc32_mod(F.col("doc_id"), PARTS) == 0).alias("for_path"), F.array(*first).alias("steps"))

    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff")) for r, cs in CUTOFFS.items() for i, c in enumerate(cs)])).alias("g")
    pairs = counted.sparkSession.range(STRATA).select(F.col("id").cast("int").alias("stratum"), grid).select("stratum", "g.*")
    tallied = held.filter("for_path").select("stratum", "quality", F.explode("steps").alias("s")).groupBy("stratum", "s.rule", "s.step").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rejected = pairs.join(tallied, ["stratum", "rule", "step"], "left").select("stratum", "rule", "step", "cutoff", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in ("good", "bad")])
    useful = rejected.filter("bad > 0").withColumn("cost", F.max((F.col("good") + 1) / (F.col("bad") + 1)).over(so_far))
    path = useful.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("cost", "step", "rule")))
    path = written(path.select("stratum", "rule", "step", "cutoff", "place"), "path", small=True)

    # At most STRATA rows with the places of as many pairs as there are cutoffs.
    key = lambda s: F.concat_ws(":", s["rule"], s["step"])
    places = path.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct(key({"rule": F.col("rule"), "step": F.col("step")}), "place"))).alias("places"))
    # Where a rule's own step is not on the path, as no bad row tells for it, the next stricter one that is rejects the row.
    steps = lambda s: F.transform(F.sequence(s["step"], F.lit(most_steps)), lambda i: F.col("places")[F.concat_ws(":", s["rule"], i)])
    most_steps = max(map(len, CUTOFFS.values()))
    gone = F.array_min(F.transform("steps", lambda s: F.array_min(steps(s))))
    tested = held.filter("not for_path").join(F.broadcast(places), "stratum", "left").groupBy("stratum", gone.alias("place")).agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    sizes = tested.groupBy("stratum").agg(F.sum("good").cast("long").alias("n"))
    walked = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    every = path.select("stratum", "place").join(tested, ["stratum", "place"], "left").join(sizes, "stratum")
    every = every.select("stratum", "place", "n", F.sum(F.coalesce("good", F.lit(0))).over(walked).cast("long").alias("k"), F.sum(F.coalesce("bad", F.lit(0))).over(walked).alias("bad"))
    ok = every.withColumn("ok", binomial_tail(F.col("n"), F.col("k"), risk) <= confidence / STRATA)
    certified = ok.withColumn("certified", F.min("ok").over(walked)).filter("certified and bad - k > 0")
    best = Window.partitionBy("stratum").orderBy(F.desc(F.col("bad") - F.col("k")), "place")
    taken = certified.withColumn("r", F.row_number().over(best)).filter("r = 1").select("stratum", F.col("place").alias("last"))
    return path.join(taken, "stratum").filter("place <= last").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, counts, base_failed and kept of every row of ``docs`` (doc_id, text).

    A null or empty text has no words and fails the base rules. Rows are judged
    one by one, so repeated rows, null ids and other columns change nothing.
    Without labels no rule is switched on, and an empty table stays empty.
    """
    counted = written(features(docs), "features")
    cutoffs = written(choose_cutoffs(counted, labels, risk, confidence), "cutoffs")
    # At most STRATA rows of len(RULES) numbers.
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    wide = wide.select("stratum", *[F.col(r).alias(f"cutoff_{r}") for r in RULES])
    rows = counted.withColumn("stratum", stratum()).join(F.broadcast(wide), "stratum", "left").withColumn("base_failed", base_failed())
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(rate(r) > F.col(f"cutoff_{r}"), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~rejected)


def op3_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
