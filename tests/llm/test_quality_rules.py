import math
import random
import re
import zlib

from pyspark.sql import functions as F

from tandem.llm import quality_rules as Q


def brute_force(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_features(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "a b", "a b c", "a a a a", "a b c\na b c", "x\n\nx\nx \n", "é😀 ## | $%", "a b c d a b c e b c d", "z " * 20_000]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "\n", "# ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "a b c", 5), (3, "one", 5)]
    got = Q.features(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != 11:
            assert tuple(r)[1:] == brute_force(texts[r.doc_id])
    assert [tuple(r)[1:] for r in got if r.doc_id == 11] == [(20_000, 20_000, 0, 0, 20_000)]


def test_binomial_tail_is_exact(spark):
    cases = [(1, 0), (5, 0), (30, 2), (400, 1), (1500, 5), (20_000, 150), (100, 100), (1, 1)]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.01) + (r.n - j) * math.log(0.99)) for j in range(r.k + 1))
        assert math.isclose(r.p, want, rel_tol=1e-9) if r.k < r.n * 0.01 else r.p == 1.0


def corpus(spark, n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 10 == 0
        words = [rng.choice("bcdfg") + str(rng.randrange(5000)) for _ in range(rng.choice([80, 300]))]
        rows.append((i, " ".join(w + "##" if bad else w for w in words), "x"))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, stratum string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_clean_rows_stay_and_bad_rows_go(spark):
    docs, labels = corpus(spark, 8000)
    got = Q.judged(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept): r["count"] for r in got} == {(1, True): 7200, (0, False): 800}


def test_too_few_labels_certify_nothing(spark):
    docs, labels = corpus(spark, 300)
    assert Q.judged(docs, labels).filter("not kept").count() == 0
    assert Q.judged(docs, labels.limit(0)).filter("not kept").count() == 0
    assert Q.judged(docs.limit(0), labels).count() == 0


def test_false_rejections_stay_below_the_risk(spark):
    """Labels at random: nothing tells good from bad, so rejections must stay within the bound."""
    docs, _ = corpus(spark, 8000)
    labels = spark.range(8000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("quality"))
    out = Q.judged(docs, labels).join(labels, "doc_id").filter("quality = 1").agg(F.avg((~F.col("kept")).cast("double"))).first()[0]
    assert out <= Q.RISK


def rate_of(r, rule):
    part, whole = Q.RULES[rule]
    return 1000 * r[part] // r[whole] if r[whole] else 0


def stratum_of(r):
    return 0 if r.n_words < 150 else 1 if r.n_words < 600 else 2


def tail_of(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))


def chosen(rows, quality, stratum, rate, tail):
    """Cutoffs by (stratum, rule), row by row."""
    cutoffs = {}
    for s in range(Q.STRATA):
        own = [(i, r, quality[i]) for i, r in rows.items() if i in quality and not r.base_failed and stratum(r) == s]
        for_path = [x for x in own if zlib.crc32(str(x[0]).encode()) % Q.PARTS == 0]
        tested = [x for x in own if zlib.crc32(str(x[0]).encode()) % Q.PARTS]
        pairs = []
        for rule, tried in Q.CUTOFFS.items():
            cost = 0
            for step, c in enumerate(tried):
                good, bad = (sum(q == kind and rate(r, rule) > c for _, r, q in for_path) for kind in (1, 0))
                if bad:
                    cost = max(cost, (good + 1) / (bad + 1))
                    pairs.append((cost, step, rule, c))
        n, best, at = sum(q for _, _, q in tested), None, {}
        for _, _, rule, c in sorted(pairs):
            at[rule] = c
            k, bad = (sum(q == kind and any(rate(r, x) > y for x, y in at.items()) for _, r, q in tested) for kind in (1, 0))
            if not n or k >= n * Q.RISK or tail(n, k, Q.RISK) > Q.CONFIDENCE / Q.STRATA:
                break
            if bad > k and (best is None or bad - k > best[0]):
                best = (bad - k, dict(at))
        if best:
            cutoffs |= {(s, rule): c for rule, c in best[1].items()}
    return cutoffs


def test_the_shipped_tables_are_judged_by_the_method(spark):
    """Where a stratum has enough labels, rules are certified, reject bad rows, and keep good ones within the risk; verdicts equal brute force."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = Q.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels).drop("text")
    got = {r.doc_id: r for r in out.collect()}
    quality = {r.doc_id: r.q for r in labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q")).collect()}
    cutoffs = chosen(got, quality, stratum_of, rate_of, tail_of)
    assert cutoffs
    for r in got.values():
        assert r.kept == (not r.base_failed and not any(rate_of(r, rule) > cutoffs.get((stratum_of(r), rule), 10**9) for rule in Q.RULES))
    gone = [quality.get(i) for i, r in got.items() if not r.kept and not r.base_failed]
    good = sum(quality.get(i) == 1 and not r.base_failed for i, r in got.items())
    assert gone.count(0) > 10 and gone.count(1) <= Q.RISK * good


def test_verdicts_equal_brute_force(spark):
    """Cutoffs and verdicts of all rules, chosen again row by row."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(9000):
        # Bad rows are of two kinds, so that one rule alone does not find them all.
        bad, loud, words = rng.random() < 0.3, rng.random() < 0.5, []
        for _ in range(rng.choice([60, 200])):
            w = rng.choice("bcdfg") + str(rng.randrange(5000))
            words.append(w.upper() * 4 if bad and loud and rng.random() < 0.4 else w + "#" * (bad and not loud and rng.random() < 0.3))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.97:
            labels.append((i, int(not bad) if rng.random() < 0.9995 else int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.judged(docs, marks).collect()}
    quality = dict(labels)
    rate, stratum, tail = rate_of, stratum_of, tail_of
    cutoffs = chosen(got, quality, stratum, rate, tail)
    assert {rule for _, rule in cutoffs} >= {"symbols", "capitals"}
    for r in got.values():
        assert r.kept == (not r.base_failed and not any(rate(r, rule) > cutoffs.get((stratum(r), rule), 10**9) for rule in Q.RULES))
    assert 0 < sum(not r.kept for r in got.values()) < 5000
