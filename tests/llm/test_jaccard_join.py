import random

import numpy as np
import pyarrow as pa

from tandem.llm import jaccard_join as J


def brute_force(rows, words, threshold):
    sets = {}
    for doc_id, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
        w = [x for x in w if x]
        sets[doc_id] = {tuple(w)} if w and len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def sample(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    texts = ["", None, " \n\t", "one", "One", "two words", "same four words here", "SAME four words here\n"]
    passage = [f"p{i}" for i in range(60)]
    for length in (5, 12, 40, 150, 400):
        base = [f"w{length}_{rng.randrange(2000)}" for _ in range(length)]
        texts += sample(rng, base, 12, max(1, length // 12)) + [" ".join(base)] * 4
    for _ in range(25):  # a passage that many documents share
        own = [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 200))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += [" ".join(f"c{i + k}" for i in range(100)) for k in range(0, 40, 3)]  # a chain of links
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_components_equal_brute_force(spark, monkeypatch):
    """Also where the texts to compare are found by a shuffle, as for more ids than are broadcast."""
    for seed, words, threshold, broadcast in ((1, 4, 85, J.MOST_BROADCAST), (2, 5, 80, 0)):
        monkeypatch.setattr(J, "MOST_BROADCAST", broadcast)
        rows = rows_of(seed)
        docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n string")
        got = J.linked_components(docs, words, threshold).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute_force(rows, words, threshold)


def kept_keys(shingles, frequency, bands):
    """Keys of one set by band, without the most frequent ones by its slack."""
    keys, _, ((*slack,),) = J.segment_keys(shingles, np.array([len(shingles)]), bands)
    kept = set()
    for band, n in slack:
        own = sorted((k for k in keys.tolist() if k & 63 == band), key=lambda k: (-frequency.get(k, 0), k))
        kept |= set(own[n:])
    return kept


def test_large_groups_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(J, "LARGE_GROUP", 1)
    for seed, words, threshold in ((7, 4, 85), (8, 5, 80)):
        rows = rows_of(seed)
        got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), words, threshold).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute_force(rows, words, threshold)


def test_unlike_documents_of_one_passage_do_not_pair(spark, monkeypatch):
    """Many documents share most of their words and differ just beyond the threshold: no square of them, and no link lost."""
    monkeypatch.setattr(J, "LARGE_GROUP", 1)
    rng = random.Random(9)
    passage, texts = [f"p{i}" for i in range(90)], []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(9, 15))]
        texts.append(passage + own)
        if i % 10 == 0:  # a near copy of it, which links
            texts.append([*passage, *own[:-1], "changed"])
    rows = [(7 * i + 2, " ".join(t)) for i, t in enumerate(texts)]
    met, form = [], J.across

    def counted(x, y, on, threshold):
        pairs = form(x, y, on, threshold)
        if on == "shingle":
            met.append(pairs.count())
        return pairs

    monkeypatch.setattr(J, "across", counted)
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 4, 85)
    assert sum(met) < 10 * len(rows)


def test_sketch_bounds():
    """Bit sketches never show more than the symmetric difference, and linked sets share keys whichever keys are frequent."""
    rng, bands = np.random.default_rng(4), J.Memo(lambda n: J.bands_of(n, 85))
    for size in (1, 3, 9, 30, 200, 1500):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for _ in range(20):
            gone = rng.integers(0, max(1, int(size * 0.15)) + 1)
            b = np.unique(np.r_[a[gone // 2 :], rng.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)])
            shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            x, y = J.folded_sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
            apart = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
            assert apart <= union - shared
            if 100 * shared >= 85 * union:
                both = {*J.segment_keys(a, np.array([len(a)]), bands)[0].tolist()} & {*J.segment_keys(b, np.array([len(b)]), bands)[0].tolist()}
                # The worst order: all that they share is frequent.
                frequency = {k: int(rng.integers(1, 9)) for k in both}
                assert kept_keys(a, frequency, bands) & kept_keys(b, frequency, bands)


def test_shingles_of_many_texts():
    texts = ["", " a  b\tc\x0bd\x0ce ", "A B c D e", "a b", "a b\x1cc d e f", "é É x", "a b c d e a b c d e a"]
    found, sizes = J.shingle_hashes(pa.array(texts), 4)
    assert sizes.tolist() == [0, 2, 2, 1, 2, 1, 5]
    own = [set(found[b - n : b].tolist()) for n, b in zip(sizes, np.cumsum(sizes))]
    assert own[1] == own[2] and not own[3] & own[1] and own[1] < own[6]


def test_hot_keys_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_ROWS", 2)
    rows = rows_of(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = J.linked_components(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 4, 85)


def test_ids_that_are_null_or_repeated(spark):
    text = "a b c d e f g"
    rows = [(None, text), (5, text), (5, text), (9, text), (2, None), (None, None), (7, "x y z"), (7, "other words of this id entirely")]
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert len(got) == 8
    found = {(r.doc_id, r.n_shingles): (r.class_id, r.component_id) for r in got}
    assert found[(5, 4)] == found[(9, 4)] == (5, 5) and found[(2, 0)] == (2, 2) and found[(None, 4)] == (None, None)
    assert J.linked_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
