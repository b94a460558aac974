"""N-gram Jaccard join by parity sketches, exact, with connected components.

A document's set is its distinct word shingles. Sketch: each shingle flips one
of the sketch's bits, so the Hamming distance of two sketches is at most the
symmetric difference of the sets. Two sets of a size band that reach the
threshold differ in at most ``h`` shingles; a sketch for the band is cut into
``h + 1 + spare`` segments, so at least ``1 + spare`` segments of a linked pair
are equal (pigeonhole). The join is on equal segments. A segment is joined by
its Zobrist key (the exclusive or of its shingles' 64-bit hashes), which equal
parity always makes equal. Segments without a shingle tell nothing; a document
with at most ``spare`` of them leaves them out, as a linked pair shares another.
What it has left of ``spare`` is its slack: of its keys it may drop as many, if
all documents drop the most frequent ones first (of the keys that a linked pair
shares, the rarest has that many behind it on either side). So keys that many
unlike documents have, as those of a common passage, are hardly ever joined on.
The band's ``spare`` is what nearly all of its documents stay below.

Steps, none of which forms all pairs of a group:

1. one map over the texts: set size, set fingerprint, a folded sketch and the
   slack; a node is an id with one of its sets, nodes with equal sets are one
   class, headed by its smallest node;
2. a second map makes the keys, which meet in one shuffle; keys that a bounded
   sample of documents shows to be hot are salted there. Keys of one document
   alone go, then copies, then each document's most frequent keys by its slack;
3. in each group of equal keys the smallest class is paired with the others;
   pairs whose sizes and folded sketches allow a link are verified on the sets;
   links make components (large star, small star);
4. groups whose members are now in different components join those across
   components only; members of large groups meet in their rarest shingles
   instead, as many as linked sets must share one of, and only where enough
   shingles follow in both sets for a link. What the sizes and
   sketches leave is verified, and components are made again. Pairs within a
   component need no check.

So every link between documents of different components is found or excluded by
a lower bound or by verification. Nothing is dropped or capped.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm._shared import Memo, per_worker, written
from tandem.llm.vocabularies import gathered, text_slices

#: A size band reaches from its lower end to WIDTH times that; sizes near an end are in two bands.
WIDTH = 1.5
FOLDED = 16
#: Rows of ids, nodes and fingerprints (four longs each) that are broadcast at most; more of them meet the texts in a shuffle.
MOST_BROADCAST = 1 << 20
#: Documents (about) whose keys tell which keys are hot, and how many of them must have a key for that. So there are never
#: many hot keys; a key that is missed only makes one task larger.
HOT_SAMPLE, HOT_ROWS, MOST_HOT, HOT_SALTS = 2_000, 20, 1 << 16, 64
#: Members of a group that are paired directly, across its components; larger groups are split by their rarest shingles.
LARGE_GROUP = 32
#: The lowest bits of a key are its band.
BAND_BITS = 6
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each whole text, end to end, and how many each text has.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text
    with fewer words than a shingle has is one shingle; without words it has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten()
    text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    distinct = found.dictionary_encode()
    codes = distinct.indices.to_numpy(zero_copy_only=False)
    spelled = [w.encode() for w in distinct.dictionary.to_pylist()]
    filled = np.fromiter(map(bool, spelled), bool, len(spelled))[codes]
    h = np.fromiter(map(word_hash, spelled), np.uint64, len(spelled))[codes[filled]]
    n_words = np.bincount(text_of[filled], minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    out = np.empty(int(n.sum()), np.uint64)
    begin = np.cumsum(n) - n
    for have in range(1, words + 1):
        own = np.flatnonzero(n_words == have if have < words else n_words >= words)
        at = gathered(np.arange(len(h)), first[own], n[own])
        mixed = np.full(len(at), have if have < words else 0, np.uint64)
        for k in range(have):
            mixed = _mix(mixed * MIX + h[at + k] + np.uint64(k + 1))
        out[gathered(np.arange(len(out)), begin[own], n[own])] = mixed
    for a, b in zip(begin.tolist(), (begin + n).tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[n > 0]] = True
    sizes = np.bincount(np.repeat(np.arange(len(texts)), n)[new], minlength=len(texts))
    return out[new], sizes


def segments(lower: int, upper: int, reach: int, threshold: int) -> tuple[int, int]:
    """(segments, spare) for a band whose smaller sets have lower..upper shingles and whose larger ones have at most reach."""
    least = (100 - threshold) * (upper + reach) // (100 + threshold) + 1
    m = least
    for _ in range(20):
        empty = m * (1 - 1 / m) ** lower
        m = least + math.ceil(empty + 4 * math.sqrt(empty) + 1)
    return m, m - least


def bands_of(size: int, threshold: int) -> list[tuple[int, int, int]]:
    """(band, segments, spare) of the bands that a set of this size is in; any two sets that can link share one.

    A pair belongs to the band of its smaller set; the larger set may reach past
    the band's upper end.
    """
    found, lower, band = [], 1, 0
    while lower <= size:
        upper = max(int(lower * WIDTH), lower)
        reach = upper * 100 // threshold
        if size <= reach:
            found.append((band, *segments(lower, upper, reach, threshold)))
        lower, band = upper + 1, band + 1
    return found


def segment_keys(shingles: np.ndarray, sizes: np.ndarray, bands: Memo) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Of sets given end to end: the join keys of all segments, how many keys each set has, and its (band, slack)."""
    plan = [bands[n] for n in sizes.tolist()]
    of = np.repeat(np.arange(len(sizes)), list(map(len, plan)))
    band, m, spare = (np.array([b[i] for own in plan for b in own], np.int64) for i in range(3))
    begin = np.cumsum(sizes) - sizes
    base = np.cumsum(m) - m
    own = gathered(shingles, begin[of], sizes[of])
    at = np.repeat(np.arange(len(of)), sizes[of])
    slot = base[at] + (own % m.astype(np.uint64)[at]).astype(np.int64)
    n_slots = int(m.sum())
    key = np.zeros(n_slots, np.uint64)
    np.bitwise_xor.at(key, slot, _mix(own + np.uint64(0x51ED2701)))
    filled = np.bincount(slot, minlength=n_slots) > 0
    unit = np.repeat(np.arange(len(of)), m)
    empty = m - np.bincount(unit[filled], minlength=len(of))
    key = _mix(key ^ _mix((band.astype(np.uint64) << np.uint64(40))[unit] + (np.arange(n_slots) - base[unit]).astype(np.uint64) + np.uint64(1)))
    key = key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | band.astype(np.uint64)[unit]
    emitted = filled | (empty > spare)[unit]
    slack = np.maximum(spare - empty, 0)
    slacks: list = [[] for _ in sizes]
    for i, b, x in zip(of.tolist(), band.tolist(), slack.tolist()):
        slacks[i].append((b, x))
    return key[emitted].view(np.int64), np.bincount(of[unit[emitted]], minlength=len(sizes)), slacks


def folded_sketches(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A parity sketch of FOLDED longs for each set: each shingle flips one bit."""
    h = _mix(shingles ^ np.uint64(0xA5A5A5A5)) % np.uint64(64 * FOLDED)
    out = np.zeros(len(sizes) * FOLDED, np.uint64)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(sizes)) * FOLDED, sizes) + (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out.view(np.int64).reshape(-1, FOLDED)


def fingerprints(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs that stand for each set."""
    a, b = np.zeros((2, len(sizes)), np.uint64)
    some = sizes > 0
    if some.any():
        begin = (np.cumsum(sizes) - sizes)[some]
        a[some] = np.bitwise_xor.reduceat(_mix(shingles), begin)
        b[some] = np.add.reduceat(_mix(shingles ^ MIX), begin)
    return a.view(np.int64), b.view(np.int64)


def text_hash():
    """What tells texts apart that share a doc_id."""
    return F.xxhash64("text")


SLACK = pa.list_(pa.struct([("band", pa.int32()), ("slack", pa.int32())]))
SKETCHES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sketch", pa.list_(pa.int64())), ("slack", SLACK)])


def _parts(arrow, words: int):
    """(rows, shingles, sizes) for parts of the batches, which have a column text."""
    per_worker("shingles", dict)
    for batch in arrow:
        at = 0
        for texts in text_slices(batch.column("text")):
            yield (batch.slice(at, len(texts)), *shingle_hashes(texts, words))
            at += len(texts)


def sketches(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Hash of the text, size, fingerprint, folded sketch and slack by band of every document."""

    def rows(arrow):
        bands = Memo(lambda n: bands_of(n, threshold))
        for part, shingles, sizes in _parts(arrow, words):
            *_, slack = segment_keys(shingles, sizes, bands)
            folded = folded_sketches(shingles, sizes)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * FOLDED, pa.int32()), pa.array(folded.ravel()))
            a, b = fingerprints(shingles, sizes)
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(sizes.astype(np.int64)), pa.array(a), pa.array(b), sketch]
            slack = pa.array([[{"band": b, "slack": x} for b, x in own] for own in slack], SLACK)
            yield pa.RecordBatch.from_arrays([*columns, slack], schema=SKETCHES)

    ddl = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sketch array<long>, slack array<struct<band:int,slack:int>>"
    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(rows, ddl)


def keys_of(texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """key and node of every segment of the ``texts`` (node, text)."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def rows(arrow):
        bands = Memo(lambda n: bands_of(n, threshold))
        for part, shingles, sizes in _parts(arrow, words):
            keys, n, _ = segment_keys(shingles, sizes, bands)
            nodes = np.repeat(part.column("node").to_numpy(), n)
            for at in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)]), pa.array(nodes[at : at + (1 << 17)])], schema=schema)

    return texts.select("node", "text").mapInArrow(rows, "key long, node long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and sorted shingle hashes of the sets that are ``wanted`` (doc_id, node, set_a, set_b)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def rows(arrow):
        for part, shingles, sizes in _parts(arrow, words):
            a, b = fingerprints(shingles, sizes)
            same = np.flatnonzero((a == part.column("set_a").to_numpy()) & (b == part.column("set_b").to_numpy()))
            kept = gathered(shingles, (np.cumsum(sizes) - sizes)[same], sizes[same]).view(np.int64)
            stops = pa.array(np.concatenate([[0], np.cumsum(sizes[same])]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(same)), pa.ListArray.from_arrays(stops, pa.array(kept))], schema=schema)

    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "node", "set_a", "set_b")
    return texts.mapInArrow(rows, "node long, shingles array<long>")


def _possible(a: str, b: str, threshold: int):
    """Whether sizes and folded sketches of two sides allow a link."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(FOLDED)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * threshold) & (apart * (100 + threshold) <= (n + m) * (100 - threshold))


def sets_of(nodes: DataFrame, most: int, heads: DataFrame, docs: DataFrame, words: int, repeated: bool) -> DataFrame:
    """The sets (node, shingles) of ``nodes``, of which there are at most ``most``; ``repeated`` says that rows repeat."""
    wanted = nodes.distinct().join(heads, "node").select("doc_id", "node", "set_a", "set_b")
    if most <= MOST_BROADCAST:
        # Few documents are compared, so the texts need not be shuffled to find them.
        wanted = F.broadcast(wanted)
    sets = shingle_sets(docs, wanted, words)
    return written(sets.dropDuplicates(["node"]) if repeated else sets, "sets", small=True)


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, words: int, threshold: int, repeated: bool) -> DataFrame:
    """Those of the pairs (a, b) of heads whose sets reach the threshold, compared as sets."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), 2 * pairs.count(), heads, docs, words, repeated)
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * threshold).select("a", "b")


def across(x: DataFrame, y: DataFrame, on: str, threshold: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that are alike in ``on`` and near enough in size; x is the smaller set.

    Where rows have a ``place`` (see ``rarest_shingles``), a meeting counts only
    if the sets could still link were it their first: they share at most the
    shingles from there on, the fewer of the two places. Of linked sets the
    first meeting always counts.
    """
    x, y = x.alias("x"), y.alias("y")
    near = (F.col("x.n") <= F.col("y.n")) & (F.col("x.n") * 100 >= F.col("y.n") * threshold)
    if "place" in x.columns:
        near &= F.least("x.place", "y.place") * (100 + threshold) >= (F.col("x.n") + F.col("y.n")) * threshold
    met = x.join(y, (F.col(f"x.{on}") == F.col(f"y.{on}")) & (F.col("x.component") != F.col("y.component")) & near)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def rarest_shingles(placed: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """shingle, node, component, n, place, short: of each set so many of its rarest shingles that linked sets share one.

    In an order that is the same for all sets, rarest first, two sets that share
    o shingles have one in common that is not among the last o - 1 of either.
    Linked sets share at least threshold percent of the larger one, and 2 t / (1 + t)
    of the smaller one; ``short`` says that a shingle will do for a smaller set.
    What a group has in common is frequent and comes last. ``place`` is how many
    shingles of the set there are from this one on.
    """
    every = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = every.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    ranked = every.join(written(often, "often"), "shingle").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("often"), "shingle")))
    # Shingles of one set alone come first in the order and pair with nothing; places count from the order's end.
    as_smaller = F.col("place") >= F.ceil(F.col("size") * (2 * threshold) / F.lit(100.0 + threshold))
    kept = ranked.filter(F.col("place") >= F.ceil(F.col("size") * threshold / 100.0)).select("shingle", "node", "place", as_smaller.alias("short"))
    return written(kept.join(placed, "node"), "rarest")


def joined_keys(texts: DataFrame, heads: DataFrame, words: int, threshold: int, n_rows: int, repeated: bool) -> DataFrame:
    """key and node of the keys that heads are joined on: those of several documents, less the most frequent ones by slack.

    Keys that many documents of a bounded sample have are salted, so that no task
    gets all rows of one.
    """
    sampled = texts.sample(min(1.0, HOT_SAMPLE / max(1, n_rows)), 7)
    hot = keys_of(sampled, words, threshold).groupBy("key").count().filter(F.col("count") >= HOT_ROWS).orderBy(F.desc("count"), "key").limit(MOST_HOT).select("key", F.lit(True).alias("hot"))
    keyed = keys_of(texts, words, threshold).join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salt = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SALTS))).otherwise(0)
    counted = keyed.withColumn("salt", salt).withColumn("n", F.count("*").over(Window.partitionBy("key", "salt")))
    shared = counted.filter("n > 1 or hot").select("key", "node", "n", "hot")
    if repeated:
        shared = shared.groupBy("key", "node").agg(F.max("n").alias("n"), F.first("hot").alias("hot"))
    # Copies leave; what is left of a document's keys is ordered by how many rows have them.
    shared = written(shared.join(heads.select("node", "slack"), "node"), "shared")
    totals = shared.filter("hot").groupBy("key").agg(F.count("*").alias("total"))
    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1)
    order = Window.partitionBy("node", "band").orderBy(F.desc("often"), "key")
    ranked = shared.join(F.broadcast(totals), "key", "left").select("key", "node", "slack", band.alias("band"), F.coalesce("total", "n").alias("often"))
    ranked = ranked.withColumn("place", F.row_number().over(order))
    own = F.filter("slack", lambda x: x["band"] == F.col("band"))[0]["slack"]
    return written(ranked.filter(F.col("place") > own).select("key", "node"), "groups")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps until no edge changes; each step
    is written to the shared folder. Hot nodes cost no more than their edges:
    a step groups by node only to find the smallest neighbour.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges", small=True)
    while True:
        # Large star: each larger neighbour is linked to the smallest of node and neighbours.
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: node and its smaller neighbours are linked to the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = written(small.filter("u > v").distinct(), "edges", small=True)
        if _digest(new) == _digest(now):
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(new.select("v", "v")).distinct()
        now = new


def with_nodes(every: DataFrame) -> DataFrame:
    """``every`` with ``node``, a long of its own for each doc_id and set; null for rows without words or id.

    It is the doc_id where that has one set. Sets of ids that have more get a
    hash; should it be another node already, they are hashed anew.
    """
    placed = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("doc_id"))
    every = every.withColumn("node", placed)
    same = ["n_shingles", "set_a", "set_b"]
    per_id = every.filter("node is not null").groupBy("doc_id").agg(*[F.min(c).alias(f"lo_{c}") for c in same], *[F.max(c).alias(f"hi_{c}") for c in same])
    clashing = per_id.filter(" or ".join(f"lo_{c} < hi_{c}" for c in same)).select("doc_id", F.lit(True).alias("clashes"))
    if clashing.isEmpty():
        return every
    marked = every.join(written(clashing, "clashing"), "doc_id", "left")
    for salt in itertools.count():
        found = marked.withColumn("node", F.when(F.col("clashes") & F.col("node").isNotNull(), F.xxhash64("doc_id", *same, F.lit(salt))).otherwise(F.col("node")))
        if found.filter("node is not null").select("node", "doc_id", *same).distinct().groupBy("node").count().filter("count > 1").isEmpty():
            return written(found.drop("clashes"), "noded")


def grouped_rows(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """As ``linked_components``, with ``text_hash`` of every row and ``group_id``.

    Rows of a component, and no others, have the same ``group_id``; so unlike
    ``component_id`` it tells apart components whose smallest doc_id is the same
    id with different texts. It is null for rows without words or id.
    """
    every = with_nodes(written(sketches(docs, words, threshold), "sketches"))
    full = every.filter("node is not null")
    firsts = [F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("set_a").alias("set_a"), F.min("set_b").alias("set_b"), F.first("sketch").alias("sketch"), F.first("slack").alias("slack"), F.count("*").alias("rows")]
    chosen = full.groupBy("node").agg(*firsts)
    same_set = ["n", "set_a", "set_b"]
    classes = chosen.groupBy(same_set).agg(F.min("node").alias("head"), F.min("doc_id").alias("class_id"), F.count("*").alias("nodes")).filter("nodes > 1").drop("nodes")
    member = chosen.join(written(classes, "classes", small=True), same_set, "left")
    member = written(member.withColumn("head", F.coalesce("head", "node")).withColumn("class_id", F.coalesce("class_id", "doc_id")), "members", small=True)
    n_rows, n_nodes = member.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    heads = member.filter("node = head")
    sketch = heads.select("node", "n", "sketch")
    texts = docs.select("doc_id", "text").filter("doc_id is not null").withColumn("node", F.col("doc_id"))
    placed = every.filter("node <> doc_id").select("doc_id", "text_hash", F.col("node").alias("other")).distinct()
    n_placed = placed.count()
    if n_placed:
        placed = written(placed, "placed")
        texts = texts.withColumn("text_hash", text_hash()).join(F.broadcast(placed) if n_placed <= MOST_BROADCAST else placed, ["doc_id", "text_hash"], "left").withColumn("node", F.coalesce("other", "node"))
    groups = joined_keys(texts, heads, words, threshold, n_rows, n_rows > n_nodes)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sketch.alias("x"), F.col("a") == F.col("x.node")).join(sketch.alias("y"), F.col("b") == F.col("y.node"))
        pairs = written(pairs.filter(_possible("x", "y", threshold)).select("a", "b"), "pairs", small=True)
        return written(verified(pairs, heads, docs, words, threshold, n_rows > n_nodes), "links", small=True)

    least = written(groups.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key", "least"), "least", small=True)
    found = links(groups.join(least, "key").filter("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    parts = components(found)

    # Groups that still hold more than one component.
    placed = groups.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).filter("lo < hi").select("key", (F.col("rows") > LARGE_GROUP).alias("large"))
    open_rows = placed.join(written(spread, "spread", small=True), "key").join(heads.select("node", "n"), "node")
    open_rows = written(open_rows, "open-groups", small=True)
    small, large = open_rows.filter("not large"), open_rows.filter("large").select("node", "component", "n").distinct()
    pairs = across(small, small, "key", threshold)
    n_large = large.count()
    if n_large:
        # Of large groups not all pairs are formed: their members meet anew in the shingles that set them apart.
        apart = rarest_shingles(large, sets_of(large.select("node"), n_large, heads, docs, words, n_rows > n_nodes), threshold)
        pairs = pairs.union(across(apart.filter("short"), apart, "shingle", threshold)).distinct()
    more = links(pairs)
    if not more.isEmpty():
        parts = components(found.union(more))

    # A component is called by the smallest doc_id of its classes, which is not its node where that is a hash.
    called = parts.join(heads.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    called = parts.join(called, "component").withColumnRenamed("node", "head")
    member = member.select("node", "head", "class_id").join(called, "head", "left")
    member = member.select("node", "class_id", F.coalesce("component", "head").alias("group_id"), F.coalesce("component_id", "class_id").alias("component_id"))
    rows = every.select("doc_id", "text_hash", "n_shingles", "node").join(member, "node", "left")
    named = [F.coalesce(c, "doc_id").alias(c) for c in ("class_id", "component_id")]
    return rows.select("doc_id", "text_hash", "n_shingles", *named, "group_id")


def linked_components(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= threshold * union of their sets
    of distinct ``words``-word shingles. ``class_id`` is the smallest doc_id with
    the same set, ``component_id`` the smallest that links reach. A document
    without words links with nothing. Rows without doc_id have null class and
    component; rows that share a doc_id are placed each by its own set. An empty
    table stays empty.
    """
    return grouped_rows(docs, words, threshold).select("doc_id", "n_shingles", "class_id", "component_id")


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, four-word shingles, 85 percent."""
    found = linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, threshold=85)
    return found.select("doc_id", "n_shingles", "component_id")
