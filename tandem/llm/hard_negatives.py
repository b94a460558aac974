"""Hard negatives by dual-tree search: trees over anchors and candidates, node pairs bounded by intervals of inner products.

Vectors are integers, floor(256 * x) of each component. Candidates are laid out
by label, the component that spreads most and vec_id, and cut into groups; a group
is a tree: its leaves hold up to ``LEAF`` rows of a kd split (by label first, then
by the widest component), and every node above is a run of leaves with the least
and largest components and labels of its rows. Anchors are laid out in chunks of
such trees likewise.

A pair of a chunk and a group is a cell. In it pairs of nodes are visited from the
roots down. With boxes [ql, qh] and [cl, ch] every inner product lies in the sum of
the least and the sum of the largest of the four corner products of each component.
Labels and that interval prune a whole anchor node at once:

1. positives: no label in common, or the interval ends below the worst k-th score of
   the node's anchors;
2. negatives: one and the same label on both sides, or the interval lies above the
   largest upper limit, or ends below what every anchor's lists still need, which is
   the lower limit of a positive's range or, once ten are found, the tenth score.

Pairs of leaves are scored exactly, in doubles while all sums are below 2^53, in
Python integers beyond. The best of all cells are merged by a window for each
anchor (and positive). A cell's memory is bounded by the sizes of chunk and group.
Dense vectors without structure have intervals that prune little: then nearly all
leaf pairs are scored, which is the stated query set against all rows, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm._shared import per_worker, written

# Positives of an anchor, negatives of a positive, and a negative's least and largest share (in tenths) of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 3, 9
#: Rows of a leaf of candidates and of anchors; rows of a group (at least and at most) and anchors of a chunk.
LEAF, ANCHOR_LEAF, LEAST_GROUP, GROUP, CHUNK = 256, 64, 1_024, 16_384, 4_096
#: Rows from which the component that spreads most is told; it only decides the layout.
SPREAD_ROWS = 20_000
TOP, BOTTOM = np.iinfo(np.int64).max, np.iinfo(np.int64).min


# --- Trees ------------------------------------------------------------------------------------------------------------


def leaves(ids: np.ndarray, labels: np.ndarray, m: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves, in the tree's order: halves by label while labels differ, else by the widest component."""
    out, stack = [], [np.arange(len(ids))]
    while stack:
        own = stack.pop()
        if len(own) <= most:
            out.append(own[np.lexsort((ids[own],))])
            continue
        by = labels[own]
        if by.min() == by.max() and m.shape[1]:
            x = m[own]
            by = x[:, int((x.max(0) - x.min(0)).argmax())]
        own = own[np.argsort(by, kind="stable")]
        stack += [own[len(own) // 2 :], own[: len(own) // 2]]
    return out


class Tree:
    """Leaves of a group or chunk, end to end, and the nodes above them: halves of runs of leaves."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("leaf")
        dim = int(frame.dim.iloc[0])
        self.leaf = frame.leaf.tolist()
        self.ids = [np.asarray(x, dtype=np.int64) for x in frame.ids]
        self.labels = [np.asarray(x, dtype=np.int64) for x in frame.labels]
        self.m = [np.asarray(x, dtype=np.float64).reshape(len(i), dim) for x, i in zip(frame.v, self.ids)]
        self.nodes: list[tuple] = []
        self.root = self._node(0, len(self.leaf))

    def _node(self, low: int, high: int) -> int:
        """Number of the node over the leaves low to high: (low, high, children, least and largest components, labels)."""
        if high - low == 1:
            m, labels = self.m[low], self.labels[low]
            node = (low, high, (), m.min(0), m.max(0), int(labels.min()), int(labels.max()))
        else:
            mid = (low + high) // 2
            kids = self._node(low, mid), self._node(mid, high)
            a, b = (self.nodes[k] for k in kids)
            node = (low, high, kids, np.minimum(a[3], b[3]), np.maximum(a[4], b[4]), min(a[5], b[5]), max(a[6], b[6]))
        self.nodes.append(node)
        return len(self.nodes) - 1


def interval(a: tuple, c: tuple) -> tuple[float, float]:
    """Least and largest inner product that rows of two nodes can have."""
    corners = a[3] * c[3], a[3] * c[4], a[4] * c[3], a[4] * c[4]
    least, most = np.minimum(np.minimum(*corners[:2]), np.minimum(*corners[2:])), np.maximum(np.maximum(*corners[:2]), np.maximum(*corners[2:]))
    size = float(np.maximum(np.abs(least), np.abs(most)).sum())
    slack = 0.0 if size < 2.0**53 else size * 1e-9
    return float(least.sum()) - slack, float(most.sum()) + slack


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; those beyond are the nearest ones."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a @ c.T).astype(np.int64)
    big = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, c)]
    return np.clip(big[0] @ big[1].T, BOTTOM, TOP).astype(np.int64)


class Best:
    """The k best (score, id) of each of n lists: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        # Kept as ~score, which sorts ascending and never overflows; empty places sort last.
        self.rest, self.ids, self.k = np.full((n, k), TOP), np.full((n, k), TOP), k

    def add(self, wanted: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (columns) for the lists (rows) where ``wanted``."""
        rest = ~score
        last, last_id = self.rest[:, -1:], self.ids[:, -1:]
        better = wanted & ((rest < last) | ((rest == last) & (ids < last_id)))
        rows = np.flatnonzero(better.any(1))
        if not len(rows):
            return
        columns = np.flatnonzero(better.any(0))
        better, rest = better[np.ix_(rows, columns)], rest[np.ix_(rows, columns)]
        both = np.hstack([self.rest[rows], np.where(better, rest, TOP)])
        names = np.hstack([self.ids[rows], np.where(better, ids[columns], TOP)])
        order = np.lexsort((names, both), axis=-1)[:, : self.k]
        self.rest[rows], self.ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def floors(self) -> np.ndarray:
        """The k-th score of each list, as a double; minus infinity where places are empty."""
        return np.where(self.ids[:, -1] == TOP, -np.inf, (~self.rest[:, -1]).astype(np.float64))

    def found(self):
        """(list, id, score) of all."""
        for i, k in zip(*np.nonzero(self.ids != TOP)):
            yield int(i), int(self.ids[i, k]), int(~self.rest[i, k])


def visit(anchors: Tree, candidates: Tree, labels_meet, needs: np.ndarray, tops: np.ndarray, score_leaves) -> int:
    """Goes down all pairs of nodes that labels and intervals do not prune; returns the pairs of leaves scored.

    ``needs`` and ``tops``: for each leaf of anchors, the least and the largest
    score that one of its lists can use. ``score_leaves`` scores two leaves and
    raises ``needs``.
    """
    scored, stack = 0, [(anchors.root, candidates.root)]
    while stack:
        i, j = stack.pop()
        a, c = anchors.nodes[i], candidates.nodes[j]
        if not labels_meet(a, c):
            continue
        low, high = interval(a, c)
        need = needs[a[0] : a[1]].min()
        if high < need - abs(need) * 1e-12 or low > tops[a[0] : a[1]].max():
            continue
        if not a[2] and not c[2]:
            score_leaves(a[0], c[0])
            scored += 1
        elif c[2] and (not a[2] or c[1] - c[0] >= a[1] - a[0]):
            # The half with the larger interval is visited first: it is likelier to raise the needs.
            ends = [interval(a, candidates.nodes[k])[1] for k in c[2]]
            stack += [(i, k) for _, k in sorted(zip(ends, c[2]))]
        else:
            stack += [(k, j) for k in a[2]]
    return scored


def positives_of_cell(anchors: Tree, candidates: Tree, k: int = POSITIVES) -> tuple[list[Best], int]:
    """For each leaf of anchors the k best rows of the same label and another id; pairs of leaves scored."""
    best = [Best(len(i), k) for i in anchors.ids]
    needs, tops = np.full(len(best), -np.inf), np.full(len(best), np.inf)

    def score_leaves(a: int, c: int) -> None:
        wanted = (anchors.labels[a][:, None] == candidates.labels[c]) & (anchors.ids[a][:, None] != candidates.ids[c])
        if wanted.any():
            best[a].add(wanted, scores(anchors.m[a], candidates.m[c]), candidates.ids[c])
            needs[a] = best[a].floors().min()

    return best, visit(anchors, candidates, lambda a, c: a[5] <= c[6] and c[5] <= a[6], needs, tops, score_leaves)


def negatives_of_cell(anchors: Tree, candidates: Tree, ranges: list, k: int = NEGATIVES) -> tuple[list[Best], int]:
    """For each leaf of anchors the k best rows of another label in each of its ranges; pairs of leaves scored.

    ranges: for each leaf, arrays (anchor's place in the leaf, lower limit, upper limit).
    """
    best = [Best(len(r[0]), k) for r in ranges]
    needs = np.array([r[1].min() if len(r[0]) else np.inf for r in ranges], dtype=np.float64)
    tops = np.array([r[2].max() if len(r[0]) else -np.inf for r in ranges], dtype=np.float64)

    def score_leaves(a: int, c: int) -> None:
        at, low, high = ranges[a]
        if not len(at):
            return
        score = scores(anchors.m[a], candidates.m[c])[at]
        wanted = (anchors.labels[a][at][:, None] != candidates.labels[c]) & (score >= low[:, None]) & (score <= high[:, None])
        best[a].add(wanted, score, candidates.ids[c])
        needs[a] = np.maximum(low.astype(np.float64), best[a].floors()).min()

    # Limits of 2^53 and more are rounded; the slack keeps what only rounding would prune.
    tops += np.where(np.isfinite(tops), np.abs(tops) * 1e-12, 0)
    return best, visit(anchors, candidates, lambda a, c: not a[5] == a[6] == c[5] == c[6], needs, tops, score_leaves)


# --- Layout -----------------------------------------------------------------------------------------------------------


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array<double> of integers), dim of the rows that take part, each as often as a list can hold it at most."""
    scaled = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Doubles of 2^52 and more are integers.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    kept = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").filter("vec_id is not null and label is not null and embedding is not null").filter(F.coalesce(finite, F.lit(False)))
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v"), F.size("embedding").alias("dim")).groupBy("vec_id", "label", "v", "dim").agg(F.count("*").alias("n"))
    most = max(POSITIVES, NEGATIVES)
    return rows.select("vec_id", "label", "v", "dim", F.least("n", F.lit(most)).cast("int").alias("n"))


def _cut(rows: DataFrame, size: int, name: str, widest: int) -> DataFrame:
    """``rows`` with the number ``part`` of their group of exactly ``size`` neighbours (the last has fewer), by dim, label, widest component and vec_id."""
    order = ["dim", "label", F.try_element_at("v", F.lit(widest + 1)), "vec_id", F.xxhash64("v")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    laid = written(laid.withColumn("task", F.shiftright("pos", 33)), name)
    # One row for each task of the layout.
    counts = laid.groupBy("task").agg(F.count("*").alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("task", before.alias("before")))
    return laid.join(starts, "task").withColumn("part", F.floor((F.col("before") + F.col("pos").bitwiseAND((1 << 33) - 1)) / size).cast("int")).drop("task", "pos", "before")


LEAVES = "part int, leaf int, dim int, ids array<bigint>, labels array<bigint>, v array<double>"


def _treed(rows: DataFrame, size: int, leaf: int, name: str, widest: int) -> DataFrame:
    """One row per leaf of the trees of all groups: part, leaf, dim, ids, labels, v (end to end)."""

    def make(own: pd.DataFrame) -> pd.DataFrame:
        per_worker("trees", dict)
        out = []
        for dim in sorted(own.dim.unique().tolist()):
            f = own[own.dim == dim]
            ids, labels = f.vec_id.to_numpy(np.int64), f.label.to_numpy(np.int64)
            m = np.stack(f.v.to_list()).reshape(len(f), dim)
            times = f.n.to_numpy()
            ids, labels, m = np.repeat(ids, times), np.repeat(labels, times), np.repeat(m, times, axis=0)
            out += [(int(own.part.iloc[0]), 0, dim, ids[x], labels[x], m[x].ravel()) for x in leaves(ids, labels, m, leaf)]
        frame = pd.DataFrame(out, columns=["part", "leaf", "dim", "ids", "labels", "v"])
        frame["leaf"] = range(len(frame))
        return frame

    return written(_cut(rows, size, name, widest).groupBy("part").applyInPandas(make, LEAVES), f"{name}-trees")


def _cells(a: DataFrame, c: DataFrame, pairs: DataFrame, search, schema: str) -> DataFrame:
    """``search(anchors, candidates)`` in every cell of ``pairs`` (a_part, c_part)."""
    left = a.join(pairs, F.col("part") == F.col("a_part"))
    right = c.join(pairs.select(F.col("a_part").alias("a_cell"), F.col("c_part").alias("c_cell")), F.col("part") == F.col("c_cell"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim in sorted(set(anchors.dim) & set(candidates.dim)):
            found += search(anchors[anchors.dim == dim], candidates[candidates.dim == dim])
        return pd.DataFrame(found, columns=names).astype("int64")

    return left.groupBy("a_part", "c_part").cogroup(right.groupBy("a_cell", "c_cell")).applyInPandas(run, schema)


def mined(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``anchors`` among ``vectors``.

    Both have vec_id, embedding and label. Rows with a null id, label, vector or
    component, or a component that is not finite (times 256, as a double), take no
    part. Vectors of different lengths are not compared; empty ones score 0.
    Positives of an anchor are the ``POSITIVES`` best rows of its label that do not
    share its vec_id; negatives of a positive the ``NEGATIVES`` best rows of other
    labels within its range; ties go to the smaller vec_id. Rows that repeat in id,
    label and vector are one anchor, but count one by one as positives and negatives;
    rows that share only an id are anchors of their own. Positives without negatives
    give no rows, empty tables none. Other columns are ignored. Scores beyond 64 bits
    are the nearest 64-bit numbers.
    """
    spark = vectors.sparkSession
    rows = written(integer_rows(vectors), "vectors")
    asked = integer_rows(anchors).withColumn("n", F.lit(1))
    n = rows.count()
    spread = rows.sample(min(1.0, SPREAD_ROWS / max(n, 1)), seed=0).select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.coalesce(F.variance("x"), F.lit(0.0)).alias("spread"))
    widest = spread.orderBy(F.desc("spread"), "k").first()
    widest = widest.k if widest else 0
    size = min(GROUP, max(LEAST_GROUP, -(-n // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    c = _treed(rows, size, LEAF, "candidates", widest)
    a = _treed(asked, CHUNK, ANCHOR_LEAF, "anchors", widest)
    chunks = a.agg(F.max("part")).first()[0]
    low, high = F.min(F.array_min("labels")), F.max(F.array_max("labels"))
    of = lambda t, p: t.groupBy("part", "dim").agg(low.alias(f"{p}_low"), high.alias(f"{p}_high")).withColumnRenamed("part", f"{p}_part")
    # Cells: each group with each chunk of its length of vectors.
    every = of(c, "c").withColumn("a_part", F.explode(F.sequence(F.lit(0), F.lit(chunks or 0)))).join(of(a, "a"), ["dim", "a_part"])
    every = written(every, "cells")

    def positives(anchors: pd.DataFrame, candidates: pd.DataFrame) -> list:
        own, part = Tree(anchors), int(anchors.part.iloc[0])
        best, _ = positives_of_cell(own, Tree(candidates))
        return [(part, own.leaf[leaf], i, int(own.ids[leaf][i]), vec_id, score) for leaf, b in enumerate(best) for i, vec_id, score in b.found()]

    alike = every.filter("a_low <= c_high and c_low <= a_high").select("a_part", "c_part").distinct()
    best = Window.partitionBy("part", "leaf", "place").orderBy(F.desc("score"), "vec_id")
    found = _cells(a, c, alike, positives, "part bigint, leaf bigint, place bigint, anchor_id bigint, vec_id bigint, score bigint")
    found = written(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= POSITIVES), "positives")

    def negatives(anchors: pd.DataFrame, candidates: pd.DataFrame) -> list:
        anchors = anchors.sort_values("leaf")
        own, part, ranges, told = Tree(anchors), int(anchors.part.iloc[0]), [], []
        for asked in anchors.positives:
            told.append(sorted((p["place"], p["r"], p["vec_id"], p["score"]) for p in asked) if asked is not None else [])
            at = np.array([p[0] for p in told[-1]], dtype=np.int64)
            limits = [(-(-LEAST * int(p[3]) // 10), MOST * int(p[3]) // 10) for p in told[-1]]
            ranges.append((at, np.array([x[0] for x in limits], dtype=np.int64), np.array([x[1] for x in limits], dtype=np.int64)))
        best, _ = negatives_of_cell(own, Tree(candidates), ranges)
        out = []
        for leaf, b in enumerate(best):
            for i, vec_id, score in b.found():
                place, r, positive, by = told[leaf][i]
                out.append((part, own.leaf[leaf], place, r, int(own.ids[leaf][place]), positive, by, vec_id, score))
        return out

    lists = found.groupBy(F.col("part").cast("int").alias("part"), F.col("leaf").cast("int").alias("leaf")).agg(F.collect_list(F.struct("place", "r", "vec_id", "score")).alias("positives"))
    unlike = every.filter("not (a_low = a_high and c_low = c_high and a_low = c_low)").select("a_part", "c_part").distinct()
    schema = "part bigint, leaf bigint, place bigint, r bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    mined = _cells(a.join(lists, ["part", "leaf"]), c, unlike, negatives, schema)
    best = Window.partitionBy("part", "leaf", "place", "r").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; labels of ids divisible by 7 are changed first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    changed = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(changed, changed.filter("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike, coalesce(list_sum([a.v[i] * c.v[i] FOR i IN range(1, len(c.v) + 1)]), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT * FROM ranked WHERE rank <= 10
"""
