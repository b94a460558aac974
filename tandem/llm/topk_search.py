"""Exact top-k by inner product, block at a time.

Vectors are integers, floor(256 * x) of each component. Rows are laid out in
blocks of neighbouring ids; a block keeps its vectors (the forward index) and,
per component (term), its largest and smallest value. For a query the sum over
components of the larger of query * largest and query * smallest bounds every
score in the block.

1. From the blocks' extremes alone every query gets the bounds of all blocks:
   the best block overall, and the best bound within each group of blocks.
2. The best block of each query is scored; its k-th score is the query's floor.
3. A query meets only the groups with a bound that reaches its floor. There it
   takes the blocks in falling order of bound, scores one at a time, and stops
   when the bound falls below its k-th score or its floor.

Queries and blocks meet in cells: a chunk of queries with a group of blocks, so a
cell's memory is bounded whatever the table's size. The k best of all cells are
merged by a window per query. Dense vectors without structure have bounds that
reach the floor nearly everywhere: then all blocks are scored, and step 3 is the
stated query set against all rows, in blocks. ``pruning`` tells how many were.
"""

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm._shared import per_worker, written

#: Rows of a block, of a group of blocks at most, and queries of a chunk (about, as both are dealt out by sampling or hash).
BLOCK, GROUP, CHUNK = 256, 8_192, 2_048


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<long>), dim of the rows that take part.

    Left out: a null vec_id, a null vector, a null, NaN or infinite component, or
    one whose integer has more than 64 bits. An empty vector is one of length 0.
    """
    v = F.col("embedding")
    # Non-finite, also on the way: a product beyond range turns infinite.
    scaled = F.transform(v, lambda x: F.lit(256.0) * x.cast("double"))
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 63)))
    kept = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", F.transform(scaled, lambda x: F.floor(x).cast("long")).alias("v"), F.size("embedding").alias("dim"))


BLOCKS = "g int, b int, dim int, ids array<long>, v array<long>, high array<long>, low array<long>"


def blocked(rows: DataFrame, groups: int, block: int) -> DataFrame:
    """One row per block of neighbouring ids: its group and number, ids, vectors end to end, largest and smallest components."""

    def make(frames):
        per_worker("blocks", dict)
        g, b, held = TaskContext.get().partitionId(), 0, None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            ready, held = split(held, False)
            for own in ready:
                yield packed(g, b, own)
                b += 1
        for own in split(held, True)[0] if held is not None else []:
            yield packed(g, b, own)
            b += 1

    def split(frame, last):
        """Whole blocks, each of vectors of one length, and the rest (all blocks, if it is the last call)."""
        out, rest = [], frame
        for dim in frame.dim.unique().tolist():
            own = frame[frame.dim == dim]
            stop = len(own) if last or dim != frame.dim.iloc[-1] else len(own) - len(own) % block
            out += [own.iloc[i : min(i + block, stop)] for i in range(0, stop, block)]
            rest = own.iloc[stop:]
        return out, rest

    def packed(g, b, own):
        dim = int(own.dim.iloc[0])
        m = np.stack(own.v.to_list()).reshape(len(own), dim).astype(np.int64)
        return pd.DataFrame({"g": [g], "b": [b], "dim": [dim], "ids": [own.vec_id.to_numpy()], "v": [m.ravel()], "high": [m.max(0)], "low": [m.min(0)]})

    return rows.repartitionByRange(groups, "dim", "vec_id").sortWithinPartitions("dim", "vec_id").select("vec_id", "v", "dim").mapInPandas(make, BLOCKS)


def _numbers(*matrices: np.ndarray) -> list[np.ndarray]:
    """The last matrix is multiplied with the others: as doubles where all sums are exact, else as Python integers."""
    *left, q = matrices
    top = max((float(np.abs(m.astype(np.float64)).max(initial=0)) for m in left), default=0.0) * float(np.abs(q.astype(np.float64)).max(initial=0)) * q.shape[1]
    return [m.astype(np.float64 if top < 2.0**53 else object) for m in matrices]


def _bounds(high: np.ndarray, low: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bound of every query (rows) for every block (columns)."""
    if not q.shape[1]:
        return np.zeros((len(q), len(high)))
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_list()).reshape(len(column), dim)


def _best(ids: np.ndarray, scores: np.ndarray, q_id: int, k: int, best: list) -> list:
    """The k best (-score, id) of those held and a block's."""
    keep = np.flatnonzero(ids != q_id)
    if len(best) == k:
        keep = keep[scores[keep] >= -best[-1][0]]
    if len(keep) > 4 * k and scores.dtype != object:
        edge = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= edge]
    return sorted(best + [(-int(scores[i]), int(ids[i])) for i in keep])[:k]


def best_of_cell(blocks: pd.DataFrame, asked: pd.DataFrame, k: int) -> list[tuple[int, int, int, int]]:
    """(query_id, vec_id, score, blocks scored) of the k best rows for every query, by block-at-a-time pruning.

    blocks: as from ``blocked``, of one length of vectors; asked: query_id, v,
    floor (a score that the k-th best of the whole table reaches; NaN or null: none).
    """
    dim = int(blocks.dim.iloc[0])
    ids, m = blocks.ids.to_list(), [np.asarray(v).reshape(len(i), dim) for v, i in zip(blocks.v, blocks.ids)]
    *extremes, q = _numbers(_vectors(blocks.high, dim), _vectors(blocks.low, dim), _vectors(asked.v, dim))
    bounds, kind = _bounds(*extremes, q), q.dtype
    m, out = [x.astype(kind) for x in m], []
    for q_id, query, bound, floor in zip(asked.query_id.tolist(), q, bounds, asked.floor.tolist()):
        best, scored = [], 0
        for i in sorted(range(len(ids)), key=lambda i: -bound[i]):
            if (floor is not None and floor == floor and bound[i] < floor) or (len(best) == k and bound[i] < -best[-1][0]):
                break
            best, scored = _best(np.asarray(ids[i]), m[i] @ query if dim else np.zeros(len(ids[i])), q_id, k, best), scored + 1
        out += [(q_id, vec_id, -s, scored) for s, vec_id in best]
    return out


def _met(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best of every cell (query_id, vec_id, score, scored, g), and the blocks."""
    spark = vectors.sparkSession
    rows, asked = integer_vectors(vectors), integer_vectors(queries)
    # Group and chunk numbers: id ranges of about GROUP rows and CHUNK queries, from row counts alone.
    n, n_asked = rows.count(), asked.count()
    groups = max(1, -(-n // GROUP), min(-(-n // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    chunks = max(1, -(-n_asked // CHUNK))
    blocks = written(blocked(rows, groups, BLOCK), "blocks")
    # Rows that share a query's vec_id and vector are one query.
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", "dim").distinct().withColumn("q", F.xxhash64("query_id", "v"))
    asked = written(asked.withColumn("c", F.pmod("q", F.lit(chunks)).cast("int")), "asked")
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))

    def bound(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim in sorted(set(blocks.dim) & set(asked.dim)):
            own, a = blocks[blocks.dim == dim], asked[asked.dim == dim]
            b = _bounds(*_numbers(_vectors(own.high, dim), _vectors(own.low, dim), _vectors(a.v, dim))).astype(np.float64)
            at = b.argmax(1)
            found.append(pd.DataFrame({"query_id": a.query_id.to_numpy(), "q": a.q.to_numpy(), "c": a.c.to_numpy(), "g": own.g.iloc[0], "b": own.b.to_numpy()[at], "bound": b[np.arange(len(a)), at]}))
        return pd.concat(found) if found else pd.DataFrame([], columns=["query_id", "q", "c", "g", "b", "bound"])

    extremes = blocks.select("g", "b", "dim", "high", "low").withColumn("c", every)
    visits = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    bounds = extremes.groupBy("g", "c").cogroup(visits.groupBy("g", "c")).applyInPandas(bound, "query_id long, q long, c int, g int, b int, bound double")
    bounds = written(bounds, "bounds")

    def scored(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim in sorted(set(blocks.dim) & set(asked.dim)):
            found += [(*r, int(blocks.g.iloc[0])) for r in best_of_cell(blocks[blocks.dim == dim], asked[asked.dim == dim], k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "scored", "g"]).astype("int64")

    def cells(pairs: DataFrame, on: list[str]) -> DataFrame:
        """The k best of every group of blocks (by ``on``) and chunk for the pairs of a query and a group; only needed blocks are copied."""
        own = blocks.select("*").alias("x").join(pairs.select(*[F.col(n).alias(f"p_{n}") for n in (*on, "c")]).distinct(), [F.col(f"x.{n}") == F.col(f"p_{n}") for n in on])
        own = own.select("x.*", F.col("p_c").alias("c"))
        return own.groupBy(*on, "c").cogroup(pairs.groupBy(*on, "c")).applyInPandas(scored, "query_id long, vec_id long, score long, scored long, g long")

    first = bounds.groupBy("q").agg(F.max_by(F.struct("g", "b"), F.struct("bound", "g", "b")).alias("at")).select("q", "at.*")
    tried = cells(asked.join(first, "q").withColumn("floor", F.lit(None).cast("double")), ["g", "b"])
    floors = tried.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
    # A shared vec_id asked with several vectors has several floors in one; it goes without.
    several = asked.groupBy("query_id").count().filter("count > 1").select("query_id")
    floors = written(floors.join(several, "query_id", "left_anti").select("query_id", F.col("floor").cast("double").alias("floor")), "floors")
    # Doubles round; the slack keeps bounds that only rounding puts below the floor.
    reached = bounds.select("query_id", "q", "g", "bound").join(floors, "query_id", "left").filter("floor is null or bound + abs(bound) * 1e-9 >= floor")
    pairs = reached.select("q", "g", "floor").join(asked, "q")
    exact = F.when(F.abs("floor") < float(1 << 53), F.col("floor"))
    return cells(pairs.withColumn("floor", exact), ["g"]), blocks


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``queries`` the k best rows of ``vectors`` but its own.

    Both have vec_id and embedding. Rows that can't take part (see
    ``integer_vectors``) are neither queries nor candidates; vectors of different
    lengths are not compared; ties go to the smaller vec_id. A vec_id that
    several rows share is excluded for its own queries; each of its rows counts
    as a candidate, and each vector of it as a query whose results are one list
    (rows equal in vec_id and score are kept as they are). Without rows the
    result is empty. Scores must fit in 64 bits.
    """
    found, _ = _met(vectors, queries, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """One row: pairs of a query and a block of the table, and how many of them were scored (without step 2)."""
    found, blocks = _met(vectors, queries, k)
    scored = found.groupBy("query_id", "g").agg(F.max("scored").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"))
    asked = integer_vectors(queries).select("vec_id", "v").distinct().agg(F.count("*").alias("queries"))
    return asked.crossJoin(blocks.agg(F.count("*").alias("blocks"))).crossJoin(scored).select((F.col("queries") * F.col("blocks")).alias("pairs"), "scored")


def op8_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)
