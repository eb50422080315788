"""Operator 4: exact top-k search by columnar branch and bound; queries are the vectors whose id is divisible by ``QUERY_EVERY``.

Vectors lie in blocks around their nearest pivot, in vertical layout: one row of the block's matrix for each dimension, those of the largest variance first.
Blocks of vectors stay where they are; blocks of queries, far fewer, are sent to them.

* First each block of queries meets one block of its own pivot, which bounds every query's k-th best distance.
* Then it is sent to the other blocks of vectors, but for those whose ball (centroid and radius) lies farther from the ball of the queries than
  the largest of these bounds; in a block, queries that lie farther from its ball than their own bound are left out too.
* For the rest squared distances are added up dimension block by dimension block. After each one, what is left of a distance is
  at least the squared difference of the two remaining norms (the remaining mass); pairs whose bound exceeds the query's
  k-th best so far are dropped, and the survivors are compacted before the next block of dimensions. Survivors of all
  blocks get their distance from the plain differences, so ranks don't depend on how sums were grouped.

What it costs: queries times vectors, in blocks. Each block of vectors is sent the queries once, as a twentieth of the vectors. Where vectors have no
clusters (random directions in many dimensions) the balls overlap, and the bounds save arithmetic but hardly any block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick

K = 10
DIM_BLOCK = 16
#: Every how many-th id is a query.
QUERY_EVERY = 20
#: Vectors and queries in a block, at most about, and pivots, at most.
BLOCK_ROWS, QUERY_ROWS, PIVOTS = 4096, 512, 32


def _nearest(pivots: np.ndarray):
    """Vectors with the number of their nearest pivot."""
    mass = (pivots**2).sum(1)

    def of(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((mass - 2 * (v @ pivots.T)).argmin(1).astype(np.int32))], names=["vec_id", "embedding", "pivot"])

    return of


def _blocks(dim: int, order: list[int]):
    """One row for each block (rows sorted by pivot and part): ids, the matrix in vertical layout, centroid and radius."""

    def block(pivot, part, ids, vectors):
        m = np.ascontiguousarray(np.concatenate(vectors)[:, order].T)
        centre = m.mean(1)
        radius = float(np.sqrt(((m - centre[:, None]) ** 2).sum(0).max()))
        return pa.RecordBatch.from_arrays([pa.array([pivot], pa.int32()), pa.array([part], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], names=["pivot", "part", "ids", "matrix", "centre", "radius"])

    def of(batches):
        now, ids, vectors = None, [], []
        for batch in batches:
            i = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            pivot, part = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            edges = np.flatnonzero(np.diff(pivot) | np.diff(part)) + 1 if len(i) else []
            for lo, hi in zip([0, *edges], [*edges, len(i)]):
                if lo == hi:
                    continue
                if (pivot[lo], part[lo]) != now:
                    if ids:
                        yield block(*now, ids, vectors)
                    now, ids, vectors = (pivot[lo], part[lo]), [], []
                ids.append(i[lo:hi]), vectors.append(v[lo:hi])
        if ids:
            yield block(*now, ids, vectors)

    return of


class Best:
    """The k nearest so far of each query of a block, by (squared distance, id)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.distance = np.full((n, k), np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(query)
        q = np.concatenate([np.repeat(rows, self.k), query])
        d = np.concatenate([self.distance[rows].ravel(), distance])
        i = np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = rank < self.k
        self.distance[q[keep], rank[keep]], self.id[q[keep], rank[keep]] = d[keep], i[keep]


def _search_block(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best, bound: np.ndarray) -> None:
    """Queries (dimensions x queries) against vectors (dimensions x vectors), given what bounds each query's k-th best square; a query doesn't meet its own id."""
    dim, n = vectors.shape
    edges = [*range(0, dim, DIM_BLOCK), dim]
    q_mass = np.concatenate([np.cumsum((queries**2)[::-1], 0)[::-1], np.zeros((1, queries.shape[1]))])
    v_mass = np.concatenate([np.cumsum((vectors**2)[::-1], 0)[::-1], np.zeros((1, n))])
    slack = 1e-9 * (q_mass[0][:, None].max(initial=0) + v_mass[0].max(initial=0)) + 1e-12
    columns = np.arange(n)
    partial = np.zeros((queries.shape[1], n))
    pairs = None
    for lo, hi in zip(edges, edges[1:]):
        q_rest, v_rest = np.sqrt(q_mass[hi]), np.sqrt(v_mass[hi])
        if pairs is None:
            a, b = queries[lo:hi], vectors[lo:hi][:, columns]
            partial += (a**2).sum(0)[:, None] + (b**2).sum(0)[None, :] - 2 * (a.T @ b)
            alive = partial + (q_rest[:, None] - v_rest[columns][None, :]) ** 2 <= bound[:, None] + slack
            if alive.mean() < 0.1 or hi == dim:
                r, c = np.nonzero(alive)
                pairs = [r, columns[c], partial[r, c]]
            else:
                some = alive.any(0)
                if not some.all():
                    columns, partial = columns[some], partial[:, some]
        else:
            r, c, d = pairs
            for k in range(lo, hi):
                d = d + (queries[k, r] - vectors[k, c]) ** 2
            alive = d + (q_rest[r] - v_rest[c]) ** 2 <= bound[r] + slack
            pairs = [r[alive], c[alive], d[alive]]
    r, c, _ = pairs
    keep = ids[c] != own[r]
    r, c = r[keep], c[keep]
    if not len(r):
        return
    d = np.zeros(len(r))
    for lo in range(0, len(r), 100_000):
        part = slice(lo, lo + 100_000)
        d[part] = ((queries[:, r[part]] - vectors[:, c[part]]) ** 2).sum(0)
    best.add(r, d, ids[c])


FOUND = "q string, bounds binary, most double, vec_id array<long>, neighbor_id array<long>, square array<double>"


def _search(k: int, dim: int):
    """Rows (q, turn, ids, matrix, bounds): a block of vectors first (turn 0), then the blocks of queries sent to it, with what bounds their k-th best squares.

    For each block of queries: each query's k-th best square here, in the order of ids, the largest distance among them, and the nearest found.
    """

    def of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, turn = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                matrix = np.frombuffer(batch.column(3)[i].as_py(), np.float64).reshape(dim, -1)
                if turn == 0:
                    ids, vectors = own, matrix
                    centre = vectors.mean(1)
                    radius = np.sqrt(((vectors - centre[:, None]) ** 2).sum(0).max())
                    continue
                raw = batch.column(4)[i].as_py()
                bound = np.frombuffer(raw, np.float64) if raw is not None else np.full(len(own), np.inf)
                away = np.maximum(np.sqrt(((matrix - centre[:, None]) ** 2).sum(0)) - radius, 0) ** 2
                at = np.flatnonzero(away <= bound * (1 + 1e-9) + 1e-9)
                best = Best(len(own), k)
                if len(at):
                    near = Best(len(at), k)
                    _search_block(matrix[:, at], own[at], vectors, ids, near, bound[at])
                    best.distance[at], best.id[at] = near.distance, near.id
                row, rank = np.nonzero(np.isfinite(best.distance))
                last = best.distance[:, -1]
                found = [[own[row]], [best.id[row, rank]], [best.distance[row, rank]]]
                yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([last.tobytes()], pa.binary()), pa.array([float(np.sqrt(last.max()))]), *(pa.array(x) for x in found)], names=["q", "bounds", "most", "vec_id", "neighbor_id", "square"])

    return of


def _arranged(own: DataFrame, dim: int, order: list[int], rows: int) -> DataFrame:
    """Blocks of at most about ``rows`` vectors around each pivot, numbered; a pivot with more vectors has several."""
    counts = own.groupBy("pivot").count().collect()  # one row for each of at most PIVOTS pivots
    parts = {r["pivot"]: -(-r["count"] // rows) for r in counts}
    number = F.create_map(*[F.lit(x) for kv in sorted(parts.items()) for x in kv])
    placed = own.withColumn("part", F.pmod(F.xxhash64("vec_id"), number[F.col("pivot")]).cast("int"))
    placed = placed.repartition("pivot", "part").sortWithinPartitions("pivot", "part")
    return cut(placed.mapInArrow(_blocks(dim, order), "pivot int, part int, ids binary, matrix binary, centre array<double>, radius double").withColumn("block", F.concat_ws("-", "pivot", "part")))


def _of_one_length(own: DataFrame, dim: int, k: int, is_query: Column, block_rows: int, query_rows: int) -> DataFrame:
    """(vec_id, neighbor_id, square): for each query its k nearest vectors, and some others."""
    found = {r["pos"]: r["v"] for r in own.select(F.posexplode("embedding")).groupBy("pos").agg(F.var_pop("col").alias("v")).collect()}
    order = sorted(range(dim), key=lambda i: (-found[i], i))
    pivots = np.array([r["embedding"] for r in own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()])
    own = cut(own.mapInArrow(_nearest(pivots), "vec_id long, embedding array<double>, pivot int"))
    blocks = _arranged(own, dim, order, block_rows)
    asked = _arranged(own.where(is_query), dim, order, query_rows).withColumnRenamed("block", "q")

    def met(sent: DataFrame) -> DataFrame:
        """What blocks of queries (block, q, ids, matrix, bounds) find in the blocks of vectors that they are sent to."""
        resident = blocks.join(sent.select("block").distinct(), "block", "left_semi")
        rows = resident.select("block", F.lit("").alias("q"), F.lit(0).alias("turn"), "ids", "matrix", F.lit(None).cast("binary").alias("bounds"))
        rows = rows.unionByName(sent.select("block", "q", F.lit(1).alias("turn"), "ids", "matrix", "bounds"))
        rows = rows.repartition("block").sortWithinPartitions("block", "turn", "q")
        return rows.select("q", "turn", "ids", "matrix", "bounds").mapInArrow(_search(k, dim), FOUND)

    home = blocks.where("part = 0").select("pivot", "block")
    first = cut(met(asked.join(home, "pivot").select("block", "q", "ids", "matrix", F.lit(None).cast("binary").alias("bounds"))))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "there", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y)) - F.col("radius") - F.col("reach")
    asking = asked.join(home.withColumnRenamed("block", "home"), "pivot").join(first.select("q", "most"), "q").select("q", "home", "most", "centre", "radius")
    pairs = asking.crossJoin(blocks.select("block", F.col("centre").alias("there"), F.col("radius").alias("reach")))
    pairs = pairs.where((F.col("block") != F.col("home")) & (apart <= F.col("most") * (1 + 1e-9) + 1e-9)).select("block", "q")
    second = met(pairs.join(asked.select("q", "ids", "matrix"), "q").join(first.select("q", "bounds"), "q"))
    each = first.select("vec_id", "neighbor_id", "square").unionByName(second.select("vec_id", "neighbor_id", "square"))
    return each.select(F.explode(F.arrays_zip("vec_id", "neighbor_id", "square")).alias("x")).select("x.*")


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for each vector whose vec_id is divisible by ``every`` the k nearest others of all, by Euclidean distance, ties by id.

    Vectors with a null id, null or empty ones, and those with a null, NaN or infinite component take no part; vectors of different lengths
    aren't compared. Of rows with one vec_id the least vector counts, so repeated rows count once. With fewer than k
    others there are fewer rows. Further columns are ignored; an empty table, or one without queries, gives an empty result.
    """
    base = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = base.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    clean = cut(clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    near = vectors.sparkSession.createDataFrame([], "vec_id long, neighbor_id long, square double")
    for r in clean.groupBy(F.size("embedding").alias("dim")).agg(F.count_if(is_query).alias("asked")).where("asked > 0").orderBy("dim").collect():  # one round for each length
        near = near.unionByName(_of_one_length(clean.where(F.size("embedding") == r["dim"]), r["dim"], k, is_query, block_rows, query_rows))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("square", "neighbor_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", F.sqrt("square").alias("distance"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("distance", F.round("distance", 6))


OP4_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= {K}
"""
