"""Approximate nearest neighbours by collision-counting hashing (operator 13).

A hash function is one random projection. For each, a shard of vectors keeps its projected values as a sorted array; a
query's window of half width R * w / 2 around its own projection is a range of that array, so no buckets are fixed in
advance. Virtual rehashing grows R step by step: each step adds only the rows that enter the windows to the collision
counts. A vector that collides with the query in at least `threshold` of the projections is verified, that is, its
distance is computed on the original vectors. A query ends in a shard when R reaches its k-th smallest verified distance
(there a neighbour at that distance falls into a window with probability 2 * Phi(w / 2) - 1, 0.68, for each projection),
or when every row has been counted in every projection. There is no cap on candidates.

The table is dealt into shards of about `shard_rows` vectors and the queries into blocks of about `block_rows`; each cell
(shard, block) is one unit of work of bounded memory, whatever the table holds, and gives at most k rows a query. A
window function with a pushed-down limit merges the cells. Nothing passes through the driver but two counts.

Defined results: vectors that are null, empty or zero, or that hold a null or non-finite component, take no part, neither
as query nor as candidate; vectors shorter than others count as filled with zeros; a null id takes no part as it names
nothing; rows are told apart by their id: a query id gives one query (of several rows with it, that with the smallest
vector) and its own rows are no candidates; repeated candidate rows are found as often as they occur; a query without a
candidate has no row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import table

K = 10
#: Projections, the collisions of them that make a candidate, window width at R = 1, growth of R in a step.
PROJECTIONS = 96
THRESHOLD = 54
WIDTH = 2.0
GROWTH = 1.3
#: A query starts at this part of the R at which the query before it ended; the first one starts at a few rows a window.
START = 0.75
SEED = 42
SHARD_ROWS = 8192
BLOCK_ROWS = 8192
#: Queries come from rows whose id is divisible by this.
EVERY = 100


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed component by component, so equal vectors have equal distances."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += (rows[:, j] - query[j]) ** 2
    return np.sqrt(total)


class Shard:
    """Vectors with one sorted array for each projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, threshold: int, width: float = WIDTH, growth: float = GROWTH) -> None:
        self.ids, self.vectors, self.axes = ids, vectors, axes
        self.threshold, self.half, self.growth = threshold, width / 2, growth
        projected = vectors @ axes.T
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        self.last = 0.0

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, row numbers) of the k nearest verified rows, ties to the smaller id; rows of the query's own id are passed over."""
        n, m = len(self.ids), len(self.axes)
        centre = self.axes @ query
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, centre)])
        high = low.copy()
        counts = np.zeros(n, np.int16)
        done = self.ids == query_id
        best_d, best_r = np.zeros(0), np.zeros(0, np.int64)
        # neighbouring queries end at like radii; a start that is too wide verifies more rows and loses none
        radius = self.last * START or self._first_radius(centre, low, k)
        while True:
            whole = not np.isfinite(radius)
            for j in range(m):
                line, order = self.sorted[j], self.order[j]
                lo = 0 if whole else min(int(line.searchsorted(centre[j] - radius * self.half, "left")), int(low[j]))
                hi = n if whole else max(int(line.searchsorted(centre[j] + radius * self.half, "right")), int(high[j]))
                counts[order[lo : low[j]]] += 1
                counts[order[high[j] : hi]] += 1
                low[j], high[j] = lo, hi
            new = np.flatnonzero((counts >= self.threshold) & ~done)
            if len(new):
                done[new] = True
                best_d = np.concatenate((best_d, distances(self.vectors[new], query)))
                best_r = np.concatenate((best_r, new))
                rank = np.lexsort((self.ids[best_r], best_d))[:k]
                best_d, best_r = best_d[rank], best_r[rank]
            enough = len(best_d) == k
            if (enough and best_d[-1] <= radius) or (not low.any() and (high == n).all()):
                self.last = radius
                return best_d, best_r
            grown = radius * self.growth
            radius = min(grown, best_d[-1]) if enough else grown

    def _first_radius(self, centre: np.ndarray, at: np.ndarray, k: int) -> float:
        """The R whose windows hold about k rows on a median projection; where that is nothing (copies), more rows."""
        n, rows = len(self.ids), k
        while True:
            gaps = np.array([max(x - s[max(0, i - rows)], s[min(n - 1, i + rows)] - x) for s, x, i in zip(self.sorted, centre, at)])
            gap = float(np.median(gaps))
            if gap > 0:
                return gap / self.half
            if rows >= n:
                # more than half of the projections have no spread at all: any window that reaches the rest will do
                return (float(gaps.max()) or 1.0) / self.half
            rows *= 4


def _cells(dim: int, k: int, projections: int, threshold: int, seed: int):
    """Streams rows sorted by cell, the queries of a cell before its vectors."""
    axes = np.random.default_rng(seed).standard_normal((projections, dim))

    def answers(part: pa.Table) -> pa.RecordBatch:
        ids = part.column("id").to_numpy()
        kind = part.column("kind").to_numpy()
        lists = part.column("v").combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), lengths)
        vectors = np.zeros((len(ids), dim))
        vectors[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
        split = int(np.searchsorted(kind, 1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if 0 < split < len(ids):
            shard = Shard(ids[split:], vectors[split:], axes, threshold)
            for q in range(split):
                d, r = shard.search(ids[q], vectors[q], k)
                found.append((np.full(len(d), ids[q]), shard.ids[r], d))
        cols = [np.concatenate(x) if found else np.zeros(0) for x in (zip(*found) if found else ((), (), ()))]
        return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(float))], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:]):
                if cell is not None and cells[s] != cell:
                    yield answers(pa.Table.from_batches(held))
                    held = []
                cell = cells[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield answers(pa.Table.from_batches(held))

    return run


def nearest_neighbours(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K,
    projections: int = PROJECTIONS, threshold: int = THRESHOLD, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0.0))
    # a repeated id must not make one shard large, so the row's place in the table takes part in the deal
    rows = rows.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id()))
    is_query = F.pmod("id", F.lit(every)) == 0
    size = rows.agg(F.count(F.lit(1)), F.sum(is_query.cast("int")), F.max(F.size("v"))).first()
    total, asked, dim = size[0], size[1] or 0, size[2] or 1
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // block_rows))
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    # every query meets every shard once: the blocks bound what a cell holds
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.lit(0).alias("kind"), "id", "v")
    vectors = rows.select(F.pmod("deal", F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    cell = (F.col("shard") * blocks + F.col("block")).cast("long").alias("cell")
    both = queries.select(cell, "kind", "id", "v").unionByName(vectors.select(cell, "kind", "id", "v"))
    dealt = both.repartition(min(shards * blocks, 20_000), "cell").sortWithinPartitions("cell", "kind", "id")
    found = dealt.mapInArrow(_cells(dim, k, projections, threshold, seed), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_collision_counting": op13_collision_counting}
ORACLES: dict[str, str] = {}
