"""Approximate nearest neighbours by collision-counting hashing, for the largest inner product.

Vectors are extended by one number, so that all have the length of the longest, and the largest inner product becomes
the least distance. As one long vector would make all others alike, this is done for bands of vectors of like length: in
a band the longest is at most BAND times the shortest. Each band of a block is indexed by PROJECTIONS arrays, one for each
random direction, which hold its projections in order. A query's window in each array is centred on the query's own
projection and widened (virtual rehashing: no array is built again); a vector collides with the query in an array if the
window holds it. Vectors that collide in LEVEL of the arrays are candidates, and the window is the narrowest of the widths
FIRST * GROWTH ** i that gives as many of them as it takes; it is found by bisection, from the width of the query before. How many it
takes is measured for each band, as it depends on dimensions and structure: SAMPLE of the queries are answered exactly, and
TARGET of their answers are within so many vectors by the width at which each collides (four times the answers asked
for at least; all, where there is next to no contrast). Candidates are verified by their inner products in double precision. Bands are taken from
the longest vectors on, and one whose length times the query's cannot reach the worst answer so far is left out, which
loses nothing. The blocks' best are merged.

Equal vectors of a block are indexed once, and candidates are counted in distinct vectors, so copies use up
nothing of what a query may look at; each copy of a verified vector is a candidate answer. Every vector is indexed. Queries
and vectors meet in blocks, (query block, vector block) by (query block, vector block), so no task holds more than one of
each. A query block holds up to QUERIES queries, so up to 20 times as many rows a vector travels once or a few times; beyond
that, queries times vectors is the work, as for any search of all rows.

Cases: vectors that are null, empty, zero, or hold null or non-finite numbers take no part; neither do those of another
length than the most frequent (the shorter, if tied); equal scores are ordered by vec_id; rows that repeat a vec_id are
candidates each; a query's own vec_id is never its answer; no queries or no candidates give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, MORE, LEVEL = 64, 128, 0.75  # MORE: from 65 dimensions on
SAMPLE, TARGET = 16, 0.97
FIRST, GROWTH, WIDEST = 0.4, 1.1, 48
BAND = 1.25
BLOCK, QUERIES = 1 << 13, 1 << 13
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = whole.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0.0))
    lengths = whole.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return whole.where(F.size("embedding") == (lengths[0].n if lengths else 0))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of x, the places of x in order of them, and where each one's places begin (one more)."""
    x = np.ascontiguousarray(x + 0.0)  # -0.0 is 0.0
    _, first, which = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    return x[first], np.argsort(which, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(which))])


class Band:
    """Arrays of the projections of some distinct vectors of like length."""

    def __init__(self, places: np.ndarray, x: np.ndarray, norm: np.ndarray, k: int, sample: np.ndarray):
        self.places, self.x, self.longest = places, x, float(norm.max())
        arrays = PROJECTIONS if x.shape[1] <= PROJECTIONS else MORE
        rest = np.sqrt(np.maximum(self.longest**2 - norm * norm, 0.0))
        self.ways = np.random.default_rng(5).normal(0, 1, (x.shape[1] + 1, arrays))
        spots = (x @ self.ways[:-1] + rest[:, None] * self.ways[-1]) / self.longest
        order = np.argsort(spots, axis=0, kind="stable")
        self.spots = np.ascontiguousarray(np.take_along_axis(spots, order, 0).T)
        self.rank = np.empty((arrays, len(x)), np.uint16 if len(x) < (1 << 16) - 1 else np.uint32)  # the place of each vector in each array
        for i in range(arrays):
            self.rank[i, order[:, i]] = np.arange(len(x))
        self.level = int(np.ceil(LEVEL * arrays))
        self.guess = WIDEST // 2
        self.enough = self.measured(sample, spots, k)

    def measured(self, sample: np.ndarray, spots: np.ndarray, k: int) -> int:
        """How many candidates hold TARGET of the exact answers to a sample of queries. spots: projections, a row a vector."""
        need = [np.zeros(0, np.int64)]
        for query in sample if len(self.x) > 4 * k else ():
            score = self.x @ query
            best = np.argpartition(-score, k)[:k]
            width = np.partition(np.abs(spots - (query / np.linalg.norm(query)) @ self.ways[:-1]), self.level - 1, axis=1)[:, self.level - 1]
            need.append(np.searchsorted(np.sort(width), width[best], "right"))
        need = np.concatenate(need)
        return min(len(self.x), max(4 * k, int(np.quantile(need, TARGET)) if len(need) else 0))

    def colliding(self, own: np.ndarray, step: int) -> np.ndarray:
        """Vectors that the windows of a width hold in LEVEL of the arrays. own: the query's projections."""
        width = FIRST * GROWTH**step if step < WIDEST else np.inf
        ends = np.stack([own - width, own + width], 1)
        low, high = np.array([a.searchsorted(v) for a, v in zip(self.spots, ends)]).T
        kind = self.rank.dtype.type
        low, size = low.astype(kind)[:, None], (high - low).astype(kind)[:, None]
        return np.flatnonzero((self.rank - low < size).sum(0, dtype=np.uint8) >= self.level)  # below low wraps around

    def candidates(self, query: np.ndarray) -> np.ndarray:
        """Places in x of the query's candidates."""
        if self.enough >= len(self.x):
            return np.arange(len(self.x))
        own = (query / np.linalg.norm(query)) @ self.ways[:-1]
        low, high, found = -1, WIDEST, {}
        step = self.guess
        while high - low > 1:  # too few at low, enough at high
            found[step] = self.colliding(own, step)
            if len(found[step]) >= self.enough:
                high = step
                step = max(low + 1, high - 1) if high == self.guess else (low + high) // 2
            else:
                low = step
                step = min(high - 1, low + 1) if low == self.guess else (low + high) // 2
        self.guess = min(high, WIDEST - 1)
        return found[high] if high in found else self.colliding(own, high)


def bands(x: np.ndarray, k: int, sample: np.ndarray) -> list[Band]:
    """Distinct vectors by length, longest first. x: no zero vectors; sample: some queries."""
    norm = np.sqrt((x * x).sum(1))
    order = np.argsort(-norm, kind="stable")
    out, a = [], 0
    while a < len(order):
        b = a + int(np.searchsorted(-norm[order[a:]], -norm[order[a]] / BAND, "right"))
        b = len(order) if len(order) - b < 4 * k else max(b, min(len(order), a + 4 * k))  # small bands are looked at whole
        out.append(Band(order[a:b], x[order[a:b]], norm[order[a:b]], k, sample))
        a = b
    return out


def search_block(query: np.ndarray, index: list[Band], size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct vectors (places) that may be the query's best k, their scores, and how many were verified; size: copies of
    each. A row of the query's own is among the k."""
    length, floor, held, verified = float(np.linalg.norm(query)), -np.inf, [(np.zeros(0, np.int64), np.zeros(0))], 0
    for band in index:
        if length * band.longest * (1 + 1e-12) < floor:
            break
        ones = band.candidates(query)
        verified += len(ones)
        held.append((band.places[ones], np.einsum("ij,j->i", band.x[ones], query)))
        place, score = (np.concatenate(c) for c in zip(*held))
        top = np.argsort(-score, kind="stable")
        last = int(np.searchsorted(np.cumsum(size[place[top]]), k))
        if last < len(top):  # those that hold k rows, and all that tie
            floor = score[top[last]]
            held = [(place[score >= floor], score[score >= floor])]
    return *(np.concatenate(c) for c in zip(*held)), verified


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best found for each row that is_query (over vec_id) picks."""
    rows = usable(vectors)
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, cores = max(1, -(-n // block)), vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-asked // queries), min(-(-asked // 256), -(-2 * cores // blocks)))  # small tables make use of the cores too
    deal = lambda m: F.pmod(F.xxhash64("vec_id", F.lit(m)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = rows.withColumn("_d", deal(blocks)).withColumn("_q", every(groups))
    asks = rows.where(is_query).withColumn("_q", deal(groups)).withColumn("_d", every(blocks))

    def matrix(table: pa.Table) -> np.ndarray:
        column = table["embedding"].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy().reshape(len(table), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            q, x = matrix(left), matrix(right)
            q_ids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            x, order, at = distinct(x)
            size, index = np.diff(at), bands(x, k, q[:: max(1, len(q) // SAMPLE)][:SAMPLE])
            for j in range(len(q)):
                ones, score, _ = search_block(q[j], index, size, k + np.count_nonzero(ids == q_ids[j]))
                found = np.concatenate([order[:0], *(order[at[i] : at[i + 1]] for i in ones.tolist())])
                score = np.repeat(score, size[ones])
                mine = ids[found] == q_ids[j]
                found, score = found[~mine], score[~mine]
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), q_ids[j]), ids[found][best], score[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    parts = asks.groupBy("_q", "_d").cogroup(data.groupBy("_q", "_d")).applyInArrow(run, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """20 neighbours of each vector whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def brute_force(ids: np.ndarray, x: np.ndarray, k: int = 20) -> dict[int, list[int]]:
    """Exact neighbours of the same queries; for tests and recall."""
    out = {}
    for j in np.flatnonzero(ids % 20 == 0):
        score = np.einsum("ij,j->i", x, x[j])
        order = np.lexsort((ids, -score))
        out[int(ids[j])] = ids[order[ids[order] != ids[j]]][:k].tolist()
    return out
