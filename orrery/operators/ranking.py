"""Scoring, thresholds and deterministic top-k, for one query or many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import dot, dot_f32, finite, literal
from orrery.operators.reconcile import chunks
from orrery.sources.shared import kept

QUERY_BLOCK = 256


def at_least(score: Column, threshold: float, f32: bool = False) -> Column:
    """Inclusive threshold: only what is below goes, so NaN stays."""
    return ~(score < (F.lit(threshold).cast("float") if f32 else F.lit(float(threshold))))


def search(images: DataFrame, query, top: int, threshold: float, key: str = "vec_id", exclude: Column | None = None, tie: Column | None = None, f32: bool = False) -> DataFrame:
    """The ``top`` best rows of ``images`` (key, embedding) for one query vector: key, score, rank.

    The query is a literal, so the plan is one scan with a bounded heap for each task (TakeOrderedAndProject). exclude
    names the query's own row, which goes before the limit; ties go by ``tie``, else by key.
    """
    if top == 0:
        return images.select(key, F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("rank")).limit(0)
    rows = images if exclude is None else images.where(~exclude)
    scored = rows.select(key, (dot_f32 if f32 else dot)(F.col("embedding"), literal(query)).alias("score"))
    order = [F.desc("score"), (F.col(key) if tie is None else tie)]
    best = scored.where(at_least(F.col("score"), threshold, f32)).orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _in_order(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, summed in order of dimensions."""
    return np.add.accumulate(x * q, axis=1)[:, -1] if len(x) else np.zeros(0)


def _best(ids: np.ndarray, q: np.ndarray, keys: np.ndarray, x: np.ndarray, top: int, threshold: float, own: bool = False):
    """query id, key and score of each query's best; own: its own key may be among them. A matrix product finds what may be among them; those are scored
    again in order of dimensions, so that scores are equal on every run, whatever rows share a block."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    slack = 1e-12 * x.shape[1] * max(1.0, float(np.abs(x).max(initial=0.0)))
    for b in range(0, len(ids), QUERY_BLOCK):
        near = q[b : b + QUERY_BLOCK] @ x.T
        for j, row in enumerate(near, b):
            if not own:
                row[keys == ids[j]] = -np.inf
            wide = slack * max(1.0, float(np.abs(q[j]).sum()))
            least = max(np.partition(row, len(row) - top)[len(row) - top] if top < len(row) else -np.inf, threshold) - wide
            at = np.flatnonzero((row >= least) & (own | (keys != ids[j])))
            score = _in_order(x[at], q[j])
            at, score = at[score >= threshold], score[score >= threshold]
            order = np.lexsort((keys[at], -score))[:top]
            out.append((np.full(len(order), ids[j]), keys[at[order]], score[order]))
    return [np.concatenate(c) for c in zip(*out)]


def batch_search(images: DataFrame, queries: DataFrame, top: int, threshold: float = -1.0, key: str = "vec_id", block_bytes: int = 32 << 20, own: bool = False) -> DataFrame:
    """query_id, key, score (double) and rank of the best ``top`` rows for every query (query_id, embedding); a row whose
    key equals the query_id is left out (not if ``own``). Vectors that are null, empty, or hold null or non-finite numbers take no part, and
    a query meets vectors of its own length alone.

    Queries and vectors are dealt by hash into blocks of about ``block_bytes``, and each two blocks meet in one task, which
    returns ``top`` rows a query. Nothing but counts reaches the driver; a block's vectors travel once for each block of
    queries.
    """
    def numbers(rows: DataFrame, name: str, to: str) -> DataFrame:
        own = rows.select(F.col(name).cast("long").alias(to), F.col("embedding").cast("array<double>").alias("embedding"))
        return own.where(F.col(to).isNotNull() & F.coalesce(finite(F.col("embedding")) & (F.size("embedding") > 0), F.lit(False))).withColumn("_n", F.size("embedding"))

    asked, rows = numbers(queries, "query_id", "query_id"), numbers(images, key, "key")
    blocks = lambda df: max(1, -(-(df.agg(F.sum(F.col("_n").cast("long") * 8)).first()[0] or 0) // block_bytes))
    groups, parts = blocks(asked), blocks(rows)
    deal = lambda name, m: F.pmod(F.xxhash64(name, F.lit("block")), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("_q", deal("query_id", groups)).withColumn("_d", every(parts))
    right = rows.withColumn("_d", deal("key", parts)).withColumn("_q", every(groups))

    def matrix(table: pa.Table) -> np.ndarray:
        return pc.list_flatten(table["embedding"]).to_numpy().reshape(len(table), -1)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(a) and len(b) and top > 0:
            found = _best(a["query_id"].to_numpy(), matrix(a), b["key"].to_numpy(), matrix(b), top, threshold, own)
        return pa.table(dict(zip(("query_id", "key", "score"), found)))

    cells = ["_q", "_d", "_n"]
    best = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(meet, "query_id long, key long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("key").alias(key), "score", "rank")


def full_ranking(scored: DataFrame, key: str = "vec_id", query: str | None = None) -> DataFrame:
    """Rank of every row of one query's scores, or of each query's, by (-score, key). Places come from range partitions
    and their counts, so that no task sees all rows of a query."""
    order = [F.desc("score"), F.col(key)]
    if query is None:
        return chunks(scored, order, 1, "rank").withColumn("rank", F.col("rank") + 1)
    placed = kept(chunks(scored, [F.col(query), *order], 1, "rank"))
    first = placed.groupBy(query).agg(F.min("rank").alias("_first"))
    return placed.join(first, query).withColumn("rank", F.col("rank") - F.col("_first") + 1).drop("_first")


def lookup(queries: DataFrame, cache: DataFrame, on: str = "query") -> DataFrame:
    """queries with the cached vector and whether there is one; strings match exactly."""
    own = cache.select(F.col(on).alias("_q"), F.col("embedding"), F.lit(True).alias("_hit"))
    return queries.join(own, F.col(on) == F.col("_q"), "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_q", "_hit")
