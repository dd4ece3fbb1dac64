"""Exact search over vectors laid out in blocks whose bounds tell which need not be read.

Vectors are laid out once: each goes to the nearest of some pivots, a sample of them, and a pivot's vectors to blocks of up to
``block_rows``, one folder of files each. Of a block the pivot c and the largest distance r from it are kept. No vector of it
scores more than q.c + |q| r with a query q, so a block whose bound is below the score of the k-th best so far, or below the
threshold, is skipped: its files are not listed among those to read. Blocks that reach the score are read, so ties are all seen
and the answers are those of a scan, bit for bit.

One query reads its best blocks first and then what their k-th score leaves. Many queries do the same in three steps, each a
batch search: (q, |q|) among the bounds (c, r) gives each one's best blocks; these give it a k-th score s; and where q.c + |q| r reaches s
a block may still hold a better one. That is judged in cells of up to ``QUERIES`` queries and some CELL vectors, whose task
returns ``top`` rows a query, so no pair of query and block travels; blocks that no query of a cell needs aren't read for it, and
where more than a share DENSE of its pairs are needed it is met whole. Nothing of the size of the data reaches the driver: one number
a block does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import dot, finite, literal
from orrery.operators.ranking import _best, batch_search, search
from orrery.sources.shared import kept, new_folder

BLOCK_ROWS, PIVOTS, QUERIES, FIRST, DENSE, CELL = 1 << 16, 4096, 8192, 2, 0.5, 1 << 14
SLACK = 1e-9  # relative, for sums of doubles in another order


@dataclass
class Report:
    """What a search read, of what there is: blocks for one query, pairs of query and block for many."""

    read: int
    total: int

    @property
    def share(self) -> float:
        return self.read / self.total if self.total else 0.0


def _numbers(rows: DataFrame, key: str) -> DataFrame:
    own = rows.select(F.col(key).cast("long").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.where(F.col("key").isNotNull() & F.coalesce(finite(F.col("embedding")) & (F.size("embedding") > 0), F.lit(False))).withColumn("_n", F.size("embedding"))


def _matrix(column) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Layout:
    """Vectors in blocks, below ``path``: vectors/block=... with key and embedding (doubles), and bounds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.vectors = spark.read.schema("key long, embedding array<double>, block int").parquet(f"{path}/vectors")
        self.bounds = spark.read.parquet(f"{path}/bounds")

    @classmethod
    def write(cls, vectors: DataFrame, key: str, path: str | None = None, block_rows: int = BLOCK_ROWS, pivots: int | None = None) -> Layout:
        """Lay out ``vectors`` (key, embedding). Null, empty and non-finite ones take no part; lengths may differ, each has pivots
        of its own. pivots: how many; one for each half a block by default, PIVOTS at most."""
        spark, path = vectors.sparkSession, path or new_folder(vectors.sparkSession, "layout")
        rows = _numbers(vectors, key)
        lengths = {r["_n"]: r["count"] for r in rows.groupBy("_n").count().collect()}  # different lengths are a few
        total = sum(lengths.values())
        wanted = min(pivots or max(8, 2 * total // block_rows), PIVOTS)
        chosen = {}
        for n, count in lengths.items():
            own = rows.where(F.col("_n") == n).orderBy(F.xxhash64("key"), "key").limit(max(1, wanted * count // total)).select("embedding").collect()
            chosen[n] = np.unique(np.array([r.embedding for r in own]), axis=0)
        base, at = {}, 0
        for n in sorted(chosen):
            base[n], at = at, at + len(chosen[n])

        def near(batches):
            for batch in batches:
                size = batch["_n"].to_numpy()
                pivot, far = np.zeros(len(size), np.int32), np.zeros(len(size))
                for n in np.unique(size).tolist():
                    which = np.flatnonzero(size == n)
                    x, c = _matrix(batch["embedding"].take(pa.array(which))), chosen[n]
                    best = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
                    pivot[which], far[which] = best + base[n], np.sqrt(((x - c[best]) ** 2).sum(1))
                yield pa.record_batch([batch["key"], batch["embedding"], pa.array(pivot), pa.array(far)], ["key", "embedding", "pivot", "far"])

        placed = rows.mapInArrow(near, "key long, embedding array<double>, pivot int, far double")
        counts = sorted((r["pivot"], r["count"]) for r in placed.groupBy("pivot").count().collect())
        first, blocks, at = [], [], 0
        for pivot, count in counts:  # a pivot with many vectors has several blocks
            parts = -(-count // block_rows)
            first.append((pivot, at, parts))
            centre = next(chosen[n][pivot - base[n]] for n in base if base[n] <= pivot < base[n] + len(chosen[n]))
            blocks += [(at + k, [float(v) for v in centre]) for k in range(parts)]
            at += parts
        where = F.broadcast(spark.createDataFrame(first, "pivot int, _first int, _parts int"))  # PIVOTS rows at most
        block = F.col("_first") + F.pmod(F.xxhash64("key", F.lit("block")), F.col("_parts")).cast("int")
        dealt = placed.join(where, "pivot").withColumn("block", block)
        dealt.repartition(max(1, min(at, 4096)), "block").select("key", "embedding", "far", "block").write.partitionBy("block").parquet(f"{path}/vectors")
        told = spark.read.parquet(f"{path}/vectors").groupBy("block").agg(F.max("far").alias("radius"), F.count("*").alias("rows"))  # reads one number a row
        told.join(spark.createDataFrame(blocks, "block int, centre array<double>"), "block").withColumn("_n", F.size("centre")).coalesce(1).write.parquet(f"{path}/bounds")
        return cls(spark, path)

    def search(self, query, top: int, threshold: float, key: str = "vec_id", exclude: int | None = None) -> tuple[DataFrame, Report]:
        """ranking.search over the layout: key, score and rank, and what was read."""
        own = [float(x) for x in query]
        rows = self.vectors if exclude is None else self.vectors.where(F.col("key") != exclude)
        rows = rows.select(F.col("key").alias(key), "embedding", "block")
        length = float(np.linalg.norm(own))
        bound = dot(F.col("centre"), literal(own)) + F.col("radius") * length
        known = self.bounds.where(F.col("_n") == len(own)).select("block", "rows", (bound + SLACK * (1 + F.abs(bound))).alias("bound"))
        known = sorted(((r["bound"], r["block"], r["rows"]) for r in known.collect() if r["bound"] >= threshold), reverse=True)  # 20 bytes a block
        total = self.bounds.count()
        first, held = [], 0
        for _, block, n in known:
            if len(first) >= FIRST and held > top:
                break
            first.append(block)
            held += n
        if top == 0 or not first:
            return search(rows.where(F.col("block").isin(first)), own, 0, threshold, key), Report(0, total)
        best = search(rows.where(F.col("block").isin(first)), own, top, threshold, key).agg(F.min("score"), F.count("*")).first()
        least = best[0] if best[1] == top else threshold
        blocks = sorted({*first, *(b for bound, b, _ in known if bound >= least)})
        return search(rows.where(F.col("block").isin(blocks)), own, top, threshold, key), Report(len(blocks), total)

    def _meet(self, pairs: DataFrame, asked: DataFrame, top: int, threshold: float) -> DataFrame:
        """query_id, key and score of the best of each query in each block of pairs (query_id, block)."""
        parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_parts"))
        left = pairs.join(asked, "query_id").join(parts, "block").withColumn("_g", F.pmod(F.xxhash64("query_id", F.lit("deal")), F.col("_parts")).cast("int"))
        right = self.vectors.join(parts, "block").withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            if len(a) and len(b):
                found = _best(a["query_id"].to_numpy(), _matrix(a["embedding"]), b["key"].to_numpy(), _matrix(b["embedding"]), top, threshold)
            return pa.table(dict(zip(("query_id", "key", "score"), found)))

        cells = ["block", "_g"]
        met = left.select("query_id", "embedding", *cells).groupBy(*cells).cogroup(right.select("key", "embedding", *cells).groupBy(*cells))
        return met.applyInArrow(run, "query_id long, key long, score double")

    def batch_search(self, queries: DataFrame, top: int, threshold: float = -1.0, key: str = "vec_id") -> tuple[DataFrame, Report]:
        """ranking.batch_search over the layout: query_id, key, score and rank; and what was read. queries: query_id (a key),
        embedding."""
        spark = self.spark
        asked = kept(_numbers(queries, "query_id").select(F.col("key").alias("query_id"), "embedding"))
        n_blocks, n_asked = self.bounds.count(), asked.count()
        if not n_blocks or not n_asked or top == 0:
            return spark.createDataFrame([], f"query_id long, {key} long, score double, rank long"), Report(0, n_blocks * n_asked)
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        of = lambda *more: F.concat("centre", F.array("radius", *more))
        ids = F.col("block").cast("long").alias("_block")
        first = batch_search(self.bounds.select(ids, of().alias("embedding")), asked.select("query_id", F.concat("embedding", F.array(length)).alias("embedding")), FIRST, float("-inf"), "_block", own=True)
        pairs = kept(first.select("query_id", F.col("_block").cast("int").alias("block")))
        found = kept(self._meet(pairs, asked, top, threshold))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        least = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == top).select("query_id", F.col("score").alias("_s"))
        need = asked.withColumn("_len", length).join(least, "query_id", "left").withColumn("_s", F.greatest(F.coalesce("_s", F.lit(threshold)), F.lit(-1e300)))
        need = need.withColumn("_s", F.col("_s") - SLACK * (1.0 + F.abs("_s") + F.col("_len")))
        need = need.join(pairs.groupBy("query_id").agg(F.collect_list("block").alias("_seen")), "query_id", "left")
        ranked, read = self._rest(need, top, threshold, n_asked)
        ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        return ranked.select("query_id", F.col("key").alias(key), "score", "rank"), Report(read, n_blocks * n_asked)

    def _rest(self, need: DataFrame, top: int, threshold: float, n_asked: int) -> tuple[DataFrame, int]:
        """query_id, key and score of the best of each query in each cell, and how many pairs of query and block were met. need:
        query_id, embedding, _len (its length), _s (what a block's bound must reach) and _seen (blocks that gave it _s)."""
        count, most = self.bounds.agg(F.sum("rows"), F.max("block")).first()
        per = max(1, CELL * (most + 1) // max(1, count))  # blocks of a cell
        tasks = 2 * self.spark.sparkContext.defaultParallelism * per // (most + 1)  # groups that keep as many tasks busy
        groups, cells = max(-(-n_asked // QUERIES), min(-(-n_asked // 256), tasks)), ["_g", "_d", "_n"]
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = need.withColumn("_n", F.size("embedding")).withColumn("_g", F.pmod(F.xxhash64("query_id", F.lit("deal")), F.lit(groups)).cast("int")).withColumn("_d", every(most // per + 1))
        left = left.select("query_id", "embedding", "_len", "_s", F.coalesce("_seen", F.array().cast("array<int>")).alias("_seen"), *cells)
        centres = self.bounds.select(F.lit(None).cast("long").alias("key"), F.col("centre").alias("embedding"), "block", "radius", "_n").withColumn("_d", F.floor(F.col("block") / per).cast("int"))

        def wanted(a: pa.Table, c: pa.Table):
            """Blocks in order, and which of them each query of a needs."""
            c = c.sort_by("block")
            block, q = c["block"].to_numpy(), _matrix(a["embedding"])
            mask = q @ _matrix(c["embedding"]).T + a["_len"].to_numpy()[:, None] * c["radius"].to_numpy() >= a["_s"].to_numpy()[:, None]
            return block, q, mask

        def ask(a: pa.Table, c: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int32)] * 2 + [np.zeros(0, np.int64)]
            if len(a) and len(c):
                block, _, mask = wanted(a, c)
                if mask.mean() > DENSE:
                    mask[:] = True
                own, pairs = np.flatnonzero(mask.any(0)), mask.copy()
                seen = a["_seen"].combine_chunks()
                who, what = pc.list_parent_indices(seen).to_numpy(), pc.list_flatten(seen).to_numpy()
                at = np.minimum(np.searchsorted(block, what), len(block) - 1)
                pairs[who[block[at] == what], at[block[at] == what]] = True
                out = [np.full(len(own), a["_g"][0].as_py(), np.int32), block[own].astype(np.int32), np.full(len(own), 0)]
                out = [np.append(out[0], np.int32(-1)), np.append(out[1], np.int32(-1)), np.append(out[2], int(pairs.sum()))]
            return pa.table(dict(zip(("_g", "block", "pairs"), out)))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            own = pc.is_valid(b["key"])
            x, c = b.filter(own), b.filter(pc.invert(own))
            if len(a) and len(x):
                block, q, mask = wanted(a, c)
                ids, keys, vectors, at = a["query_id"].to_numpy(), x["key"].to_numpy(), _matrix(x["embedding"]), x["block"].to_numpy()
                if mask.mean() > DENSE:  # next to all is needed: all at once
                    found.append(_best(ids, q, keys, vectors, top, threshold))
                else:
                    for k in np.flatnonzero(mask.any(0)).tolist():
                        who, rows = np.flatnonzero(mask[:, k]), np.flatnonzero(at == block[k])
                        found.append(_best(ids[who], q[who], keys[rows], vectors[rows], top, threshold))
            ids, keys, score = (np.concatenate(f) for f in zip(*found))
            order = np.lexsort((keys, -score, ids))
            first = np.searchsorted(ids[order], ids[order], "left")
            order = order[np.arange(len(order)) - first < top]
            return pa.table({"query_id": ids[order], "key": keys[order], "score": score[order]})

        dealt = centres.withColumn("_g", every(groups))
        asking = kept(left.groupBy(*cells).cogroup(dealt.select("key", "embedding", "block", "radius", *cells).groupBy(*cells)).applyInArrow(ask, "_g int, block int, pairs long"))
        some = asking.where("block >= 0").select("_g", "block")
        vectors = self.vectors.withColumn("radius", F.lit(None).cast("double")).withColumn("_n", F.size("embedding")).withColumn("_d", F.floor(F.col("block") / per).cast("int"))
        names = ["key", "embedding", "block", "radius", "_n", "_d"]
        right = vectors.join(some, "block").select(*names, "_g").unionByName(dealt.select(*names, "_g"))
        best = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(meet, "query_id long, key long, score double")
        return best, asking.where("block < 0").agg(F.sum("pairs")).first()[0] or 0
