"""Retrieval quality over ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4  # fixed value: scores this close are equal


def per_query(hits: DataFrame, n_relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10), depth: int = 10) -> DataFrame:
    """recall_at_k, ndcg_at_depth and mrr_at_depth of each query. hits: query_id, rank, hit (boolean); n_relevant:
    query_id, n. Recall divides by all relevant; the ideal of nDCG stops at depth; gains are binary."""
    inside = F.col("hit") & (F.col("rank") <= depth)
    sums = [F.sum((F.col("hit") & (F.col("rank") <= k)).cast("long")).alias(f"_h{k}") for k in ks]
    got = hits.groupBy("query_id").agg(*sums, F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"), F.min(F.when(inside, F.col("rank"))).alias("_first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(depth)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1)))
    joined = n_relevant.where("n > 0").join(got, "query_id", "left").na.fill(0, [f"_h{k}" for k in ks]).na.fill(0.0, ["_dcg"])
    recalls = [(F.col(f"_h{k}") / F.col("n")).alias(f"recall_at_{k}") for k in ks]
    return joined.select("query_id", *recalls, (F.col("_dcg") / ideal).alias(f"ndcg_at_{depth}"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias(f"mrr_at_{depth}"))


def evaluate(runs: DataFrame, threshold: float) -> DataFrame:
    """One row of metrics over quality runs (id, kind, intent, relevant, results): captions give recall, MRR and nDCG;
    categories give the mean over intents of wrong-accept and no-accept rates."""
    rows = runs.withColumn("_id", F.monotonically_increasing_id())
    captions = rows.where("kind = 'caption'")
    ranked = captions.select(F.col("_id").alias("query_id"), "relevant", F.posexplode("results").alias("_at", "r"))
    hits = ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.array_contains("relevant", F.col("r.path")).alias("hit"))
    per = per_query(hits, captions.select(F.col("_id").alias("query_id"), F.size("relevant").alias("n")))
    means = per.agg(*[F.avg(c).alias(c) for c in per.columns if c != "query_id"])
    accepted = F.filter("results", lambda r: r["score"] >= threshold)
    judged = rows.where("kind = 'category'").select("intent", F.exists(accepted, lambda r: ~F.array_contains("relevant", r["path"])).alias("wrong"), (F.size(accepted) == 0).alias("none"))
    return means.crossJoin(macro_rates(judged))  # one row each


def macro_rates(judged: DataFrame, group: str = "intent") -> DataFrame:
    """Mean over groups of each group's rates; judged: group, wrong, none (booleans)."""
    by = judged.groupBy(group).agg(F.avg(F.col("wrong").cast("double")).alias("w"), F.avg(F.col("none").cast("double")).alias("n"))
    return by.agg(F.avg("w").alias("absent_false_positive_rate"), F.avg("n").alias("present_false_negative_rate"))


def top_lists(ranked: DataFrame, k: int = 10, key: str = "vec_id") -> DataFrame:
    """query_id and the keys of its first k, in order (k a query, so lists are small)."""
    own = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias("t"))
    return own.select("query_id", F.transform("t", lambda x: x[key]).alias("top"))


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("query_id", F.col("top").alias("a")).join(b.select("query_id", F.col("top").alias("b")), "query_id", "full_outer")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of queries whose lists are equal in order; a query on one side only is an error."""
    checked = _paired(a, b).select(F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("the runs hold different queries"))).otherwise((F.col("a") == F.col("b")).cast("double")).alias("same"))
    return checked.agg(F.avg("same").alias("agreement"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Share of k that two lists have in common, over all queries."""
    return _paired(a, b).agg((F.sum(F.size(F.array_intersect("a", "b")).cast("long")) / (F.count("*") * k)).alias("overlap"))


def hit_rates(first_hit: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of queries whose first hit (rank) is within each k."""
    return first_hit.agg(*[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in ks])


def delta_stats(pairs: DataFrame) -> DataFrame:
    """Mean and population deviation of candidate - reference."""
    delta = F.col("candidate") - F.col("reference")
    return pairs.agg(F.avg(delta).alias("mean_delta"), F.stddev_pop(delta).alias("std_delta"))


def vector_comparison(pairs: DataFrame) -> DataFrame:
    """Largest absolute difference and least inner product over pairs of vectors (a, b)."""
    from orrery.functions.vectors import dot

    worst = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return pairs.agg(F.max(worst).alias("max_abs_error"), F.min(dot(F.col("a"), F.col("b"))).alias("min_cosine"))


def target_scores(queries: DataFrame, images: DataFrame, targets: DataFrame, key: str = "vec_id") -> DataFrame:
    """query_id, key and score of each query (query_id, embedding) with its own target (query_id, key) among images."""
    from orrery.functions.vectors import dot

    asked = targets.select("query_id", key).join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    return asked.join(images.select(key, F.col("embedding").alias("_e")), key).select("query_id", key, dot(F.col("_q"), F.col("_e")).alias("score"))


def output_difference(left: DataFrame, right: DataFrame, by: str = "query_id", key: str = "vec_id", tolerance: float = TOLERANCE) -> DataFrame:
    """by and difference of each list of results (by, rank, key, score) on either side: null where both agree, else another
    length, or the first rank at which keys differ, a score isn't finite, or scores are further apart than the tolerance. One row
    a rank is joined, and lists are folded by a minimum, so a list of any length is never gathered."""
    one = lambda df, n: df.select(F.col(by).alias("_q"), F.col("rank").alias("_rank"), F.col(key).alias(f"_k{n}"), F.col("score").cast("double").alias(f"_s{n}"))
    both = one(left, 0).join(one(right, 1), ["_q", "_rank"], "full_outer")
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))  # noqa: E731  NaN is not below
    same = F.col("_k0").eqNullSafe(F.col("_k1")) & finite(F.col("_s0")) & finite(F.col("_s1")) & (F.abs(F.col("_s0") - F.col("_s1")) <= tolerance)
    n = [F.count_if(F.col(f"_s{k}").isNotNull() | F.col(f"_k{k}").isNotNull()) for k in (0, 1)]
    told = both.groupBy("_q").agg(n[0].alias("n0"), n[1].alias("n1"), F.min(F.when(~same, F.col("_rank"))).alias("first"))
    text = F.when(F.col("n0") != F.col("n1"), F.format_string("result count differs: %d vs %d", "n0", "n1")).when(F.col("first").isNotNull(), F.format_string("result %d differs", "first"))
    return told.select(F.col("_q").alias(by), text.alias("difference"))
