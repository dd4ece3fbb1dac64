"""Queries of the retrieval engine by name, with DuckDB SQL for each that SQL can express.

Scores are ranked unrounded and rounded to 6 places in the last projection. Where a query asks many questions at once,
every vector whose vec_id is divisible by 20 is one, against all rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.contracts import Contract
from orrery.functions import images, paths, vectors
from orrery.operators import metrics, ranking, reconcile, stats
from orrery.sources import sinks
from orrery.sources.shared import new_folder
from orrery.sources.snapshot import Index


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vector(spark, sf_dir, vec_id: int = 0):
    row = _read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def topk_threshold(spark, sf_dir):
    found = ranking.search(_read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 5, 0.25, exclude=F.col("vec_id") == 0)
    return _round(found, "score")


def topk_exhaustive(spark, sf_dir):
    found = ranking.search(_read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, -1.0, exclude=F.col("vec_id") == 0)
    return _round(found, "score")


def _batch(spark, sf_dir, k=10, dims=None, threshold=-1.0):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding" if dims is None else F.slice("embedding", 1, dims).alias("embedding"))
    return ranking.batch_search(rows, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k, threshold)


def knn_batch(spark, sf_dir):
    return _round(_batch(spark, sf_dir), "score")


def full_ranking(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").where("vec_id <> 0")
    scored = rows.select("vec_id", vectors.dot(F.col("embedding"), vectors.literal(_vector(spark, sf_dir))).alias("score"))
    return _round(ranking.full_ranking(scored), "score")


def vector_stats(spark, sf_dir):
    e = F.col("embedding")
    return _round(_read(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("long").alias("dim"), vectors.norm(e).alias("norm"), vectors.finite(e).alias("finite"), (F.abs(vectors.norm(e) - 1) <= 1e-3).alias("stored")), "norm")


def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x * 3).cast("float"))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", vectors.normalise(scaled, 64).alias("unit"))
    return rows.select("vec_id", F.round(F.element_at("unit", 1).cast("double"), 5).alias("first_value"), F.round(vectors.norm(F.col("unit")), 5).alias("norm"))


def invalid_vectors(spark, sf_dir):
    broken = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: (x * 2).cast("float"))).when(F.col("vec_id") % 10 == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return _read(spark, sf_dir, "embeddings").select("vec_id", broken.alias("embedding")).select("vec_id", vectors.is_stored(F.col("embedding"), 64).alias("valid"))


def cached_query_lookup(spark, sf_dir):
    items = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    cache = items.where("item_id % 3 = 0").select("query", F.array(F.lit(1.0)).alias("embedding"))
    return ranking.lookup(items, cache).select("item_id", "hit")


def _snapshots(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    old = docs.where("doc_id % 10 <> 0")
    new = docs.where("doc_id % 10 <> 1").withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 10 == 2).cast("long"))
    return old, new


def reconcile_plan(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return reconcile.plan(new, old, "doc_id", ("n_chars",))


def missing_keys(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return reconcile.missing(new, old, "doc_id", ("n_chars",)).select("doc_id", "n_chars")


def stale_keys(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return reconcile.only_in(old, new, "doc_id").select("doc_id")


def apply_changes(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    upserts = reconcile.missing(new, old, "doc_id", ("n_chars",)).select("doc_id", "n_chars", F.lit("upsert").alias("op"))
    deletes = reconcile.only_in(old, new, "doc_id").select("doc_id", F.lit(None).cast("long").alias("n_chars"), F.lit("delete").alias("op"))
    return reconcile.apply_changes(old, upserts.unionByName(deletes), "doc_id").select("doc_id", "n_chars")


def chunk_assignment(spark, sf_dir):
    return reconcile.chunks(_read(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], 8).select("page_id", "chunk")


def extension_filter(spark, sf_dir):
    ext = paths.extension(paths.url_path(F.col("url")))
    return _read(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), ext.isin("html", "htm").alias("supported"))


def _hits(spark, sf_dir):
    labels = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    top = _batch(spark, sf_dir).join(asked, "query_id").join(labels, "vec_id")
    per_label = labels.groupBy("label").agg(F.count("*").alias("c"))
    relevant = asked.join(per_label, F.col("own") == F.col("label")).select("query_id", (F.col("c") - 1).alias("n"))
    return top.select("query_id", "rank", "score", (F.col("own") == F.col("label")).alias("hit"), "own"), relevant


def recall_at_k(spark, sf_dir):
    per = metrics.per_query(*_hits(spark, sf_dir))
    return _round(per.select("query_id", "recall_at_1", "recall_at_5", "recall_at_10"), "recall_at_1", "recall_at_5", "recall_at_10")


def ndcg_at_10(spark, sf_dir):
    return _round(metrics.per_query(*_hits(spark, sf_dir)).select("query_id", "ndcg_at_10"), "ndcg_at_10")


def mrr_at_10(spark, sf_dir):
    return _round(metrics.per_query(*_hits(spark, sf_dir)).select("query_id", "mrr_at_10"), "mrr_at_10")


def hit_rates(spark, sf_dir):
    hits, relevant = _hits(spark, sf_dir)
    first = relevant.join(hits.where("hit").groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    return _round(metrics.hit_rates(first), "hit_at_1", "hit_at_5", "hit_at_10")


def macro_error_rates(spark, sf_dir):
    hits, relevant = _hits(spark, sf_dir)
    over = (F.col("score") >= 0.35).cast("int")
    judged = hits.groupBy("query_id", F.col("own").alias("intent")).agg((F.max(F.when(~F.col("hit"), over).otherwise(0)) == 1).alias("wrong"), (F.max(over) == 0).alias("none"))
    return _round(metrics.macro_rates(judged), "absent_false_positive_rate", "present_false_negative_rate")


def topk_overlap(spark, sf_dir):
    return _round(metrics.overlap(metrics.top_lists(_batch(spark, sf_dir)), metrics.top_lists(_batch(spark, sf_dir, dims=32))), "overlap")


def topk_agreement(spark, sf_dir):
    return _round(metrics.agreement(metrics.top_lists(_batch(spark, sf_dir)), metrics.top_lists(_batch(spark, sf_dir, dims=63))), "agreement")


def _pairs(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    q = vectors.literal(_vector(spark, sf_dir))
    cut = lambda e: F.slice(e, 1, 32)
    return rows.where("vec_id <> 0").select(vectors.dot(F.col("embedding"), q).alias("reference"), vectors.dot(cut(F.col("embedding")), cut(q)).alias("candidate"))


def score_delta_stats(spark, sf_dir):
    return _round(metrics.delta_stats(_pairs(spark, sf_dir)), "mean_delta", "std_delta")


def vector_comparison(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    moved = F.transform("embedding", lambda x: x.cast("double") + 0.001)
    return _round(metrics.vector_comparison(rows.select(F.col("embedding").cast("array<double>").alias("a"), moved.alias("b"))), "max_abs_error", "min_cosine")


def phase_rollup(spark, sf_dir):
    return stats.phase_rollup(_read(spark, sf_dir, "events"), "event_type", "value").select("phase", F.round("elapsed_ms", 4).alias("elapsed_ms"), "invocations")


def percentile_nearest_rank(spark, sf_dir):
    return stats.percentiles(_read(spark, sf_dir, "events"), ["event_type"], "value", (50, 90, 95))


def upper_median(spark, sf_dir):
    return stats.upper_median(_read(spark, sf_dir, "events"), "event_type", "value")


def median_change(spark, sf_dir):
    return _round(stats.median_change(_read(spark, sf_dir, "events"), F.col("event_id") % 2 == 1, "value", ["event_type"]), "change")


def index_count(spark, sf_dir):
    return _read(spark, sf_dir, "pages").agg(F.count("*").alias("n"))


def text_fingerprint(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", paths.fingerprint(F.col("text")).alias("sha256"))


def has_matches(spark, sf_dir):
    found = ranking.search(_read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 1, 0.25, exclude=F.col("vec_id") == 0)
    return found.agg(F.when(F.count("*") > 0, 0).otherwise(1).cast("long").alias("exit_status"))


def _samples(spark, sf_dir):
    # Sixty events in a row are one benchmark; reference and candidate take turns.
    scenario = F.floor(F.col("event_id") / 60).cast("string")
    rows = _read(spark, sf_dir, "events").select(scenario.alias("scenario"), F.when(F.col("event_id") % 2 == 0, "reference").otherwise("candidate").alias("side"), F.col("value").alias("seconds"), (F.col("user_id") * 1024).alias("rss_bytes"), "event_id")
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("scenario", "side").orderBy("event_id")))
    return placed.withColumn("both", F.count("*").over(Window.partitionBy("scenario", "n"))).where("both = 2")  # samples come in pairs


def bootstrap_change(spark, sf_dir):
    return _round(stats.bootstrap(_samples(spark, sf_dir).select("scenario", "side", "n", "seconds")), "change", "low", "high")


def benchmark_report(spark, sf_dir):
    found = stats.report(_samples(spark, sf_dir))
    return _round(found, *[c for c in found.columns if c != "scenario"])


def benchmark_medians(spark, sf_dir):
    return _round(stats.medians(_samples(spark, sf_dir)), "seconds", "rss_bytes")


def correct_score_deltas(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    targets = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("vec_id"))
    small = rows.withColumn("embedding", F.slice("embedding", 1, 32))
    told = [metrics.target_scores(r.withColumnRenamed("vec_id", "query_id"), r, targets).withColumnRenamed("score", n) for r, n in ((rows, "reference"), (small, "candidate"))]
    return _round(metrics.delta_stats(told[0].join(told[1], ["query_id", "vec_id"])), "mean_delta", "std_delta")


def path_escape(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", paths.escaped(F.col("text")).alias("line"))


def path_display(spark, sf_dir):
    shown = paths.display("/srv/pictures/", F.encode(F.concat(F.lit("a/"), paths.url_path(F.col("url"))), "UTF-8"))
    rows = _read(spark, sf_dir, "pages").select("page_id", shown.alias("full"))
    return rows.select("page_id", F.decode("full", "UTF-8").alias("shown"), F.decode(paths.relative("/srv/pictures", F.col("full")), "UTF-8").alias("relative"))


def path_order(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages").select("page_id", paths.components(F.encode(paths.url_path(F.col("url")), "UTF-8")).alias("key"))
    return reconcile.chunks(rows, ["key", "page_id"], 1, "place").select("page_id", "place")


def image_kinds(spark, sf_dir):
    endings = F.array(*[F.lit(x) for x in (".JPG", ".cr2", ".Nef", ".txt", "", ".tiff", ".RAF", ".jpeg.bak")])
    name = F.concat(F.lit("dir.x/img"), F.col("page_id").cast("string"), F.element_at(endings, (F.col("page_id") % 8 + 1).cast("int")))
    return _read(spark, sf_dir, "pages").select("page_id", name.alias("name"), paths.image_kind(name).alias("kind"))


def image_sizes(spark, sf_dir):
    width, height = F.col("event_id") * 37 % 9000, F.col("event_id") * 101 % 12000
    rows = _read(spark, sf_dir, "events").select("event_id", width.alias("width"), height.alias("height"))
    return rows.withColumns(images.size_columns(F.col("width"), F.col("height")))


def cache_keys(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", paths.cache_key(F.col("source"), F.col("lang"), F.col("text")).alias("key"))


def blob_codec(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.to_blob(F.col("embedding")).alias("blob"))
    back = vectors.from_blob(F.col("blob"))
    return rows.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (back == F.col("embedding")).alias("same"), vectors.from_blob(F.expr("substring(blob, 1, vec_id % 7)")).isNull().alias("cut"))


def reconcile_null_versions(spark, sf_dir):
    blank = lambda df: df.withColumn("n_chars", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")))
    old, new = (blank(df) for df in _snapshots(spark, sf_dir))
    todo = reconcile.missing(new, old, "doc_id", ("n_chars",)).select("doc_id", F.lit(True).alias("embed"))
    return reconcile.plan(new, old, "doc_id", ("n_chars",)).join(todo, "doc_id", "left").na.fill(False, ["embed"])


def index_commits(spark, sf_dir):
    """Three commits and a delete into a new index, in the folder that driver and executors share."""
    folder = new_folder(spark, "index").removeprefix("file://")
    os.makedirs(folder)
    index = Index(spark, f"{folder}/i", Contract("i", "q", 2))
    docs = _read(spark, sf_dir, "documents").select(F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("path"), F.col("n_chars").alias("size"), "doc_id")
    rows = docs.select(F.lit("upsert").alias("op"), "path", (F.col("doc_id") * 1000).alias("mtime_ns"), "size", F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"), "doc_id")
    index.commit(rows.where("doc_id % 3 <> 0").drop("doc_id"))
    index.commit(rows.where("doc_id % 3 < 2").withColumn("size", F.col("size") + 1).drop("doc_id"))
    index.commit(rows.where("doc_id % 4 = 1").withColumn("op", F.lit("delete")).drop("doc_id"))
    index.delete(docs.where("doc_id % 5 = 0").select("path"))
    return index.vectors().join(index.files(), "path").select(F.decode("path", "UTF-8").cast("long").alias("doc_id"), "mtime_ns", "size", F.size("embedding").alias("dim"))


def sink_lines(spark, sf_dir):
    found = ranking.search(_read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20, -1.0, exclude=F.col("vec_id") == 0)
    rows = [(r.score, f"set\t{r.vec_id}.jpg".encode()) for r in found.orderBy("rank").collect()]  # 20 rows
    lines = sinks.render(rows).decode().splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


def queries() -> dict:
    names = (
        topk_threshold, topk_exhaustive, knn_batch, full_ranking, vector_stats, l2_normalize, invalid_vectors, cached_query_lookup, reconcile_plan, missing_keys, stale_keys, apply_changes,
        chunk_assignment, extension_filter, recall_at_k, ndcg_at_10, mrr_at_10, hit_rates, macro_error_rates, topk_overlap, topk_agreement, score_delta_stats, vector_comparison, phase_rollup,
        percentile_nearest_rank, upper_median, median_change, index_count, text_fingerprint, has_matches, bootstrap_change,
        benchmark_report, benchmark_medians, correct_score_deltas, path_escape, path_display, path_order, image_kinds, image_sizes, cache_keys, blob_codec, reconcile_null_versions, index_commits, sink_lines,
    )
    from orrery.plans import operations

    return {f.__name__: f for f in names} | operations.queries()


def _dot(a: str, b: str, n: int = 64) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


_ONE = f"""SELECT e.vec_id, {_dot('e.embedding', 'q.embedding')} AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0"""


def _top(threshold: str, k: int) -> str:
    return f"""SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
FROM (SELECT * FROM ({_ONE}) WHERE score >= {threshold} ORDER BY score DESC, vec_id LIMIT {k}) s"""


def _knn(n: int = 64, k: int = 10) -> str:
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, q.label AS own, e.label, {_dot('q.embedding', 'e.embedding', n)} AS score
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= {k}"""


_OLD = "SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 0"
_NEW = "SELECT doc_id, n_chars + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 10 <> 1"
_MISSING = "SELECT n.doc_id, n.n_chars::BIGINT AS n_chars FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.doc_id = n.doc_id AND o.n_chars = n.n_chars)"
_PER_QUERY = f"""WITH top AS ({_knn()}), asked AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0),
relevant AS (SELECT a.query_id, (SELECT count(*) - 1 FROM embeddings e WHERE e.label = a.label) AS n FROM asked a)
SELECT r.query_id, {{}} FROM relevant r JOIN top t USING (query_id) WHERE n > 0 GROUP BY r.query_id, r.n"""
_LISTS = lambda n, k: f"SELECT query_id, list(vec_id ORDER BY rank) AS t FROM ({_knn(n, k)}) GROUP BY query_id"
_DELTA = f"""SELECT {_dot('e.embedding', 'q.embedding')} AS r, {_dot('e.embedding', 'q.embedding', 32)} AS c
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0"""


_SAMPLES = """SELECT scenario, side, n, value, rss FROM (SELECT *, count(*) OVER (PARTITION BY scenario, n) AS paired FROM (
  SELECT (event_id // 60)::VARCHAR AS scenario, CASE WHEN event_id % 2 = 0 THEN 'reference' ELSE 'candidate' END AS side, value, user_id * 1024 AS rss,
    row_number() OVER (PARTITION BY event_id // 60, event_id % 2 ORDER BY event_id) AS n FROM events)) WHERE paired = 2"""


def _bootstrap_sql() -> str:
    """Intervals from the same draws, which are written out for the numbers of pairs that the tables' scenarios have."""
    picks = ", ".join(f"({n}, {row})" for n in (20, 30) for row in (stats.draws(n) + 1).tolist())
    change = "1 - list_aggregate(list_transform({0}, lambda i: b[i]), 'median') / list_aggregate(list_transform({0}, lambda i: a[i]), 'median')"
    return f"""WITH draws(n, picks) AS (VALUES {picks}),
sides AS (SELECT scenario, list(value ORDER BY n) FILTER (side = 'reference') AS a, list(value ORDER BY n) FILTER (side = 'candidate') AS b FROM ({_SAMPLES}) GROUP BY scenario),
drawn AS (SELECT scenario, list_sort(list({change.format("picks")})) AS d FROM sides JOIN draws ON n = len(a) GROUP BY scenario)
SELECT scenario, {change.format("range(1, len(a) + 1)")} AS change, d[{stats.LOW + 1}] AS low, d[{stats.HIGH + 1}] AS high FROM sides JOIN drawn USING (scenario)"""


def _escape_sql(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in [*range(32), *range(127, 160)]:
        out = f"replace({out}, chr({c}), chr(92) || '" + {9: "t", 10: "n", 13: "r"}.get(c, f"u{{{c:x}}}") + "')" if c else out
    return out


def oracle_sql() -> dict[str, str]:
    from orrery.plans import operations

    known = _oracle_sql()
    return known | operations.oracle_sql(known)


def _oracle_sql() -> dict[str, str]:
    return {
        "topk_threshold": _top("0.25", 5),
        "topk_exhaustive": _top("-1", 10),
        "knn_batch": f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_knn()})",
        "full_ranking": f"SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_ONE})",
        "vector_stats": f"""SELECT vec_id, len(embedding)::BIGINT AS dim, round(n, 6) AS norm, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite, abs(n - 1) <= 1e-3 AS stored
            FROM (SELECT *, sqrt({_dot('embedding', 'embedding')}) AS n FROM embeddings)""",
        "l2_normalize": f"""SELECT vec_id, round(u[1], 5) AS first_value, round(sqrt({_dot('u', 'u')}), 5) AS norm FROM (
            SELECT vec_id, list_transform(t, lambda x: x / n) AS u FROM (SELECT *, sqrt({_dot('t', 't')}) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: (x * 3)::DOUBLE) AS t FROM embeddings)))""",
        "invalid_vectors": """SELECT vec_id, len(e) = 64 AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AND abs(sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-3 AS valid
            FROM (SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN list_transform(embedding, lambda x: x * 2) WHEN 1 THEN embedding[:63] ELSE embedding END AS e FROM embeddings)""",
        "cached_query_lookup": "SELECT b.item_id, c.text IS NOT NULL AS hit FROM benchmark b LEFT JOIN (SELECT text FROM benchmark WHERE item_id % 3 = 0) c USING (text)",
        "reconcile_plan": f"""WITH old AS ({_OLD}), new AS ({_NEW}) SELECT coalesce(n.doc_id, o.doc_id) AS doc_id,
            CASE WHEN o.doc_id IS NULL THEN 'missing' WHEN n.doc_id IS NULL THEN 'stale' WHEN n.n_chars = o.n_chars THEN 'same' ELSE 'changed' END AS op FROM new n FULL JOIN old o USING (doc_id)""",
        "missing_keys": f"WITH old AS ({_OLD}), new AS ({_NEW}) {_MISSING}",
        "stale_keys": f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT doc_id FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)",
        "apply_changes": f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT doc_id, n_chars::BIGINT AS n_chars FROM new",
        "chunk_assignment": "SELECT page_id, ((row_number() OVER (ORDER BY url, page_id) - 1) // 8)::BIGINT AS chunk FROM pages",
        "extension_filter": r"""SELECT page_id, ext, ext IN ('html', 'htm') AS supported FROM (
            SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '[^/]\.([^./]+)$', 1)) AS ext FROM pages)""",
        "recall_at_k": _PER_QUERY.format(", ".join(f"round(sum(CASE WHEN own = label AND rank <= {k} THEN 1 ELSE 0 END)::DOUBLE / n, 6) AS recall_at_{k}" for k in (1, 5, 10))),
        "ndcg_at_10": _PER_QUERY.format("round(sum(CASE WHEN own = label THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg_at_10"),
        "mrr_at_10": _PER_QUERY.format("round(coalesce(1.0::DOUBLE / min(CASE WHEN own = label THEN rank END), 0), 6) AS mrr_at_10"),
        "hit_rates": f"WITH f AS ({_PER_QUERY.format('min(CASE WHEN own = label THEN rank END) AS f')}) SELECT " + ", ".join(f"round(avg(CASE WHEN f <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_{k}" for k in (1, 5, 10)) + " FROM f",
        "macro_error_rates": f"""WITH j AS (SELECT query_id, own, max(CASE WHEN score >= 0.35 AND own <> label THEN 1.0::DOUBLE ELSE 0 END) AS w, 1 - max(CASE WHEN score >= 0.35 THEN 1.0::DOUBLE ELSE 0 END) AS n FROM ({_knn()}) GROUP BY query_id, own)
            SELECT round(avg(w), 6) AS absent_false_positive_rate, round(avg(n), 6) AS present_false_negative_rate FROM (SELECT avg(w) AS w, avg(n) AS n FROM j GROUP BY own)""",
        "topk_overlap": f"SELECT round(sum(len(list_intersect(a.t, b.t)))::DOUBLE / (count(*) * 10), 6) AS overlap FROM ({_LISTS(64, 10)}) a JOIN ({_LISTS(32, 10)}) b USING (query_id)",
        "topk_agreement": f"SELECT round(avg(CASE WHEN a.t = b.t THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement FROM ({_LISTS(64, 10)}) a JOIN ({_LISTS(63, 10)}) b USING (query_id)",
        "score_delta_stats": f"SELECT round(avg(c - r), 6) AS mean_delta, round(stddev_pop(c - r), 6) AS std_delta FROM ({_DELTA})",
        "vector_comparison": """SELECT round(max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE - (x::DOUBLE + 0.001::DOUBLE))))), 6) AS max_abs_error,
            round(min(list_sum(list_transform(embedding, lambda x: x::DOUBLE * (x::DOUBLE + 0.001::DOUBLE)))), 6) AS min_cosine FROM embeddings""",
        "phase_rollup": "SELECT event_type AS phase, round(sum(value), 4) AS elapsed_ms, count(*) AS invocations FROM events GROUP BY event_type",
        "percentile_nearest_rank": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
        "upper_median": "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY event_type",
        "median_change": "SELECT event_type, round(1 - median(value) FILTER (event_id % 2 = 1) / median(value) FILTER (event_id % 2 = 0), 6) AS change FROM events GROUP BY event_type",
        "index_count": "SELECT count(*) AS n FROM pages",
        "text_fingerprint": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "has_matches": f"SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END::BIGINT AS exit_status FROM ({_ONE}) WHERE score >= 0.25",
        "bootstrap_change": f"SELECT scenario, round(change, 6) AS change, round(low, 6) AS low, round(high, 6) AS high FROM ({_bootstrap_sql()})",
        "benchmark_medians": f"SELECT scenario, side, round(median(value), 6) AS seconds, round(median(rss), 6) AS rss_bytes FROM ({_SAMPLES}) GROUP BY scenario, side",
        "benchmark_report": f"""SELECT scenario, {", ".join(f"round(median({c}) FILTER (side = '{side}') {unit}, 6) AS {side}_{name}" for c, unit, name in (("value", "* 1000", "ms"), ("rss", "/ 1048576", "mib")) for side in ("reference", "candidate"))},
            {", ".join(f"round(any_value({c}) * 100, 6) AS {c}_percent" for c in ("change", "low", "high"))} FROM ({_SAMPLES}) JOIN ({_bootstrap_sql()}) USING (scenario) GROUP BY scenario""",
        "correct_score_deltas": f"""SELECT round(avg(c - r), 6) AS mean_delta, round(stddev_pop(c - r), 6) AS std_delta FROM (
            SELECT {_dot('q.embedding', 'e.embedding')} AS r, {_dot('q.embedding', 'e.embedding', 32)} AS c FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id + 1 WHERE q.vec_id % 20 = 0)""",
        "path_escape": f"SELECT doc_id, {_escape_sql('text')} AS line FROM documents",
        "path_display": r"SELECT page_id, '/srv/pictures/a/' || regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS shown, 'a/' || regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS relative FROM pages",
        "path_order": r"SELECT page_id, row_number() OVER (ORDER BY string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), page_id) - 1 AS place FROM pages",
        "image_kinds": """SELECT page_id, 'dir.x/img' || page_id || ending AS name, CASE WHEN lower(ending) IN ('.jpg', '.tiff') THEN 'standard' WHEN lower(ending) IN ('.cr2', '.nef', '.raf') THEN 'raw' END AS kind
            FROM (SELECT page_id, ['.JPG', '.cr2', '.Nef', '.txt', '', '.tiff', '.RAF', '.jpeg.bak'][page_id % 8 + 1] AS ending FROM pages)""",
        "image_sizes": """WITH s AS (SELECT event_id, event_id * 37 % 9000 AS width, event_id * 101 % 12000 AS height FROM events),
            r AS (SELECT *, CASE WHEN width < height THEN 256 ELSE width * 256 // nullif(height, 0) END::BIGINT AS resized_width, CASE WHEN width < height THEN height * 256 // nullif(width, 0) ELSE 256 END::BIGINT AS resized_height FROM s),
            w AS (SELECT *, round_even((resized_width - 256) / 2, 0)::BIGINT AS "left", round_even((resized_height - 256) / 2, 0)::BIGINT AS top, 9 * width * height + 3 * resized_width * resized_height + 983040 AS working_bytes FROM r)
            SELECT *, width > 0 AND height > 0 AND width * height <= 100000000 AND coalesce(working_bytes <= 536870912, false) AS accepted FROM w""",
        "cache_keys": "SELECT doc_id, sha256(concat_ws(chr(0), source, lang, text)) AS key FROM documents",
        "blob_codec": "SELECT vec_id, len(embedding)::BIGINT * 4 AS n_bytes, true AS same, vec_id % 7 <> 4 AS cut FROM embeddings",
        "reconcile_null_versions": f"""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS v FROM ({_OLD})), n AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS v FROM ({_NEW})),
            j AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'missing' WHEN n.doc_id IS NULL THEN 'stale' WHEN n.v IS NOT DISTINCT FROM o.v THEN 'same' ELSE 'changed' END AS op FROM n FULL JOIN o ON n.doc_id = o.doc_id)
            SELECT doc_id, op, op IN ('missing', 'changed') AS embed FROM j""",
        "index_commits": "SELECT doc_id, doc_id * 1000 AS mtime_ns, CASE WHEN doc_id % 3 < 2 THEN n_chars + 1 ELSE n_chars END AS size, 2::INT AS dim FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 5 <> 0",
        "sink_lines": f"""SELECT 0::BIGINT AS place, 'score' || chr(9) || 'path' AS line UNION ALL
            SELECT rank, printf('%.3f', score) || chr(9) || 'set' || chr(92) || 't' || vec_id || '.jpg' FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_ONE})) WHERE rank <= 20""",
    }
