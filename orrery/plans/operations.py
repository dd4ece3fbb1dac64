"""Queries over stored forms of the tables: vectors in blocks, snapshots in buckets, result files, comparisons of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.functions import vectors
from orrery.operators import metrics, ranking, stats
from orrery.operators.blocks import Layout
from orrery.operators.reconcile import BucketedSnapshot, missing, only_in
from orrery.plans import catalogue as base
from orrery.sources.result_sink import write_results
from orrery.sources.shared import new_folder

BLOCK_ROWS, BUCKETS = 256, 16


def topk_blocks(spark, sf_dir):
    """topk_threshold over vectors laid out in blocks."""
    layout = Layout.write(base._read(spark, sf_dir, "embeddings"), "vec_id", block_rows=BLOCK_ROWS)
    return base._round(layout.search(base._vector(spark, sf_dir), 5, 0.25, exclude=0)[0], "score")


def knn_blocks(spark, sf_dir):
    """knn_batch over vectors laid out in blocks."""
    rows = base._read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    layout = Layout.write(rows, "vec_id", block_rows=BLOCK_ROWS)
    return base._round(layout.batch_search(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)[0], "score")


def _bucketed(spark, rows) -> BucketedSnapshot:
    return BucketedSnapshot(spark, f"snapshot_{uuid.uuid4().hex}", "doc_id", BUCKETS).write(rows)


def reconcile_bucketed(spark, sf_dir):
    """reconcile_plan against a bucketed snapshot: what is indexed is not shuffled."""
    old, new = base._snapshots(spark, sf_dir)
    return _bucketed(spark, old).plan(new, ("n_chars",))


def apply_bucketed(spark, sf_dir):
    """apply_changes to a bucketed snapshot, as its next version."""
    old, new = base._snapshots(spark, sf_dir)
    upserts = missing(new, old, "doc_id", ("n_chars",)).select("doc_id", "n_chars", F.lit("upsert").alias("op"))
    deletes = only_in(old, new, "doc_id").select("doc_id", F.lit(None).cast("long").alias("n_chars"), F.lit("delete").alias("op"))
    index = _bucketed(spark, old)
    index.apply(upserts.unionByName(deletes))
    return index.rows


def ranked_lines(spark, sf_dir):
    """The whole ranking of vector 0 written as text by all tasks, and its lines read back."""
    rows = base._read(spark, sf_dir, "embeddings").where("vec_id <> 0")
    scored = rows.select("vec_id", vectors.dot(F.col("embedding"), vectors.literal(base._vector(spark, sf_dir))).alias("score"))
    ranked = ranking.full_ranking(scored).withColumn("path", F.encode(F.concat(F.lit("set\\"), F.col("vec_id").cast("string"), F.lit(".jpg")), "UTF-8"))
    path = new_folder(spark, "lines")
    write_results(ranked, path, ["rank"])
    return spark.read.text(path).withColumnRenamed("value", "line")


def output_differences(spark, sf_dir):
    """Neighbours by 64 and by 63 dimensions, compared rank by rank; some lists are shorter."""
    small = base._batch(spark, sf_dir, dims=63).where("query_id % 3 > 0 or rank < 10")
    return metrics.output_difference(base._batch(spark, sf_dir), small, tolerance=0.05)


def sample_order(spark, sf_dir):
    """Which side every measurement takes first."""
    return stats.sample_order(base._read(spark, sf_dir, "events").select(F.col("event_id").alias("n")))


def resident_memory(spark, sf_dir):
    """Peak memory of two systems in one unit."""
    system = F.when(F.col("event_id") % 3 == 0, "Darwin").otherwise("linux")
    return base._read(spark, sf_dir, "events").select("event_id", stats.resident_bytes(F.col("user_id"), system).alias("rss_bytes"))


def quality_report(spark, sf_dir):
    """All quality figures of one run: every 40th vector is a caption, whose relevant ones are the 19 after it; the other queries are
    categories, by label."""
    rows = base._read(spark, sf_dir, "embeddings").select("vec_id", "label")
    name = lambda c: F.col(c).cast("string")
    asked = rows.where("vec_id % 20 = 0").withColumn("_g", F.col("vec_id").cast("long"))
    near = rows.select(name("vec_id").alias("_r"), (F.col("vec_id") - F.col("vec_id") % 20).alias("_g")).where(F.col("_r").cast("long") > F.col("_g"))
    relevant = near.groupBy("_g").agg(F.collect_list("_r").alias("relevant"))  # 19 a query
    found = base._batch(spark, sf_dir).groupBy(F.col("query_id").alias("_g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].cast("string").alias("path"), x["score"].alias("score"))).alias("results"))
    kind = F.when(F.col("vec_id") % 40 == 0, "caption").otherwise("category")
    runs = asked.join(relevant, "_g").join(found, "_g").select(name("vec_id").alias("id"), kind.alias("kind"), F.concat(F.lit("label "), name("label")).alias("intent"), "relevant", "results")
    told = metrics.evaluate(runs, 0.35)
    return base._round(told, *told.columns)


QUERIES = (quality_report, topk_blocks, knn_blocks, reconcile_bucketed, apply_bucketed, ranked_lines, output_differences, sample_order, resident_memory)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql(known: dict[str, str]) -> dict[str, str]:
    """known: SQL of the catalogue, as some queries say the same of another form."""
    lists = lambda n: f"SELECT query_id, vec_id, rank, score FROM ({base._knn(n)})"
    return {
        "quality_report": f"""WITH asked AS (SELECT vec_id AS q, label FROM embeddings WHERE vec_id % 20 = 0), relevant AS (SELECT q, e.vec_id AS r FROM asked JOIN embeddings e ON e.vec_id > q AND e.vec_id < q + 20),
            n AS (SELECT q, count(*) AS n FROM relevant GROUP BY q),
            hits AS (SELECT query_id AS q, rank, score, r IS NOT NULL AS hit, own FROM ({base._knn()}) LEFT JOIN relevant ON q = query_id AND r = vec_id),
            per AS (SELECT q, n, {", ".join(f"sum(CASE WHEN hit AND rank <= {k} THEN 1 ELSE 0 END)::DOUBLE / n AS r{k}" for k in (1, 5, 10))}, coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN rank END), 0) AS mrr,
              sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg FROM hits JOIN n USING (q) WHERE q % 40 = 0 GROUP BY q, n),
            judged AS (SELECT q, own, max(CASE WHEN score >= 0.35 AND NOT hit THEN 1.0::DOUBLE ELSE 0 END) AS w, 1 - max(CASE WHEN score >= 0.35 THEN 1.0::DOUBLE ELSE 0 END) AS z FROM hits WHERE q % 40 <> 0 GROUP BY q, own),
            rates AS (SELECT avg(w) AS w, avg(z) AS z FROM (SELECT avg(w) AS w, avg(z) AS z FROM judged GROUP BY own))
            SELECT {", ".join(f"(SELECT round(avg(r{k}), 6) FROM per) AS recall_at_{k}" for k in (1, 5, 10))}, (SELECT round(avg(ndcg), 6) FROM per) AS ndcg_at_10, (SELECT round(avg(mrr), 6) FROM per) AS mrr_at_10,
              round(w, 6) AS absent_false_positive_rate, round(z, 6) AS present_false_negative_rate FROM rates""",
        "topk_blocks": known["topk_threshold"],
        "knn_blocks": known["knn_batch"],
        "reconcile_bucketed": known["reconcile_plan"],
        "apply_bucketed": known["apply_changes"],
        "ranked_lines": f"""SELECT 'score' || chr(9) || 'path' AS line UNION ALL
            SELECT printf('%.3f', score) || chr(9) || 'set' || chr(92) || chr(92) || vec_id || '.jpg' FROM ({base._ONE})""",
        "output_differences": f"""WITH l AS ({lists(64)}), r AS (SELECT * FROM ({lists(63)}) WHERE query_id % 3 > 0 OR rank < 10),
            j AS (SELECT query_id, rank, l.score AS a, r.score AS b, l.vec_id IS NOT DISTINCT FROM r.vec_id AND abs(l.score - r.score) <= 0.05 AS same FROM l FULL JOIN r USING (query_id, rank)),
            d AS (SELECT query_id, count(a) AS n, count(b) AS m, min(CASE WHEN same IS NOT TRUE THEN rank END) AS first FROM j GROUP BY query_id)
            SELECT query_id, CASE WHEN n <> m THEN 'result count differs: ' || n || ' vs ' || m WHEN first IS NOT NULL THEN 'result ' || first || ' differs' END AS difference FROM d""",
        "sample_order": """SELECT event_id AS n, turn::INT AS turn, CASE WHEN (turn + event_id % 2) % 2 = 0 THEN 'reference' ELSE 'candidate' END AS side
            FROM events, (SELECT unnest([0, 1]) AS turn)""",
        "resident_memory": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id ELSE user_id * 1024 END AS rss_bytes FROM events",
    }
