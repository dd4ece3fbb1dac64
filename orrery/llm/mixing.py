"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source; each source's target share follows its weight, but stops at ``most`` times its words, and
what that leaves over is shared out again by weight until no source is above its stop. That is one level L for which
target = min(most * words, weight * L) adds up to the total, found in one pass over the sources ordered by
words / weight. A document is then taken floor(rate) times, rate = target / words of its source, and once more if a
hash of (seed, doc_id, text) falls below the rate's fraction. The draw depends on the row alone, so reruns, retries and
other partitionings agree; rows that repeat a doc_id with the same text draw alike.

Only per-source sums are gathered (one row a source; partial sums before the shuffle, so a hot source costs no more
than another), and they are broadcast only after they are counted, up to MOST_BROADCAST sources; beyond, rows are joined
by source. Levels are found by windows over all
sources in one task, 60 bytes a source: meant for up to some millions of sources, whatever the number of documents.

Cases: null and empty texts have size 0 and are taken as 0 words; a null source is a source of its own, ordered last;
a source without words has target 0 and rate 0; a null doc_id draws by its text; other columns are ignored by the query
and kept by repeat_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._store import Scratch, free

WEIGHTS, MOST, SEED, MOST_BROADCAST = (5, 2, 1), 3, "mix", 50_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_source, source_size, target (double) of each source of ``sizes`` (_source, size)."""
    by_source = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    staged = (
        by_source.withColumn("w", weight)
        .withColumn("_low", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("_w", F.sum("w").over(rest) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("_total", F.sum("source_size").over(rest))
        # the level if all sources before this one stand at their stop and the rest share by weight
        .withColumn("_level", (F.col("_total") - F.col("_low")) / F.col("_w"))
        .withColumn("_open", F.col("w") * F.col("_level") <= F.col("source_size") * most)
        .withColumn("level", F.max(F.when(F.col("_open"), F.struct(-F.row_number().over(order), F.col("_level")))).over(rest)["_level"])
    )
    return staged.select("_source", "source_size", F.coalesce(F.least(F.col("w") * F.col("level"), (F.col("source_size") * most).cast("double")), F.lit(0.0)).alias("target"))


def draw(seed: str = SEED) -> Column:
    """A number in [0, 1) of each row, from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("\x00", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source_targets, to be broadcast if they are few: else a small table would make all rows travel."""
    targets = Scratch(sizes.sparkSession).keep(source_targets(sizes, weights, most))
    return F.broadcast(targets) if targets.count() <= MOST_BROADCAST else targets


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source) as doc_id, _source, size, _draw, source_size, target and n (times it is taken)."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("_source"), n_words(F.col("text")).alias("size"), draw(seed).alias("_draw"))
    sized = Scratch(docs.sparkSession).keep(sized)  # texts are read once; what is kept of them is some 30 bytes a row
    targets = _targets(sized.select("_source", "size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("long")
    targets = targets.select(F.col("_source").alias("_of"), "source_size", "target")  # names of sized and targets alone meet here, whatever docs holds
    return sized.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("n", n.cast("long"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 over the sources in order of code points, null last."""
    mixed = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; columns as they were, whatever their names."""
    of, rate, copy = free(docs, "of", "rate", "copy")
    sizes = docs.select(F.col("source").cast("string").alias("_source"), n_words(F.col("text")).alias("size"))
    targets = _targets(sizes, weights, most).select(F.col("_source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    n = F.floor(F.col(rate)) + (draw(seed) < F.col(rate) - F.floor(F.col(rate))).cast("long")
    out = docs.join(targets, F.col("source").cast("string").eqNullSafe(F.col(of))).where(n > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM by_source),
staged AS (
  SELECT *, row_number() OVER o AS k, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed
  WINDOW o AS (ORDER BY source_size / w, source NULLS LAST), before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT arg_min(level, k) AS level FROM staged WHERE w * level <= source_size * 3),
targets AS (
  SELECT source, source_size, coalesce(least(w * levels.level, source_size * 3.0::DOUBLE), 0.0::DOUBLE) AS target FROM staged, levels),
rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix' || chr(0) || coalesce(doc_id::VARCHAR, 'null') || chr(0) || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
