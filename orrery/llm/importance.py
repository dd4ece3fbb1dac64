"""Target-distribution importance resampling with hashed word runs.

Runs of words of the documents and of a target (the benchmark) are counted by bucket: ``buckets`` integers each, whatever the
corpus's size, and these two lists alone reach the driver. A bucket's gain is the logarithm of the target's smoothed share
over the documents' in thousandths; the gains go to the tasks as one array, and a document's weight is the sum of gains over
its runs. A fixed draw by doc_id is added (Gumbel's, so that the best scores are a sample without replacement by weight).

Scores are integers, so the draw needs no sort of documents: rows are counted by score, the histogram is dealt to range
partitions from the highest score on, a score's rank offset is what stands in the partitions before its own plus the
suffix sum inside, and the last score whose offset is below the draw is the cutoff. Only rows at or above it are numbered,
by doc_id inside each score. No task holds more than one range of the histogram, or the rows of one score.

Cases: null and empty texts have no words, weight 0 and their draw as score; a row with a null doc_id has no draw: its score
and rank are null and it is not among the N; rows that repeat a doc_id are documents each (tied ones by fewer features, then
as they come: they differ in nothing that is returned); no documents, or too few words in each, give no ranks; other columns
are ignored by rank() and kept by resample().
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._flat import LOWER, Words, buffers, pieces
from orrery.llm._store import Scratch, free

RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
BETWEEN = np.ones(256, bool)  # what stands between words, once A-Z are lower-cased
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CRC = np.array([functools.reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)], np.uint32)
LONG = 64


def crc32(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start:end] for each pair: all ranges advance together by a byte, the longest alone."""
    order = np.argsort(start - end, kind="stable")
    begin, size = start[order], (end - start)[order]
    far = int(np.searchsorted(-size, -LONG, "left"))
    code = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[far]) if far < len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        now = code[far:n]
        code[far:n] = _CRC[(now ^ raw[begin[far:n] + j]) & 0xFF] ^ (now >> np.uint32(8))
    code ^= np.uint32(0xFFFFFFFF)
    for k in range(far):
        code[k] = zlib.crc32(raw[begin[k] : begin[k] + size[k]])
    out = np.empty_like(code)
    out[order] = code
    return out


def features(text: pa.Array, run: int, buckets: int):
    """For slices of the texts: index of the first, words of each text, buckets of all runs of words, and of each the text."""
    raw, offsets = buffers(text)
    for a, b in pieces(offsets):
        low = LOWER[raw[offsets[a] : offsets[b]]]
        own = Words(low, offsets[a : b + 1] - offsets[a], BETWEEN)
        count, start, end, at = np.diff(own.at), own.start, own.end, own.at
        if run > 1:  # the words with one space after each
            size = end - start + 1
            place = np.cumsum(size) - size
            spot = np.arange(size.sum()) - np.repeat(place, size) + np.repeat(start, size)
            low = np.append(low, np.uint8(0x20))[spot]
            start, end = place, place + size - 1
            low[end] = 0x20
        doc = np.repeat(np.arange(b - a), count)
        found = [(crc32(low, start, end), doc)]
        for n in range(2, run + 1):
            first = np.flatnonzero(np.arange(len(start)) + n <= at[1:][doc])
            found.append((crc32(low, start[first], end[first + n - 1]), doc[first]))
        code, owner = (np.concatenate(x) for x in zip(*found))
        yield a, count, (code % np.uint32(buckets)).astype(np.int64), owner


def counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts by bucket; a task sends one row for each of its buckets."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _ in features(batch["text"], run, buckets):
                total += np.bincount(bucket, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], ["b", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for row in found:
        out[row["b"]] = row["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    n, s, t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)))) for a, b in zip(source, target)]


def draw(seed: str = SEED) -> Column:
    """Gumbel's draw of a doc_id in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_features, weight and score."""
    table = np.array(gains(counts(docs, run, buckets), counts(target, run, buckets)), np.int64)  # 8 bytes a bucket go to each task

    def weigh(batches):
        for batch in batches:
            n_words, n_features, weight = np.zeros((3, len(batch)), np.int64)
            for a, count, bucket, owner in features(batch["text"], run, buckets):
                n_words[a : a + len(count)] = count
                n_features[a : a + len(count)] = np.bincount(owner, minlength=len(count))
                np.add.at(weight, owner + a, table[bucket])
            yield pa.record_batch([batch["doc_id"], *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + draw(seed))


def offsets(scores: DataFrame, scratch: Scratch) -> DataFrame:
    """score and _ahead (rows of a higher score) of each score of ``scores``: suffix sums of the histogram in two levels."""
    dealt = scratch.keep(scores.groupBy("score").count().repartitionByRange(F.desc("score")).withColumn("_p", F.spark_partition_id()))
    parts = dealt.groupBy("_p").agg(F.sum("count").alias("_s"))  # one row a partition
    parts = parts.select(F.col("_p").alias("_q"), (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))
    inside = F.sum("count").over(Window.partitionBy("_p").orderBy(F.desc("score"))) - F.col("count")
    return dealt.withColumn("_in", inside).join(parts, F.col("_p") == F.col("_q")).select("score", (F.col("_before") + F.col("_in")).alias("_ahead"))


def rank(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(scored(docs, target, run, buckets, seed))  # some 30 bytes a document; texts are not read again
    able = rows.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    take = able.count() * percent // 100
    ahead = scratch.keep(offsets(able, scratch).where(F.col("_ahead") < take))
    cutoff = ahead.agg(F.min("score")).first()[0]
    cutoff = (1 << 63) - 1 if cutoff is None else cutoff
    may = (F.col("n_words") >= least_words) & F.coalesce(F.col("score") >= cutoff, F.lit(False))
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    drawn = rows.where(may).join(ahead, "score").withColumn("rank", place.cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*names).unionByName(rows.where(~may).withColumn("rank", F.lit(None).cast("long")).select(*names))


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, columns as they were. docs: one row a doc_id."""
    (own,) = free(docs, "drawn")
    drawn = rank(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(drawn, F.col("doc_id").cast("long") == F.col(own), "left_semi")


def op12_importance(spark, sf_dir: str) -> DataFrame:
    """The tenth of documents that a draw by likeness to the benchmark takes, and every document's score."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
own AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
counted AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(w) AS w FROM own) GROUP BY k, w),
vocabulary AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS b
  FROM (SELECT w FROM counted UNION SELECT w FROM target), crc),
s AS (SELECT b, sum(n) AS n FROM counted JOIN vocabulary USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM target JOIN vocabulary USING (w) GROUP BY b),
gain AS (
  SELECT r.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT unnest(range(10000)) AS b) r LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b),
weighed AS (SELECT k, sum(n * g) AS weight FROM counted JOIN vocabulary USING (w) JOIN gain USING (b) GROUP BY k),
scored AS (
  SELECT o.k, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM own o LEFT JOIN weighed USING (k)),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () * 10 // 100 AS most FROM scored WHERE n_features >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (k)
"""
