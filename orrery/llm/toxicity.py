"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's subwords are its byte n-grams (3 to 5, with the word's edges) and the word itself, hashed into buckets; a
word's vector is the mean of its subwords' embeddings, and a passage's the mean of its words'. Misspellings and inflected
forms share most n-grams with the words they come from. Every PASSAGE consecutive words of a text are a passage, one
word apart (a shorter text is filled up with words of no weight), and a text's score is that of its worst passage: an
average over a whole text would hide a few words in a long one.

Embeddings and the softmax layer are fitted together by Adam; the embeddings' first column starts from the log-odds of
their buckets between the labels (by number of texts), the rest from small random numbers. The sample is bounded: for
each label at most ``sample_docs`` rows and ``sample_bytes`` bytes, in order of a hash of doc_id; texts beyond
TEXT_BYTES are not learned from (they are scored like any). Fitting is seeded and is one task on an executor, of which
the driver sees the folded weights; its time and memory do not grow with the corpus. Only text goes into a score.

Since the softmax is linear in the averages, the two layers fold into one number per bucket for scoring: 1 MB is sent
to each worker.

Cases: null and empty texts have no words and get the score of the bias alone; labels that are null take no part; of rows
that repeat a labelled doc_id the least text is learned from, and the label is 1 if any is; a table without both labels
gives the share of label 1 (0 if there are none) as every score; a row without doc_id is scored, and is not held out;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._flat import _BYTE, LOWER, U64, Words, _ranges, buffers, mix, pieces

BITS, DIM, SIZES = 18, 4, (3, 4, 5)
PASSAGE, MIN_TEXTS = 4, 2
SAMPLE_DOCS, SAMPLE_BYTES, TEXT_BYTES = 1200, 3 << 20, 1 << 19
EPOCHS, RATE = 24, 0.05
SLICE = 1 << 18


def _edges() -> np.ndarray:
    """Bytes that separate words: white space and ASCII punctuation, controls and digits."""
    table = np.zeros(256, bool)
    for b in range(128):
        table[b] = not chr(b).isalpha()
    return table


EDGE = _edges()


def _buckets(raw: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's subwords, and where each word's begin. Edges are told apart by the n-gram's place."""
    values = _BYTE[raw]
    length = end - start
    found, owner = [], []
    for n in SIZES:
        own = np.maximum(length - n + 1, 0)
        word = np.repeat(np.arange(len(start)), own)
        at = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(own) - own, own)
        place = (at == start[word]).astype(U64) + U64(2) * (at + n == end[word]).astype(U64)
        found.append(mix(_ranges(values, at, at + n) + place))
        owner.append(word)
    found.append(mix(_ranges(values, start, end) + U64(7)))
    owner.append(np.arange(len(start)))
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (found[order] >> U64(64 - bits)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(start) + 1))


def _passages(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the PASSAGE values from each place on, and where each text's places begin (one more than texts). A text
    with values is filled up to PASSAGE by zeros; places too near its end for a passage hold -inf."""
    count = np.diff(at)
    begin = np.concatenate([[0], np.cumsum(np.where(count > 0, np.maximum(count, PASSAGE), 0))])
    n = int(begin[-1])
    spread = np.zeros(n + PASSAGE - 1, values.dtype)
    spread[np.arange(len(values)) + np.repeat(begin[:-1] - at[:-1], count)] = values
    out = sum(spread[k : n + k] for k in range(PASSAGE)) / PASSAGE
    ends = begin[1:][count > 0]
    for k in range(1, PASSAGE):
        out[ends - k] = -np.inf
    return out, begin


def _worst(logit: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with passages, and the first place of each one's greatest."""
    full = np.flatnonzero(np.diff(begin) > 0)
    if not len(full):
        return full, full
    size = np.diff(begin)[full]
    top = np.flatnonzero(logit == np.repeat(np.maximum.reduceat(logit, begin[full]), size))
    return full, top[np.unique(np.searchsorted(begin[full], top, "right"), return_index=True)[1]]


class Model:
    """weights: one number per bucket; bias."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights.astype(np.float32), float(bias), bits

    def score(self, text: pa.Array) -> np.ndarray:
        raw, offsets = buffers(text)
        out = [np.zeros(0)]
        for a, b in pieces(offsets, SLICE):
            words = Words(LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], EDGE)
            best = np.full(b - a, self.bias)
            if len(words.start):
                _, use, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
                bucket, at = _buckets(words.raw, words.start[use], words.end[use], self.bits)
                mean = np.add.reduceat(self.weights[bucket].astype(np.float64), at[:-1]) / np.diff(at)
                logit, begin = _passages(mean[place], words.at)
                full, top = _worst(logit, begin)
                best[full] += logit[top]
            out.append(1.0 / (1.0 + np.exp(-np.clip(best, -500, 500))))
        return np.concatenate(out)


def _vocabulary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the distinct words, the word at each place, and where each text's places begin."""
    raw, offsets = buffers(texts)
    hashes, at, kept, n = [np.zeros(0, U64)], [np.zeros(1, np.int64)], [(np.zeros(0, U64), np.zeros(0, np.uint8), np.zeros(0, np.int64))], 0
    for a, b in pieces(offsets, SLICE):
        words = Words(LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], EDGE)
        hashes.append(words.hashes())
        at.append(words.at[1:] + n)
        n += len(hashes[-1])
        own, use = np.unique(hashes[-1], return_index=True)
        size = words.end[use] - words.start[use]
        kept.append((own, words.raw[np.repeat(words.start[use] - np.cumsum(size) + size, size) + np.arange(size.sum())], size))
    known, bytes_, size = (np.concatenate(x) for x in zip(*kept))
    distinct, use = np.unique(known, return_index=True)
    end = np.cumsum(size)
    return bytes_, (end - size)[use], end[use], np.searchsorted(distinct, np.concatenate(hashes)).astype(np.int32), np.concatenate(at)


def fit(texts: pa.Array, labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Full-batch Adam over embeddings (buckets x dim) and softmax (dim x 2 and bias).

    In each epoch a text is stood for by its worst passage, so clean texts push down what they have in common with toxic
    ones. Both labels weigh the same in total. Buckets of fewer than MIN_TEXTS texts keep a zero vector.
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << bits), np.log(p / (1 - p)), bits)
    raw, start, end, place, at = _vocabulary(texts)
    n = len(start)
    if not n:
        return fit(texts, np.zeros(0), bits)
    bucket, first = _buckets(raw, start, end, bits)
    size = np.diff(first).astype(np.float32)
    spread = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    pair = np.unique(np.repeat(np.arange(len(y)), np.diff(at)) * n + place)  # text and word
    in_all = np.bincount(pair % n, minlength=n)
    in_one = np.bincount(pair % n, y[pair // n], n)
    keep = (np.bincount(bucket, in_all[spread], 1 << bits) >= min(MIN_TEXTS, len(y)))[bucket]
    kinds, bucket = np.unique(bucket[keep], return_inverse=True)
    spread, bucket = spread[keep], bucket.astype(np.int32)
    ones, every = np.bincount(bucket, in_one[spread], len(kinds)), np.bincount(bucket, in_all[spread], len(kinds))
    odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((every - ones + 0.5) / (len(y) - y.sum() + 1))
    rng = np.random.default_rng(0)
    params = [rng.normal(0, 0.01, (len(kinds), dim)), rng.normal(0, 0.1, (dim, 2)), np.array([1.0, -1.0])]
    params[0][:, 0] = odds * every / (every + 8.0)  # drawn to 0 where few texts have it
    params[1][0] = [-1.0, 1.0]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    count = np.diff(at)
    for step in range(1, epochs + 1):
        # The logit is linear in the words, so the worst passages are found by one number a word.
        told = (np.bincount(spread, (params[0] @ (params[1][:, 1] - params[1][:, 0]))[bucket], n) / size).astype(np.float32)
        logit, begin = _passages(told[place], at)
        full, top = _worst(logit, begin)
        inside = top - begin[full]
        spots = at[full, None] + inside[:, None] + np.arange(PASSAGE)  # places of the passages' words
        real = inside[:, None] + np.arange(PASSAGE) < count[full, None]
        words = place[np.where(real, spots, 0)]
        used, which = np.unique(words, return_inverse=True)  # the embeddings of their words alone
        index = np.full(n, -1)
        index[used] = np.arange(len(used))
        own = np.flatnonzero(index[spread] >= 0)
        vectors = np.stack([np.bincount(index[spread[own]], params[0][bucket[own], k], len(used)) for k in range(dim)], 1) / size[used, None]
        hidden = np.where(real[..., None], vectors[which.reshape(words.shape)], 0.0).sum(1) / PASSAGE
        z = hidden @ params[1] + params[2]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - np.stack([1 - y[full], y[full]], 1)) * weight[full, None]
        down = g @ params[1].T / PASSAGE
        grads = [np.zeros_like(params[0]), hidden.T @ g, g.sum(0)]
        for k in range(dim):
            word = np.bincount(which.ravel(), np.where(real, down[:, k, None], 0.0).ravel(), len(used)) / size[used]
            grads[0][:, k] = np.bincount(bucket[own], word[index[spread[own]]], len(kinds))
        for k, gradient in enumerate(grads):
            one[k] = 0.9 * one[k] + 0.1 * gradient
            two[k] = 0.99 * two[k] + 0.01 * gradient**2
            params[k] = params[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(1 << bits)
    weights[kinds] = params[0] @ (params[1][:, 1] - params[1][:, 0])
    return Model(weights, params[2][1] - params[2][0], bits)


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id, mod 5."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labels whose fold isn't 0. Sample of each label: by hash of doc_id, up to both bounds."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    marked = marked.where(fold(F.col("_id")) != 0).withColumn("_o", F.xxhash64("_id", F.lit("toxicity")))
    first = [marked.where(F.col("_y") == y).orderBy("_o", "_id").limit(sample_docs) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_t")).where("_t is not null").where(F.octet_length("_t") <= TEXT_BYTES)
    found = texts.join(F.broadcast(first[0].union(first[1])), "_id").groupBy("_id", "_y", "_o").agg(F.min("_t").alias("_t"))  # 2 * sample_docs ids at most
    so_far = F.sum(F.octet_length("_t")).over(Window.partitionBy("_y").orderBy("_o", "_id").rowsBetween(Window.unboundedPreceding, 0))
    sample = found.withColumn("_at", so_far).where(F.col("_at") <= sample_bytes).select("_id", "_y", "_t")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        model = fit(table["_t"].cast(pa.large_string()), table["_y"].to_numpy())
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias])})

    fitted = sample.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(one, "weights binary, bias double").collect()  # 4 bytes a bucket
    if not fitted:
        return fit(pa.array([], pa.large_string()), np.zeros(0))
    return Model(np.frombuffer(fitted[0].weights, np.float32), fitted[0].bias, BITS)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(model.score(batch["text"]))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, by a model that never saw a held-out label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs whose score is below the limit, columns as they were; the score is taken in the row, so nothing is joined."""
    model = train(docs, labels)

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text))

    return docs.where(rate(F.col("text").cast("string")) < limit)
