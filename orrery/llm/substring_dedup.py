"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is cut into reference blocks, runs of neighbouring doc_ids of about equal bytes. Every block is indexed by
its phrases of ``window`` words; the index is dealt out over hash ranges, so that each block meets every other block's
phrases without any pair of blocks being formed, and learns of each of its own phrases which blocks before it hold it: the
first HOLDERS of them. A document is then factored greedily from left to right: a factor starts at a phrase that some
block holds (or a document before it in its own block), takes the reference block whose run of known phrases from there
on is the longest, and ends where that block knows no more; the next factor starts at the next known phrase. Only where
a phrase has more than HOLDERS holders may a block that goes on be overlooked, which cuts a factor in two; it never changes
which words are covered. Phrases that straddle two factors are looked up like any other, so no repeat is lost at a
boundary. Factors are at least ``window`` words long by construction; the words they cover are the duplicate spans.

Data moved: each text once (the exchange is shared by both passes), 8 bytes for each distinct phrase of a block, and
an answer of one bit for each of these and 4 bytes for each known holder. A block sends a phrase once however often it holds it, so hot passages shrink
before they are shuffled.

Cases: null and empty texts have no words and lose none; rows with a null doc_id are returned unchanged (they are no
reference and are judged against none); rows that repeat a doc_id are judged alike, and never against each other, so
they share a block (doc_id is a key; only its repeats can make a block larger than asked for); a document larger than a
block is one of its own; other columns are ignored. 64-bit phrase hashes stand for phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._flat import buffers, shingles, word_hashes

WINDOW = 13
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 4 << 20
HOLDERS = 4

FACTORS = "doc_id long, start int, n_words int, block int"
RESULT = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:int,n_words:int,block:int>>"


def block_starts(docs: DataFrame, block_bytes: int) -> tuple[np.ndarray, int]:
    """The first doc_id of each block, and the number of bytes. Sizes are dealt by ranges of doc_id and cut in order in each
    task, so blocks follow the data, however doc_ids are spread; 16 bytes a block reach the driver."""
    sizes = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"))

    def cut(batches):
        first, last, held = None, None, 0
        rows = []
        for batch in batches:
            for i, n in zip(batch["doc_id"].to_pylist(), batch["size"].to_pylist()):
                if first is None:
                    first = i
                elif held + n > block_bytes and i != last:
                    rows.append((first, held))
                    first, held = i, 0
                last, held = i, held + n
        rows += [(first, held)] * (first is not None)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[], []])], ["first", "bytes"])

    runs = sizes.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(cut, "first long, bytes long").collect()
    starts, held, total = [], 0, 0
    for first, n in sorted(tuple(r) for r in runs):  # what ends a task is joined to what begins the next
        if not starts or held + n > block_bytes:
            starts.append(first)
            held = 0
        held, total = held + n, total + n
    return np.array(starts or [0], np.int64), total


def assign_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int, int]:
    """docs (doc_id, text; no null doc_id) with ``_block``, non-decreasing in doc_id; the number of blocks and of bytes."""
    starts, total = block_starts(docs, block_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(starts)  # 8 bytes a block

    @F.pandas_udf("int")
    def block(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(shared.value, doc_id.to_numpy(np.int64), "right") - 1, 0).astype(np.int32))

    return docs.withColumn("_block", block("doc_id")), len(starts), total


def _phrases(table: pa.Table, window: int):
    """Of a block: documents' ids, words' starts, phrase hashes and first words, the distinct hashes and each one's place."""
    words, at = word_hashes(table["text"])
    hashes, first = shingles(words, at, window)
    distinct, place = np.unique(hashes, return_inverse=True)
    return table["doc_id"].to_numpy(), at, hashes, first, distinct, place


def greedy(holders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First phrase, number of phrases and block of the factors of a run of known phrases; holders: blocks that hold each
    phrase (row), in order and padded by -1."""
    out, i, n = [], 0, len(holders)
    while i < n:
        best, block = 0, -1
        for own in holders[i][holders[i] >= 0].tolist():
            end, step = i + 1, 32
            while end < n:  # look ahead in growing strides
                gone = np.flatnonzero(~(holders[end : end + step] == own).any(1))
                if len(gone):
                    end += int(gone[0])
                    break
                end, step = min(n, end + step), 2 * step
            if end - i > best:
                best, block = end - i, own
        out.append((i, best, block))
        i += best
    return tuple(np.array(c, np.int64) for c in zip(*out))


def _factor(table: pa.Table, answers: pa.Table, bits: int, window: int):
    """For each document of a block: index, number of words, flags of covered words, and factors."""
    ids, at, hashes, first, distinct, place = _phrases(table, window)
    own = table["_block"][0].as_py() if len(table) else 0
    known = np.full((len(distinct), HOLDERS + 1), -1, np.int32)
    bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    for row in answers.select(["_bucket", "hit", "n", "source"]).to_pylist():
        part = known[begins[row["_bucket"]] : begins[row["_bucket"] + 1]]
        hit = np.flatnonzero(np.unpackbits(np.frombuffer(row["hit"], np.uint8), count=len(part)))
        count = np.frombuffer(row["n"], np.uint8).astype(np.int64)
        spot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        part[np.repeat(hit, count), spot] = np.frombuffer(row["source"], np.int32)
    doc = np.searchsorted(at, first, "right") - 1
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids[doc])
    before = least[place] < ids[doc]  # a document before it in its own block
    hit = np.flatnonzero(before | (known[place, 0] >= 0))
    holders = known[place[hit]]
    holders[before[hit], HOLDERS] = own
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(doc[hit]) != 0)
    runs = np.append(np.flatnonzero(new), len(hit))
    same = np.ones(len(hit), bool)  # phrases whose holders are those of the phrase before: no factor ends between them
    same[1:] = (holders[1:] == holders[:-1]).all(1)
    factors = [np.zeros((3, 0), np.int64)]
    for a, b in zip(runs.tolist(), runs[1:].tolist()):
        if same[a + 1 : b].all():
            factors.append(np.array([[a], [b - a], [holders[a][holders[a] >= 0][0]]], np.int64))
        else:
            head, size, block = greedy(holders[a:b])
            factors.append(np.stack([head + a, size, block]))
    head, size, block = np.concatenate(factors, 1)
    length, start = size + window - 1, first[hit[head]]
    edge = np.zeros(at[-1] + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    covered = np.cumsum(edge[:-1]) > 0
    owner = doc[hit[head]]
    return at, covered, owner, start - at[owner], length, block.astype(np.int32)


def factor_documents(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the text left, words joined by one space) and factors
    (start word, number of words, reference block), in word order."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocked, n_blocks, n_bytes = assign_blocks(plain.where("doc_id is not null"), block_bytes)
    bits = max(6, int(np.ceil(np.log2(max(1, 1.5 * n_bytes / bucket_bytes)))))
    parts = max(2, -(-n_blocks // 2))
    blocked = blocked.repartition(parts, "_block")

    def index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        distinct = _phrases(table, window)[4]
        begins = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(begins))
        return pa.table({
            "_bucket": pa.array(full.astype(np.int32)),
            "_block": pa.array(np.full(len(full), key[0].as_py(), np.int32)),
            "phrases": pa.array([distinct[begins[k] : begins[k + 1]].tobytes() for k in full], pa.binary()),
        })

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        blocks = table["_block"].to_numpy()
        lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["phrases"]]
        sizes = np.array([len(x) for x in lists])
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")  # equal phrases stay in order of block
        ranked = every[order]
        head = np.ones(len(ranked), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        owner = np.repeat(blocks, sizes).astype(np.int32)[order]
        begin = np.maximum.accumulate(np.where(head, np.arange(len(ranked)), 0))
        count = np.empty(len(every), np.int64)  # holders before each one's own block that it is told of
        count[order] = np.minimum(np.arange(len(ranked)) - begin, HOLDERS)
        where = np.empty(len(every), np.int64)
        where[order] = begin
        rows, end = [], np.cumsum(sizes)
        for b, s, e in zip(blocks.tolist(), (end - sizes).tolist(), end.tolist()):
            n = count[s:e]
            if n.any():
                told = n[n > 0]
                spots = np.repeat(where[s:e][n > 0], told) + np.arange(told.sum()) - np.repeat(np.cumsum(told) - told, told)
                rows.append((b, np.packbits(n > 0).tobytes(), told.astype(np.uint8).tobytes(), owner[spots].tobytes()))
        return pa.table({
            "_block": pa.array([r[0] for r in rows], pa.int32()),
            "_bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "hit": pa.array([r[1] for r in rows], pa.binary()),
            "n": pa.array([r[2] for r in rows], pa.binary()),
            "source": pa.array([r[3] for r in rows], pa.binary()),
        })

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        at, covered, owner, start, length, source = _factor(table, answers, bits, window)
        raw, offsets = buffers(table["text"])
        lost = np.add.reduceat(np.append(covered, False).astype(np.int64), at[:-1]) if len(table) else np.zeros(0, np.int64)
        lost = np.where(np.diff(at) > 0, lost, 0)
        kept = []
        for k in range(len(table)):
            words = raw[offsets[k] : offsets[k + 1]].tobytes().split()
            if lost[k]:
                words = [w for w, gone in zip(words, covered[at[k] : at[k + 1]].tolist()) if not gone]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        runs = np.searchsorted(owner, np.arange(len(table) + 1))
        factors = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(source)], ["start", "n_words", "block"])
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(np.diff(at).astype(np.int64)), "n_removed": pa.array(lost), "kept": pa.array(kept, pa.string()),
            "factors": pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), factors),
        })

    sent = blocked.groupBy("_block").applyInArrow(index, "_bucket int, _block int, phrases binary")
    answers = sent.groupBy("_bucket").applyInArrow(meet, "_block int, _bucket int, hit binary, n binary, source binary")
    done = blocked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(remove, RESULT)

    def alone(batches):
        for batch in batches:
            text = [x.as_py() for x in batch["text"].cast(pa.binary())]
            words = [(t or b"").split() for t in text]
            yield pa.record_batch({
                "doc_id": pa.array([None] * len(words), pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64()),
                "n_removed": pa.array([0] * len(words), pa.int64()), "kept": pa.array([b" ".join(w).decode("utf-8", "replace") for w in words], pa.string()),
                "factors": pa.array([[]] * len(words), pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("block", pa.int32())]))),
            })

    return done.unionByName(plain.where("doc_id is null").mapInArrow(alone, RESULT))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 13 words; the digest of what is left, and the number of factors."""
    found = factor_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """What the contract says, by a plain table of first holders; for tests."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, own in words.items():
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out[i] = len(own), sum(gone), hashlib.sha256(kept).hexdigest()
    return out
