"""Exact substring dedup by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A string of LEAST bytes is a window. Windows that may be equal must meet in one transform, so each is dealt by its anchor, the
GRAM bytes in it that have the least hash (the first, if tied): a function of the window's own bytes. Neighbouring windows of a document
with one anchor travel as one piece, the bytes they span; equal pieces are counted into one with a weight, and a piece whose anchor stands
nowhere else has no repeats and does not travel at all; nor do the pieces of an anchor that are all counted twice or more, as
each of their windows is a repeat. What is left is one text a different piece, from one document that holds it.

In a task, the pieces of some anchors (BLOCK bytes of them, or one anchor's) are sorted by their suffixes' first LEAST bytes, which gives
the Burrows-Wheeler transform. Starting from the intervals of single bytes, every interval is extended backwards by each byte
before it, breadth first, so common prefixes come out by increasing length: an edge of intervals that first shows at
strings of length v + 1 has the common prefix v. At LEAST the search stops; edges that have not shown by then
stand between suffixes that share LEAST bytes or more, and the windows between two edges that have are equal. Where
their weights add up to two or more, they are repeats.

An anchor with more than HOT different pieces (the edge of a passage in a large part of all documents) isn't given to one
task: digests of its windows are counted over all tasks, which is exact as well.

Cases: null and empty texts are empty; texts below LEAST bytes lose nothing; a text that repeats itself is judged like any
other, and rows that repeat a doc_id are documents each; a null doc_id is a doc_id; what is left of a text may cut a
character in two, as it is bytes; other columns are ignored.
128-bit digests stand for pieces, documents and hot windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._flat import U64, buffers, mix
from orrery.llm._store import Scratch

LEAST, GRAM = 400, 64
BLOCK, HOT = 1 << 19, 4096
SLICE, ROWS = 1 << 20, 1 << 15
ODD = mix(np.arange(1, 9, dtype=U64)) | U64(1)
RUNS = "r1 long, r2 long, key long, c1 long, c2 long, m int, starts array<int>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(raw: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """Of one document: first window, number of windows and anchor's hash of each run of windows with one anchor. Anchors are picked
    by a hash of all their bytes (gram: 8 to 64; of a multiple of 8): fewer of them, and repeated words would bring anchors close together."""
    n, width = len(raw) - least + 1, least - gram + 1
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))]
    for a in range(0, max(n, 0), SLICE):
        b = min(n, a + SLICE)
        part = np.concatenate([raw[a : b + least - 1], np.zeros(8, np.uint8)])
        n_at = b - a + width - 1
        words = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,)).copy()
        marks = np.zeros(n_at, U64)  # high bits depend on all bytes of the anchor
        for k, odd in zip(range(0, gram - 7, 8), ODD):
            marks += words[k : k + n_at] * odd
        marks &= U64(0xFFFFFFFFFF000000)
        marks |= np.arange(n_at, dtype=U64)
        anchor = (_least(marks, width) & U64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        own, view = anchor[first].tolist(), memoryview(part)
        key = np.frombuffer(b"".join([hashlib.blake2b(view[k : k + gram], digest_size=8).digest() for k in own]), U64)
        out.append((first + a, np.diff(np.append(first, b - a)), key))
    return tuple(np.concatenate(c) for c in zip(*out))


def _digests(raw: memoryview, start: list[int], end: list[int]) -> np.ndarray:
    """128 bits of raw[start:end] for each pair, as two signed numbers."""
    new = hashlib.blake2b
    return np.frombuffer(b"".join([new(raw[a:b], digest_size=16).digest() for a, b in zip(start, end)]), np.int64).reshape(-1, 2)


def suffix_order(text: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Places of text in order of their suffixes' first ``least`` bytes. left: bytes before the end of the place's piece, which
    sorts below every byte, the earlier end first; 0 at the end itself."""
    n = len(text)
    word = np.ndarray((n,), ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), 0, (1,)).astype(U64)
    near = np.flatnonzero(left < 8)  # those that end within the word
    cut = ((8 - left[near]) * 8).astype(U64)
    word[near] = np.where(cut >= 64, U64(0), (word[near] >> np.minimum(cut, U64(63))) << np.minimum(cut, U64(63)))
    near = near[np.lexsort((near, left[near], word[near]))]
    far = np.flatnonzero(left >= 8)
    far = far[np.argsort(word[far])]
    order = np.insert(far, np.searchsorted(word[far], word[near], "left"), near)
    new = np.ones(n, bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (left[order[1:]] < 8) | (left[order[:-1]] < 8)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    depth, bits = 8, n.bit_length()
    while depth < least:
        again = np.flatnonzero(~new | np.append(~new[1:], False))  # what still ties
        if not len(again):
            break
        own = order[again]
        key = rank[own].astype(np.int64)
        ranks = min(63 // bits, -(-least // depth))  # as many as a number holds; one that ends before the next is no other's
        for k in range(1, ranks):
            key = key << bits | rank[np.minimum(own + k * depth, n - 1)]
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[again] = own
        new[again[1:]] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new[again], again, 0))
        depth *= ranks
    return order


def edges(text: np.ndarray, left: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Which places of the order (and one more) begin with fewer than ``least`` bytes in common with the one before."""
    n, ends = len(text), int(np.count_nonzero(left == 0))
    before = text[order - 1].astype(np.int16)
    before[(order == 0) | (left[order - 1] == 0)] = 256  # begins of pieces have nothing before them
    by = np.argsort(before, kind="stable")[: n - ends]
    step = np.full(n, -1, np.int32)  # the place of the suffix that is longer by a byte
    step[by] = np.arange(ends, n)
    last, following = np.full(n, -1, np.int32), np.full(n, n, np.int32)  # where the same byte stood before, and stands next
    same = before[by[1:]] == before[by[:-1]]
    last[by[1:][same]] = by[:-1][same]
    following[by[:-1][same]] = by[1:][same]
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(by) else np.zeros(0, np.int64)
    low, high = ends + heads, ends + np.append(heads[1:], len(by))[: len(heads)]
    shown = np.zeros(n + 1, bool)
    shown[: ends + 1] = shown[n] = True
    shown[high] = True
    for _ in range(1, least):  # strings of so many bytes are extended
        one = high - low == 1
        alone = step[low[one]]
        alone = alone[alone >= 0]
        a, size = low[~one], (high - low)[~one]
        b = np.repeat(a + size, size)
        rows = np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)
        a = np.repeat(a, size)
        whole = step[rows] >= 0
        first, end = np.sort(step[rows[whole & (last[rows] < a)]]), np.sort(step[rows[whole & (following[rows] >= b)]])
        low, high = np.concatenate([alone, first]), np.concatenate([alone, end]) + 1
        fresh = ~shown[high]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        shown[high] = True
    return shown


def repeats(pieces: list[bytes], weight: np.ndarray, least: int = LEAST) -> list[list[int]]:
    """Of each piece, begins and ends of the runs of windows that are found twice or more in all, a piece counting ``weight`` times."""
    size = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    stop = np.cumsum(size + 1) - 1
    left = np.repeat(stop, size + 1) - np.arange(len(text))
    order = suffix_order(text, left, least)
    group = np.cumsum(edges(text, left, order, least)[:-1]) - 1
    whole = left[order] >= least
    owner = np.searchsorted(stop, order)
    held = np.bincount(group[whole], weight[owner[whole]], minlength=int(group[-1]) + 1)
    found = np.zeros(len(text) + 1, np.int8)
    found[order[whole & (held[group] >= 2)]] = 1
    change = np.flatnonzero(np.diff(found, prepend=0))
    own = np.searchsorted(stop, change[::2])
    out: list[list[int]] = [[] for _ in pieces]
    base = stop - size
    for k, a, b in zip(own.tolist(), change[::2].tolist(), change[1::2].tolist()):
        out[k] += [a - int(base[k]), b - int(base[k])]
    return out


def find_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept (the bytes left)."""
    scratch = Scratch(docs.sparkSession)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(doc_id.alias("doc_id"), text.alias("text"), *[F.xxhash64(F.lit(k), doc_id, text).alias(f"r{k}") for k in (1, 2)])

    def cut(batches):
        held, rows = [], 0

        def told():
            r1, r2, key, c1, c2, m, count, starts = (np.concatenate(c) for c in zip(*held))
            at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            return pa.record_batch([*map(pa.array, (r1, r2, key, c1, c2, m)), pa.ListArray.from_arrays(at, pa.array(starts))], ["r1", "r2", "key", "c1", "c2", "m", "starts"])

        for batch in batches:
            raw, at = buffers(batch["text"])
            view = memoryview(raw)
            ids = [batch[c].to_numpy() for c in ("r1", "r2")]
            for k in np.flatnonzero(np.diff(at) >= least).tolist():
                a = int(at[k])
                first, m, key = runs(raw[a : at[k + 1]], least, gram)
                digest = _digests(view, (first + a).tolist(), (first + a + m + least - 1).tolist())
                order = np.lexsort((first, digest[:, 1], digest[:, 0]))
                new = np.ones(len(order), bool)
                new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(1)
                head = np.flatnonzero(new)
                own, n = order[head], len(head)
                held.append((np.full(n, ids[0][k]), np.full(n, ids[1][k]), key[own].view(np.int64), digest[own, 0], digest[own, 1], m[own].astype(np.int32), np.diff(np.append(head, len(order))), first[order].astype(np.int32)))
                rows += len(order)
                if rows > ROWS:  # documents share a batch of rows
                    yield told()
                    held, rows = [], 0
        if held:
            yield told()

    found = scratch.keep(plain.select("r1", "r2", "text").mapInArrow(cut, RUNS))
    classes = found.groupBy("key", "c1", "c2").agg(F.sum(F.size("starts")).alias("n"), F.min("r1").alias("rep"))
    keys = classes.groupBy("key").agg(F.sum("n").alias("_n"), (F.count("*") > hot).alias("hot"), (F.min("n") > 1).alias("whole")).where("_n > 1").drop("_n")
    alive = classes.join(keys, "key").drop("key")
    held = scratch.keep(found.join(alive, ["c1", "c2"]).withColumn("rep", F.col("rep") == F.col("r1")))
    scratch.drop(found)
    wanted = held.where("rep and not whole").groupBy("r1", "r2").agg(F.collect_set(F.struct("c1", "c2", "key", "n", "hot", F.element_at("starts", 1).alias("a"), F.col("m"))).alias("wanted"))

    def tell(batches):
        seen, rows, size = None, [], 0

        def told():
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["key", "c1", "c2", "n", "hot", "piece"])

        for batch in batches:
            raw, at = buffers(batch["text"])
            for k, own in enumerate(batch["wanted"].to_pylist()):
                now = (batch["r1"][k].as_py(), batch["r2"][k].as_py())
                if own and now != seen:
                    for w in own:
                        a = int(at[k]) + w["a"]
                        rows.append((w["key"], w["c1"], w["c2"], w["n"], w["hot"], raw[a : a + w["m"] + least - 1].tobytes()))
                        size += w["m"] + least
                seen = now
                if size > BLOCK:
                    yield told()
                    rows, size = [], 0
        if rows:
            yield told()

    pieces = scratch.keep(plain.select("r1", "r2", "text").join(wanted, ["r1", "r2"]).mapInArrow(tell, "key long, c1 long, c2 long, n long, hot boolean, piece binary"))

    def expand(batches):
        rows, bytes_held, last = [], 0, None

        def flush():
            spans = repeats([r[3] for r in rows], np.array([r[2] for r in rows], float), least)
            out = [(r[0], r[1], s) for r, s in zip(rows, spans) if s]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["c1", "c2", "spans"])

        for batch in batches:
            for key, c1, c2, n, piece in zip(*(batch[c].to_pylist() for c in ("key", "c1", "c2", "n", "piece"))):
                if rows and key != last and bytes_held + len(piece) > block:
                    yield from flush()
                    rows, bytes_held = [], 0
                last = key
                if not rows or (c1, c2) != rows[-1][:2]:
                    rows.append((c1, c2, n, piece))
                    bytes_held += len(piece) + 1
        if rows:
            yield from flush()

    def each(batches):
        for batch in batches:
            for c1, c2, n, piece in zip(*(batch[c].to_pylist() for c in ("c1", "c2", "n", "piece"))):
                m = len(piece) - least + 1
                digest = _digests(memoryview(piece), range(m), range(least, least + m))
                yield pa.record_batch([*map(pa.array, (digest[:, 0], digest[:, 1], np.full(m, c1), np.full(m, c2), np.full(m, n), np.arange(m, dtype=np.int32)))], ["w1", "w2", "c1", "c2", "n", "i"])

    few = pieces.where("not hot").repartition("key").sortWithinPartitions("key", "c1", "c2").mapInArrow(expand, "c1 long, c2 long, spans array<int>")
    windows = pieces.where("hot").dropDuplicates(["c1", "c2"]).mapInArrow(each, "w1 long, w2 long, c1 long, c2 long, n long, i int")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    many = windows.join(twice, ["w1", "w2"]).groupBy("c1", "c2").agg(F.flatten(F.transform(F.collect_list("i"), lambda i: F.array(i, i + 1))).alias("spans"))
    own = ["r1", "r2", "c1", "c2", "starts"]
    back = held.where("not whole").select(*own).join(few.unionByName(many), ["c1", "c2"]).select(*own, "spans")
    back = back.unionByName(held.where("whole").select(*own, F.array(F.lit(0), F.col("m")).alias("spans")))
    gone = back.groupBy("r1", "r2").agg(F.collect_set(F.struct("starts", "spans")).alias("gone"))

    def remove(batches):
        for batch in batches:
            raw, at = buffers(batch["text"])
            n_removed, n_spans, kept = [], [], []
            for k, own in enumerate(batch["gone"].to_pylist()):
                part = raw[at[k] : at[k + 1]]
                edge = np.zeros(len(part) + 1, np.int32)
                for g in own or ():
                    starts, spans = np.array(g["starts"])[:, None], np.array(g["spans"]).reshape(-1, 2)
                    np.add.at(edge, (starts + spans[:, 0]).ravel(), 1)
                    np.add.at(edge, (starts + spans[:, 1] + least - 1).ravel(), -1)
                covered = np.cumsum(edge[:-1]) > 0
                n_removed.append(int(covered.sum()))
                n_spans.append(int(np.count_nonzero(covered[1:] & ~covered[:-1])) + int(len(covered) > 0 and covered[0]))
                kept.append(part[~covered].tobytes())
            yield pa.record_batch([batch["doc_id"], pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return plain.join(gone, ["r1", "r2"], "left").select("doc_id", "text", "gone").mapInArrow(remove, RESULT)


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 400 bytes; the digest of what is left."""
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], least: int = LEAST) -> list[tuple]:
    """What the contract says, by a plain count of all windows; for tests."""
    from collections import Counter

    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + least] for t in texts for k in range(len(t) - least + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - least + 1):
            if count[t[k : k + least]] > 1:
                gone[k : k + least] = b"\1" * least
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
