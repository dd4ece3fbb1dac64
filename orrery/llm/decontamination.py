"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are normalised (A-Z lower-cased; runs of white space and ASCII punctuation are one space) and cut into
pieces of 64 bytes, STEP bytes apart; an item no longer than that is one piece. STEP is a piece's budget of edits, so a
quotation of PIECE + STEP - 1 = 68 bytes of an item holds a whole piece, wherever it begins. A piece of m bytes within k edits of
some part of a document shares at least m - q + 1 - k * q of its q-grams with it, on diagonals that differ by at most k.
So shared q-grams are counted in overlapping diagonal bands, the bands that reach the bound are verified by banded
alignment, and a document is contaminated by an item if some piece is within k = floor(rate * m) edits.

The index holds the benchmark alone and is sent to the workers in blocks of bounded bytes: a benchmark beyond
``block_bytes`` means another pass over the documents, whose result is written before the next, never a larger broadcast
or a larger index in a worker. Documents are not shuffled.

Cases: null and empty texts match nothing; items without Q bytes after normalising take no part, as
they would be found in any text; items that repeat an
item_id or a text each report; a null item_id takes no part; other columns are ignored. Offsets are bytes of the UTF-8
text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._align import PLAIN, Patterns, matches, windows
from orrery.llm._store import Scratch

Q, PIECE, RATE = 8, 64, 0.08
STEP = int(PIECE * RATE)
BLOCK_BYTES = 8 << 20
RESULT = "doc_id long, item_id long, covered long, item_bytes long, edits long, start long, end long"


def benchmark_blocks(benchmark: DataFrame, block_bytes: int):
    """Lists of (item_id, text) of at most block_bytes each (or one item), in order of item_id."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    block, held = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if block and held + len(row.text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += len(row.text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, piece: int = PIECE, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it contains, wholly or in pieces."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch, done, block = Scratch(docs.sparkSession), None, None
    for items in benchmark_blocks(benchmark, block_bytes):
        if block is not None:  # one block's index at a time
            own = scratch.keep(block[0])
            block[1].destroy()
            done = own if done is None else done.unionByName(own)
        shared = docs.sparkSession.sparkContext.broadcast(windows(items, q, piece, rate))

        def search(batches, shared=shared):
            for batch in batches:
                rows = []
                for index in shared.value:
                    found = matches(index, batch["text"], index.find(batch["text"]))
                    rows += [(t, key, covered, index.total[key], edits, start, end) for (t, key), (covered, edits, start, end) in found.items()]
                cols = list(zip(*sorted(rows))) or [[]] * 7
                yield pa.record_batch([batch["doc_id"].take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "item_id", "covered", "item_bytes", "edits", "start", "end"])

        block = plain.mapInArrow(search, RESULT), shared
    if block is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    return block[0] if done is None else done.unionByName(block[0])


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair found."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs that contain no benchmark item, columns as they were; judged in the row, so nothing is joined."""
    clean, scratch, shared = docs, Scratch(docs.sparkSession), None
    for items in benchmark_blocks(benchmark, block_bytes):
        if shared is not None:  # one block's index at a time
            clean = scratch.keep(clean)
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(windows(items, Q, PIECE, RATE))
        clean = clean.where(~_leaks(shared)(F.col("text").cast("string")))
    return clean


def _leaks(shared):
    @F.arrow_udf("boolean")
    def leaks(text: pa.Array) -> pa.Array:
        found = np.zeros(len(text), bool)
        for index in shared.value:
            found[index.find(text)[0]] = True
        return pa.array(found)

    return leaks


def brute_force(rows: list[tuple[int, str | None]], items: list[tuple[int, str]], q: int = Q, piece: int = PIECE, rate: float = RATE) -> set[tuple[int, int]]:
    """(doc_id, item_id) by full alignment of every piece with every text; for tests. Of a piece within k edits, one of
    any k + 1 parts is in the text as it is, so texts without one are passed over."""
    class Plain(Patterns):
        def bound(self) -> None:
            pass

    index = Plain(items, q, piece, rate, max(1, int(piece * rate)))
    cuts = [[n * index.length[k] // (index.budget[k] + 1) for n in range(index.budget[k] + 2)] for k in range(len(index.owner))]
    parts = [[index.rows[k, a:b].tobytes() for a, b in zip(c, c[1:])] for k, c in enumerate(cuts)]
    sizes = {len(x) for p in parts for x in p}
    out = set()
    for i, text in rows:
        plain = b" ".join(PLAIN[list((text or "").encode())].tobytes().split()) if text else b""
        t, held = np.frombuffer(plain, np.uint8), {plain[a : a + n] for n in sizes for a in range(len(plain) - n + 1)}
        at = np.arange(len(t) + 1, dtype=np.int32)
        row, near = np.zeros_like(at), np.zeros_like(at)
        for k in range(len(index.owner)):
            if (i, int(index.owner[k])) in out or held.isdisjoint(parts[k]):
                continue
            row[:] = 0
            for n, c in enumerate(index.rows[k, : index.length[k]], 1):
                near[0] = n
                np.add(row[:-1], t != c, out=near[1:])
                row += 1
                np.minimum(near[1:], row[1:], out=near[1:])
                near -= at
                np.minimum.accumulate(near, out=row)
                row += at  # a step to the right costs one
            if row.min() <= index.budget[k]:
                out.add((i, int(index.owner[k])))
    return out
