import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import suffix_dedup
from oracle import SF


def found(spark, rows, least=400, gram=64, **how):
    """Sorted result rows; the table has clashing columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("r1", F.lit(1)).withColumn("starts", F.lit(None).cast("int"))
    got = suffix_dedup.find_repeats(df, least, gram, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_repeats(seed):
    """Flags of every window of weighted pieces against a plain count, over alphabets of one byte, zeros and all bytes."""
    rng = random.Random(seed)
    least, alphabet = rng.choice([4, 9, 16, 20]), rng.choice([b"a", b"ab", b"abcdefgh", bytes(range(256)), b"\0a"])
    source = bytes(rng.choice(alphabet) for _ in range(200))
    pieces = {source[a : a + rng.randrange(least, 50)] for a in (rng.randrange(150) for _ in range(30))} | {bytes(rng.choice(alphabet) for _ in range(rng.randrange(least, 40))) for _ in range(5)}
    pieces = sorted(pieces)
    weight = np.array([rng.choice([1, 1, 2]) for _ in pieces], float)
    count = Counter()
    for p, w in zip(pieces, weight):
        for k in range(len(p) - least + 1):
            count[p[k : k + least]] += w
    for p, got in zip(pieces, suffix_dedup.repeats(pieces, weight, least)):
        own = {k for a, b in zip(got[::2], got[1::2]) for k in range(a, b)}
        assert own == {k for k in range(len(p) - least + 1) if count[p[k : k + least]] >= 2}


def test_runs_cover_all_windows():
    """Each window is in one run, and its anchor's hash depends on its bytes alone."""
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 3, 3000).astype(np.uint8)
    raw[1000:1300] = raw[100:400]
    first, m, key = suffix_dedup.runs(raw, 40, 8)
    assert np.array_equal(np.repeat(first, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m), np.arange(3000 - 39))
    of = dict(zip(range(3000 - 39), np.repeat(key, m).tolist()))
    assert [of[k] for k in range(100, 360)] == [of[k] for k in range(1000, 1260)]
    assert len(suffix_dedup.runs(raw[:39], 40, 8)[0]) == 0


def texts(seed):
    """Nulls, empties, copies, shared passages with other surroundings, characters of several bytes, periodic texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(150)
    rows = [(0, None), (1, ""), (2, "x"), (None, passage), (3, "ab" * 700), (4, "c" * 3000), (5, text(4000))]
    rows += [(k, text(rng.randrange(80)) + passage + text(rng.randrange(80))) for k in range(10, 60)]
    rows += [(k, rows[12][1]) for k in range(60, 70)] + [(70, rows[9][1][37:]), (71, passage[:300] + "!" + passage[300:])]
    return rows + [rows[15]] * 4


def test_find_repeats(spark):
    rows = texts(1)
    want = sorted(suffix_dedup.brute_force(rows), key=repr)
    assert found(spark, rows) == want
    assert found(spark, rows, block=3000, hot=3) == want  # many transforms; most anchors by digests of windows
    assert found(spark, []) == []


def test_copies_are_not_transformed(spark, monkeypatch):
    """Pieces that are found twice or more each, and no others with their anchors, need no transform; those beside a piece of
    another text do."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = text(3000), text(900), text(500)
    rows = [(1, a), (2, a), (3, b), (4, b), (5, b)]
    with monkeypatch.context() as m:
        m.setattr(suffix_dedup, "repeats", lambda *_: 1 / 0)
        assert found(spark, rows) == sorted(suffix_dedup.brute_force(rows), key=repr)
    rows += [(6, "x" + b[100:]), (7, a[:1500] + c), (8, c)]
    assert found(spark, rows) == sorted(suffix_dedup.brute_force(rows), key=repr)
    assert found(spark, rows, hot=0) == sorted(suffix_dedup.brute_force(rows), key=repr)


@pytest.mark.parametrize("n", [300, 5000, 40_000])
def test_suffix_order(n):
    """Against a plain sort, with as many ranks a number as the size allows (7, 4 and 3), and ends within every round."""
    rng = np.random.default_rng(n)
    pieces = [bytes(rng.choice(list(b"ab"), rng.integers(1, 30))) * int(rng.integers(1, 40)) for _ in range(1 + n // 300)]
    size = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    left = np.repeat(np.cumsum(size + 1) - 1, size + 1) - np.arange(len(text))
    order = suffix_dedup.suffix_order(text, left, 400)
    raw, ends = text.tobytes(), left.tolist()
    key = lambda k: raw[k : k + min(ends[k], 400)] + b"\0" * (ends[k] < 400)
    got = [key(k) for k in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(text))) and got == sorted(got)


def test_sort_rounds(monkeypatch):
    """A sort of 400 bytes takes one round for 8 bytes and four more, as several ranks share a number."""
    piece = bytes(np.random.default_rng(3).integers(97, 123, 30_000).astype(np.uint8))
    text = np.frombuffer(piece + b"\0" + piece + b"!\0", np.uint8)
    left = np.concatenate([np.arange(30_000, -1, -1), np.arange(30_001, -1, -1)])
    calls, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or plain(*a, **k))
    suffix_dedup.suffix_order(text, left, 400)
    assert len(calls) <= 5


def test_short_windows(spark):
    rows = texts(2)[:40]
    assert found(spark, rows, 50, 12) == sorted(suffix_dedup.brute_force(rows, 50), key=repr)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(suffix_dedup.brute_force([tuple(r) for r in docs]), key=repr)
    got = suffix_dedup.op11_suffix_dedup(spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == want
