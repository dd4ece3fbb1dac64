import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import importance, prefix_trie
from oracle import SF, compare, connect


def pair(spark, schema, rows, **tables):
    """rows as a Spark table with extra columns, and all tables in DuckDB."""
    con = duckdb.connect()
    for name, own in tables.items():
        con.register(name, own)
    return spark.createDataFrame(rows, schema).withColumn("_b", F.lit(1)).withColumn("score", F.lit("x")), con


def arrow(names, types, rows):
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types))})


def test_importance(spark):
    ours, theirs = compare(importance.op12_importance(spark, SF), connect(), importance.OP12_SQL)
    assert ours == theirs


def test_importance_cases(spark):
    """Nulls, empty and very long texts, ties, repeated rows, letters beyond ASCII, words of one and of 5,000 letters."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["Aé", "b", "c-D", "٣x", "q" * 90, "zz"]) for _ in range(n))
    rows = [(k, text(rng.randrange(60))) for k in range(200)] + [(200, None), (201, ""), (None, text(40)), (202, text(50_000)), (203, "Q" * 5000), (204, "\x00\x7f a")]
    rows += [(3, rows[3][1])] * 5 + [(k, rows[7][1]) for k in range(300, 400)]
    target = [(1, text(30)), (2, None), (3, "")]
    docs, con = pair(spark, "doc_id long, text string", rows, documents=arrow(["doc_id", "text"], [pa.int64(), pa.string()], rows), benchmark=arrow(["item_id", "text"], [pa.int64(), pa.string()], target))
    bench = spark.createDataFrame(target, "item_id long, text string")
    got = importance.rank(docs, bench)
    ours, theirs = compare(got, con, importance.OP12_SQL)
    assert ours == theirs
    kept = importance.resample(docs.dropDuplicates(["doc_id"]), bench)
    assert kept.columns == docs.columns and 0 < kept.count() < 50
    assert importance.rank(docs.limit(0), bench).count() == 0
    assert importance.rank(docs, bench.limit(0)).where("rank is not null").count() == got.where("rank is not null").count()


@pytest.mark.parametrize("run", [2, 3])
def test_runs_of_words(run):
    texts = ["one Two  three", None, "", "x", "a-b-c-d é " * 3]
    got = {}
    for first, count, bucket, owner in importance.features(pa.array(texts), run, 997):
        for o, b in zip(owner, bucket):
            got.setdefault(int(o) + first, []).append(int(b))
    for k, text in enumerate(texts):
        own = "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("-", " ").split()
        want = [zlib.crc32(" ".join(own[i : i + n]).encode()) % 997 for n in range(1, run + 1) for i in range(len(own) - n + 1)]
        assert sorted(got.get(k, [])) == sorted(want)
    raw = np.frombuffer(b"y" * 300, np.uint8)
    assert importance.crc32(raw, np.array([0, 5, 9]), np.array([300, 5, 73])).tolist() == [zlib.crc32(b"y" * n) for n in (300, 0, 64)]


def test_prefix_trie(spark):
    ours, theirs = compare(prefix_trie.op13_prefix_trie(spark, SF), connect(), prefix_trie.OP13_SQL)
    assert ours == theirs


def talk(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for c in range(-20, n):
        for t in range(rng.choice([1, 2, 3, 4, 9, 12]) if rng.random() > 0.1 else 0):
            rows.append((None if rng.random() < 0.002 else c, None if rng.random() < 0.02 else t, rng.choice(["u", "a", None]) if t > 2 else "u", rng.choice(["x", "yé", "", None]) if t < 6 else "same"))
    return rows + rows[-3:]


@pytest.mark.parametrize("parts", [1, 3, 25])
def test_prefix_trie_blocks(spark, parts):
    """Whatever the blocks' edges cut: long shared paths, equal conversations, nulls, ties and repeated rows."""
    rows = talk(parts) + [(c, t, "u", "hot") for c in range(1000, 1400) for t in range(2)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    names, types = ["conv_id", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df, con = pair(spark, "conv_id long, turn long, role string, text string", rows, conversations=arrow(names, types, rows))
        ours, theirs = compare(prefix_trie.trie(df), con, prefix_trie.OP13_SQL)
        assert ours == theirs
        assert prefix_trie.trie(df.limit(0)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ends_in_order_of_number(spark):
    """More ids than one text of ids holds."""
    import hashlib

    ids = random.Random(1).sample(range(-50_000, 50_000), 20_000)
    rows = spark.createDataFrame([(b"k" if i % 3 else b"l", i) for i in ids], "class binary, conv_id long")
    got = {bytes(r["_class"]): r["ends_sha256"] for r in prefix_trie.ends(rows).collect()}
    for kind, own in ((b"k", [i for i in ids if i % 3]), (b"l", [i for i in ids if i % 3 == 0])):
        assert got[kind] == hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest()
