import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orrery.llm import _align, _flat, decontamination, license_scan, mixing, near_dedup, neighbours, pii, sharding, substring_dedup, toxicity, url_filter
from orrery.llm._store import Scratch
from oracle import SF, compare, connect

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empties, one very long text, copies, near copies, a shared passage, ties and repeated rows."""
    rng = random.Random(3)
    shared = words(rng, 30)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, " ".join(words(rng, 20000)))]
    for i in range(6, 60):
        rows.append((i, " ".join(words(rng, 40) + shared * (i % 3 == 0) + words(rng, 40))))
    for i in range(60, 80):
        own = rows[6 + i % 5][1].split(" ")
        own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own) if i % 2 else rows[6 + i % 5][1]))
    return rows


def frame(spark, rows):
    """documents with extra columns whose names an operator might use itself."""
    df = spark.createDataFrame([(i, t, None if i is not None and i % 7 == 0 else "en", f"src{(i or 0) % 3}" if i != 9 else None, None) for i, t in rows], DOC)
    return df.withColumn("key", F.lit(1)).withColumn("_block", F.lit("x")).withColumn("shard", F.lit(None).cast("int"))


def test_substring_dedup(spark, corpus):
    rows = corpus + [(90, corpus[8][1])]
    want = substring_dedup.brute_force(rows)
    got = substring_dedup.factor_documents(frame(spark, rows + [(None, corpus[8][1])]), block_bytes=1500, bucket_bytes=512)
    out = {r.doc_id: r for r in got.withColumn("digest", F.sha2("kept", 256)).collect()}
    assert {i: (r.n_words, r.n_removed, r.digest) for i, r in out.items() if i is not None} == want
    assert out[None].n_removed == 0 and all(f.n_words >= 13 for r in out.values() for f in r.factors)
    assert substring_dedup.factor_documents(frame(spark, [])).count() == 0


def test_substring_factors(spark):
    """Factors are the longest that one reference block holds, by plain sets of phrases; and cover what they must."""
    rng = random.Random(21)
    base = words(rng, 400, 10**6)
    rows = [(1, " ".join(base[:200])), (2, " ".join(base[100:130])), (3, " ".join(base[150:400])), (4, " ".join(base[90:260])), (5, " ".join(base[20:60] + base[300:340] + base[60:100])), (6, " ".join(words(rng, 50)))]
    df = frame(spark, rows)
    got = {r.doc_id: [(f.start, f.n_words, f.block) for f in r.factors] for r in substring_dedup.factor_documents(df, block_bytes=1, bucket_bytes=512).collect()}
    block = {i: k for k, (i, _) in enumerate(rows)}  # one document a block
    split = {i: t.split(" ") for i, t in rows}
    phrases = {i: [tuple(w[k : k + 13]) for k in range(len(w) - 12)] for i, w in split.items()}
    for i, own in phrases.items():
        want, k = [], 0
        while k < len(own):
            best = (0, 0)
            for j in sorted(x for x in phrases if x < i):
                n = next((n for n in range(len(own) - k) if own[k + n] not in phrases[j]), len(own) - k)
                best = max(best, (n, -block[j]))
            if best[0]:
                want.append((k, best[0] + 12, -best[1]))
            k += max(1, best[0])
        assert got[i] == want, i
    assert got[4] == [(0, 110, 0), (98, 72, 2)] and got[6] == []


def test_substring_blocks(spark):
    """Outlying and clustered ids: blocks follow the bytes, and answers stay right."""
    rng = random.Random(2)
    shared = words(rng, 20)
    ids = [-(9 * 10**18), 9 * 10**18] + list(range(1000, 1600)) + [10**12 + 7 * i for i in range(200)]
    rows = [(i, " ".join(words(rng, 30) + shared * (k % 4 == 0))) for k, i in enumerate(ids)]
    df = frame(spark, rows)
    dealt, n, total = substring_dedup.assign_blocks(df.select("doc_id", "text"), 4000)
    sizes = dealt.groupBy("_block").agg(F.sum(F.octet_length("text") + 8).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("_block").collect()
    assert len(sizes) == n and sum(r.n for r in sizes) == total and max(r.n for r in sizes) <= 2 * 4000 and n <= 2.5 * total / 4000
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))
    got = substring_dedup.factor_documents(df, block_bytes=4000, bucket_bytes=512).withColumn("digest", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.digest) for r in got} == substring_dedup.brute_force(rows)


@pytest.mark.parametrize("n", [2, 5])
def test_near_dedup(spark, corpus, n, monkeypatch):
    monkeypatch.setattr(near_dedup, "DENSE", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    want = near_dedup.brute_force(corpus, n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_components(frame(spark, corpus + corpus[:3]), n).collect()}
    assert got == want


def test_near_dedup_dense(spark, monkeypatch):
    """Large buckets of texts that resemble each other around the limit: a group of near copies, strays, and chains."""
    monkeypatch.setattr(near_dedup, "DENSE", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(8)
    base = words(rng, 60)
    rows = []
    for i in range(150):
        own, changed = list(base), 1 if i < 60 else rng.randrange(3, 9)
        for _ in range(changed):
            own[rng.randrange(60)] = f"x{rng.randrange(12) if i % 3 else i}"
        rows.append((1000 - i, " ".join(own)))
    for i in range(30):  # each like the one before only
        rows.append((i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 60))))
    want = near_dedup.brute_force(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_components(frame(spark, rows), 2).collect()}
    assert got == want and 20 < len({c for _, c in want.values()}) < 160


def test_near_dedup_links(spark, monkeypatch):
    """What a group of near copies makes is in proportion to its size: two links a class at most go into components."""
    seen = []
    plain = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda links, scratch: (seen.append(links.count()), plain(links, scratch))[1])
    rng = random.Random(9)
    base = words(rng, 40)
    for n in (100, 200):
        rows = []
        for i in range(n):
            own = list(base)
            for _ in range(4):
                own[rng.randrange(40)] = f"y{i}-{rng.randrange(99)}"
            rows.append((i, " ".join(own)))
        seen.clear()
        near_dedup.find_components(frame(spark, rows), 2).count()
        assert seen and max(seen) <= 2 * n


def test_near_dedup_edges(spark):
    kept = near_dedup.drop_near_copies(frame(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)]))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert near_dedup.find_components(frame(spark, [])).count() == 0
    texts = [" ".join(words(random.Random(k), 30)) for k in range(3)]  # one document of three texts, each of which others have
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(5, t) for t in texts] + [(9, "something else")]
    assert {(r.doc_id, r.component_id) for r in near_dedup.find_components(frame(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 1), (5, 1), (9, 9)}


def test_decontamination(spark):
    rng = random.Random(5)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(1, letters(14)), (2, letters(40)), (3, "tiny"), (4, None)]
    edited = list(items[0][1])
    for k in (10, 30, 50):
        edited[k] = "z"
    docs = [(0, None), (1, ""), (2, letters(50)), (3, letters(9) + " " + items[0][1].upper() + ", " + letters(9)), (4, "".join(edited)), (5, letters(5) + items[1][1].replace(" ", "\n")), (6, letters(5) + " tiny " + letters(3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(frame(spark, docs), bench)
    want = decontamination.brute_force(docs, [x for x in items if x[1]])
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want == {(3, 1), (4, 1), (5, 2)}
    assert decontamination.find_leaks(frame(spark, docs), bench, block_bytes=50).count() == 3
    clean = decontamination.drop_leaks(frame(spark, docs), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 6] and clean.columns == frame(spark, docs).columns
    assert decontamination.find_leaks(frame(spark, docs), bench.where("false")).count() == 0


def test_decontamination_quotations(spark):
    """A verbatim quotation of 68 bytes is found wherever it begins, as is one with an edit in 80."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    items = [(1, letters(240)), (2, letters(163))]
    docs = [(1000 * i + a, letters(40) + " " + t[a : a + 68] + " " + letters(50)) for i, t in items for a in range(len(t) - 67)]
    docs += [(5000 + a, letters(9) + items[0][1][a : a + 40] + "!" + items[0][1][a + 41 : a + 80]) for a in range(0, 160, 7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(frame(spark, docs), bench).collect()}
    assert set(got) == {(i, 1 if i >= 5000 else i // 1000) for i, _ in docs} == decontamination.brute_force(docs, items)
    assert all(r.edits <= 10 and 64 <= r.covered <= 92 for r in got.values()), [r for r in got.values() if not (r.edits <= 10 and 64 <= r.covered <= 92)][:5]
    assert decontamination.drop_leaks(frame(spark, docs + [(1, letters(300))]), bench).count() == 1


def test_decontamination_lengths(spark):
    """Items of every length, whole and with an edit in the middle, in blocks and at once: as by full alignment."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    items = [(n, letters(n)) for n in range(1, 201)]
    docs = [(n, letters(30) + " " + t + " " + letters(30)) for n, t in items]
    docs += [(1000 + n, letters(30) + " " + t[: n // 2] + "z" + t[n // 2 + 1 :] + " " + letters(30)) for n, t in items]
    docs += [(5000, letters(300000) + " " + items[150][1] + " " + letters(300000)), (None, items[99][1]), (1, docs[0][1])]
    bench = spark.createDataFrame(items + [(None, items[50][1]), (7, items[70][1])], "item_id long, text string")
    want = decontamination.brute_force([d for d in docs if d[0] != 5000], items + [(7, items[70][1])])
    for size in (8 << 20, 2000):
        got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, docs), bench, block_bytes=size).collect()}
        assert got == want | {(5000, 151)} and {(1000 + n, n) for n in range(13, 201)} <= got
        clean = decontamination.drop_leaks(frame(spark, docs), bench, block_bytes=size)
        assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT-notice"]
    docs = [(0, None), (1, ""), (2, "some text. Released under the MIT License. more"), (3, "x " + mit.replace("free", "fee").lower()), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "no notice of any kind here")]
    got = {(r.doc_id, r.license, r.coverage == 1.0) for r in license_scan.scan(frame(spark, docs)).collect()}
    assert got == {(2, "MIT", True), (3, "MIT-notice", True), (4, "GPL-3.0", True)}
    assert license_scan.scan(frame(spark, []), {}).count() == license_scan.scan(frame(spark, docs), {}).count() == license_scan.scan(frame(spark, [])).count() == 0


def test_license_blocks(spark):
    """One template a block or all in one, long texts, nulls, repeated rows, and pieces that stand far apart: as by
    aligning each template with each text."""
    rng = random.Random(4)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    own = {f"t{k}": letters(n) for k, n in enumerate((12, 30, 60, 200))}
    own["t4"] = own["t2"] + " " + letters(10)
    docs = [(0, None), (1, ""), (None, own["t1"]), (2, letters(40000) + " " + own["t3"] + " " + letters(40000))]
    docs += [(10 + k, letters(20) + " " + t.upper() + "! " + letters(20)) for k, t in enumerate(own.values())] * 2
    cut = own["t3"].split(" ")
    docs += [(30, letters(3000).join(" ".join(cut[a : a + 40]) for a in range(0, 200, 40))), (31, own["t1"] + " " + letters(500) + " " + own["t1"])]

    def edits(pattern, text):  # the fewest against any part of text
        row = np.zeros(len(text) + 1, int)
        t = np.frombuffer(text, np.uint8)
        for n, c in enumerate(pattern, 1):
            near = np.minimum(np.concatenate([[n], row[:-1] + (t != c)]), row + 1)
            row = np.minimum.accumulate(near - np.arange(len(near))) + np.arange(len(near))
        return row.min()

    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()).encode()
    want = set()
    for i, t in docs:
        near = {n: edits(norm(x), norm(t or "")) for n, x in own.items()} if len(t or "") < 20000 else {n: 0 if norm(x) in norm(t) else 999 for n, x in own.items()}
        held = {n for n, e in near.items() if e <= 0.12 * len(norm(own[n]))}
        want |= {(i, n) for n in held}
    results = []
    for size in (4 << 20, 1):
        rows = license_scan.scan(frame(spark, docs), own, block_bytes=size).collect()
        assert {(r.doc_id, r.license) for r in rows if r.license not in ("t2", "t4")} == {x for x in want if x[1] not in ("t2", "t4")} and len(rows) == len({(r.doc_id, r.license) for r in rows})
        assert {(12, "t2"), (14, "t4")} <= {(r.doc_id, r.license) for r in rows}
        results.append(sorted(rows, key=lambda r: (r.doc_id or -1, r.license)))
        twice = next(r for r in rows if r.doc_id == 31)
        assert twice.coverage == 1.0 and (twice.start, twice.end) == (0, len(own["t1"]))
    assert results[0] == results[1]


def test_license_notices_and_texts(spark):
    full = license_scan.full_texts()
    notice = {n: license_scan.TEMPLATES[f"{n}-notice"] for n in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC-BY-SA-4.0")}
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"):  # worded as their publishers do
        statement = license_scan.TEMPLATES.get(f"{name}-notice", license_scan.TEMPLATES[name])
        assert " ".join(plain(statement)) in " ".join(plain(full[f"{name}-text"]))
    docs = list(enumerate([f"# x.c\n# {t} And more." for t in notice.values()] + ["Copyright (c) 2020 Z\n\n" + t for t in full.values()]))
    got = {}
    for r in license_scan.scan(frame(spark, docs)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert [got[i] for i in range(len(notice))] == [{f"{n}-notice"} for n in notice]
    whole = [{x for x in got[len(notice) + i] if x.endswith("-text")} for i in range(len(full))]
    assert whole == [{n} for n in full] and {"MIT-text", "ISC-text", "Zlib-text", "CC0-1.0-text", "BSD-3-Clause-text", "Unlicense-text"} <= set(full)
    own = license_scan.TEMPLATES
    assert [license_scan.scan(frame(spark, [(1, own[n])])).first().license for n in ("CC-BY-3.0-short", "CC-BY-SA-4.0-short", "LGPL-3.0")] == ["CC-BY-3.0-short", "CC-BY-SA-4.0-short", "LGPL-3.0"]
    typo = full["MIT-text"].replace("Software", "Sofware")  # its notice has fewer edits, and does not drop it
    assert {r.license for r in license_scan.scan(frame(spark, [(1, typo)])).collect()} >= {"MIT-text"}


def test_toxicity(spark):
    rng = random.Random(1)
    bad = ["vorgul", "vorgulish", "vorguls", "snarpit", "snarpits"]
    rows, labels = [], []
    for i in range(400):
        own, toxic = words(rng, 60), i % 4 == 0
        if toxic:
            own[rng.randrange(60)], own[rng.randrange(60)] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    rows += [(400, None), (401, ""), (402, " ".join(words(rng, 9000))), (403, " ".join(words(rng, 3000)) + " vorgullish snarpitted vorgulls")]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    repeated = rows + [(1, "vorgul snarpit"), (3, "z" * toxicity.TEXT_BYTES + " vorguls")]  # the least of a doc_id's texts, within the bound
    model = toxicity.train(frame(spark, repeated), marked)
    assert (toxicity.train(frame(spark, repeated[::-1]), marked).weights == model.weights).all()
    out = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == (i % 4 == 0) for i in held]) >= 0.97
    assert out[400] < 0.5 and out[401] < 0.5 and out[402] < 0.5 <= out[403]  # unseen forms
    pair = [" ".join(["w1"] * k + ["vorgul", "snarpits"] + ["w2"] * 9) for k in range(6)]
    assert (model.score(pa.array(pair)) >= 0.5).all()  # wherever they stand
    assert toxicity.train(frame(spark, rows), marked.where("false")).score(pa.array(["x", None])).max() < 0.5
    assert toxicity.drop_toxic(frame(spark, []), marked).count() == 0


def test_toxicity_windows():
    """A text's score from those of its words alone: the greatest mean of four in a row; long and short texts."""
    rng = random.Random(6)
    texts = [" ".join(words(rng, 30, 90)) + " vorgul" * (i % 2) for i in range(60)]
    model = toxicity.fit(pa.array(texts, pa.large_string()), np.array([i % 2 for i in range(60)]))
    logit = lambda t: np.log(s / (1 - s)) if (s := float(model.score(pa.array([t]))[0])) not in (0.0, 1.0) else None
    several = ["ab", "vorgul", "vorguls ab", "x ab vorgul", *(" ".join(rng.choices(["ab", "cd", "vorgul", "vorgulls", "efg", "w", "snarp"], k=n)) for n in (3, 4, 5, 9, 400))]
    alone = {w: 4 * (logit(w) - model.bias) for t in several for w in t.split()}
    for t in several:
        own = [alone[w] for w in t.split()]
        own += [0.0] * (4 - len(own))
        assert logit(t) == pytest.approx(model.bias + max(sum(own[k : k + 4]) for k in range(len(own) - 3)) / 4, abs=1e-6)
    whole = pa.array([None, "", *several, several[-1] * 3000])
    assert model.score(whole).tolist() == [float(model.score(whole.slice(k, 1))[0]) for k in range(len(whole))]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[500:520] = x[40]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [1.0] * 8), (1100, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=200, queries=16).collect()
    want, by = neighbours.brute_force(np.arange(900), x), {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-9)
    assert set(by) == set(want) and np.mean([len(set(by[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert [v for v in by[40] if 500 <= v < 520] == sorted(v for v in by[40] if 500 <= v < 520)
    assert neighbours.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert neighbours.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_neighbours_lengths(spark, spread):
    """Recall on vectors of like and of very unequal lengths, one of them a hundred times as long as any."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 48))
    x *= np.exp(spread * rng.normal(size=(3000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 100 if spread else 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, got = neighbours.brute_force(np.arange(3000), x), {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=1500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    shares = [len(got[q] & set(want[q])) / 20 for q in want]
    assert np.mean(shares) >= 0.9 and min(shares) >= 0.5


def test_neighbours_hot_copies(spark):
    """A third of the rows are one vector, near the queries but outside their best: it takes up no allowance."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[20] = x[0]  # twins, whose answers are alike
    near = np.argsort(-(x @ x[0]))
    hot = x[near[50]].copy()
    x[np.setdiff1d(np.arange(1, 2400, 2), near[:60])[:1100]] = hot
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = neighbours.brute_force(np.arange(2400), x)
    got = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id").isin(0, 20)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(got[q]) == 20 and len(set(got[q]) & set(want[q])) >= 16 for q in (0, 20)) and got[0][0] == 20 and got[20][0] == 0
    copies = np.flatnonzero((x == hot).all(1))  # asked for itself, it gives its first copies
    own = int(copies[30])
    answer = neighbours.nearest(df, F.col("vec_id") == own).orderBy("rank").collect()
    assert [r.vec_id for r in answer] == [int(i) for i in copies if i != own][:20]


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = neighbours.brute_force(rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float))
    got = neighbours.op4_nearest(spark, SF).toPandas().groupby("query_id").vec_id.apply(set)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://a.example.com/en/", "http://example.com", "ftp://b.net/es/#z", "x://y://z/en/", "http://spam-farm.example.org/q", "http://m.casino-win.example.com/", "http://ok.org/a b\nc", "http://spam-farm.example.org/q", "http://x.spam-farm.example.org/q", "http://" + "y" * 70000 + ".org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    hosts = spark.createDataFrame([(h,) for h in url_filter.LISTED + url_filter.LISTED[:2] + [None]], "host string").withColumn("key", F.lit(0))
    for most, keys, rows in ((1 << 20, 100, 100), (0, 3, 2)):  # broadcast, and dealt by shard
        ours, theirs = compare(url_filter.judge(pages.repartition(3), hosts, most, keys, rows), con, url_filter.OP5_SQL)
        assert ours == theirs
        assert url_filter.judge(pages.where("false"), hosts, most, keys, rows).count() == 0
    assert not [r for r in url_filter.judge(pages, hosts.where("false")).collect() if r.listed]
    hot = spark.createDataFrame([(i, f"http://h{i % 7 if i % 3 else 0}.org/") for i in range(300)], "page_id long, url string")
    told = url_filter.judge(hot, spark.createDataFrame([("h0.org",), ("h5.org",), ("h99.org",)], "host string"), 0, 3, 10)
    assert {r.page_id: r.verdict for r in told.collect()} == {i: "block" if i % 3 == 0 or i % 7 in (0, 5) else "allow" for i in range(300)}
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(1 << 62), 1 << 62, (2, 20000))
    for share in (0.0, 0.01, 0.5, 1.0):
        listed = rng.random(20000) < share
        assert (url_filter.contains(url_filter.build(a, b, listed), a, b) == listed).all()


def test_pii(spark):
    texts = [None, "", "mail a.b+c@x-y.example.com. 1.2.3.4 999.1.1.1 00012.0.0.255", "4111 1111 1111 1111, 4111111111111112 +1 (040) 555-0631 +1 2", "é😀 a@b.co 1.1.1.1.1"]
    rows = list(enumerate(texts)) + [(10 + i, f"badge number 10.0.0.{i} and so on") for i in range(5)] + [(20, "my badge number AB-77-4411-9 here")]
    out = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    base = lambda i: [(pii.KINDS[s.kind], s.start, s.stop) for s in out[i].base]
    assert base(0) == base(1) == [] and [k for k, *_ in base(2)] == ["email", "ip", "ip"] and [k for k, *_ in base(3)] == ["card", "phone"]
    assert base(4) == [("email", 3, 9), ("ip", 10, 17)]
    assert [(s.kind, s.start, s.stop) for s in out[20].extra] == [(1, 16, 28)] and not out[12].extra
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_pii_rounds(spark):
    """A chain: seeds, the words before them, what follows those, the words before that, and so on, until nothing is new."""
    rows = [(i, f"badge number 10.0.0.{i} and so on") for i in range(40)]
    for step, n in enumerate((17, 7, 3)):  # instances known from one pattern are seeds of the next
        before, after = ("badge number", "desk alpha", "desk beta", "desk gamma")[step : step + 2]
        rows += [(100 * (step + 1) + k, f"x {before} id-{step}-{7000 + k} y {after} id-{step}-{7000 + k} z") for k in range(n)]
    want = pii.brute_force(rows)
    got = {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.extra]) for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got == want and all(len(got[100 * (step + 1)][1]) == 2 for step in range(3))


def test_pii_names(spark):
    """Names before a mark and first letters tell identifiers that look like nothing themselves; other names do not."""
    rng = random.Random(10)
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, f"{drawn('xyz', 6)} {drawn('xyz', 5)} secret_key='{drawn('abcdef', 6)}{drawn('0123456789', 6)}{drawn('abcdef', 6)}', size:{100 + i} x") for i in range(12)]
    rows += [(20 + i, f"{drawn('xyz', 6)} {drawn('xyz', 5)} QRST{drawn('ABCDEF', 8)}{drawn('23456789', 8)}.") for i in range(8)]
    rows += [(40, "my SECRET_KEY=hunter-2 here"), (41, "there QRSTabcdefghijklmno1 and"), (42, "sizes: size:77 nm=12 QRST1 QRST"), (43, "Secret_Key: x9 secret_key=none")]
    want = pii.brute_force(rows)
    texts = dict(rows)
    got = {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.extra]) for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got == want
    found = {i: [texts[i][a:b] for a, _, b in extra] for i, (_, extra) in got.items()}
    assert all(len(found[i]) == 1 and len(found[i][0]) == 18 for i in range(12)) and all(len(found[20 + i]) == 1 and found[20 + i][0][:4] == "QRST" for i in range(8))
    assert found[40] == ["hunter-2"] and found[41] == ["QRSTabcdefghijklmno1"] and found[42] == found[43] == []


def test_pii_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = pii.brute_force([tuple(r) for r in docs.collect()])
    told = lambda spans: ",".join(f"{[*pii.KINDS, 'secret'][k]}:{a}:{b}" for a, k, b in spans)
    got = {r.doc_id: r for r in pii.op6_pii(spark, SF).collect()}
    found = {i: [docs_text[a:b] for a, _, b in want[i][1]] for i, docs_text in docs.collect()}
    every = [x for own in found.values() for x in own]
    # The added spans of this table, looked through by hand: numbers of 16 digits that fail the checksum, and tokens.
    assert len(every) > 20 and all(re.fullmatch("[0-9]{16}|[0-9A-Fa-f]{40}", x) for x in every) and {len(x) for x in every} == {16, 40}
    assert {i: (r.base_sha256, r.spans) for i, r in got.items()} == {i: (hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + extra))) for i, (base, extra) in want.items()}
    assert all([r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want[i][0]) for n in range(4)] for i, r in got.items())


def test_pii_shapes(spark):
    """Adjacent, overlapping and broken matches; texts of more than a run of matches; long runs, which once overflowed the stack."""
    rng = random.Random(7)
    letters = ["a", "b", "@", ".", "%", "+", "-", "1", "2", "9", "0", " ", " ", "(", ")", "\n", "é", "😀", "a@b.co", "1.2.3.4", "+1 (040) 555", "4111 1111 1111 1111", "id no ", "key=", "Pw:", "=", ":", "QRST", "0123456789ABCDEF", "0123abcd4567ef89"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(120)))) for i in range(1500)]
    rows += [(2000, "call me 12.0.0.1 " * 1500), (2001, "7" * 40000), (2002, "x@y" + ".z" * 20000), (2003, "a b " + "." * 30000 + "1@")]
    want = pii.brute_force(rows)
    got = {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.extra]) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == want and len(want[2000][0]) == 1500
    assert pii.find_pii(spark.createDataFrame([(1, "q" * 400000 + " x@y 1")], "doc_id long, text string")).count() == 1  # quadratic before


def test_mixing(spark, corpus):
    ours, theirs = compare(mixing.op8_mixing(spark, SF), connect(), mixing.OP8_SQL)
    assert ours == theirs
    rows = mixing.copies(frame(spark, corpus)).collect()
    assert len(rows) == len(corpus) and all(r.n <= 3 for r in rows) and {r.size for r in rows if r.doc_id in (0, 1, 2)} == {0}
    total = {r["_source"]: r.target for r in rows}
    assert sum(total.values()) == pytest.approx(sum(r.size for r in rows)) and None in total
    repeated = mixing.repeat_documents(frame(spark, corpus))
    assert repeated.columns == frame(spark, corpus).columns and repeated.count() == sum(r.n for r in rows)
    assert mixing.repeat_documents(frame(spark, [])).count() == 0 and mixing.copies(frame(spark, [(1, None)])).first().n == 0


def test_sharding(spark, corpus):
    rows = corpus + corpus[:4] + [(1000 + i, "hot") for i in range(60)] + [(None, "x")]
    out = sharding.assign(frame(spark, rows), 7).toPandas()
    counts = out.shard.value_counts()
    assert len(out) == len(rows) and counts.max() - counts.min() <= 1 and len(counts) == 7
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    pairs = out[(out.text_crc32 != 0) & (out.text_crc32 != zlib.crc32(b"hot"))].groupby("text_crc32").shard.agg(["nunique", "size"])
    split = pairs[pairs["size"] > 1]
    assert (split["nunique"] > 1).mean() < 0.5
    assert sharding.assign(frame(spark, []), 7).count() == 0


def test_sharding_moves(spark):
    """Rounds of moves against plain loops over cells, with the session's own hashes."""
    rng, shards = random.Random(14), 6
    cells = [(f"g{g}", home, home, rng.choice([1, 1, 2, 5, 30])) for g in range(120) for home in rng.sample(range(shards), rng.randrange(1, 5))]
    total = Counter()
    for gid, _, _, n in cells:
        total[gid] += n
    load = Counter()
    for _, home, _, n in cells:
        load[home] += n
    quota = [load[k] + (40, 3, 0, 150, 12, 70)[k] for k in range(shards)]
    df = spark.createDataFrame([(*c, total[c[0]]) for c in cells], "gid string, home int, shard int, n long, all long")
    tie = {(r.gid, r.k): r.h for r in df.select("gid").distinct().crossJoin(spark.range(shards).select(F.col("id").cast("int").alias("k"))).select("gid", "k", F.xxhash64("gid", "k").alias("h")).collect()}
    unit = {(r.gid, r.t): r.u for r in df.select("gid").distinct().crossJoin(spark.range(40).select(F.col("id").cast("int").alias("t"))).select("gid", "t", sharding._unit(F.col("gid"), F.col("t")).alias("u")).collect()}
    at, turn = {(g, h): h for g, h, _, _ in cells}, 0
    size = {(g, h): n for g, h, _, n in cells}
    while True:
        held, load = {}, Counter()
        for (g, h), k in at.items():
            held.setdefault(g, Counter())[k] += size[g, h]
            load[k] += size[g, h]
        asks = {g: (max(own, key=lambda k: (own[k], tie[g, k])), sum(own.values()) - max(own.values())) for g, own in held.items() if len(own) > 1}
        moves = set()
        for k in range(shards):
            room, by = max(0, quota[k] - load[k]), {}
            for g, (to, n) in asks.items():
                if to == k:
                    by.setdefault(n.bit_length() - 1, []).append(g)
            for power in sorted(by):
                need = sum(asks[g][1] for g in by[power])
                if need <= room:
                    moves |= set(by[power])
                    room -= need
                    continue
                ask, least = min((asks[g][1], g) for g in by[power])
                if ask <= room:
                    moves.add(least)
                    room -= ask
                    if 2 ** (power + 1) <= room:
                        moves |= {g for g in by[power] if unit[g, turn] < room / need}
                break
        for (g, h), k in list(at.items()):
            if g in moves:
                at[g, h] = asks[g][0]
        turn += 1
        if not moves:
            break
    got = {(r.gid, r.home): r.shard for r in sharding.propagate(df, quota, Scratch(spark)).collect()}
    assert got == at and turn > 2 and len({g for g, own in held.items() if len(own) == 1}) > len(total) // 2


def test_sharding_hot(spark):
    """A text with a third of the rows has no room anywhere: it stays, and the others are brought together all the same."""
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"text {i % 100}") for i in range(300)] + [(2000 + i, f"single {i}") for i in range(500)]
    out = sharding.assign(frame(spark, rows), 8).toPandas()
    assert out.shard.value_counts().tolist() == [150] * 8
    copies = out[(out.doc_id >= 1000) & (out.doc_id < 2000)].groupby("text_crc32").shard.nunique()
    assert (copies == 1).mean() > 0.95 and out[out.doc_id < 400].groupby("shard").size().max() < 80
    asked = [Row(to=to, power=power, n=n, least=Row(ask=ask, gid=gid)) for to, power, n, ask, gid in ((0, 0, 4, 1, "a"), (0, 1, 8, 2, "b"), (0, 9, 600, 600, "c"), (1, 0, 1, 1, "d"), (2, 3, 18, 9, "e"))]
    assert sharding._grants([10, 0, 15], asked) == [(1, 4 / 8, "b"), (0, 0.0, None), (3, 0.0, "e")]


def test_sharding_fits(spark):
    """Of two requests that exclude each other one is granted: no request that fits is left."""
    cells = [("g1", 0, 0, 10, 30), ("g1", 1, 1, 20, 30), ("g2", 0, 0, 10, 30), ("g2", 1, 1, 20, 30)]
    df = spark.createDataFrame(cells, "gid string, home int, shard int, n long, all long")
    got = [(r.gid, r.home, r.shard) for r in sharding.propagate(df, [20, 55], Scratch(spark)).collect()]
    assert sorted(got) == [("g1", 0, 1), ("g1", 1, 1), ("g2", 0, 0), ("g2", 1, 1)]


def test_clashing_names(spark, corpus):
    """Columns named like those that operators use inside come back as they were."""
    inner = ["_n", "_of", "_rate", "_copy", "_gone", "_id", "_t", "_y", "_o", "key", "class", "comp", "hub", "a", "b", "gid", "home", "n", "size", "score", "of", "rate", "copy", "gone", "item_id", "target"]
    docs = frame(spark, corpus)
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(inner) if c not in docs.columns])
    labels = spark.createDataFrame([(6, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").withColumn("_id", F.lit(0)).withColumn("_y", F.lit(0))
    bench = spark.createDataFrame([(1, "not in here at all, whatever is looked for")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    for out in (near_dedup.drop_near_copies(docs), mixing.repeat_documents(docs), decontamination.drop_leaks(docs, bench), toxicity.drop_toxic(docs, labels, 2.0)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == k for r in rows for k, c in enumerate(inner) if c != "key")
    assert sharding.assign(docs, 3).count() == mixing.copies(docs).count() == len(corpus)


def taken(rows):
    """How often the mix takes each (doc_id, text, source), by filling up sources one after the other."""
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    total = Counter()
    for i, _, source in rows:
        total[source] += size[i]
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sorted(total, key=lambda x: (x is None, x or "")))}
    full = set()
    while True:
        level = (sum(total.values()) - 3 * sum(total[x] for x in full)) / sum(weight[x] for x in total if x not in full)
        if not (more := {x for x in total if x not in full and weight[x] * level > 3 * total[x]}):
            break
        full |= more
    out = {}
    for i, t, x in rows:
        rate = 0 if not total[x] else 3 if x in full else weight[x] * level / total[x]
        draw = int(hashlib.md5(f"mix\0{i}\0{t or ''}".encode()).hexdigest()[:13], 16) / 2**52
        out[i] = int(rate) + (draw < rate % 1)
    return out


def test_pipeline(spark):
    """Every stage's decisions against its plain version, on whole tables."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    score = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).score(pa.array([t for _, t, _ in rows], pa.large_string()))
    rows = [r for r, s in zip(rows, score) if s < 0.5]
    kept = near_dedup.brute_force([r[:2] for r in rows], 5)
    rows = [r for r in rows if kept[r[0]][1] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {i for i, _ in decontamination.brute_force([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in leaks]
    times, texts = taken(rows), {i: (t or "").encode() for i, t, _ in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert leaks and Counter(out.doc_id.tolist()) == Counter({i: n for i, n in times.items() if n})
    assert all((n, crc) == (len(texts[i]) + 16, zlib.crc32(texts[i])) for i, n, crc in zip(out.doc_id, out["size"], out.text_crc32))
    counts = out.shard.value_counts().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_registry_names():
    from orrery.llm import registry

    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)


def passes_by_period(plain, offsets, span):
    """told_elsewhere by a pass over all bytes for every period."""
    told = np.zeros(len(plain), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        for p in range(1, min(_align.PERIOD, span, len(plain) - 1) + 1):
            broken = [-1, *[k for k in range(max(b - a - p, 0)) if plain[a + k] != plain[a + k + p]], max(b - a - p, 0)]
            for x, y in zip(broken, broken[1:]):
                if y - x > 2 * span + 2 * p:
                    told[a + x + 1 + span + p : a + y - span] = True
    return told


@pytest.mark.parametrize("span", [3, 8, 20, 69])
def test_told_elsewhere(span):
    """Stretches of any period, at both ends of texts and across them, beside empty texts and texts of no period."""
    rng = random.Random(span)
    texts = ["", "a" * 700, "a" * 300, "ab" * 40, "", "x"]
    for _ in range(30):
        unit = "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 7, 19, 60, 64, 65])))
        texts.append("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(200))) + (unit * 400)[: rng.randrange(500)] + "".join(rng.choice("ab") for _ in range(rng.randrange(3))))
    plain = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = _align.told_elsewhere(plain, offsets, span)
    assert np.array_equal(got, passes_by_period(plain, offsets, span)) and 0 < got.sum() < len(got)
    assert not _align.told_elsewhere(plain[:0], np.zeros(1, np.int64), span).any()


def test_told_elsewhere_is_cheap():
    """Text of no period costs less than a pass over its bytes for each of the 64 periods."""
    plain = np.random.default_rng(1).integers(97, 123, 2 << 20).astype(np.uint8)
    offsets = np.arange(0, len(plain) + 1, 1 << 12)

    def least(f):
        out = []
        for _ in range(3):
            began = time.process_time()
            f()
            out.append(time.process_time() - began)
        return min(out)

    one = least(lambda: np.diff(np.flatnonzero(plain[1:] != plain[:-1])))
    assert least(lambda: _align.told_elsewhere(plain, offsets, 69)) < 25 * one


def thue_morse(n=1024):
    """Two words that polynomial hashes modulo a power of two can't tell apart, whatever the base."""
    t = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 4096])
def test_long_words_differ(spark, size):
    a, b = thue_morse(size)
    rows = [(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, a), (4, b), (5, a)]
    want = substring_dedup.brute_force(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.digest) for r in substring_dedup.factor_documents(frame(spark, rows)).withColumn("digest", F.sha2("kept", 256)).collect()}
    assert got == want
    linked = {r.doc_id: r.component_id for r in near_dedup.find_components(frame(spark, rows), 2).collect()}
    assert linked == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
    words = _flat.word_hashes(pa.array([" ".join([a, b, a[:16], b[:16], a[:8], b[:8], "", "x"])]))[0]
    assert len(set(words.tolist())) == 7


def test_repetitive_texts(spark):
    """Texts and items of one letter or one sentence: what brute force finds, in bounded memory."""
    items = [(1, "a" * 200), (2, "the answer is yes. " * 20), (3, "plain item of no period whatever, with words enough to fill a piece or two of it")]
    rows = [(1, "a" * 20_000), (2, "the answer is yes. " * 600), (3, "b" * 20_000), (4, "zz " + "a" * 300 + " xx"), (6, "q" * 100 + items[2][1] + "a" * 5000), (7, "a" * 90), (8, "a" * 90), (9, "a" * 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert got == decontamination.brute_force(rows, items) and len(got) == 8
    long = [(1, "a" * 2_000_000), (2, "the answer is yes. " * 100_000)]
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, long), bench).collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("seed", range(4))
def test_slices_of_seeds(seed, monkeypatch):
    """Periodic stretches and edits, with seeds in slices of a few places, against full alignment."""
    monkeypatch.setattr(_align, "SEEDS", 200)
    rng = random.Random(seed)
    unit = "".join(rng.choice("abc d") for _ in range([1, 2, 19, 60][seed]))
    items = [(1, unit * (400 // len(unit))), (2, "".join(rng.choice("abcdefgh ") for _ in range(300)))]
    rows = []
    for k in range(6):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) + unit * rng.randrange(1500 // len(unit)) + items[1][1][rng.randrange(100) : rng.randrange(150, 300)]
        text = list(text)
        for _ in range(rng.randrange(20)):
            text[rng.randrange(len(text))] = "x"
        rows.append((k, "".join(text)))
    got = set()
    for index in _align.windows(items, decontamination.Q, decontamination.PIECE, decontamination.RATE):
        texts = pa.array([t for _, t in rows])
        got |= {(rows[t][0], key) for t, key in _align.matches(index, texts, index.find(texts))}
    assert got == decontamination.brute_force(rows, items)


@pytest.mark.parametrize("dims", [64, 128, 256, 512])
def test_recall_by_dimension(dims):
    """Random vectors of unequal lengths, the hardest kind."""
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(4096, dims))
    x *= (rng.uniform(0.2, 3, 4096) / np.linalg.norm(x, axis=1))[:, None]
    asked = list(range(48))
    index = neighbours.bands(x, 20, x[asked[::3]])
    hits = 0
    for j in asked[1::3] + asked[2::3]:  # not those that it was measured by
        score = x @ x[j]
        score[j] = -np.inf
        ones, own, _ = neighbours.search_block(x[j], index, np.ones(len(x), int), 21)
        hits += len(set(np.argsort(-score)[:20].tolist()) & {i for i in ones[np.argsort(-own)].tolist() if i != j}.intersection(ones[np.argsort(-own)][:21].tolist()))
    assert hits / (32 * 20) >= 0.93
