import hashlib
import io
import json
import os
import random
import statistics
import struct
import zlib

import numpy as np
import pytest

from orrery import cli
from orrery.contracts import COMMIT_BATCH, CHANGES, Contract, EngineError, ImageError, IndexError_, ScanError
from orrery.engine import Cache, Engine
from orrery.functions import codecs, images
from orrery.operators import metrics, stats
from orrery.operators.encode import HashEncoder, PixelEncoder
from orrery.operators.ranking import batch_search, full_ranking, search
from orrery.operators.reconcile import chunks, missing, plan
from orrery.sources import sinks
from orrery.sources.scan import discover
from orrery.sources.snapshot import Index
from orrery.timing import Progress, Timings

DIM = 16
CONTRACT = Contract("i1", "q1", DIM)


def tree(path, names):
    for n, data in names.items():
        os.makedirs(os.path.dirname(path / n), exist_ok=True)
        (path / n).write_bytes(data)


def test_scan(spark, tmp_path):
    tree(tmp_path, {"a.JPG": b"1", "a/x.jpg": b"22", ".hidden/b.png": b"3", "notes.txt": b"4", ".png": b"5", "a.png.bak": b"6", "png": b"7"})
    os.symlink(tmp_path / "a.JPG", tmp_path / "link.jpg")
    with open(os.fsencode(tmp_path) + b"/img\xff.jpg", "wb") as f:
        f.write(b"8")
    os.utime(tmp_path / "a.JPG", ns=(1, 1_700_000_000_123_456_789))
    rows = [(bytes(r.path), r.mtime_ns, r.size) for r in discover(spark, str(tmp_path)).collect()]
    assert [r[0] for r in rows] == [b".hidden/b.png", b"a.JPG", b"a/x.jpg", b"img\xff.jpg"]
    assert rows[1][1:] == (1_700_000_000_123_456_789, 1)
    with pytest.raises(ScanError):
        discover(spark, str(tmp_path / "none"))


def test_scan_in_rounds(spark, tmp_path):
    """Folders that are left over are dealt anew; a deep path, many folders and one full folder give the rows of one walk."""
    deep = "/".join(f"d{k}" for k in range(12))
    tree(tmp_path, {f"{deep}/{k}.png": b"x" * k for k in range(5)} | {f"wide{k}/{j}.jpg": b"y" for k in range(20) for j in range(3)} | {f"full/{k:03}.gif": b"" for k in range(200)})
    want = sorted((os.path.relpath(os.path.join(at, n), tmp_path).encode(), os.stat(os.path.join(at, n)).st_mtime_ns, os.stat(os.path.join(at, n)).st_size) for at, _, names in os.walk(tmp_path) for n in names)
    for limit in (1, 30, 10**6):
        assert [(bytes(r.path), r.mtime_ns, r.size) for r in discover(spark, str(tmp_path), limit).collect()] == want
    (tmp_path / "empty").mkdir()
    assert discover(spark, str(tmp_path / "empty")).count() == 0


def test_ingest_resumes(spark, tmp_path):
    """An engine that dies in a batch leaves the batches before it; the next one starts there and embeds nothing twice."""
    tree(tmp_path / "r", {f"{k:02}.jpg": b"x%d" % k for k in range(40)})
    log = tmp_path / "log"

    class Logged(HashEncoder):
        fail = b""

        def prepare(self, path):
            with open(log, "ab") as f:
                f.write(os.path.basename(path) + b"\n")
            if self.fail and os.path.basename(path) >= self.fail:
                raise RuntimeError("killed")
            return super().prepare(path)

    failing = Logged(DIM)
    failing.fail = b"24.jpg"
    with pytest.raises(Exception, match="killed"):
        Engine(spark, str(tmp_path / "r"), failing, CONTRACT, str(tmp_path / "i"), commit=8).index()
    done = Index(spark, str(tmp_path / "i"), CONTRACT).count()
    assert done == 24 and os.path.isdir(tmp_path / "i.feed")
    log.write_bytes(b"")
    assert Engine(spark, str(tmp_path / "r"), Logged(DIM), CONTRACT, str(tmp_path / "i"), commit=8).index() == 40
    assert sorted(log.read_bytes().split()) == [b"%02d.jpg" % k for k in range(24, 40)]
    assert not os.path.exists(tmp_path / "i.feed")


def test_lifecycle(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    tree(root, {"a.jpg": b"one", "b.jpg": b"one", "c/d.png": b"two", "bad.jpg": b"corrupt"})
    skipped = []
    engine = Engine(spark, str(root), HashEncoder(DIM), CONTRACT, str(tmp_path / "idx"), lambda p, e: skipped.append(p))
    assert engine.index() == 3 and skipped == [b"bad.jpg"]
    found = engine.search(image=str(root / "a.jpg"), top=3, threshold=-1.0)
    assert found[0][1] == b"b.jpg" and found[0][0] == pytest.approx(1.0) and len(found) == 2
    first = engine.search("a dog", top=5, threshold=-1.0)
    assert engine.search("a dog", top=5, threshold=-1.0, cache=Cache.DISABLED) == first
    (root / "a.jpg").unlink()
    (root / "c/d.png").write_bytes(b"corrupt now")
    assert engine.index() == 1
    assert engine.search("a dog", threshold=-1.0, cache=Cache.REINDEX)[0][1] == b"b.jpg"

    class Failing(HashEncoder):
        def text(self, query):
            raise EngineError("no")

    with pytest.raises(EngineError):
        Engine(spark, str(root), Failing(DIM), CONTRACT, str(tmp_path / "idx")).search("new", cache=Cache.REINDEX)
    assert Index(spark, str(tmp_path / "idx"), CONTRACT).count() == 1
    assert not [n for n in os.listdir(tmp_path) if "stage" in n]


def test_index_contracts(spark, tmp_path):
    path = str(tmp_path / "i")
    index = Index(spark, path, CONTRACT, "/r")
    unit = [1.0] + [0.0] * (DIM - 1)
    index.commit(spark.createDataFrame([("upsert", b"a", 1, 2, unit)], CHANGES))
    index.remember("Q", unit)
    with pytest.raises(IndexError_):
        index.commit(spark.createDataFrame([("upsert", b"b", 1, 2, [2.0] + unit[1:])], CHANGES))
    assert index.count() == 1 and index.recall("q") is None and index.recall("Q") == unit
    again = Index(spark, path, Contract("i2", "q1", DIM), "/r")
    assert again.count() == 0 and again.recall("Q") == unit
    with pytest.raises(IndexError_):
        Index(spark, path, CONTRACT, "/other")


def test_ranking_traps(spark):
    rows = spark.createDataFrame([(b"a.jpg", [1.0, 0.0]), (b"a/x.jpg", [1.0, 0.0]), (b"z", [0.3, 0.0]), (b"n", [float("nan"), 0.0])], "path binary, embedding array<float>")
    from pyspark.sql import functions as F

    from orrery.functions.paths import components

    got = [bytes(r.path) for r in search(rows, [1.0, 0.0], 9, 0.3, "path", tie=components(F.col("path")), f32=True).orderBy("rank").collect()]
    assert got == [b"n", b"a/x.jpg", b"a.jpg", b"z"]
    assert search(rows, [1.0, 0.0], 0, 0.0, "path").count() == 0


def test_batch_search(spark):
    """Against a plain loop, in small and large blocks, with vectors that take no part and several lengths."""
    rng = np.random.default_rng(6)
    whole = [(i, rng.normal(size=4 if i % 5 else 6).round(1).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [float("nan")] * 4), (103, [1.0, None, 1.0, 1.0]), (104, [float("inf")] * 4), (None, [9.0] * 4)]
    df = spark.createDataFrame(whole + bad, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 3 = 0 or vec_id > 99 or vec_id is null").withColumnRenamed("vec_id", "query_id")
    want = set()
    for q, x in whole[::3]:
        near = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in whole if v != q and len(y) == len(x))
        want |= {(q, v, k) for k, (s, v) in enumerate(near[:7], 1) if -s >= 0.5}
    for size in (300, 1 << 20):
        assert {(r.query_id, r.vec_id, r["rank"]) for r in batch_search(df, asked, 7, 0.5, block_bytes=size).collect()} == want
    assert batch_search(df, asked, 0).count() == 0 and batch_search(df.where("false"), asked, 3).count() == 0
    assert batch_search(spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [0.0, 1.0, 1.0, 0.0])], "vec_id long, embedding array<double>"), asked.where("false").union(spark.createDataFrame([(9, [1.0, 0.0])], asked.schema)), 5).count() == 2


def test_full_ranking(spark):
    scored = spark.createDataFrame([(q, i, float((i * 7 + q) % 5)) for q in range(3) for i in range(40)], "query_id long, vec_id long, score double")
    for own, query in ((scored.where("query_id = 1"), None), (scored, "query_id")):
        rows = [tuple(r) for r in full_ranking(own, query=query).select("query_id", "rank", "vec_id", "score").collect()]
        for q in {r[0] for r in rows}:
            want = sorted(((-float((i * 7 + q) % 5), i) for i in range(40)))
            assert [(-s, i) for _, _, i, s in sorted(r for r in rows if r[0] == q)] == want
            assert sorted(r[1] for r in rows if r[0] == q) == list(range(1, 41))


def test_reconcile_and_chunks(spark):
    old = spark.createDataFrame([(b"a", 1, 1), (b"b", 1, 1), (b"s", 1, 1)], "path binary, mtime_ns long, size long")
    new = spark.createDataFrame([(b"a", 1, 1), (b"b", 2, 1), (b"n\xff", 1, 1)], "path binary, mtime_ns long, size long")
    assert {bytes(r.path): r.op for r in plan(new, old).collect()} == {b"a": "same", b"b": "changed", b"s": "stale", b"n\xff": "missing"}
    rows = "path string, mtime_ns long, size long"
    old, new = spark.createDataFrame([("a", None, 1), ("b", None, 1), ("c", 1, None)], rows), spark.createDataFrame([("a", None, 1), ("b", 2, 1), ("c", 1, None), (None, 1, 1)], rows)
    by = {r.path: r.op for r in plan(new, old).collect()}
    assert by == {"a": "same", "b": "changed", "c": "same", None: "missing"}
    assert {r.path for r in missing(new, old).collect()} == {p for p, op in by.items() if op in ("missing", "changed")}
    assert {r.id: r.chunk for r in chunks(spark.range(100), ["id"], 8).collect()} == {i: i // 8 for i in range(100)}
    assert chunks(spark.range(0), ["id"], 8).count() == 0


def test_quality(spark):
    """Rows of our own against plain loops."""
    rng = np.random.default_rng(3)
    runs = []
    for i in range(40):
        names = [f"p{k}" for k in rng.permutation(30)[:12]]
        kind = "caption" if i % 2 else "category"
        runs.append((str(i), kind, f"t{i % 6}", [f"p{k}" for k in rng.permutation(30)[: i % 5 + 1]], [(n, float(s)) for n, s in zip(names, -np.sort(-rng.random(12)))]))
    from orrery.contracts import QUALITY

    m = metrics.evaluate(spark.createDataFrame(runs, QUALITY), 0.8).first().asDict()
    captions = [([n in own for n, _ in found], len(own)) for _, kind, _, own, found in runs if kind == "caption"]
    want = {f"recall_at_{k}": np.mean([sum(hit[:k]) / n for hit, n in captions]) for k in (1, 5, 10)}
    want["mrr_at_10"] = np.mean([max([1 / (r + 1) for r in range(10) if hit[r]], default=0) for hit, _ in captions])
    want["ndcg_at_10"] = np.mean([sum(1 / np.log2(r + 2) for r in range(10) if hit[r]) / sum(1 / np.log2(r + 2) for r in range(min(n, 10))) for hit, n in captions])
    rates = {}
    for _, kind, intent, own, found in runs:
        if kind == "category":
            took = [n for n, s in found if s >= 0.8]
            rates.setdefault(intent, []).append((any(n not in own for n in took), not took))
    want["absent_false_positive_rate"], want["present_false_negative_rate"] = np.mean([np.mean(x, axis=0) for x in rates.values()], axis=0)
    assert m == pytest.approx(want)


def test_bootstrap(spark):
    """Against draws one by one; samples that don't pair are an error."""
    rng = random.Random(1)
    a, b = [rng.uniform(1, 2) for _ in range(12)], [rng.uniform(1, 3) for _ in range(12)]
    assert stats.change_interval(a, [x / 2 for x in a]) == pytest.approx((0.5, 0.5, 0.5))
    drawn, own = [], random.Random(stats.BOOTSTRAP_SEED)
    for _ in range(2000):
        at = own.choices(range(12), k=12)
        drawn.append(1 - statistics.median(b[i] for i in at) / statistics.median(a[i] for i in at))
    assert stats.change_interval(a, b) == pytest.approx((1 - statistics.median(b) / statistics.median(a), sorted(drawn)[49], sorted(drawn)[1949]))
    rows = [("s", "reference", i, x, 10) for i, x in enumerate(a)] + [("s", "candidate", i, x, 30) for i, x in enumerate(b)]
    samples = spark.createDataFrame(rows, "scenario string, side string, n int, seconds double, rss_bytes long")
    told = stats.report(samples).collect()
    assert told[0].reference_ms == pytest.approx(statistics.median(a) * 1000) and told[0].candidate_mib == pytest.approx(30 / 2**20)
    lines = stats.report_lines(told)
    assert len(lines) == 2 and len(lines[0]) == len(lines[1]) and lines[1].startswith("s ")
    with pytest.raises(Exception, match="don't come in pairs"):
        stats.bootstrap(samples.where("side = 'reference' or n < 5")).collect()


def test_placed(spark):
    """Percentiles and medians against sorted lists; nulls, null groups, ties, one value, and no rows."""
    rng = random.Random(5)
    rows = [(g, rng.choice([float(rng.randrange(9)), rng.random(), None])) for g in ("a", "b", None) for _ in range(157)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {}
    for g, v in rows:
        by.setdefault(g, []).extend([v] if v is not None else [])
    by = {g: sorted(x) for g, x in by.items() if x}
    got = {r.g: (r.p50, r.p90, r.p100) for r in stats.percentiles(df, ["g"], "v", (50, 90, 100)).collect()}
    assert got == {g: tuple(x[-(-len(x) * p // 100) - 1] for p in (50, 90, 100)) for g, x in by.items()}
    assert {r.g: r.upper_median for r in stats.upper_median(df, "g", "v").collect()} == {g: x[len(x) // 2] for g, x in by.items()}
    assert {r.g: r.median for r in stats.median(df, ["g"], "v").collect()} == {g: statistics.median(x) for g, x in by.items()}
    assert stats.median(df, [], "v").first()[0] == statistics.median(sum(by.values(), []))
    assert stats.percentiles(df.where("false"), ["g"], "v", (50,)).count() == 0


def plain_resize(pixels, width, height):
    """Bicubic with a = -0.5, antialiased, in doubles, one output pixel after the other."""
    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def across(rows, size, out):
        made, scale = [], size / out
        for k in range(out):
            center, wide = (k + 0.5) * scale, max(scale, 1.0)
            w = [kernel((i - center + 0.5) / wide) if int(max(center - 2 * wide + 0.5, 0)) <= i < min(int(center + 2 * wide + 0.5), size) else 0.0 for i in range(size)]
            made.append([[min(255, max(0, int(np.floor(sum(w[i] * row[i][c] for i in range(size)) / sum(w) + 0.5)))) for c in range(3)] for row in rows])
        return [[made[k][r] for k in range(out)] for r in range(len(rows))]

    wide = across(pixels.tolist(), pixels.shape[1], width)
    turned = [[row[x] for row in wide] for x in range(width)]
    down = across(turned, pixels.shape[0], height)
    return np.array([[down[x][y] for x in range(width)] for y in range(height)])


def test_resize():
    rng = np.random.default_rng(7)
    for shape, size in (((3, 4), (5, 4)), ((9, 7), (3, 5)), ((6, 6), (6, 2)), ((1, 5), (8, 3))):
        pixels = rng.integers(0, 256, (*shape, 3), np.uint8)
        assert np.abs(images.resize(pixels, *size).astype(int) - plain_resize(pixels, *size)).max() <= 1
    pixels = rng.integers(0, 256, (40, 40, 3), np.uint8)
    flat = images.prepare(np.full((300, 500, 3), 128, np.uint8))
    assert flat.shape == (3, 256, 256) and flat[0, 0, 0] == pytest.approx((128 / 255 - images.MEAN[0]) / images.STD[0], abs=1e-6) and np.ptp(flat[2]) == 0
    assert [images.crop_offset(n) for n in (1, 3, 5, 4)] == [0, 2, 2, 2]
    turns = {1: pixels, 2: pixels[:, ::-1], 3: pixels[::-1, ::-1], 4: pixels[::-1], 5: pixels.transpose(1, 0, 2), 6: np.rot90(pixels, -1), 7: np.rot90(pixels, 2).transpose(1, 0, 2), 8: np.rot90(pixels)}
    assert all((images.orient(pixels, k) == want).all() for k, want in turns.items())


def jpeg(w, h):
    return b"\xff\xd8\xff\xc0\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\0" * 10


def tiff(directories, at, big=False, head=None, end=4000):
    """A container: directories by place, each a list of (tag, kind, count, value) and the next one's place; ``at`` more bytes by place."""
    order = ">" if big else "<"
    out = bytearray(end)
    out[:8] = (head or (b"MM\0*" if big else b"II*\0")) + struct.pack(order + "I", min(directories) if directories else 0)
    for place, (entries, following) in directories.items():
        out[place : place + 2] = struct.pack(order + "H", len(entries))
        for k, (tag, kind, count, value) in enumerate(entries):
            small = struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value)
            out[place + 2 + 12 * k : place + 14 + 12 * k] = struct.pack(order + "HHI", tag, kind, count) + small
        out[place + 2 + 12 * len(entries) : place + 6 + 12 * len(entries)] = struct.pack(order + "I", following)
    for place, data in at.items():
        out[place : place + len(data)] = data
    return bytes(out)


def test_raw_previews():
    small, large, other = jpeg(300, 300), jpeg(600, 400), jpeg(400, 600)
    whole = lambda at, data: [(0x0201, 4, 1, at), (0x0202, 4, 1, len(data))]
    raf = b"FUJIFILMCCD-RAW ".ljust(84, b"\0") + (92).to_bytes(4, "big") + len(large).to_bytes(4, "big") + large
    assert images.raw_preview(raf) == (large, None)
    for big, head in ((False, None), (True, None), (False, b"IIU\0")):
        plain = tiff({8: ([(0x0112, 3, 1, 6), *whole(1000, small)], 0)}, {1000: small}, big, head)
        assert images.raw_preview(plain) == (small, 6)
    strips = [(0x0103, 3, 1, 7), (0x0111, 4, 1, 1000), (0x0117, 4, 1, len(large))]
    assert images.raw_preview(tiff({8: (strips, 0)}, {1000: large}))[0] == large
    for kind in (4, 13):  # one directory below stands in the entry, several in a list
        assert images.raw_preview(tiff({8: ([(0x014A, kind, 1, 200)], 0), 200: (whole(1000, large), 0)}, {1000: large}))[0] == large
        both = tiff({8: ([(0x014A, kind, 2, 100)], 0), 200: (whole(1000, large), 0), 300: (whole(2000, other), 0)}, {100: struct.pack("<II", 200, 300), 1000: large, 2000: other})
        assert images.raw_preview(both)[0] == other  # of equal ones the first that is met: the last directory of the list
    for kind in (1, 7):
        assert images.raw_preview(tiff({8: ([(0x002E, kind, len(large), 1000)], 0)}, {1000: large}))[0] == large
    following = tiff({8: ([(0x014A, 4, 1, 200)], 300), 200: (whole(1000, large), 0), 300: (whole(2000, other), 0)}, {1000: large, 2000: other})
    assert images.raw_preview(following)[0] == other  # the next directory goes before those below
    broken = {
        "circle": tiff({8: (whole(1000, large), 8)}, {1000: large}), "header": tiff({8: ([], 0)}, {}, head=b"II+\0"), "no preview": tiff({8: ([], 0)}, {}),
        "out of bounds": tiff({8: ([(0x0201, 4, 1, 9000), (0x0202, 4, 1, 90)], 0)}, {}), "too many directories": tiff({8: ([(0x014A, 4, 65, 200)], 0)}, {}),
        "too many entries": tiff({}, {8: struct.pack("<H", 1025)})[:4] + struct.pack("<I", 8) + struct.pack("<H", 1025), "cut short": tiff({8: (whole(1000, large), 0)}, {})[:20],
        "only": tiff({8: (whole(1000, jpeg(100, 100)), 0)}, {1000: jpeg(100, 100)}),
    }
    for message, data in broken.items():
        with pytest.raises(ImageError, match=message):
            images.raw_preview(data)
    prvw = b"\0" * 12 + len(large).to_bytes(4, "big") + large
    box = lambda kind, data: (8 + len(data)).to_bytes(4, "big") + kind + data
    moov = box(b"moov", box(b"uuid", images.CR3_METADATA + box(b"CMT1", tiff({8: ([(0x0112, 3, 1, 8)], 0)}, {}, end=60))))
    cr3 = box(b"ftyp", b"crx ") + moov + box(b"uuid", images.CR3_PREVIEW + b"\0" * 8 + box(b"PRVW", prvw))
    assert images.raw_preview(cr3) == (large, 8)
    turned = b"\xff\xd8\xff\xe1" + (8 + 60).to_bytes(2, "big") + b"Exif\0\0" + tiff({8: ([(0x0112, 3, 1, 3)], 0)}, {}, end=60) + large[2:]
    assert images.exif_orientation(turned) == 3 and images.exif_orientation(large) is None and images.jpeg_size(turned) == (600, 400)
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (images.load(cr3, "raw", lambda data: pixels) == images.orient(pixels, 8)).all() and (images.load(turned, "standard", lambda data: pixels) == images.orient(pixels, 3)).all()
    with pytest.raises(ImageError):
        images.load(jpeg(60000, 60000), "standard", lambda data: pixels)


def test_deltas(spark, tmp_path, monkeypatch):
    """Commits add files in proportion to what changes; reading and merging give the last word on each key."""
    monkeypatch.setattr("orrery.sources.snapshot.MOST_DELTAS", 4)
    index, unit = Index(spark, str(tmp_path / "i"), CONTRACT, "/r"), [1.0] + [0.0] * (DIM - 1)
    want, rng = {}, random.Random(0)
    for turn in range(9):
        rows = [(rng.choice(["upsert", "delete"]), bytes([65 + k]), turn, k, unit) for k in rng.sample(range(12), 5)]
        index.commit(spark.createDataFrame(rows, CHANGES))
        for op, path, mtime, size, _ in rows:
            want.pop(path, None)
            if op == "upsert":
                want[path] = (mtime, size)
        assert {bytes(r.path): (r.mtime_ns, r.size) for r in index.files().collect()} == want
        assert len(index.metadata("deltas")) == (turn + 1) % 4
    again = Index(spark, str(tmp_path / "i"), Contract("i2", "q1", DIM), "/r")
    assert again.count() == 0


def test_synced(spark, tmp_path, monkeypatch):
    """Every data file is on disk before a manifest that names it."""
    index, done = Index(spark, str(tmp_path / "i"), CONTRACT, "/r"), []
    plain = os.fsync
    monkeypatch.setattr("os.fsync", lambda handle: (done.append(os.readlink(f"/proc/self/fd/{handle}")), plain(handle))[1])
    index.commit(spark.createDataFrame([("upsert", b"a", 1, 1, [1.0] + [0.0] * (DIM - 1))], CHANGES))
    index.compact()
    live = os.path.join(index.path, index.metadata("images"))
    first = next(k for k, p in enumerate(done) if "/.manifest-" in p)
    assert first and all("/delta-" in p for p in done[:first]) and index.path in done
    assert {os.path.join(live, n) for n in os.listdir(live)} | {live} <= set(done)
    last = max(k for k, p in enumerate(done) if "/.manifest-" in p)
    assert all(done.index(os.path.join(live, n)) < last for n in os.listdir(live))


def test_corpora(spark, tmp_path):
    from orrery.sources.corpora import captions, checked_images

    pics = [{"id": 2, "file_name": "b.jpg", "width": 1}, {"id": 1, "file_name": "a.jpg"}]
    notes = [{"image_id": 1, "caption": "a dog"}, {"image_id": 2, "caption": "a cat"}, {"image_id": 1, "caption": "a dog"}]

    def file(name, data):
        (tmp_path / name).write_text(json.dumps(data, indent=1))
        return str(tmp_path / name)

    images = file("i.json", {"images": pics})
    sums = file("s.json", {"a.jpg": {"sha256": "x", "url": "u"}, "b.jpg": {"sha256": "y"}, "c.jpg": {"sha256": "z"}})
    assert sorted(tuple(r) for r in checked_images(spark, images, sums).collect()) == [("a.jpg", "x"), ("b.jpg", "y")]
    with pytest.raises(Exception, match="no checksum of b.jpg"):
        checked_images(spark, images, file("t.json", {"a.jpg": {"sha256": "x"}})).collect()
    whole = file("c.json", {"info": {}, "images": pics, "annotations": notes})
    assert sorted(tuple(r) for r in captions(spark, whole, 2, 3).collect()) == [("a cat", "b.jpg"), ("a dog", "a.jpg"), ("a dog", "a.jpg")]
    broken = [{"images": pics + pics, "annotations": notes}, {"images": pics, "annotations": notes + [{"image_id": 9, "caption": "?"}]}, {"images": pics, "annotations": notes[:1]}]
    for k, data in enumerate(broken):
        with pytest.raises(EngineError):
            captions(spark, file(f"b{k}.json", data))
    with pytest.raises(EngineError):
        captions(spark, whole, 3)


def png(pixels, colour=2, depth=8, filters=(0, 1, 2, 3, 4), laced=False, palette=None):
    """pixels: height x width x channels of samples; each line of a pass gets the next filter."""
    height, width, channels = pixels.shape

    def packed(line):
        bits = np.array([[(int(v) >> k) & 1 for k in range(depth - 1, -1, -1)] for v in line.ravel()], np.uint8).ravel()
        return np.packbits(bits).tolist()

    def filtered(part):
        step, out, above, n = max(1, channels * depth // 8), b"", None, 0
        for line in part:
            own = packed(line)
            up, kind = above or [0] * len(own), filters[n % len(filters)]
            made = [kind]
            for x, v in enumerate(own):
                a, b, c = own[x - step] if x >= step else 0, up[x], up[x - step] if x >= step else 0
                near = sorted((abs(a + b - c - w), k, w) for k, w in enumerate((a, b, c)))[0][2]
                made.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
            out, above, n = out + bytes(made), own, n + 1
        return out

    parts = [pixels[y::dy, x::dx] for x, y, dx, dy in codecs.PASSES] if laced else [pixels]
    data = zlib.compress(b"".join(filtered(p) for p in parts if p.size))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(laced))
    return codecs.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


def test_codecs():
    rng = np.random.default_rng(8)
    for laced in (False, True):
        for height, width in ((7, 5), (1, 1), (9, 13)):
            make = lambda channels, most=256: rng.integers(0, most, (height, width, channels), np.int64)
            rgb, grey = make(3), make(1)
            assert (codecs.decode(png(rgb, laced=laced)) == rgb).all()
            assert (codecs.decode(png(np.concatenate([rgb, make(1)], 2), 6, laced=laced)) == rgb).all()
            assert (codecs.decode(png(np.concatenate([grey, make(1)], 2), 4, laced=laced)) == np.repeat(grey, 3, 2)).all()
            assert (codecs.decode(png(rgb * 256 + 7, 2, 16, laced=laced)) == rgb).all()
            palette = rng.integers(0, 256, (16, 3), np.uint8)
            for depth in (1, 2, 4, 8):
                few = make(1, 1 << depth)
                assert (codecs.decode(png(few, 0, depth, laced=laced)) == np.repeat(few * (255 // ((1 << depth) - 1)), 3, 2)).all()
                few = few % 16
                assert (codecs.decode(png(few, 3, depth, laced=laced, palette=palette)) == palette[few[:, :, 0]]).all()
    whole = png(rgb)
    for broken in (whole[:40], whole[:-20], whole.replace(b"IHDR", b"IHDQ"), png(grey % 2, 3, 1), b"GIF89a", png(grey, 3, 8, palette=palette[:0])):
        with pytest.raises(ImageError):
            codecs.decode(broken)
    for bits in (24, 32):
        line = lambda row: b"".join(bytes([b, g, r] + [9] * (bits == 32)) for r, g, b in row.tolist()).ljust(-(-width * bits // 32) * 4, b"\0")
        for turn in (1, -1):
            body = b"".join(line(row) for row in rgb[::-turn])
            bmp = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, turn * height, 1, bits, 0, 0, 0, 0, 0, 0) + body
            assert (codecs.decode(bmp) == rgb).all()
    with pytest.raises(ImageError):
        codecs.decode(bmp[:-1])


def test_pictures_end_to_end(spark, tmp_path):
    """From files of several formats to ranked answers; the query itself is left out, a broken file is skipped."""
    red, blue = np.full((48, 64, 3), (240, 20, 30)), np.full((48, 64, 3), (20, 30, 240))
    nearly = red + np.arange(3)
    tree(tmp_path / "r", {"red.png": png(red, filters=(0,)), "sub/nearly.png": png(nearly, filters=(2,)), "blue.png": png(blue, filters=(1,)), "cut.png": png(red)[:60], "shot.jpg": b"GIF89a"})
    skipped = []
    engine = Engine(spark, str(tmp_path / "r"), PixelEncoder(DIM), CONTRACT, str(tmp_path / "i"), lambda p, e: skipped.append(p))
    assert engine.index() == 3 and sorted(skipped) == [b"cut.png", b"shot.jpg"]
    found = engine.search(image=str(tmp_path / "r/red.png"), top=5, threshold=-1.0)
    assert [p for _, p in found] == [b"sub/nearly.png", b"blue.png"] and found[0][0] > 0.99 > found[1][0]
    (tmp_path / "other.png").write_bytes(png(blue + 1, filters=(0,)))
    assert engine.search(image=str(tmp_path / "other.png"), top=1, threshold=-1.0)[0][1] == b"blue.png"


def test_verified(spark, tmp_path):
    from orrery.sources.corpora import verified

    tree(tmp_path, {"a.jpg": b"one", "b.jpg": b"two", "c.jpg": b""})
    sums = [(n, hashlib.sha256(d).hexdigest()) for n, d in (("a.jpg", b"one"), ("b.jpg", b"two"))]
    checks = lambda rows: spark.createDataFrame(rows, "file_name string, sha256 string")
    assert sorted(r.file_name for r in verified(spark, str(tmp_path), checks([(sums[0][0], sums[0][1].upper()), sums[1]])).collect()) == ["a.jpg", "b.jpg"]
    for wrong in (("b.jpg", sums[0][1]), ("d.jpg", sums[0][1]), ("a.jpg", None)):
        with pytest.raises(Exception, match="missing or changed"):
            verified(spark, str(tmp_path), checks([sums[0], wrong])).collect()


def test_sinks():
    assert sinks.escape_path(b"a\\b\tc\x01") == "a\\\\b\\tc\\u{1}"
    assert sinks.escape_path(b"\xff\n") == "\\xff\\x0a"
    assert sinks.score_text(0.0625) == "0.062" and sinks.score_text(0.5) == "0.500"
    assert json.loads(sinks.render([(0.5, b"a")], "json")) == [{"score": 0.5, "path": "a"}]
    assert sinks.render([(0.5, b"\xff")], "nul") == b"\xff\0"
    with pytest.raises(EngineError):
        sinks.render([(0.5, b"\xff")], "json")


def test_cli(spark, tmp_path):
    tree(tmp_path, {"a.jpg": b"one"})
    out = io.BytesIO()
    assert cli.main(["dog", str(tmp_path), "--threshold", "-1", "--paths"], spark, out) == 0
    assert out.getvalue() == f"{tmp_path}/a.jpg\n".encode()
    assert cli.main(["dog", str(tmp_path), "--threshold", "1"], spark, io.BytesIO()) == 1
    assert cli.main([" ", str(tmp_path)], spark) == 2 and cli.main(["x", str(tmp_path), "--top", "0"], spark) == 2


def test_timings_and_progress(spark, tmp_path, capsys):
    tree(tmp_path / "r", {f"{k:03}.jpg": b"x%d" % k if k % 50 else b"corrupt" for k in range(1, 521)})
    lines, timings = [], Timings()
    engine = Engine(spark, str(tmp_path / "r"), HashEncoder(DIM), CONTRACT, str(tmp_path / "i"), timings=timings, progress=Progress(lines.append), commit=COMMIT_BATCH)
    assert engine.index() == 510
    assert [x for x in lines if x.startswith("Index")] == ["Indexing 520 images...", "Indexed 256/520 images", "Indexed 512/520 images"] and sum(x.startswith("warning: ") for x in lines) == 10
    engine.search("a dog")
    told = json.loads(timings.report())
    by = {p["phase"]: p for p in told["phases"]}
    assert by["commit"]["invocations"] == 4 and by["scan"]["invocations"] == 2 and by["rank"]["elapsed_ms"] > 0 and told["total_wall_ms"] >= sum(p["elapsed_ms"] for p in told["phases"])
    assert told["environment"]["query_cache_state"] == "miss" and told["environment"]["index_cache_state"] == "partial"

    class Short(HashEncoder):
        def images(self, prepared):
            return super().images(prepared)[:-1]

    with pytest.raises(Exception, match="the model gave shape"):
        Engine(spark, str(tmp_path / "r"), Short(DIM), CONTRACT, str(tmp_path / "j")).index()
    assert cli.main(["dog", str(tmp_path / "r"), "--threshold", "1", "--timings", str(tmp_path / "t.json")], spark, io.BytesIO()) == 1
    assert json.loads((tmp_path / "t.json").read_text())["schema_version"] == 1 and "Indexing 520 images..." in capsys.readouterr().err


def test_stream(spark, tmp_path):
    from orrery.streaming.ingest import ingest

    unit = [1.0] + [0.0] * (DIM - 1)
    rows = spark.createDataFrame([(1, "upsert", b"a", 1, 1, unit), (2, "delete", b"a", None, None, None), (1, "upsert", b"b", 1, 1, unit)], "seq int, op string, path binary, mtime_ns long, size long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "feed"))
    index = Index(spark, str(tmp_path / "i"), CONTRACT)
    ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "feed")), index, str(tmp_path / "c")).awaitTermination()
    assert [bytes(r.path) for r in index.files().collect()] == [b"b"]
