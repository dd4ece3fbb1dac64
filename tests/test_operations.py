import json
import math
import os
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.contracts import CHANGES, DIM, Contract, EngineError
from orrery.operators import metrics, ranking, stats
from orrery.operators.blocks import Layout
from orrery.operators.encode import embed
from orrery.operators.reconcile import BucketedSnapshot, chunks
from orrery.sources import sinks
from orrery.sources.result_sink import read_bytes, write_results
from orrery.sources.snapshot import Index
from orrery.timing import Timings

CONTRACT = Contract("i1", "q1", DIM)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:160] = x[99]  # more copies than a page of answers
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(7000, None), (7001, []), (7002, [float("nan")] * 16), (7003, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return x, df, Layout.write(df, "vec_id", block_rows=100, pivots=60)


@pytest.mark.parametrize("query, top, threshold, exclude", [(0, 10, -1.0, 0), (99, 20, -1.0, 99), (5, 5, 0.25, None), (7, 9000, -2.0, None), (3, 5, 2.0, None), (3, 0, 0.0, None)])
def test_blocks_one_query(clusters, query, top, threshold, exclude):
    """Rows of a scan, bit for bit; fewer than half of the blocks are read where k is small."""
    x, df, layout = clusters
    got, report = layout.search(x[query], top, threshold, exclude=exclude)
    whole = df.where("vec_id < 3000")
    want = ranking.search(whole, x[query], top, threshold, exclude=None if exclude is None else F.col("vec_id") == exclude)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [tuple(r) for r in want.orderBy("rank").collect()]
    assert report.total == layout.bounds.count() and (top > 100 or report.share < 0.5)


@pytest.mark.parametrize("top, threshold", [(10, -1.0), (4, 0.95), (0, -1.0)])
def test_blocks_many_queries(clusters, top, threshold):
    _, df, layout = clusters
    asked = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got, report = layout.batch_search(asked, top, threshold)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ranking.batch_search(df, asked, top, threshold).collect()))
    assert report.share < 0.5
    assert layout.batch_search(asked.limit(0), 3)[0].count() == 0


def test_blocks_without_structure(spark, monkeypatch):
    """Where nearly all blocks are needed, queries are paired with their first blocks alone, and answers are those of a scan."""
    x = np.random.default_rng(2).normal(size=(3000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, [1.0, 2.0]), (9001, [3.0, 1.0])], "vec_id long, embedding array<double>")
    layout = Layout.write(df, "vec_id", block_rows=30, pivots=50)
    pairs, plain = [], Layout._meet
    monkeypatch.setattr(Layout, "_meet", lambda self, own, *a: pairs.append(own.count()) or plain(self, own, *a))
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got, report = layout.batch_search(asked, 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ranking.batch_search(df, asked, 10).collect()))
    assert sum(pairs) <= 2 * asked.count() and 0.5 < report.share <= 1


def test_bucketed(spark):
    """Reconciling and applying shuffle what comes in alone; versions follow one another."""
    rng = random.Random(2)
    rows = "path string, mtime_ns long, size long"
    held = {f"p{k}": (k, 1) for k in range(300)}
    index = BucketedSnapshot(spark, "snapshot_test", "path", 8).write(spark.createDataFrame([(p, *v) for p, v in held.items()], rows))
    try:
        for turn in range(2):
            now = {p: v for p, v in held.items() if rng.random() > 0.2} | {f"n{turn}-{k}": (k, 2) for k in range(40)}
            for p in rng.sample(sorted(now), 30):
                now[p] = (-1 - turn, 9)
            found = spark.createDataFrame([(p, *v) for p, v in now.items()], rows)
            plan = index.plan(found)
            text = plan_text(plan)  # before it runs: one plan, not the initial beside the final one
            want = {p: "missing" if p not in held else "stale" if p not in now else "same" if held[p] == now[p] else "changed" for p in held.keys() | now.keys()}
            assert {r.path: r.op for r in plan.collect()} == want
            assert text.count("Exchange") == 1 and "Bucketed: true" in text
            told = found.join(plan.where("op in ('missing', 'changed')").select("path"), "path").withColumn("op", F.lit("upsert"))
            gone = plan.where("op = 'stale'").select("path", F.lit(None).cast("long").alias("mtime_ns"), F.lit(None).cast("long").alias("size"), F.lit("delete").alias("op"))
            index.apply(told.unionByName(gone))
            assert {r.path: (r.mtime_ns, r.size) for r in index.rows.collect()} == now
            held = now
    finally:
        index.drop()


@pytest.mark.parametrize("most", [20, 10_000])
def test_ranks_by_brackets(spark, most):
    """Against sorted lists, in one pass or many: ties, NaN and infinities, nulls, null groups, one value, no rows."""
    rng = random.Random(most)
    rows = [(g, rng.choice([float(rng.randrange(9)), rng.gauss(0, 100), None, float("nan"), float("inf")])) for g in ("a", None) for _ in range(1500)]
    rows += [("one", 4.0), ("none", None)] + [("same", 2.5)] * 500 + [("nan", float("nan"))] * 30 + [("skew", float(k) ** 3) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    by = {g: sorted(x, key=lambda v: (math.isnan(v), v)) for g, x in by.items()}
    got = {r.g: (r.p1, r.p50, r.p99, r.p100) for r in stats.at_ranks(df, ["g"], "v", {f"p{p}": lambda n, p=p: F.ceil(n * p / 100) for p in (1, 50, 99, 100)}, most).collect()}
    want = {g: tuple(x[-(-len(x) * p // 100) - 1] for p in (1, 50, 99, 100)) for g, x in by.items()}
    assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))
    whole = spark.createDataFrame([(v,) for v in range(10**6, 10**6 + 999)], "v long")
    assert stats.at_ranks(whole, [], "v", {"m": lambda n: F.floor(n / 2) + 1}, most).first()[0] == 10**6 + 499
    assert stats.at_ranks(df.where("false"), ["g"], "v", {"m": lambda n: n}, most).count() == 0


def test_drawn_medians():
    """Bit for bit the medians of the values drawn: ties, infinities, NaN, odd and even numbers, and more than a byte counts."""
    rng = random.Random(4)
    for n in (1, 2, 7, 30, 300):
        for pool in ([1.5, 2.5, 1e-3], [rng.gauss(0, 9) for _ in range(50)], [1.0, float("inf"), 3.0], [2.0, float("nan"), 5.0]):
            values = np.array([rng.choice(pool) for _ in range(n)])
            want = np.median(values[stats._places(n, 250, 500)], axis=1)
            assert np.array_equal(stats._drawn_medians(values, 250, 500), want, equal_nan=True)


def test_bootstrap_of_many(spark):
    """Many scenarios: one row each leaves a task, and no draw is shuffled."""
    rng = random.Random(6)
    own = {f"s{k}": ([rng.random() + 1 for _ in range(10)], [rng.random() + 1 for _ in range(10)]) for k in range(60)}
    samples = spark.createDataFrame([(s, side, k, v) for s, both in own.items() for side, own_side in zip(("reference", "candidate"), both) for k, v in enumerate(own_side)], "scenario string, side string, n int, seconds double")
    got = stats.bootstrap(samples)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    assert {r.scenario: (r.change, r.low, r.high) for r in got.collect()} == {s: stats.change_interval(a, b) for s, (a, b) in own.items()}


def test_report_makes_samples_once(spark):
    """The samples of a report are computed once, whatever reads them."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = [(f"s{s}", side, n, 1.0 + s + n, 1024 * n) for s in range(3) for side in ("reference", "candidate") for n in range(4)]
    schema = "scenario string, side string, n int, seconds double, rss_bytes long"
    samples = spark.createDataFrame(rows, schema).mapInPandas(count, schema)
    assert stats.report(samples).count() == 3 and made.value == 24
    assert stats.medians(samples).count() == 6 and made.value == 48


def test_bootstrap_blocks(spark):
    """Blocks of draws of any size give the interval of all draws at once."""
    rng = random.Random(3)
    own = {s: ([rng.random() + 1 for _ in range(n)], [rng.random() + 1 for _ in range(n)]) for s, n in (("x", 12), ("y", 31), ("z", 1))}
    samples = spark.createDataFrame([(s, side, k, v) for s, both in own.items() for side, own_side in zip(("reference", "candidate"), both) for k, v in enumerate(own_side)], "scenario string, side string, n int, seconds double")
    for block in (250, 777, 2000):
        got = {r.scenario: (r.change, r.low, r.high) for r in stats.bootstrap(samples, block).collect()}
        assert got == {s: stats.change_interval(a, b) for s, (a, b) in own.items()}
    assert statistics.median(own["x"][0]) > 0


@pytest.mark.parametrize("form", ["text", "json", "paths", "nul"])
def test_result_sink(spark, tmp_path, form):
    """The bytes of one rendering of all rows, whatever the parts; no rows; an error leaves no parts."""
    rows = [(k, (k * 37 % 101) / 101, f"d\\{k}\t{'é' * (k % 3)}.jpg".encode()) for k in range(6000)]
    df = spark.createDataFrame(rows, "rank int, score double, path binary").repartition(7)
    for name, own, quiet in (("all", df, False), ("quiet", df.where("rank < 5"), True), ("none", df.limit(0), False)):
        write_results(own, str(tmp_path / name), ["rank"], form=form, quiet=quiet)
        kept = [(s, p) for k, s, p in rows if name == "all" or (name == "quiet" and k < 5)]
        assert read_bytes(str(tmp_path / name)) == sinks.render(kept, form, quiet)
    if form == "json":
        json.loads(read_bytes(str(tmp_path / "all")))
        with pytest.raises(Exception, match="not UTF-8"):
            write_results(spark.createDataFrame([(1, 0.5, b"\xff")], "rank int, score double, path binary"), str(tmp_path / "bad"), ["rank"], form=form)
        assert not os.path.exists(tmp_path / "bad" / "_SUCCESS")


def test_output_difference(spark):
    lists = {"same": ([("a", 0.5), ("b", 0.4)],) * 2, "close": ([("a", 0.5)], [("a", 0.50009)]), "far": ([("a", 0.5), ("b", 0.4)], [("a", 0.5), ("b", 0.40011)]), "nan": ([("a", float("nan"))],) * 2,
             "short": ([("a", 0.5), ("b", 0.4)], [("a", 0.5)]), "other": ([("a", 0.5)], [("b", 0.5)]), "gone": ([("a", 0.5)], [])}
    make = lambda n: spark.createDataFrame([(q, k, p, s) for q, both in lists.items() for k, (p, s) in enumerate(both[n], 1)], "query_id string, rank int, vec_id string, score double")
    got = {r.query_id: r.difference for r in metrics.output_difference(make(0), make(1)).collect()}
    assert got == {"same": None, "close": None, "far": "result 2 differs", "nan": "result 1 differs", "short": "result count differs: 2 vs 1", "other": "result 1 differs", "gone": "result count differs: 1 vs 0"}


def test_sample_order_and_memory(spark):
    got = {}
    for r in sorted(stats.sample_order(spark.range(4).withColumnRenamed("id", "n")).collect(), key=lambda r: (r.n, r.turn)):
        got.setdefault(r.n, []).append(r.side)
    assert list(got.values()) == [["reference", "candidate"], ["candidate", "reference"]] * 2
    rows = spark.createDataFrame([(5, "darwin"), (5, "Linux")], "v long, s string")
    assert [r[0] for r in rows.select(stats.resident_bytes(F.col("v"), F.col("s"))).collect()] == [5, 5120]


def test_narrow_reads(spark, tmp_path):
    """Keys and versions are read without vectors, also where there are deltas; a query's vector is one folder's read and one row's write."""
    index, unit = Index(spark, str(tmp_path / "i"), CONTRACT, "/r"), [1.0] + [0.0] * (DIM - 1)
    for turn in range(3):
        index.commit(spark.createDataFrame([("upsert", b"%d" % (k + turn), turn, 1, unit) for k in range(3)], CHANGES))
        index.delete(spark.createDataFrame([(b"%d" % turn,)], "path binary"))
    assert sorted(bytes(r.path) for r in index.files().collect()) == sorted(bytes(r.path) for r in index.vectors().collect()) == [b"3", b"4"]
    assert "embedding" not in re.findall(r"ReadSchema: .*", plan_text(index.files()) + str(index.files()._jdf.queryExecution().toString())).__str__()
    for k in range(5):
        index.remember(f"q{k}", unit[:-1] + [float(k)])
    folder = os.path.join(index.path, index.metadata("queries"))
    before = {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}
    index.remember("q2", unit)
    after = {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}
    assert len(after) == len(before) + 1 and all(after[p] == t for p, t in before.items())
    assert index.recall("q2") == unit and index.recall("q3")[-1] == 3.0 and index.recall("Q3") is None
    told = index.recalled("q2")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", told) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(query,q2\)", told)
    assert index.queries().count() == 6


def test_commit_leaves_nothing(spark, tmp_path):
    """A commit that fails its checks leaves no delta behind, and two changes of a path are one failure."""
    index, unit = Index(spark, str(tmp_path / "i"), CONTRACT, "/r"), [1.0] + [0.0] * (DIM - 1)
    for rows in ([("upsert", b"a", 1, 1, [2.0] + unit[1:])], [("upsert", b"a", 1, 1, unit), ("delete", b"a", None, None, None)]):
        with pytest.raises(EngineError):
            index.commit(spark.createDataFrame(rows, CHANGES))
        assert not [n for n in os.listdir(index.path) if n.startswith("delta-")] and index.count() == 0


def tellers():
    """An encoder whose vectors tell their batch: its first file and its size; defined here, so that tasks get it by value."""
    from orrery.contracts import ImageError

    class Batches:
        def prepare(self, path):
            if path.endswith(b"bad.jpg"):
                raise ImageError("broken")
            return int(os.path.basename(path)[:4])

        def images(self, prepared):
            return np.array([[1.0, float(prepared[0]), float(len(prepared))] for _ in prepared], np.float32)

    return Batches()


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_batches_across_partitions(spark, parts, tmp_path):
    """The same batches of eight in order of path, however files are dealt."""
    names = [f"{k:04}{'bad' if k % 13 == 0 else ''}.jpg" for k in range(203)]
    files = spark.createDataFrame([(n.encode(), 1, 1) for n in names], "path binary, mtime_ns long, size long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {bytes(r.path): r for r in embed(files, "/", tellers()).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 203
    for at in range(0, 203, 8):
        good = [n for n in names[at : at + 8] if "bad" not in n]
        size = np.float32(len(good)) / np.linalg.norm(np.float32([1.0, int(good[0][:4]), len(good)]))
        for n in names[at : at + 8]:
            r = rows[n.encode()]
            assert (r.error == "broken" and r.embedding is None) if "bad" in n else r.embedding[2] == pytest.approx(size, rel=1e-5)
            assert r.decode_ms >= 0 and r.infer_ms >= 0
    assert embed(files.limit(0), "/", tellers()).count() == 0


def test_recorded_phases(spark):
    timings = Timings()
    timings.add("decode", 1500.0, 3)
    timings.add("decode", 500.0)
    with timings.phase("scan"):
        pass
    rows = {r.phase: (r.elapsed_ms, r.invocations) for r in stats.phase_rollup(timings.table(spark), "phase", "elapsed_ms").collect()}
    assert rows["decode"] == (2000.0, 1) and set(rows) == {"decode", "scan"} and dict((n, k) for n, _, k in timings.rows())["decode"] == 4


def test_chunks_travel_once(spark):
    """Numbers without a window: the only exchange is the one by range."""
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.lit("x").alias("_q"))
    assert {r.id: r.chunk for r in chunks(rows, ["id"], 8).collect()} == {i: i // 8 for i in range(1000)}
    assert "Window" not in plan_text(chunks(rows, ["id"], 8))


def test_command_lines(capsys):
    """What is taken, and what is refused with status 2 before anything starts."""
    from orrery import cli

    got = cli.parse(["a dog", "dir", "-n", "3", "-t", "-0.5", "-0", "--paths-only", "-q"])
    assert (got.command, got.query, got.directory, got.top, got.threshold, got.form, got.quiet) == ("search", "a dog", "dir", 3, -0.5, "nul", True)
    assert cli.parse(["--image", "x.jpg", "dir", "--json"]).form == "json" and cli.parse(["dir", "--image", "x.jpg"]).directory == "dir"
    assert cli.parse(["index", "dir", "--index-path", "p"]).command == "index" and cli.parse(["-q", "index", "dir"]).query == "index"
    assert cli.parse(["a", "d", "--timing"]).report == "-" and cli.parse(["a", "d", "--timing", "--timing-file", "f"]).report == "f" and cli.parse(["a", "d"]).report is None
    assert cli.parse(["--", "-x", "dir"]).query == "-x"
    wrong = [[], ["only"], ["a", "b", "c"], ["--image", "x", "a", "b"], ["--image", "x"], ["a", "d", "--json", "--paths-only"], ["a", "d", "--json", "-0"], ["a", "d", "--reindex", "--no-cache"],
             ["a", "d", "--no-cache", "--index-path", "p"], ["a", "d", "--timing-file", "f"], ["a", "d", "-n", "x"], ["index"], ["index", "d", "--json"], ["a", "d", "--unknown"], ["a", "d", "--to", "3"]]
    for line in wrong:
        assert cli.main(line) == 2, line
    assert "cannot be combined" in capsys.readouterr().err
    for line in (["a", "d", "-n", "0"], ["a", "d", "-t", "2"], ["a", "d", "-t", "nan"], [" \t", "d"]):
        assert cli.main(line) == 2


def test_typed_errors(spark, tmp_path):
    """A class for each cause, with what it is about, also when it comes from a task."""
    import pickle

    from orrery import errors
    from orrery.sources.scan import discover, snapshot

    unit = [1.0] + [0.0] * (DIM - 1)
    assert errors.vector_error(b"p", unit, DIM) is None and errors.vector_error(b"p", None, 2).path == b"p"
    kinds = {errors.DimensionError: [1.0], errors.NonFiniteError: [float("nan"), 1.0], errors.NormError: [3.0, 4.0]}
    for kind, vector in kinds.items():
        assert type(errors.vector_error(b"p", vector, 2)) is kind
    told = pickle.loads(pickle.dumps(errors.NormError(path=b"p", norm=5.0)))
    assert told.norm == 5.0 and str(told) == "b'p': length 5.0 is not 1"
    index = Index(spark, str(tmp_path / "i"), CONTRACT, "/r")
    with pytest.raises(errors.NormError) as e:
        index.commit(spark.createDataFrame([("upsert", b"a", 1, 1, unit), ("upsert", b"b", 1, 1, [2.0] + unit[1:])], CHANGES))
    assert e.value.path == b"b"
    with pytest.raises(errors.DuplicateChangeError):
        index.commit(spark.createDataFrame([("upsert", b"a", 1, 1, unit), ("delete", b"a", None, None, None)], CHANGES))
    with pytest.raises(errors.RootMismatchError) as e:
        Index(spark, str(tmp_path / "i"), CONTRACT, "/other")
    assert (e.value.bound, e.value.asked) == ("/r", "/other")
    for path, kind in (("none", errors.RootMissingError), ("file", errors.RootKindError)):
        (tmp_path / "file").write_bytes(b"")
        with pytest.raises(kind):
            discover(spark, str(tmp_path / path))
    old = tmp_path / "old.jpg"
    old.write_bytes(b"")
    os.utime(old, ns=(-5, -5))
    with pytest.raises(errors.EpochError):
        snapshot(os.fsencode(old), b"old.jpg")
    with pytest.raises(errors.MetadataError):
        index.metadata("nothing")


def test_heap_is_a_full_sort(spark):
    """The best of 20,000 rows by a bounded heap are those of a full sort of 32-bit scores, bit for bit, ties by path."""
    n = 20_000
    first = ((np.arange(n) % 2001) - 1000).astype(np.float32) / np.float32(1000)
    rows = spark.range(n).select(F.encode(F.format_string("image-%06d.jpg", "id"), "UTF-8").alias("path"), F.array(((F.col("id") % 2001 - 1000).cast("float") / F.lit(1000.0).cast("float")).cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    order = np.lexsort((np.arange(n), -first))
    for top, threshold in ((100, -1.0), (37, 0.25)):
        got = ranking.search(rows, [1.0, 0.0], top, threshold, "path", f32=True).orderBy("rank").collect()
        want = [i for i in order if first[i] >= np.float32(threshold)][:top]
        assert [(bytes(r.path), np.float32(r.score)) for r in got] == [(b"image-%06d.jpg" % i, first[i]) for i in want]
