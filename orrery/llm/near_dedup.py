"""MinHash near-dedup with tensored banding.

A text's set is its distinct word shingles. ``groups`` small collections of ``rows`` minhashes are computed for it, 42
hashes at the defaults; each pair of collections makes the key of one table, so 91 tables of 6 minhashes each come from
them, where plain banding would compute 546. Two sets of similarity s share a key if they agree on two collections at
least: 0.9993 at s = 0.8, 1 - 1e-6 at 0.9.

Candidates are confirmed on full sets; the texts of classes that share a bucket with another are fetched once for that.
Equal sets are one class from the start. Links between classes are looked for until no bucket holds two components whose
members were not compared: first each class with the least class that it shares a bucket with, then in two rounds each
class with the least, and the greatest, of another component among the ends of its buckets. What has been found is
carried as a star, a class and its component, so there are never more links than two a class. What is left is compared
in full: pair by pair in buckets of at most DENSE classes, so that pairs stay in proportion to rows, and block by block
in larger ones, whose texts resemble each other just below the limit. There each two blocks that hold different
components are one product of incidence matrices in one task, which returns a spanning forest of its links; pairs are
never rows. Pairs inside a component are mostly not compared, as no answer depends on them, so a large group of near
copies costs about one comparison a member. DENSE changes the way, never the links.

Cases: texts without words, and null texts, have an empty set and are linked with nothing; a row with a null doc_id is
left out of linking and gets a null component and kept = true; rows that repeat a doc_id are one document (their sets
are taken together as the classes of one id); texts shorter than a shingle are one shingle; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._flat import mix, shingles, word_hashes
from orrery.llm._store import Scratch, free

WORDS, PERCENT, GROUPS, ROWS = 5, 80, 14, 3
BATCH = 4 << 20
DENSE, BLOCK, BLOCK_SHINGLES, TASK_ROWS = 24, 128, 1 << 20, 1_000_000


def _sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin (one more than texts)."""
    words, at = word_hashes(text, lower=True)
    hashes, first = shingles(words, at, n, short=True)
    doc = np.searchsorted(at, first, "right") - 1
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(text) + 1))


def _reduce(ufunc, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ufunc over each run that isn't empty, 0 for those that are."""
    out = np.zeros(len(at) - 1, values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, at[full])
    return out


def signatures(docs: DataFrame, n_words: int = WORDS, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (fp_a, fp_b) and the collections g0, g1, ..."""
    names = [f"g{k}" for k in range(groups)]

    def sign(batches):
        for batch in batches:
            whole = batch["text"].cast(pa.large_string())
            lengths = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(whole), 0).to_numpy())
            cuts, done = [0], 0
            for k, total in enumerate(lengths.tolist()):
                if total - done > BATCH:
                    cuts.append(k + 1)
                    done = total
            for a, b in zip(cuts, [*cuts[1:], len(batch)]):
                if a == b:
                    continue
                sets, at = _sets(whole.slice(a, b - a), n_words)
                cols = {
                    "doc_id": batch["doc_id"].slice(a, b - a), "n_shingles": pa.array(np.diff(at).astype(np.int64)),
                    "fp_a": pa.array(_reduce(np.add, mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at).view(np.int64)),
                    "fp_b": pa.array(_reduce(np.add, mix(sets + np.uint64(0x3C6EF372FE94F82B)), at).view(np.int64)),
                }
                for g, name in enumerate(names):
                    own = np.zeros(len(at) - 1, np.uint64)
                    for r in range(rows):
                        seed = mix(np.array([g * rows + r + 1], np.uint64))[0]
                        least = _reduce(np.minimum, (sets ^ seed) * np.uint64(0x9E3779B97F4A7C15), at)
                        own = mix(own * np.uint64(31) + least)
                    cols[name] = pa.array(own.view(np.int64))
                yield pa.record_batch(cols)

    schema = "doc_id long, n_shingles long, fp_a long, fp_b long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, schema)


def confirm(pairs: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the similarity; texts: doc_id, text."""

    def check(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                (left, at), (right, to) = _sets(part["_ta"], n_words), _sets(part["_tb"], n_words)
                for i in range(len(part)):
                    x, y = left[at[i] : at[i + 1]], right[to[i] : to[i + 1]]
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and len(x):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[k + i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.record_batch({"a": batch["a"], "b": batch["b"]}).filter(pa.array(keep))

    own = texts.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t"))
    left = pairs.join(own.select(F.col("_id").alias("a"), F.col("_t").alias("_ta")), "a")
    return left.join(own.select(F.col("_id").alias("b"), F.col("_t").alias("_tb")), "b").mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node in links (a, b): comp is the least node reachable. Labels spread over links and jump
    to their label's label, so the rounds grow with the logarithm of a component's diameter."""
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("src", "dst"))
    labels = scratch.keep(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("comp")).withColumnRenamed("src", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.src).select("node", F.least("comp", "near").alias("to"), "comp")
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        moved = scratch.keep(step.join(jump, "to").select("node", F.least("to", "next").alias("comp"), (F.least("to", "next") != F.col("comp")).alias("moved")))
        scratch.drop(labels)
        labels = scratch.same(moved.select("node", "comp"), moved)
        if moved.where("moved").isEmpty():
            scratch.drop(both)
            return labels


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, comp) after more links. What is known stands as a star, one link a node, whatever links it came from."""
    star = labels.where("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    out = components(star.union(links.select("a", "b")), scratch)
    scratch.drop(labels)
    return out


def clusters(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(comp, cluster): components of classes (comp) that buckets (key) connect, cluster being the least of them. In each
    round a cluster is linked with the least one that it shares a bucket with, and no other."""
    spots = scratch.keep(rows.select("key", "comp", F.col("comp").alias("cluster")).distinct())
    while True:
        ends = spots.groupBy("key").agg(F.min("cluster").alias("b"), F.max("cluster").alias("most")).where("b < most")
        ends = scratch.keep(ends.select("key", "b"))
        if ends.isEmpty():
            return spots.select("comp", "cluster").distinct()
        links = spots.join(ends, "key").where("cluster != b").groupBy(F.col("cluster").alias("a")).agg(F.min("b").alias("b"))
        found = components(links, scratch).toDF("cluster", "_to")
        moved = scratch.keep(spots.join(found, "cluster", "left").select("key", "comp", F.coalesce("_to", "cluster").alias("cluster")))
        for done in (spots, ends):
            scratch.drop(done)
        spots = moved


def dense_links(rows: DataFrame, texts: DataFrame, n_words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links between different components among classes of large buckets. rows: key, class, n_shingles, comp.

    Classes that large buckets connect are one cluster, which is cut into blocks of about BLOCK classes and at most about
    BLOCK_SHINGLES shingles. A large component fills blocks of its own, which don't meet each other; all other two blocks
    meet once. So a few classes beside a large component cost its size, and not the square of it."""
    dealt = rows.select("class", "n_shingles", "comp").distinct().join(clusters(rows, scratch), "comp")
    dealt = scratch.keep(dealt.select("cluster", "comp", F.col("class").alias("_id"), "n_shingles"))
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    sizes = dealt.groupBy("cluster", "comp").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_s"))
    sizes = scratch.keep(sizes.withColumn("_own", F.when(F.col("_n") >= BLOCK, F.col("comp"))))  # null: blocks shared with others
    shares = sizes.groupBy("cluster", "_own").agg(parts(F.sum("_n"), F.sum("_s")).alias("_m"))  # one row for each BLOCK classes at most
    order = Window.partitionBy("cluster").orderBy("_own")
    whole = Window.partitionBy("cluster")
    shares = shares.select("cluster", F.col("_own").alias("_as"), "_m", (F.sum("_m").over(order) - F.col("_m")).cast("int").alias("_first"), F.sum("_m").over(whole).cast("int").alias("_nb"))
    plan = sizes.join(shares.withColumnRenamed("cluster", "_c"), (F.col("cluster") == F.col("_c")) & F.col("_own").eqNullSafe(F.col("_as")))
    dealt = dealt.join(plan.select(F.col("comp").alias("_comp"), "_own", "_m", "_first", "_nb"), F.col("comp") == F.col("_comp"))
    dealt = dealt.withColumn("_at", F.col("_first") + F.pmod(F.xxhash64("_id"), F.col("_m")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_nb") - 1), lambda k: F.col("_own").isNull() | (k < F.col("_first")) | (k >= F.col("_first") + F.col("_m")))
    own = texts.select(F.col("doc_id").alias("_id"), "text")
    met = own.join(dealt.select("cluster", "comp", "_id", "_at", others.alias("_others")), "_id").withColumn("_other", F.explode("_others"))
    met = met.select("cluster", F.least("_at", "_other").alias("_i"), F.greatest("_at", "_other").alias("_j"), "_id", "comp", "text")

    def meet(table: pa.Table) -> pa.Table:
        sets, at = _sets(table["text"].combine_chunks().cast(pa.large_string()), n_words)
        ids, comp, count = table["_id"].to_numpy(), table["comp"].to_numpy(), np.diff(at)
        _, column = np.unique(sets, return_inverse=True)
        row = np.repeat(np.arange(len(ids)), count)
        both = np.zeros((len(ids), len(ids)), np.float32)
        for k in range(0, int(column.max(initial=-1)) + 1, 1 << 14):
            own = (column >= k) & (column < k + (1 << 14))
            part = np.zeros((len(ids), 1 << 14), np.float32)
            part[row[own], column[own] - k] = 1
            both += part @ part.T
        union = count[:, None] + count[None, :] - both
        x, y = np.nonzero(np.triu((100 * both >= percent * union) & (both > 0), 1) & (comp[:, None] != comp[None, :]))
        _, root = np.unique(comp, return_inverse=True)
        up = np.arange(root.max(initial=-1) + 1)
        forest = []
        for p, q in zip(x.tolist(), y.tolist()):
            i, j = int(root[p]), int(root[q])
            while up[i] != i:
                i = int(up[i])
            while up[j] != j:
                j = int(up[j])
            if i != j:
                up[max(i, j)] = min(i, j)
                forest.append((p, q))
        pairs = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[pairs[:, 0]]), "b": pa.array(ids[pairs[:, 1]])})

    return met.groupBy("cluster", "_i", "_j").applyInArrow(meet, "a long, b long").distinct()


def find_components(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over links) of each document."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(signatures(docs, n_words, groups, rows))
    names = [f"g{k}" for k in range(groups)]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["fp_a", "fp_b", "n_shingles"]
    classes = scratch.keep(usable.groupBy(*same).agg(F.min("doc_id").alias("class"), *[F.first(n).alias(n) for n in names]))
    keys = [F.xxhash64(F.lit(i), F.lit(j), names[i], names[j]) for i in range(groups) for j in range(i)]
    parts = max(1, -(-classes.count() * len(keys) // TASK_ROWS))  # a class becomes many rows, so few classes are many for a task
    tables = classes.select("class", "n_shingles", *names).repartition(parts).select("class", "n_shingles", F.explode(F.array(*keys)).alias("key"))
    # A key's rows never meet in one task: ends come from sums in each task, and a hot key's join can be split.
    hubs = scratch.keep(tables.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("most")).where("hub < most").select("key", "hub"))
    buckets = scratch.keep(tables.join(hubs, "key").select("key", "class", "n_shingles", "hub"))
    scratch.drop(hubs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = scratch.keep(own.join(buckets.select(F.col("class").alias("doc_id")).distinct(), "doc_id", "left_semi"))  # all that will be compared
    fits = F.lit(100) * F.least("n_shingles", "n_b") >= F.lit(percent) * F.greatest("n_shingles", "n_b")
    first = buckets.where("hub < class").groupBy(F.col("class").alias("a")).agg(F.min("hub").alias("b"))
    # Rows of one doc_id with different sets belong together.
    sets = usable.join(classes.select(*same, "class"), same).select("doc_id", "class")
    several = sets.groupBy("doc_id").agg(F.min("class").alias("b"), F.max("class").alias("most")).where("b < most").select("doc_id", "b")
    repeats = sets.join(scratch.keep(several), "doc_id").where("class != b").select(F.col("class").alias("a"), "b").distinct()
    labels = components(confirm(first, texts, n_words, percent).union(repeats), scratch)
    for choose in ("min", "max", "all"):
        known = buckets.join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "n_shingles", F.coalesce("comp", "class").alias("comp"))
        end = F.max if choose == "max" else F.min
        ends = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("_n"), end(F.struct("class", "n_shingles", "comp")).alias("e"))
        ends = scratch.keep(ends.where("low < high").select("key", "_n", F.col("e.class").alias("class_b"), F.col("e.n_shingles").alias("n_b"), F.col("e.comp").alias("comp_b")))
        if ends.isEmpty():
            break
        left = scratch.keep(known.join(ends, "key"))
        scratch.drop(buckets)
        if choose == "all":
            large = left.where(F.col("_n") > DENSE)
            more = dense_links(large, texts, n_words, percent, scratch) if not large.isEmpty() else None
            small = left.where(F.col("_n") <= DENSE).select("key", "class", "n_shingles", "comp")
            found = small.join(small.toDF("key", "class_b", "n_b", "comp_b"), "key").where("comp < comp_b").where(fits)
            found = found.select(F.greatest("class", "class_b").alias("a"), F.least("class", "class_b").alias("b")).distinct()
            more = confirm(found, texts, n_words, percent).union(more) if more is not None else confirm(found, texts, n_words, percent)
        else:
            # Each class with one of another component, however many buckets it is in.
            found = left.where("comp != comp_b").where(fits).groupBy(F.col("class").alias("a")).agg(end("class_b").alias("b"))
            more = confirm(found, texts, n_words, percent)
        labels = merged(labels, more, scratch)
        scratch.drop(ends)
        buckets = scratch.same(left.select("key", "class", "n_shingles"), left)
    for done in (buckets, texts):
        scratch.drop(done)
    reach = classes.select(*same, F.col("class").alias("node")).join(labels, "node", "left").select(*same, F.coalesce("comp", "node").alias("comp"))
    linked = signed.join(reach, same, "left")
    return linked.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components over distinct 2-word shingles at similarity 0.8."""
    found = find_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without those that are not the first of their component (5 words, 0.8), columns as they were, whatever their
    names; rows with a null doc_id stay."""
    (gone,) = free(docs, "gone")
    dropped = find_components(docs).where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def brute_force(rows: list[tuple[int, str | None]], n_words: int, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """n_shingles and component of each doc_id, by all pairs; for tests."""
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[k : k + n_words]) for k in range(max(1, len(w) - n_words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}
