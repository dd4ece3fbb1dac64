"""Balanced label propagation, with DataFrame functions only.

Documents with equal texts are linked. They begin in shard hash(doc_id) mod K; the copies of a text that begin in one
shard are a cell, so a text has K cells at most, whatever the number of its copies, and all propagation runs over cells
joined with per-text, per-shard sums. In each round a text's cells look for the shard that holds most of it (ties by a
hash of text and shard) and move there if the shard's quota has room for all that is elsewhere. Room is granted to small
requests first, by powers of two; within the power where it runs out, to the smallest, and to others by a hash of text and round. So a text with more
copies than fit stays where it is and keeps no other from moving. Each move to the heaviest neighbour cuts fewer edges;
rounds go on until none is granted. Then every document gets a place in its shard, linked ones first, by counts per (shard, hash part) and ranks inside each part;
places beyond the shard's quota, floor(n / K) or one more, are given the holes of the other shards in order. Counts are
thus at most one apart ("rows" law), and mostly documents without copies pay for it.

Nothing but the K shards' loads and requests by power of two reaches the driver, and only tables of K or K times the
number of rank parts are gathered in one task. Ranks need no global sort.

Cases: null texts count as no bytes and are linked with nothing, empty texts are equal to each other; rows that repeat
a doc_id are rows of their own; a null doc_id is hashed like any value; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._store import Scratch

SHARDS = 40
PART_ROWS = 4000


def _unit(*cols) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _grants(room: list[int], asked: list) -> list[tuple[int, float, str | None]]:
    """For each shard the power below which all requests are granted, the share of those of that power, and one of that power, the
    least, which is granted for itself. asked: rows of shard (to), power, the sum of requests (n) and the least (ask, gid). Where
    not all of a power fit, its least one does or nothing that is left does, so rounds go on until no request fits."""
    out = []
    for k, free in enumerate(room):
        power, share, gid = 64, 1.0, None
        for row in sorted((r for r in asked if r.to == k), key=lambda r: r.power):
            if row.n > free:
                power, share = row.power, 0.0
                if row.least.ask <= free:
                    gid, free = row.least.gid, free - row.least.ask
                    share = free / row.n if 2 ** (row.power + 1) <= free else 0.0
                break
            free -= row.n
        out.append((power, share, gid))
    return out


def propagate(cells: DataFrame, quota: list[int], scratch: Scratch) -> DataFrame:
    """cells (gid, home, shard, n, all) of linked documents after all rounds of moves."""
    turn = 0
    while True:
        held = cells.groupBy("gid", "shard").agg(F.sum("n").alias("m"))
        best = held.groupBy("gid").agg(F.max_by("shard", F.struct("m", F.xxhash64("gid", "shard"))).alias("to"), F.max("m").alias("top"), F.sum("m").alias("sum"))
        best = best.where("top < sum").select("gid", "to", (F.col("sum") - F.col("top")).alias("ask"))
        wants = scratch.keep(cells.join(best, "gid", "left").withColumn("to", F.coalesce("to", "shard")).withColumn("power", F.floor(F.log2("ask")).cast("int")))
        load = dict(wants.groupBy("shard").agg(F.sum("n")).collect())
        asked = wants.where("shard != to").groupBy("to", "power").agg(F.sum("n").alias("n"), F.min(F.struct("ask", "gid")).alias("least")).collect()  # some dozens a shard
        grants = _grants([max(0, q - load.get(k, 0)) for k, q in enumerate(quota)], asked)
        grant = F.element_at(F.array(*[F.struct(F.lit(p).alias("power"), F.lit(float(x)).alias("share"), F.lit(g).cast("string").alias("gid")) for p, x, g in grants]), F.col("to") + 1)
        goes = (F.col("shard") != F.col("to")) & ((F.col("power") < grant["power"]) | ((F.col("power") == grant["power"]) & ((_unit(F.col("gid"), F.lit(turn)) < grant["share"]) | F.col("gid").eqNullSafe(grant["gid"]))))
        moved = scratch.keep(wants.select("gid", "home", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), "n", "all", goes.alias("moved")))
        scratch.drop(wants)
        scratch.drop(cells)
        cells = scratch.same(moved.drop("moved"), moved)
        if moved.where("moved").isEmpty():
            return cells
        turn += 1


def _places(rows: DataFrame, by: list[str], order: list[Column], parts: int, scratch: Scratch, name: str) -> DataFrame:
    """rows with a gapless number from 0 inside each value of ``by``. _part deals each value over tasks, lower first."""
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_part", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return rows.withColumn("_in", inside).join(offsets, [*by, "_part"]).withColumn(name, (F.col("_in") + F.col("_offset")).cast("long")).drop("_in", "_offset")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = scratch.keep(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.sha2(text.cast("binary"), 256)).alias("gid"),
        F.pmod(F.xxhash64("doc_id", F.lit("home")), F.lit(shards)).cast("int").alias("home"),
    ))
    n = rows.count()
    quota = [n // shards + (k < n % shards) for k in range(shards)]
    spots = rows.where("gid is not null").groupBy("gid", "home").agg(F.count("*").alias("n"))
    linked = spots.groupBy("gid").agg(F.sum("n").alias("all")).where("all > 1")
    cells = scratch.keep(spots.join(linked, "gid").select("gid", "home", F.col("home").alias("shard"), "n", "all"))
    cells = propagate(cells, quota, scratch).select("gid", "home", "shard", "all")
    parts = max(1, n // shards // PART_ROWS)
    # Linked documents come first in a shard; part 0 to parts - 1 hold them, by text (a frequent one in several), and the
    # rest hold the others.
    first = F.col("shard").isNotNull()
    several = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("all") / PART_ROWS)))
    dealt = rows.join(cells, ["gid", "home"], "left").select(
        "doc_id", "size", "text_crc32", "gid", F.coalesce("shard", "home").alias("shard"),
        F.when(first, F.pmod(F.xxhash64("gid", several), F.lit(parts))).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)) + parts).alias("_part"),
    )
    order = [F.col("gid"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    placed = scratch.keep(_places(dealt, ["shard"], order, parts, scratch, "place"))
    quotas = F.array(*[F.lit(q) for q in quota])
    over = F.col("place") >= F.element_at(quotas, F.col("shard") + 1)
    load = dict(placed.groupBy("shard").agg(F.count("*")).collect())
    # Places beyond a quota are numbered through all shards; holes too, so that the i-th of these fills the i-th hole.
    beyond, holes, spill, gap = [], [], 0, 0
    for k in range(shards):
        beyond.append(spill)
        holes.append((gap, k, min(load.get(k, 0), quota[k])))
        spill += max(0, load.get(k, 0) - quota[k])
        gap += max(0, quota[k] - load.get(k, 0))
    nth = F.element_at(F.array(*[F.lit(x) for x in beyond]), F.col("shard") + 1) + F.col("place") - F.element_at(quotas, F.col("shard") + 1)
    hole = F.array_max(F.filter(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(k).alias("k"), F.lit(p).cast("long").alias("p")) for a, k, p in holes if quota[k] > load.get(k, 0)] or [F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("p"))]), lambda h: h["a"] <= F.col("nth")))
    out = placed.withColumn("nth", F.when(over, nth)).withColumn("hole", F.when(over, hole))
    return out.select("doc_id", "size", "text_crc32", F.coalesce(F.col("hole.k"), F.col("shard")).alias("shard"), F.coalesce(F.col("nth") - F.col("hole.a") + F.col("hole.p"), F.col("place")).alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """40 shards under the law "rows"."""
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
