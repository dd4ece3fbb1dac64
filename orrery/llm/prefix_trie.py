"""The prefix trie of conversations, from the Cartesian tree over the LCP array of the sorted conversations.

A conversation is a row: the digests (role and text) and code points of its turns. Equal ones are counted into one before
anything is sorted. The different ones are dealt to range partitions, the blocks, and sorted; LCP[i] is the number of
turns that i shares with the one before it. Node (i, d) is the prefix of d turns that i is the first to begin with, so i
brings the depths LCP[i] + 1 to its length: one node of the Cartesian tree for each different LCP value, equal values being
merged, and the depths between it and its parent's filled in. Its interval ends before the next LCP below d, its parent is
(i, d - 1), or at d = LCP[i] + 1 the node that begins at the nearest LCP to the left that is smaller than LCP[i].

All nearest smaller values are found in two levels. In each block a pass with a stack closes every interval that lies
inside it and sums up its members, leaves and tokens. What crosses an edge of blocks is one path of open nodes on either side:
a block's first conversation is taken to continue whatever came before. These paths, with the position of the last LCP
below each depth (the block's minima), reach the driver: rows by blocks times the length of the conversations at their edges, never
by conversations. There the paths are joined from block to block, partial sums of one node are added, and nodes inside
blocks learn of parents outside theirs by a join.

The digest of a node's ends is taken over ids in order of number: ids are sorted in range partitions, joined there to texts of
IDS ids, and these are streamed through the hash by one task for each group of equal conversations, which holds one text.

Cases: rows with a null conv_id take no part; a null role or text is empty; turns that tie are ordered by role and text (null
as empty); a conversation may come out without turns, and ends at the root; no conversations give no nodes; other columns are
ignored. A conversation's turns are gathered in its row (40 bytes a turn), as a document's text would be.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._store import Scratch

IDS = 4096
HEADS, GROUP = 6, 100
NODE = "block int, first int, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, parent_conv_id long, up int"
#: What crosses edges: open: -1 continues, else begins at ``first``; chars: code points of the node's last text; below: ``first`` of its ancestors by depth.
EDGE = NODE + ", chars long, below array<int>, head array<binary>, tail array<binary>"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each with digest and code points."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    own = rows.withColumn("k", place).select("conv_id", F.struct("k", digest.alias("digest"), F.length("text").cast("int").alias("chars")).alias("t"))
    return own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(rows: DataFrame, heads: int = HEADS, group: int = GROUP) -> DataFrame:
    """Each conversation after the first turns of its group's first one; how many, the id tells."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = rows.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads).alias("_head"))
    joined = rows.withColumn("_h", h.cast("int")).join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("_base"), "left")
    none = F.array().cast(rows.schema["turns"].dataType)
    head = F.when(F.col("_head").isNull(), none).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


class _Open:
    """A node whose interval is not closed yet. first: -1 if it may have begun in an earlier block."""

    __slots__ = ("first", "depth", "chars", "conv", "n", "children", "leaves", "saved", "ends", "inner", "below")

    def __init__(self, first: int, depth: int, chars: int):
        self.first, self.depth, self.chars = first, depth, chars
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None
        self.inner, self.below = [], None


def shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def block_nodes(block: int, rows):
    """Nodes and open paths of one block. rows: (digests, chars, conv_id, n, class) in order of digests."""
    stack: list[_Open] = []
    head = before = None
    at = 0

    def close(crosses: bool):
        own = stack.pop()
        up = stack[-1] if stack else None
        if up is not None:
            up.n += own.n
            if up.conv is None or own.conv < up.conv:
                up.conv = own.conv
        known = not crosses and own.first >= 0
        told = (own.conv, None) if known else (None, own.depth if own.first < 0 else -1 - own.depth)
        for child in own.inner:  # their parent's conv_id is known now, or its place at the block's begin or end
            yield child + told + (None,) * 4
        if not known:
            yield (block, own.first, own.depth, own.conv, own.n, own.children, own.leaves, own.saved, own.ends, None, None, own.chars, own.below, None, None)
        else:
            leaves, saved = own.leaves or 1, own.saved + (own.n - 1) * own.chars
            up.leaves += leaves
            up.saved += saved
            up.children += 1
            up.inner.append((block, own.first, own.depth, own.conv, own.n, own.children, leaves, saved, own.ends))

    for digests, chars, conv, n, kind in rows:
        if before is None:
            head = digests
            stack = [_Open(-1, d, chars[d - 1] if d else 0) for d in range(len(digests) + 1)]
        else:
            common = shared(before, digests)
            while len(stack) > common + 1:
                yield from close(False)
            stack.extend(_Open(at, d, chars[d - 1]) for d in range(common + 1, len(digests) + 1))
        top = stack[-1]
        top.n, top.ends = top.n + n, kind
        top.conv = conv if top.conv is None else min(conv, top.conv)
        before, at = digests, at + 1
    if before is not None:
        path = [own.first for own in stack]
        for own in stack:
            own.below = path[: own.depth]
        yield (block, None, None, None, None, None, None, None, None, None, None, None, path, head, before)
        while stack:
            yield from close(True)


def _blocks(batches):
    block = TaskContext.get().partitionId()

    def rows():
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("digests", "chars", "conv_id", "n", "class")))

    names = [f.split()[0] for f in EDGE.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
    held = []
    for row in block_nodes(block, rows()):
        held.append(row)
        if len(held) == 8192:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)


def join_paths(edges: list) -> tuple[list, list]:
    """Whole nodes that cross edges of blocks, as NODE rows, and (block, up, conv_id) of what inner nodes call their parent:
    a depth of the path that the block continues, or -1 - depth of the one that it leaves open. edges: EDGE rows."""
    summaries = sorted((e for e in edges if e.head is not None), key=lambda e: e.block)
    begins: dict[tuple[int, int], tuple[int, int]] = {}  # where the node begins that a block's first conversation is in, by depth
    path: list[tuple[int, int]] = []  # the open nodes' places, by depth
    tail = None
    for s in summaries:
        low = -1 if tail is None else shared(tail, s.head)
        for d in range(len(s.head) + 1):
            begins[s.block, d] = path[d] if d <= low else (s.block, 0)
        path = [begins[s.block, d] if first < 0 else (s.block, first) for d, first in enumerate(s.below)]
        tail = s.tail
    nodes: dict[tuple[int, int, int], dict] = {}
    for e in edges:
        if e.head is not None:
            continue
        key = (*(begins[e.block, e.depth] if e.first < 0 else (e.block, e.first)), e.depth)
        own = nodes.setdefault(key, {"conv": e.conv_id, "n": 0, "children": 0, "leaves": 0, "saved": 0, "ends": None, "chars": e.chars})
        own["conv"] = min(own["conv"], e.conv_id)
        own["n"] += e.n_convs
        own["children"] += e.n_children
        own["leaves"] += e.n_leaves
        own["saved"] += e.saved_tokens
        own["ends"] = own["ends"] if e.ends is None else bytes(e.ends)
        if e.first >= 0 or key[:2] == (e.block, 0):  # where it begins, its parent's place is known
            up = None if not e.depth else e.below[e.depth - 1] if e.first >= 0 else -1
            own["up"] = None if up is None else (*(begins[e.block, e.depth - 1] if up < 0 else (e.block, up)), e.depth - 1)
    for key in sorted(nodes, key=lambda k: -k[2]):  # from the deepest, so that a parent has all of its children's
        own = nodes[key]
        own["leaves"] = own["leaves"] if own["children"] else 1
        own["saved"] += (own["n"] - 1) * own["chars"]
        if own["up"] is not None:
            up = nodes[own["up"]]
            up["children"] += 1
            up["leaves"] += own["leaves"]
            up["saved"] += own["saved"]
    out = [(b, i, d, o["conv"], o["n"], o["children"], o["leaves"], o["saved"], o["ends"], None if o["up"] is None else nodes[o["up"]]["conv"], None) for (b, i, d), o in nodes.items()]
    left = [(s.block, -1 - d, nodes[s.block, first, d]["conv"]) for s in summaries for d, first in enumerate(s.below) if first >= 0]
    return out, [(b, d, nodes[(*at, d)]["conv"]) for (b, d), at in begins.items()] + left


def ends(members: DataFrame) -> DataFrame:
    """_class and ends_sha256 of members (class, conv_id)."""

    def texts(batches):
        own, first, ids = None, None, []

        def row():
            return pa.record_batch([pa.array([own], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["class", "first", "ids"])

        for batch in batches:
            for kind, conv in zip(batch["class"].to_pylist(), batch["conv_id"].to_pylist()):
                if ids and (kind != own or len(ids) == IDS):
                    yield row()
                    ids = []
                if not ids:
                    own, first = kind, conv
                ids.append(conv)
        if ids:
            yield row()

    def digest(batches):
        own, state, done = None, None, []
        for batch in batches:
            for kind, ids in zip(batch["class"].to_pylist(), batch["ids"].to_pylist()):
                if kind == own:
                    state.update(b",")
                else:
                    if own is not None:
                        done.append((own, state.hexdigest()))
                    own, state = kind, hashlib.sha256()
                state.update(ids.encode())
            if len(done) > 8192:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], ["_class", "ends_sha256"])
                done = []
        if own is not None:
            done.append((own, state.hexdigest()))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], ["_class", "ends_sha256"])

    dealt = members.repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id").mapInArrow(texts, "class binary, first long, ids string")
    return dealt.repartition("class").sortWithinPartitions("class", "first").mapInArrow(digest, "_class binary, ends_sha256 string")


def trie(conversations: DataFrame, rebuild=rebuilt) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. rebuild: what makes each conversation's turns from the original ones."""
    scratch = Scratch(conversations.sparkSession)
    paths = rebuild(turns(conversations)).select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))
    kind = F.unhex(F.sha2(F.array_join(F.transform("digests", F.hex), ",").cast("binary"), 256))
    paths = scratch.keep(paths.withColumn("class", kind))
    different = paths.groupBy("class", "digests", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    found = scratch.keep(different.repartitionByRange("digests").sortWithinPartitions("digests").mapInArrow(_blocks, EDGE))
    crosses = F.col("chars").isNotNull() | F.col("head").isNotNull()
    whole, continued = join_paths(found.where(crosses).collect())  # two paths a block
    spark = conversations.sparkSession
    names = [f.split()[0] for f in NODE.split(", ")]
    up = spark.createDataFrame(continued, "_block int, _up int, _conv long")
    inside = found.where(~crosses).select(*names).join(up, (F.col("block") == F.col("_block")) & (F.col("up") == F.col("_up")), "left")
    inside = inside.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv")).select(*names)
    nodes = inside.unionByName(spark.createDataFrame(whole, NODE))
    joined = nodes.join(ends(paths.select("class", "conv_id")), F.col("ends") == F.col("_class"), "left")
    long: list[Column] = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return joined.select(*long, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Conversations rebuilt after the first turns of every hundredth."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
asked AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(conv_id::VARCHAR))),
    lambda k: ('0x' || substr(hex(encode(conv_id::VARCHAR)), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 6 AS h FROM own, crc),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM asked a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM built),
members AS (SELECT md5(turns[1:depth]::VARCHAR || depth) AS id, md5(turns[1:depth - 1]::VARCHAR || (depth - 1)) AS up, depth, conv_id, len(turns) AS n,
  CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].t) END AS chars FROM prefixes),
nodes AS (
  SELECT id, any_value(up) AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM members GROUP BY id, depth),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.up = n.id AND c.depth = n.depth + 1) AS n_children FROM nodes n LEFT JOIN nodes p ON p.id = n.up AND p.depth = n.depth - 1),
above AS (SELECT DISTINCT a.id AS top, a.depth AS top_depth, b.id, b.depth FROM members a JOIN members b USING (conv_id) WHERE b.depth >= a.depth),
sums AS (SELECT top, top_depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM above JOIN linked USING (id, depth) GROUP BY top, top_depth)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN sums ON top = id AND top_depth = depth
"""
