"""URL filters: rules by longest match, and a Bloom filter cascade for the hosts that no rule settles.

The list is a table of hosts, of any size. The universe of keys is every distinct host of the pages; it is joined with the
list once, to build. Level 0 of the cascade encodes the listed hosts of the universe; level 1 those unlisted hosts that
level 0 lets through by mistake; level 2 the listed hosts that level 1 lets through, and so on, until a level makes no
mistake. The first level that a host fails tells its side: for hosts of the universe, all there are, membership is exact,
and pages meet the cascade alone, not the list.

A cascade is built for each shard of keys, about SHARD_KEYS of the universe in one task, by hash of the key. Where all
levels take at most MOST_BYTES together they are broadcast; beyond that, pages are dealt to their key's shard, a frequent
shard over several tasks of about TASK_ROWS pages, each of which gets that shard's levels alone. Either way gives the
same verdicts. Keys stand as 128-bit hashes.

Cases: a null url, or one without "://", has empty host and path, no rule fits it, and it is allowed unless the empty
host is listed; rows that repeat, of pages or of the list, count once each page; null hosts of the list are left out; an
empty table gives no rows, an empty list lists nothing; other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm._flat import U64, mix
from orrery.llm._store import Scratch

SHARD_KEYS, MOST_BYTES, TASK_ROWS = 200_000, 32 << 20, 500_000

# Verdict, host and path of each rule; the parts of the hosts that the query lists.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
BEFORE, SITES, ZONES = ["", "blog.", "m.", "www."], ["adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"], ["example.com", "example.net", "example.org"]
LISTED = [f"{a}{b}.{c}" for a in BEFORE for b in SITES for c in ZONES]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        chain = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def _spots(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int):
    salt = mix(np.array([level + 1], U64))[0]
    one, two = mix(a.view(U64) ^ salt), mix(b.view(U64) + salt) | U64(1)
    for i in range(hashes):
        yield ((one + U64(i) * two) % U64(bits)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Levels (bits, hashes, packed bits) for keys with hashes a, b."""
    levels = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        ratio = max(2.0, len(outside) / len(inside)) if not levels else 2.0
        hashes = max(1, round(np.log2(ratio)))
        bits = max(8, int(np.ceil(1.45 * hashes * len(inside))))
        table = np.zeros(bits, bool)
        for spot in _spots(a[inside], b[inside], len(levels), bits, hashes):
            table[spot] = True
        levels.append((bits, hashes, np.packbits(table)))
        wrong = np.ones(len(outside), bool)
        for spot in _spots(a[outside], b[outside], len(levels) - 1, bits, hashes):
            wrong &= table[spot]
        inside, outside = outside[wrong], inside
    return levels


def contains(levels: list[tuple[int, int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed: it is, if the first level that it fails is odd, or if it passes an odd number of them."""
    passed = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for k, (bits, hashes, packed) in enumerate(levels):
        table = np.unpackbits(packed, count=bits).astype(bool)
        ok = np.ones(len(alive), bool)
        for spot in _spots(a[alive], b[alive], k, bits, hashes):
            ok &= table[spot]
        alive = alive[ok]
        passed[alive] = k + 1
    return passed % 2 == 1


def build_cascades(keys: DataFrame, scratch: Scratch, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """Levels (shard, level, bits, hashes, packed) over ``keys`` (distinct key, listed), and the number of shards."""
    hashed = scratch.keep(keys.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit("b"), "key").alias("b"), "listed"))
    shards = max(1, -(-hashed.count() // shard_keys))

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        levels = build(table["a"].to_numpy(), table["b"].to_numpy(), table["listed"].to_numpy(zero_copy_only=False))
        cols = ([key[0].as_py()] * len(levels), range(len(levels)), [x[0] for x in levels], [x[1] for x in levels], [x[2].tobytes() for x in levels])
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["shard", "level", "bits", "hashes", "packed"])

    sharded = hashed.withColumn("_shard", F.pmod("a", F.lit(shards)).cast("int"))
    return scratch.keep(sharded.groupBy("_shard").applyInArrow(one, "shard int, level int, bits long, hashes int, packed binary")), shards


def _contains(levels: list, shards: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed. levels: rows of shard, level, bits, hashes, packed, in that order."""
    own, out = a % shards, np.zeros(len(a), bool)
    by: dict[int, list] = {}
    for r in levels:
        by.setdefault(r["shard"], []).append((r["bits"], r["hashes"], np.frombuffer(r["packed"], np.uint8)))
    for shard in np.unique(own).tolist():
        if shard in by:
            at = np.flatnonzero(own == shard)
            out[at] = contains(by[shard], a[at], b[at])
    return out


def with_listed(rows: DataFrame, cascades: DataFrame, shards: int, most_bytes: int = MOST_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows (with hashes a, b of their keys) with ``listed`` in place of the hashes."""
    size = cascades.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    if size <= most_bytes:
        shared = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in cascades.orderBy("shard", "level").collect()])

        @F.pandas_udf("boolean")
        def member(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(_contains(shared.value, shards, a.to_numpy(np.int64), b.to_numpy(np.int64)))

        return rows.withColumn("listed", member("a", "b")).drop("a", "b")
    dealt = rows.withColumn("_shard", F.pmod("a", F.lit(shards)).cast("int"))
    salts = dealt.groupBy("_shard").agg(F.ceil(F.count("*") / task_rows).cast("int").alias("_m"))
    dealt = dealt.join(salts, "_shard").withColumn("_salt", F.pmod(F.xxhash64("page_id", "a"), F.col("_m")).cast("int")).drop("_m")
    levels = cascades.join(salts.toDF("_of", "_m"), F.col("shard") == F.col("_of")).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m")
    schema = rows.withColumn("listed", F.lit(False)).drop("a", "b").schema

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        listed = _contains(sorted(right.to_pylist(), key=lambda r: r["level"]), shards, left["a"].to_numpy(), left["b"].to_numpy()) if len(left) else np.zeros(0, bool)
        return left.select([f.name for f in schema.fields[:-1]]).append_column("listed", pa.array(listed))

    return dealt.groupBy("_shard", "_salt").cogroup(levels.groupBy("_of", "_copy")).applyInArrow(check, schema)


def judge(pages: DataFrame, hosts: DataFrame, most_bytes: int = MOST_BYTES, shard_keys: int = SHARD_KEYS, task_rows: int = TASK_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every page. hosts: host of each listed one."""
    host, path = parts(F.col("url").cast("string"))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scratch = Scratch(pages.sparkSession)
    listed = hosts.select(F.col("host").alias("_host")).where("_host is not null").distinct().withColumn("_in", F.lit(True))
    keys = plain.select(F.col("host").alias("key")).distinct().join(listed, F.col("key") == F.col("_host"), "left")
    cascades, shards = build_cascades(keys.select("key", F.coalesce("_in", F.lit(False)).alias("listed")), scratch, shard_keys)
    hashed = plain.withColumn("a", F.xxhash64("host")).withColumn("b", F.xxhash64(F.lit("b"), "host"))
    told = with_listed(hashed, cascades, shards, most_bytes, task_rows).withColumn("_r", by_rule(F.col("host"), F.col("path")))
    return told.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page, by the rules, else by the cascade over listed hosts."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame([(h,) for h in LISTED], "host string"))


OP5_SQL = "WITH list(listed_host) AS (VALUES " + ", ".join(f"('{h}')" for h in LISTED) + r"""),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed_host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed_host IS NOT NULL AS listed
FROM ruled LEFT JOIN list ON host = listed_host
"""
